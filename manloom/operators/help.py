"""Contextual help: recorded answers to ``?`` as rows of options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import spread as dealt

LINE_BREAK = r"[\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_BLANKS = " \t\n\x0b\x0c\r"
#: What a line of an answer may be.
_ERROR = r"(?i)^(?:%|\^|error\b|invalid\b|unrecognized\b|unknown\b|ambiguous\b|incomplete\b|syntax\s+error\b|bad\s+command\b|command\s+not\s+found\b)"
_HEADER = r"(?i)^(?:possible\s+completions|available\s+(?:commands|options)|commands|options)\s*:\s*$"
_PAGER = r"(?i)--+\s*more\s*--+|press\s+(?:any\s+key|space)|\(\s*q\s*\)\s*uit"
_NOISE = rf"^(?:\??$|[%^])|{_HEADER}|{_PAGER}"
_OPTION = r"^\s+(\S+)(?:\s{2,}|\t+)(\S.*?)\s*$"
_ENTER = r"(?i)^\s+(<cr>|<return>|<enter>|<\[enter\]>|\[enter\])\s*$"
_LONE = r"^\s+([A-Za-z0-9<][\w.:/<>\[\]{}|-]*)\s*$"


def lines_of(rows: DataFrame, column: Column, *keep: str) -> DataFrame:
    """``(keep..., pos, line)``: the lines of a text, from 0."""
    return rows.select(*keep, F.posexplode(F.split(column, LINE_BREAK)).alias("pos", "line"))


def parse_help(responses: DataFrame, *, undescribed: bool = False, error_words: bool = False, spread: bool = True) -> DataFrame:
    """``(prefix, output)`` -> ``(prefix, pos, token, kind, description)``.

    An option is an indented token, then two spaces or a tab and its description; an enter mark
    may stand alone, and so may any token if ``undescribed``.  Headers, pager lines, prompts, the
    echo of the query and error lines are no options; with ``error_words`` an indented line that
    begins like an error is one.  Of a repeated token the first line counts.

    Answers are dealt by prefix before they are cut into lines, which is the dealing that first lines
    and later sums by prefix need; without ``spread`` they are taken to lie so already.
    """
    if spread:
        responses = dealt(responses.select("prefix", "output"), "prefix")
    answers = responses.select("prefix", F.posexplode(F.split(T.terminal_cleaned(F.col("output")), LINE_BREAK)).alias("pos", "line"), T.one_spaced(F.col("prefix")).alias("query"))
    # only indented lines can be options; as rows, each is looked at in generated code
    told = answers.where(F.substring("line", 1, 1).isin(*_BLANKS)).withColumn("bare", F.btrim("line", F.lit(_BLANKS)))
    bare, query = F.col("bare"), F.col("query")
    asked = F.rtrim(bare, F.lit("?" + _BLANKS))
    lead = F.rtrim(F.left(asked, F.length(asked) - F.length(query)))
    echoed = (query != "") & F.contains(bare, query) & ((asked == query) | (F.endswith(asked, query) & lead.rlike(r"[#>$]$")))
    noise = bare.rlike(_NOISE if error_words else f"{_NOISE}|{_ERROR}") | F.coalesce(echoed, F.lit(False))
    alone = F.regexp_extract("line", _ENTER, 1)
    if undescribed:
        alone = F.coalesce(F.when(alone != "", alone), F.regexp_extract("line", _LONE, 1))
    told = told.where(~noise).withColumn("described", F.regexp_extract("line", _OPTION, 1))
    token = F.when(F.col("described") != "", F.col("described")).otherwise(alone)
    options = told.select("prefix", "pos", token.alias("token"), F.when(F.col("described") != "", F.regexp_extract("line", _OPTION, 2)).otherwise("").alias("description")).where("token <> ''")
    first = options.withColumn("_n", F.row_number().over(Window.partitionBy("prefix", "token").orderBy("pos"))).where("_n = 1")
    return first.select("prefix", "pos", "token", T.option_kind(F.col("token")).alias("kind"), "description")


def signatures(options: DataFrame) -> DataFrame:
    """``(prefix, signature, expandable)``: the set of tokens and kinds of each node, descriptions
    apart, and whether anything but an enter mark stands in it."""
    shape = F.array_sort(F.collect_set(F.concat_ws("\t", "token", "kind")))
    return options.groupBy("prefix").agg(F.sha2(F.array_join(shape, "\n"), 256).alias("signature"), F.bool_or(F.col("kind") != "cr").alias("expandable"))
