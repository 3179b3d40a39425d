"""Running configurations: view hierarchy, probe harvest, matching against the catalog, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .help import LINE_BREAK

#: Prompts, ends of a dump, what opens free text and may close it, and how far down
#: an echo of the command may stand.
_PROMPT = r"^\S*[>#$]\s*$"
_END = r"(?i)^(?:return|end|exit|quit)\s*$"
_BANNER = r"""(?is)^(?:banner|header)\b.*?(["'^%~])(.*)$"""
_DELIMITERS = ('"', "'", "^", "%", "~")
_ECHO_LINES = 5
UNTERMINATED = "<unterminated free text>"


def _body(dumps: DataFrame) -> DataFrame:
    """``(device, command, dump, at, number, line, bare)``: the lines of each dump without the echo
    and prompts before them and the blanks, ends and prompts after them."""
    told = dumps.select("device", F.trim(F.coalesce("source_command", F.lit(""))).alias("command"), T.terminal_cleaned(F.col("output")).alias("output")).distinct()
    key = F.sha2(F.to_json(F.struct("device", "command", "output")), 256)
    lines = told.select("device", "command", key.alias("dump"), F.posexplode(F.split("output", LINE_BREAK)).alias("at", "raw"))
    lines = lines.withColumn("line", F.regexp_replace("raw", r"(?U)\s+$", "")).withColumn("bare", F.regexp_replace("line", r"(?U)^\s+", "")).drop("raw")
    blank, prompt = F.col("bare") == "", F.col("bare").rlike(_PROMPT)
    echo = (F.col("command") != "") & F.endswith(F.col("bare"), F.col("command"))
    whole = Window.partitionBy("dump")
    edged = lines.withColumn("first", F.min(F.when(~(blank | prompt | echo) | (F.col("at") >= _ECHO_LINES), F.col("at"))).over(whole))
    edged = edged.withColumn("last", F.max(F.when(~(blank | prompt | F.col("bare").rlike(_END)), F.col("at"))).over(whole))
    return edged.where("at BETWEEN first AND last").withColumn("number", F.col("at") - F.col("first") + 1).drop("first", "last")


def _free_texts(lines: DataFrame) -> DataFrame:
    """``(device, command, dump, at, number, until)``: lines that open free text, and the line with
    their delimiter again (null: none comes).  What opens within another's text doesn't."""
    below = Window.partitionBy("dump").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    mark = F.regexp_extract("bare", _BANNER, 1)
    closing = F.coalesce(*[F.when(F.col("mark") == d, F.last(F.when(F.col("line").contains(d), F.col("at")), ignorenulls=True).over(below)) for d in _DELIMITERS])
    told = lines.withColumn("mark", mark).withColumn("until", closing)
    opens = told.where((F.col("mark") != "") & ~F.contains(F.regexp_extract("bare", _BANNER, 2), F.col("mark")))
    found = opens.groupBy("device", "command", "dump").agg(F.array_sort(F.collect_list(F.struct("at", "number", "until"))).alias("found"))

    def step(state: Column, x: Column) -> Column:
        later = x["at"] > state["until"]
        return F.struct(F.when(later, F.coalesce(x["until"], F.lit(2**31 - 1))).otherwise(state["until"]).alias("until"), F.when(later, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    start = F.struct(F.lit(-1).alias("until"), F.slice("found", 1, 0).alias("kept"))
    return found.select("device", "command", "dump", F.explode(F.aggregate("found", start, step)["kept"]).alias("x")).select("device", "command", "dump", "x.*")


def config_lines(dumps: DataFrame) -> DataFrame:
    """``(device, source_command, output)`` -> ``(device, seq, number, indent, text, path, verbatim)``.

    Indent makes the views and a separator line closes them all.  Free text after a banner's
    delimiter is one opaque line, up to the line with the delimiter again; if none comes, a mark
    line says so.  A dump given twice counts once.  All is windows over the lines of a dump: views
    are looked up level by level, as the last line above that is indented no deeper than the level.
    """
    lines = _body(dumps)
    free = _free_texts(lines)
    opened = free.select("dump", "at", F.lit(True).alias("verbatim"), F.coalesce("until", F.lit(2**31 - 1)).alias("until"))
    above = Window.partitionBy("dump").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    told = lines.join(opened, ["dump", "at"], "left").withColumn("verbatim", F.coalesce("verbatim", F.lit(False)))
    told = told.withColumn("inside", F.coalesce(F.col("at") <= F.last("until", ignorenulls=True).over(above), F.lit(False))).where("NOT inside")
    separator = F.col("bare").rlike("^[#!]+$")
    remark = ~separator & (F.col("bare").rlike("^(?:!|;|//)") | F.col("bare").rlike(_END))
    told = told.where((F.col("bare") != "") & ~remark).withColumn("separator", separator)
    up_to = Window.partitionBy("dump").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    told = told.withColumn("segment", F.sum(F.col("separator").cast("int")).over(up_to)).where("NOT separator")
    told = told.withColumn("indent", F.length("line") - F.length("bare")).withColumn("level", F.dense_rank().over(Window.partitionBy("dump").orderBy("indent")))
    told = told.withColumn("deepest", F.max("level").over(Window.partitionBy("dump")))
    each = told.withColumn("at_level", F.explode(F.sequence(F.lit(1), F.col("deepest"))))
    over = Window.partitionBy("dump", "segment", "at_level").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    view = F.last(F.when((F.col("level") <= F.col("at_level")) & ~F.col("verbatim"), F.struct("level", "bare")), ignorenulls=True).over(over)
    each = each.withColumn("view", view)
    holds = (F.col("at_level") < F.col("level")) & (F.col("view.level") == F.col("at_level"))
    views = F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("at_level", F.col("view.bare").alias("bare"))))), lambda v: v["bare"])
    rows = each.groupBy("device", "command", "dump", "at", "number", "indent", "bare", "verbatim").agg(views.alias("views"))
    rows = rows.select("device", "command", "dump", "at", "number", "indent", F.col("bare").alias("text"), F.concat("views", F.array("bare")).alias("path"), "verbatim")
    open_ended = free.where("until IS NULL").select(
        "device", "command", "dump", F.lit(2**31 - 1).alias("at"), "number", F.lit(0).alias("indent"), F.lit(UNTERMINATED).alias("text"), F.array(F.lit(UNTERMINATED)).alias("path"), F.lit(True).alias("verbatim")
    )
    seq = F.row_number().over(Window.partitionBy("device").orderBy("command", "dump", "at")) - 1
    return rows.unionByName(open_ended).select("device", seq.alias("seq"), "number", "indent", "text", "path", "verbatim")


def harvest(lines: DataFrame, most: int = 2) -> DataFrame:
    """``(device, head, entries)``: top-level lines to try, at most ``most`` of each shape."""
    top = lines.where("size(path) = 1 AND NOT verbatim AND text <> ''").withColumn("shape", T.folded(F.col("text")))
    few = top.withColumn("_n", F.row_number().over(Window.partitionBy("device", "shape").orderBy("seq"))).where(F.col("_n") <= most)
    entries = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return few.groupBy("device", T.head_word(F.col("text")).alias("head")).agg(entries.alias("entries"))


def view_prefixes(contexts: DataFrame) -> DataFrame:
    """Distinct entry paths as words with the empty one: ``(place, tokens)``.  ``place`` orders them,
    shortest first, and is no number, so that none has to be counted."""
    spine = contexts.sparkSession.createDataFrame([([],)], "tokens array<string>")
    paths = contexts.select(T.words(F.array_join("entry_path", " ")).alias("tokens")).union(spine).distinct()
    return paths.select(F.struct(F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("text")).alias("place"), "tokens")


def _patterns(commands: DataFrame) -> DataFrame:
    """``(pattern, command, place)``: words in lower case, null for a placeholder.  Of commands that
    spell the same pattern the last by place stands, at the place of the first."""
    pattern = F.transform(T.words(F.col("command")), lambda t: F.when(T.option_kind(t) == "parameter", F.lit(None).cast("string")).otherwise(F.lower(t)))
    return commands.select("command", "place", pattern.alias("pattern")).groupBy("pattern").agg(F.max_by("command", F.struct("place", "command")).alias("command"), F.min("place").alias("place"))


def _spellings(first: Column) -> Column:
    """What a pattern's first word may be met as."""
    return F.when(first.isNull(), F.array(F.lit("*"))).otherwise(F.array(F.concat(F.lit("="), first), F.concat(F.lit("~"), T.folded(first))))


def _ways(word: Column) -> Column:
    """What a word may meet."""
    return F.array(F.lit("*"), F.concat(F.lit("="), word), F.concat(F.lit("~"), T.folded(word)))


def _ranks(low: Column | str, pattern: Column | str) -> Column:
    """How each word meets its pattern: 0 equal, 1 placeholder, 2 equal once digits are folded, null not."""
    return F.zip_with(low, pattern, lambda t, p: F.when(p == t, 0).when(p.isNull(), 1).when((T.folded(t) != t) & (T.folded(p) == T.folded(t)), 2))


def _lowered(tokens: str) -> Column:
    return F.transform(tokens, lambda t: F.lower(t))


def match_commands(asked: DataFrame, commands: DataFrame) -> DataFrame:
    """``asked(key, tokens)`` against ``commands(command, place)`` -> ``(key, command)`` for matches.

    A command's placeholders match any word.  Word by word from the left an equal word is
    preferred over a placeholder, and that over a word that is equal once digits are folded.  Of
    commands that spell the same pattern the last by ``place`` stands.  Words and patterns meet on
    their number and on the first word's possible spellings, never all with all.
    """
    spelled = _patterns(commands).where("size(pattern) > 0").select("pattern", "command", "place", F.size("pattern").alias("n"), F.explode(_spellings(F.col("pattern")[0])).alias("via"))
    met = asked.where("size(tokens) > 0").select("key", _lowered("tokens").alias("low")).select("key", "low", F.size("low").alias("n"), F.explode(_ways(F.col("low")[0])).alias("via")).join(spelled, ["n", "via"])
    ranked = met.withColumn("rank", _ranks("low", "pattern")).where(~F.exists("rank", lambda r: r.isNull()))
    return ranked.groupBy("key").agg(F.min_by("command", F.struct("rank", "place")).alias("command"))


def _below_views(commands: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(view, lead_rank, tail, command, place)``: what is left of each command under each entry path
    that it begins with.  Paths and commands meet on the first word's spellings, and only pairs that
    fit go on."""
    spelled = _patterns(commands).where("size(pattern) > 0")
    paths = prefixes.select(F.col("place").alias("view"), _lowered("tokens").alias("lead"))
    keyed = spelled.select("*", F.explode(_spellings(F.col("pattern")[0])).alias("via"))
    met = paths.where("size(lead) > 0").select("*", F.explode(_ways(F.col("lead")[0])).alias("via")).join(keyed, "via").where("size(pattern) > size(lead)")
    met = met.withColumn("lead_rank", _ranks("lead", F.slice("pattern", F.lit(1), F.size("lead")))).where(~F.exists("lead_rank", lambda r: r.isNull()))
    under = met.select("view", "lead_rank", F.expr("slice(pattern, size(lead) + 1, size(pattern))").alias("tail"), "command", "place").distinct()
    bare = paths.where("size(lead) = 0").select("view").limit(1)  # the empty path is one row
    at_top = spelled.join(F.broadcast(bare)).select("view", F.array().cast("array<int>").alias("lead_rank"), F.col("pattern").alias("tail"), "command", "place")
    return under.unionByName(at_top)


def correlate(lines: DataFrame, commands: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Adds ``status`` and ``command`` to config lines.

    A line is ``matched`` if its whole view path is a command under some entry path, shortest
    first; ``matched_elsewhere`` if only its own words are; else ``unmatched``; free text is
    neither.  ``prefixes(place, tokens)`` are the entry paths of one device's scan.  Entry paths are
    taken off the commands once, and lines meet what is left on their number of words and the
    first word, so lines aren't multiplied by entry paths.
    """
    keyed = lines.withColumn("line", F.struct("device", "seq"))
    ways = F.array(F.struct(F.lit(0).alias("mode"), T.words(F.array_join("path", " ")).alias("own")), F.struct(F.lit(1).alias("mode"), T.words(F.col("text")).alias("own")))
    tried = keyed.where("NOT verbatim").select("line", F.explode(ways).alias("t")).select("line", "t.mode", _lowered("t.own").alias("low")).where("size(low) > 0")
    asked = tried.select("line", "mode", "low", F.size("low").alias("n"), F.explode(_ways(F.col("low")[0])).alias("via"))
    tails = _below_views(commands, prefixes).select("*", F.size("tail").alias("n"), F.explode(_spellings(F.col("tail")[0])).alias("via"))
    met = asked.join(tails, ["n", "via"]).withColumn("rank", _ranks("low", "tail")).where(~F.exists("rank", lambda r: r.isNull()))
    best = F.min_by(F.struct("mode", "command"), F.struct("mode", "view", F.concat("lead_rank", "rank"), "place"))
    found = met.groupBy("line").agg(best.alias("best"))
    status = F.when(F.col("verbatim"), "free-text").when(F.col("best.mode") == 0, "matched").when(F.col("best.mode") == 1, "matched_elsewhere").otherwise("unmatched")
    return keyed.join(found, "line", "left").withColumn("status", status).withColumn("command", F.col("best.command")).drop("line", "best")


def coverage(matched: DataFrame) -> DataFrame:
    """Per device: counts by status and the share of lines the catalog explains, 4 digits, ties to
    even; 1 where nothing was checked."""
    n = lambda s: F.count_if(F.col("status") == s)
    checked = F.count_if(F.col("status") != "free-text")
    known = n("matched") + n("matched_elsewhere")
    return matched.groupBy("device").agg(
        F.count("*").alias("lines"), n("matched").alias("matched"), n("matched_elsewhere").alias("matched_elsewhere"), n("unmatched").alias("unmatched"), n("free-text").alias("free_text"),
        F.when(checked > 0, F.bround(known / checked, 4)).otherwise(1.0).alias("coverage"),
    )


def gaps(matched: DataFrame) -> DataFrame:
    """``(device, command, occurrences)``: unmatched lines with their views, values and secrets folded
    in both, most frequent first."""
    views = F.array_join(F.transform("path", lambda v: T.skeleton(T.secrets_blanked(v))), " ")
    return matched.where("status = 'unmatched'").groupBy("device", F.trim(views).alias("command")).agg(F.count("*").alias("occurrences")).orderBy("device", F.desc("occurrences"), "command")


def redacted(lines: DataFrame) -> DataFrame:
    """Lines with secrets blanked in text and views."""
    return lines.withColumn("text", T.secrets_blanked(F.col("text"))).withColumn("path", F.transform("path", lambda v: T.secrets_blanked(v)))
