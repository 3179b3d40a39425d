"""Keyword or value: what each word of a card's syntax is, and on what evidence.

A line is cut into words, marks and blanks, and a running fold gives each its depth in brackets.  The
card's parameter table comes as a map, the words a manual explains parameters with as columns of
its profile; so a line needs one join, and everything else is said about it in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import spread
from .tables import TOKEN, tokens_in, without_own_name

_KEYS = ["doc", "card"]
_NOTHING = "(?!)"
_SPANS = "array<struct<start:int,end:int,low:string,high:string>>"
#: Fixed value: how many notations of ranges have an expression of their own; with more, all are folded.
_IN_PLACE = 8


@dataclass(frozen=True)
class Lexicon:
    """Patterns of one manual: what states a domain, an address, an effect; and its notations of
    numeric ranges, two groups each, in the order in which they take characters."""

    domain: str = _NOTHING
    address: str = _NOTHING
    effect: str = _NOTHING
    ranges: tuple[str, ...] = field(default=())


def _named(value: Column, body) -> Column:
    """``body`` of a value that is computed once.  Not ``[0]``: that derives the body's type anew for every row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _spans(text: Column, pattern: Column) -> Column:
    """``[(start, end, low, high)]`` of a notation's matches: matches are set between marks, and the
    lengths of what stands between add up to their places."""

    def step(s: Column, piece: Column) -> Column:
        def added(k: Column) -> Column:
            end = s["at"] + F.length(k["whole"][0])
            bound = lambda part: F.regexp_replace(part, r"(?U)\s", "")
            return F.struct((end + F.length(k["whole"][1])).alias("at"), F.array_append(s["found"], F.struct(s["at"].alias("start"), end.alias("end"), bound(k["bounds"][0]).alias("low"), bound(k["bounds"][1]).alias("high"))).alias("found"))

        return _named(F.split(piece, "\x02"), lambda parts: _named(F.struct(parts.alias("bounds"), F.split(parts[2], "\x03").alias("whole")), added))

    def placed(pieces: Column) -> Column:
        start = F.struct(F.length(pieces[0]).alias("at"), F.array().cast(_SPANS).alias("found"))
        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), start, step)["found"]

    marked = F.regexp_replace(text, pattern, F.lit("\x01$1\x02$2\x02$0\x03"))
    return _named(marked, lambda m: F.when(~m.contains("\x01"), F.array().cast(_SPANS)).otherwise(_named(F.split(m, "\x01"), placed)))


def _of_one_notation(text: Column, pattern: Column) -> Column:
    """``range_in`` of a text that states ranges in this notation only."""
    bare = lambda bound: F.regexp_replace(bound, r"(?U)\s", "")
    pairs = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.regexp_extract_all(text, pattern, 2), lambda low, high: F.concat(bare(low), F.lit("-"), bare(high)))
    between = F.slice(F.split(text, pattern), F.lit(2), F.size(F.split(text, pattern)) - 2)
    joined = F.exists(between, lambda t: t.contains("/") & ~t.rlike(r"\p{L}"))
    return _named(F.array_distinct(pairs), lambda each: F.when((F.size(each) == 1) & ~joined, each[0]))


def _of_any_notation(text: Column, ranges: Column) -> Column:
    def in_clean(clean: Column) -> Column:
        def taken(found: Column, pattern: Column) -> Column:
            return F.flatten(F.array(found, F.filter(_spans(clean, pattern), lambda s: ~F.exists(found, lambda f: (s["start"] < f["end"]) & (f["start"] < s["end"])))))

        def stated(found: Column) -> Column:
            between = F.zip_with(F.slice(found, 1, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(found, 2, F.size(found)), lambda a, b: F.substring(clean, a["end"] + 1, b["start"] - a["end"]))
            joined = F.exists(between, lambda t: t.contains("/") & ~t.rlike(r"\p{L}"))
            pairs = F.array_distinct(F.transform(found, lambda f: F.concat(f["low"], F.lit("-"), f["high"])))
            return F.when((F.size(pairs) == 1) & ~joined, pairs[0])

        return _named(F.array_sort(F.aggregate(ranges, F.array().cast(_SPANS), taken)), stated)

    return _named(F.translate(text, "\x01\x02\x03", "   "), in_clean)


def range_in(text: Column, ranges: Column) -> Column:
    """``lo-hi`` where a text states one numeric range in any of the notations, however often; null
    where it states none, several that differ, or a run of them joined by slashes.

    ``ranges`` are patterns; where two could read the same characters, the first takes them.  The
    first ``_IN_PLACE`` have an expression each, which compiles its pattern when that changes.  Places
    are compared only in a text with several notations, or where there are more patterns.
    """
    patterns = [F.get(ranges, F.lit(k)) for k in range(_IN_PLACE)]

    def by_counts(counts: Column) -> Column:
        one = reduce(lambda acc, k: acc.when(counts[k] > 0, _of_one_notation(text, patterns[k])), range(1, _IN_PLACE), F.when(counts[0] > 0, _of_one_notation(text, patterns[0])))
        several = (F.size(F.filter(counts, lambda n: n > 0)) > 1) | (F.size(ranges) > _IN_PLACE) | text.rlike("[\x01-\x03]")
        return F.when(several, _of_any_notation(text, ranges)).otherwise(one)

    return _named(F.array(*[F.coalesce(F.regexp_count(text, p), F.lit(0)) for p in patterns]), by_counts)


def says(text: Column, pattern: Column) -> Column:
    """Whether a text holds a pattern that may differ by row; compiled when it changes, as ``rlike``
    compiles such a pattern for every row."""
    return F.regexp_instr(text, pattern) > 0


def placeholder(name: Column, description: Column, address: Column, ranges: Column) -> Column:
    """``<lo-hi>`` where the description states one range and no address, else ``<name>``."""
    domain = F.when(~says(description, address), range_in(description, ranges))
    return F.concat(F.lit("<"), F.coalesce(domain, name), F.lit(">"))


def looked_up(name: Column, table: Column) -> Column:
    """A word's description in a table (a map): as it stands, before a slash, without a final mark,
    without its number, and without both; null if the table has none of these."""
    head = F.split(name, "/")[0]
    return F.coalesce(*[table[k] for k in (name, head, F.regexp_replace(name, "[.,;:]+$", ""), T.stem(name), T.stem(head))])


def lexemes(line: Column) -> Column:
    """``[(text, depth, left)]``: the words and marks of a line, with the number of brackets open around
    each, a bracket counting itself, and for words and bars where the depth last fell below theirs.

    A line is cut before its brackets, so depth and ``left`` are one for all that follows a bracket; the
    fold runs over these pieces and keeps the last place at each depth or below.
    """
    start = F.struct(F.lit(0).alias("depth"), F.array(F.lit(-1)).alias("last"), F.array().cast("array<struct<text:string,own:int,depth:int,left:int>>").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        at, first = F.size(s["out"]), F.left(piece, F.lit(1))
        opened, closed = first.isin("{", "["), first.isin("}", "]")
        own = s["depth"] + F.when(opened, 1).otherwise(0)

        def placed(k: Column) -> Column:
            below = lambda places, depth, place: F.array_append(F.slice(places, F.lit(1), depth), place)
            # a bracket that closes stands one deeper than what follows it
            bracket = F.when(closed, below(s["last"], k["own"], 2 * at)).otherwise(s["last"])
            last = F.when(closed & (F.length(piece) == 1), bracket).otherwise(below(bracket, k["depth"], 2 * at + 1))
            left = F.when(k["depth"] > 0, F.get(bracket, k["depth"] - 1)).otherwise(-1)
            return F.struct(k["depth"].alias("depth"), last.alias("last"), F.array_append(s["out"], F.struct(piece.alias("text"), k["own"].alias("own"), k["depth"].alias("depth"), left.alias("left"))).alias("out"))

        return _named(F.struct(own.alias("own"), F.when(closed, F.greatest(own - 1, F.lit(0))).otherwise(own).alias("depth")), placed)

    def cut(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p["text"], F.lit(rf"((?U){TOKEN}|\S)"), 1), lambda t: F.struct(t.alias("text"), F.when(t.isin("}", "]"), p["own"]).otherwise(p["depth"]).alias("depth"), p["left"].alias("left")))

    return F.flatten(F.transform(F.aggregate(F.split(line, r"(?=[{}\[\]])"), start, step)["out"], cut))


def _words(lex: Column) -> Column:
    """The words of a line's lexemes, each with the marks beside it and whether its group offers a
    choice: a bar at the group's own depth, between the places where the depth falls below it."""
    def in_line(ink: Column) -> Column:
        group = lambda x: F.struct(x["depth"], x["left"])

        def among(bars: Column) -> Column:
            beside = lambda i: F.coalesce(F.get(ink, i)["text"], F.lit(""))
            told = lambda x, i: F.when(x["text"].rlike("^[A-Za-z0-9]"), F.struct(x["text"].alias("token"), x["depth"].alias("depth"), beside(i - 1).alias("before"), beside(i + 1).alias("after"), ((x["depth"] > 0) & F.array_contains(bars, group(x))).alias("choice")))
            return F.filter(F.transform(ink, told), lambda w: w.isNotNull())

        return _named(F.array_distinct(F.transform(F.filter(ink, lambda x: x["text"] == "|"), group)), among)

    return _named(lex, in_line)


def _own_words(words: Column, command: Column) -> Column:
    """How many of a line's first words spell the card's command; a negation that the heading lacks
    stands before them."""
    wanted = tokens_in(command)

    def told(printed: Column) -> Column:
        skip = F.when((F.get(printed, F.lit(0)) == "no") & ~F.coalesce(F.get(wanted, F.lit(0)) == "no", F.lit(False)), 1).otherwise(0)

        def counted(k: Column) -> Column:
            matched = F.coalesce(F.array_position(k["same"], False).cast("int") - 1, F.lit(-1))
            matched = F.when(matched < 0, F.size(k["same"])).otherwise(matched)
            return F.when(matched > 0, k["skip"] + matched).otherwise(0)

        same = F.zip_with(wanted, F.slice(printed, skip + 1, F.greatest(F.size(printed), F.lit(1))), lambda a, b: F.coalesce(a == b, F.lit(False)))
        return _named(F.struct(skip.alias("skip"), same.alias("same")), counted)

    return _named(F.transform(words, lambda w: w["token"]), told)


def marks(card_lines: DataFrame, rows: DataFrame, lexicon: Lexicon | DataFrame) -> DataFrame:
    """``(doc, card, n, pos, token, kind, written, reason, description)`` for every word of the syntax.

    ``rows(doc, card, name, text)`` are the parameter tables; ``lexicon`` holds for all documents, or
    is a table ``(doc, domain, address, effect, ranges)``.  The first evidence counts: the command's
    own name; a word printed as a placeholder; a word right before itself; a row that says nothing; a word without a row, whose parts
    between dots may have some; a word that stands outside of brackets and within them; one of
    several alternatives; a stated domain; a described effect; and if there is none, a value.
    """
    table = rows.groupBy(*_KEYS).agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("table"))
    # merged: by the size of the files that they come from, tables look small enough to broadcast
    lines = spread(card_lines.where("part = 'syntax'").select(*_KEYS, "command", "n", "line"), *_KEYS).join(table.hint("merge"), _KEYS, "left")
    told_by = ["domain", "address", "effect", "ranges"]
    if isinstance(lexicon, DataFrame):
        lines = lines.join(lexicon.select("doc", *told_by), "doc")
        domain, address, effect, ranges = [F.col(k) for k in told_by]
    else:
        told_by = []
        domain, address, effect = F.lit(lexicon.domain), F.lit(lexicon.address), F.lit(lexicon.effect)
        ranges = F.array(*[F.lit(r) for r in lexicon.ranges]).cast("array<string>")
    lines = lines.withColumn("lex", lexemes(F.col("line"))).withColumn("words", _words(F.col("lex"))).withColumn("own", _own_words(F.col("words"), F.coalesce("command", F.lit(""))))
    at_depth = lambda test: F.array_distinct(F.transform(F.filter("words", test), lambda w: w["token"]))
    lines = lines.withColumn("both", F.array_intersect(at_depth(lambda w: w["depth"] == 0), at_depth(lambda w: w["depth"] > 0)))
    lines = lines.withColumn("table", F.coalesce("table", F.create_map().cast("map<string,string>")))
    # outer: for an inner one Spark asks beforehand whether there are words, and cuts every line in the few tasks that read the file
    words = lines.select("*", F.posexplode_outer("words").alias("pos", "w")).where("pos IS NOT NULL").select(*_KEYS, "n", "pos", "w.*", "own", "both", "table", *told_by, F.get(F.col("words"), F.col("pos") + 1)["token"].alias("following"))
    words = words.withColumn("row", looked_up(F.col("token"), F.col("table"))).withColumn("description", without_own_name(F.col("token"), F.col("row")))
    parts = F.split("token", r"\.")
    resolved = F.when(F.col("token").contains(".") & F.exists(parts, lambda p: looked_up(p, F.col("table")).isNotNull()), F.array_join(F.transform(parts, lambda p: F.when(looked_up(p, F.col("table")).isNotNull(), placeholder(p, looked_up(p, F.col("table")), address, ranges)).otherwise(p)), "."))
    words = words.withColumn("compound", F.when(F.col("row").isNull(), resolved))
    bar_beside = (F.col("before") == "|") | (F.col("after") == "|")
    alone = F.col("before").isin("{", "[", "|") & F.col("after").isin("}", "]", "|") & F.col("choice")
    reason = (
        F.when(F.col("pos") < F.col("own"), "command-name").when((F.col("before") == "<") & (F.col("after") == ">"), "printed").when(F.col("following") == F.col("token"), "named-then-valued").when(F.col("description") == "", "named-only")
        .when(F.col("row").isNull() & F.col("compound").isNotNull(), "compound").when(F.col("row").isNull(), "untabled").when(F.array_contains("both", F.col("token")) & (F.col("depth") == 0), "named-then-valued")
        .when(bar_beside | alone, "alternative").when(says(F.col("description"), domain), "domain").when(says(F.col("description"), effect), "effect").otherwise("default")
    )
    words = words.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason").isin("printed", "compound", "domain", "default"), "value").otherwise("keyword"))
    written = F.when(F.col("reason") == "compound", F.col("compound")).when((F.col("kind") == "value") & (F.col("reason") != "printed"), placeholder(F.col("token"), F.col("description"), address, ranges)).otherwise(F.col("token"))
    told = F.when(F.col("reason").isin("named-then-valued", "alternative", "domain", "effect", "default") & ~(F.col("following").eqNullSafe(F.col("token"))), F.col("description"))
    return words.select(*_KEYS, "n", "pos", "token", "kind", written.alias("written"), "reason", F.coalesce(told, F.lit("")).alias("description"))


def marked_lines(card_lines: DataFrame, marked: DataFrame) -> DataFrame:
    """``(doc, card, n, line, marked)``: the syntax lines with every word as it is written."""
    written = marked.groupBy(*_KEYS, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "written"))), lambda x: x["written"]).alias("written"))
    lines = card_lines.where("part = 'syntax'").select(*_KEYS, "n", "line").join(written, [*_KEYS, "n"], "left")
    filled = F.zip_with(F.split("line", TOKEN), F.col("written"), lambda gap, w: F.concat(gap, F.coalesce(w, F.lit(""))))
    return lines.select(*_KEYS, "n", "line", F.trim(F.when(F.col("written").isNull(), F.col("line")).otherwise(F.array_join(filled, ""))).alias("marked"))


def read_rows(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``(doc, card, name, kind, written, reason, text)``: every row of the tables with each way its
    word was decided; rows that no word of the syntax stands for are ``unused``."""
    decided = marked.select(*_KEYS, F.col("token").alias("name"), "kind", "written", "reason").distinct()
    told = rows.select(*_KEYS, "name", "text").join(decided, [*_KEYS, "name"], "left")
    return told.select(*_KEYS, "name", F.coalesce("kind", F.lit("unused")).alias("kind"), F.coalesce("written", "name").alias("written"), F.coalesce("reason", F.lit("unmatched-row")).alias("reason"), "text")


def card_records(card_lines: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``(doc, card, command, record)``: each card as one JSON document: syntax, the same marked, and
    parameters in the order of their names."""
    lines = marked_lines(card_lines, marked).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("n", "line", "marked"))).alias("l"))
    params = read_rows(rows, marked).groupBy(*_KEYS).agg(F.array_sort(F.collect_list(F.struct("name", "kind", "written", "reason", F.col("text").alias("description")))).alias("parameters"))
    heads = card_lines.groupBy(*_KEYS).agg(F.min("command").alias("command"))
    told = heads.join(lines, _KEYS, "left").join(params, _KEYS, "left")
    record = F.struct("command", F.transform("l", lambda x: x["line"]).alias("syntax"), F.transform("l", lambda x: x["marked"]).alias("marked"), "parameters")
    return told.select(*_KEYS, "command", F.to_json(record).alias("record"))
