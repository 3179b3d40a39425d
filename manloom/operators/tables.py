"""Parameter tables of cards, read in spite of what their conversion to text did to them.

Gutters are gone, names are broken over lines or glued to a neighbour, descriptions wrap into the
name column.  So rows are found by the words that the card's own syntax spells, not by columns.
Every way a line might begin a row is a row of its own here: ``(line, rank of the evidence, name)``.
Names in one piece are found by looking words up in the card's vocabulary; broken ones by
equi-joins of the pieces on the page with an index of all partial spellings.  One fold per card
then takes, line by line, the best evidence for a name that no earlier line has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import keep, spread

#: What a word of a syntax line is, how far right of the header a name may begin, how
#: far below the first piece of a name its second may stand, the shortest piece that tells anything,
#: and what a name looks like where nothing vouches for it.
TOKEN = "[A-Za-z0-9][A-Za-z0-9._/-]*"
NAME_SLACK = 8
REACH = 2
LEAST = 3
_PLAIN_NAME = "^[a-z][a-z0-9]*(?:-[a-z0-9]+)*$"
_HEADER = r"^(\s*)(?:Пара\w*|Parameter|参数)(?:\s+(\S+))?"
_HEADER_TAIL = r"^\s*(?:метр|значения|значение)\s*$"

_KEYS = ["doc", "card"]
#: The kinds of evidence, best first.
_AT_HEAD, _ANYWHERE, _BROKEN, _TAIL_GLUED, _TEXT_GLUED = range(5)


def tokens_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def vocabulary(card_lines: DataFrame) -> DataFrame:
    """``(doc, card, tokens, words, known)``: what a card's syntax lines spell.

    ``tokens`` are its words, those before a slash and those between dots; ``words`` are these and
    their forms without a final number; ``known`` leads from lower case to the longest spelling, the
    least of equally long ones.
    """
    token = card_lines.where("part = 'syntax'").select(*_KEYS, F.explode(tokens_in(F.col("line"))).alias("t"))
    spelled = token.select(*_KEYS, F.explode(F.concat(F.array("t", F.split("t", "/")[0]), F.split("t", r"\."))).alias("word")).where("word <> ''").distinct()
    both = spelled.withColumn("exact", F.lit(True)).unionByName(spelled.select(*_KEYS, T.stem(F.col("word")).alias("word"), F.lit(False).alias("exact")).where("word <> ''"))
    words = both.groupBy(*_KEYS, "word").agg(F.bool_or("exact").alias("exact"))
    per_fold = words.groupBy(*_KEYS, F.lower("word").alias("low")).agg(F.min_by("word", F.struct(-F.length("word"), "word")).alias("first"), F.collect_list(F.struct("word", "exact")).alias("all"))
    lists = per_fold.groupBy(*_KEYS).agg(F.flatten(F.collect_list("all")).alias("all"), F.map_from_entries(F.collect_list(F.struct("low", "first"))).alias("known"))
    return lists.select(*_KEYS, F.transform(F.filter("all", lambda w: w["exact"]), lambda w: w["word"]).alias("tokens"), F.transform("all", lambda w: w["word"]).alias("words"), "known")


def spelled(candidate: Column, folding: bool = False) -> Column:
    """The vocabulary's spelling of a word, null if it has none: the word itself, or one that differs
    in the case of its first letter; in any letter's if ``folding``."""
    known = F.col("known")[F.lower(candidate)]
    near = F.lit(True) if folding else F.substring(candidate, 2, 1 << 20) == F.substring(known, 2, 1 << 20)
    return F.when(F.array_contains("words", candidate), candidate).otherwise(F.when(near, known))


def spellings(vocab: DataFrame) -> DataFrame:
    """``(doc, card, written, name)``: every writing that ``spelled`` accepts, and what it stands for."""
    exact = vocab.select(*_KEYS, "words", F.explode("words").alias("written")).withColumn("name", F.col("written"))
    first, rest = F.substring("name", 1, 1), F.substring(F.col("name"), 2, 1 << 20)
    turned = vocab.select(*_KEYS, "words", F.explode(F.map_values("known")).alias("name")).withColumn("written", F.concat(F.when(first == F.upper(first), F.lower(first)).otherwise(F.upper(first)), rest))
    return exact.select(*_KEYS, "written", "name").unionByName(turned.where("NOT array_contains(words, written)").select(*_KEYS, "written", "name"))


def partial_spellings(vocab: DataFrame) -> DataFrame:
    """``(doc, card, head, tail, joint, name)``: each writing cut in two at every place; with
    ``joint`` 1 the hyphen at the cut is lost."""
    cut = spellings(vocab).select("*", F.explode(F.expr("CASE WHEN length(written) > 1 THEN sequence(1, length(written) - 1) ELSE array() END")).alias("k"))
    cut = cut.select(*_KEYS, "name", F.expr("left(written, k)").alias("head"), F.expr("substring(written, k + 1)").alias("tail"))
    eaten = cut.where("startswith(tail, '-')").select(*_KEYS, "name", "head", F.expr("substring(tail, 2)").alias("tail"), F.lit(1).alias("joint"))
    return cut.withColumn("joint", F.lit(0)).unionByName(eaten)


def completions(vocab: DataFrame) -> DataFrame:
    """``(doc, card, head, name)``: every beginning of ``LEAST`` letters or more of a longer word."""
    words = vocab.select(*_KEYS, F.explode("words").alias("name")).where(F.length("name") > LEAST)
    return words.select(*_KEYS, "name", F.explode(F.expr(f"sequence({LEAST}, length(name) - 1)")).alias("k")).select(*_KEYS, "name", F.expr("left(name, k)").alias("head"))


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"(?U)^\s+", ""))


def table_body(card_lines: DataFrame, header: str = _HEADER, tail: str | None = _HEADER_TAIL, *, headerless: bool = False) -> DataFrame:
    """``(doc, card, i, line, indent, edge, headed)``: the lines below a table's header, blank ones and the
    broken off ends of its words left out.

    ``header`` has the indent and the second column's title as groups; ``edge`` is where that
    column begins.  Where the lines come with columns ``parameter_header`` and ``header_tail``, these
    patterns are taken instead.  Tables without a header have no rows, unless ``headerless``: then the first two
    columns of blanks that all of a card's lines share are its gutter.
    """
    own = {"parameter_header", "header_tail"} <= set(card_lines.columns)
    patterns = [F.col("parameter_header").alias("h"), F.col("header_tail").alias("t")] if own else [F.lit(header).alias("h"), F.lit(tail or "(?!)").alias("t")]
    lines = card_lines.where("part = 'parameters'").select(*_KEYS, "n", "line", *patterns)
    whole = Window.partitionBy(*_KEYS)
    group = lambda k: F.call_function("regexp_extract", F.col("line"), F.col("h"), F.lit(k))
    edge = F.when(F.col("second") != "", F.expr("locate(second, line, indent + 1)") - 1)
    told = lines.withColumn("second", group(2)).withColumn("indent", F.length(group(1))).withColumn("at", F.when(F.rlike("line", F.col("h")), F.struct("n", "indent", edge.alias("edge"))))
    told = told.withColumn("head", F.min("at").over(whole)).where(F.col("line").rlike(r"(?U)\S"))
    up_to = Window.partitionBy(*_KEYS).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    body = told.where("n > head.n").withColumn("begun", F.bool_or(~F.rlike("line", F.col("t"))).over(up_to)).where("begun").select(*_KEYS, "n", "line", "head.indent", "head.edge", F.lit(True).alias("headed"))
    if headerless:
        bare = told.where("head IS NULL").select(*_KEYS, "n", "line")
        body = body.unionByName(bare.join(gutters(bare), _KEYS).withColumn("headed", F.lit(False)))
    return body.withColumn("i", F.row_number().over(Window.partitionBy(*_KEYS).orderBy("n")) - 1).drop("n")


def gutters(lines: DataFrame) -> DataFrame:
    """``(doc, card, indent, edge)``: where the lines of a table begin, and where its second column
    does: right of the first two columns or more that are blank on every line; null if none are."""
    inked = lines.select(*_KEYS, F.posexplode(F.split("line", "")).alias("at", "c")).where(F.col("c").rlike(r"(?U)\S")).groupBy(*_KEYS, "at").count()
    before = F.lag("at").over(Window.partitionBy(*_KEYS).orderBy("at"))
    return inked.withColumn("gap", F.col("at") - before - 1).groupBy(*_KEYS).agg(F.min("at").alias("indent"), F.min(F.when(F.col("gap") >= 2, F.col("at"))).alias("edge"))


def candidates(body: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(doc, card, i, kind, turn, name, uses)``: what each line may begin a row for, in the order of
    ``kind`` and ``turn``; ``uses`` is the line that holds the second piece of a broken name."""
    line = F.col("line")
    stripped = F.regexp_replace(line, r"(?U)^\s+", "")
    at = _indent(line)
    lines = body.join(vocab, _KEYS).withColumn("stripped", stripped).withColumn("in_names", (at <= F.col("indent") + NAME_SLACK) & (F.col("edge").isNull() | (at < F.col("edge"))))
    none = F.lit(None).cast("int")

    def told(df: DataFrame, kind: int, turn: Column, uses: Column = none) -> DataFrame:
        return df.select(*_KEYS, "i", F.lit(kind).alias("kind"), turn.alias("turn"), "name", uses.cast("int").alias("uses"))

    exact = F.array_contains(F.col("tokens"), F.col("name"))
    # the longest name that the first word spells, alone or with a second word one blank on
    pair = rf"^[^A-Za-z0-9]*({TOKEN}) ({TOKEN})"
    one, two = F.regexp_extract("stripped", f"({TOKEN})", 1), F.regexp_extract("stripped", pair, 2)
    joined = F.when(two != "", F.array(spelled(F.concat("one", F.lit("-"), "two"), True), spelled(F.concat("one", "two"), True))).otherwise(F.array().cast("array<string>"))
    heads = lines.where("in_names").withColumn("one", one).withColumn("two", two).where("one <> ''")
    heads = heads.select("*", F.posexplode(F.concat(F.array(spelled(F.col("one"))), joined)).alias("pos", "name")).where(exact)
    parts = [told(heads, _AT_HEAD, F.array(-F.length("name"), "pos"))]
    words = lines.select("*", F.posexplode(tokens_in(line)).alias("pos", "name"))
    parts.append(told(words.where(exact), _ANYWHERE, F.array("pos")))
    # two pieces on two lines that spell a name between them
    pieces = words.where(spelled(F.col("name")).isNull()).select(*_KEYS, "i", F.col("pos").alias("head_pos"), F.col("name").alias("head"))
    ends = words.select(*_KEYS, F.col("i").alias("uses"), F.col("pos").alias("tail_pos"), F.col("name").alias("tail"))
    broken = pieces.join(partial_spellings(vocab), [*_KEYS, "head"]).select("*", F.explode(F.array(*[F.lit(k) for k in range(1, REACH + 1)])).alias("down")).withColumn("uses", F.col("i") + F.col("down"))
    broken = broken.join(ends, [*_KEYS, "uses", "tail"])
    parts.append(told(broken, _BROKEN, F.array("head_pos", "down", "tail_pos", "joint"), F.col("uses")))
    # a beginning of a name whose end is buried in a word beside or below
    over = Window.partitionBy(*_KEYS).orderBy("i")
    first = F.regexp_extract("stripped", f"^({TOKEN})", 1)
    glued = lines.withColumn("below", F.concat_ws(" ", *[F.lead("line", k).over(over) for k in range(1, REACH + 1)])).withColumn("head", first).where("in_names AND head <> ''").where(spelled(F.col("head")).isNull())
    rest = F.concat_ws(" ", F.expr("substring(stripped, length(head) + 1)"), "below")
    ended = glued.where(F.length("head") >= LEAST).select(*_KEYS, "i", "head", tokens_in(rest).alias("rest")).join(completions(vocab), [*_KEYS, "head"])
    ended = ended.withColumn("tail", F.regexp_replace(F.expr("substring(name, length(head) + 1)"), "^-+", "")).where(F.length("tail") >= LEAST).where(F.exists("rest", lambda w: w.contains(F.col("tail"))))
    by_length = F.row_number().over(Window.partitionBy(*_KEYS, "i").orderBy(F.length("name"), "name"))
    parts.append(told(ended, _TAIL_GLUED, F.array(by_length)))
    # a name with the description glued on, which begins with a capital; the longest name first
    cuts = F.expr(f"CASE WHEN length(head) > {LEAST} THEN sequence(length(head) - 1, {LEAST}, -1) ELSE array() END")
    opened = glued.select("*", F.explode(cuts).alias("k")).where(F.expr("substring(head, k + 1, 1)").rlike("[A-Z]")).withColumn("name", spelled(F.expr("left(head, k)"))).where(exact)
    parts.append(told(opened, _TEXT_GLUED, F.array(-F.col("k"))))
    return reduce(DataFrame.unionByName, parts)


def row_starts(found: DataFrame) -> DataFrame:
    """``(doc, card, i, name)``: the rows that the candidates of a card agree on.

    Lines in order take their best candidate; a name begins one row only, and a line that held the
    second piece of a name begins none and ends no other.
    """
    item = F.struct("i", "kind", "turn", "name", "uses")
    start = F.struct(F.array().cast("array<string>").alias("names"), F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<i:int,name:string>>").alias("rows"), F.lit(-1).alias("last"))

    def step(s: Column, c: Column) -> Column:
        free = (c["i"] != s["last"]) & ~F.array_contains(s["names"], c["name"]) & ~F.array_contains(s["used"], c["i"]) & ~F.array_contains(s["used"], F.coalesce(c["uses"], F.lit(-1)))
        added = F.struct(
            F.array_append(s["names"], c["name"]).alias("names"), F.concat(s["used"], F.when(c["uses"].isNull(), F.array().cast("array<int>")).otherwise(F.array(c["uses"]))).alias("used"),
            F.array_append(s["rows"], F.struct(c["i"].alias("i"), c["name"].alias("name"))).alias("rows"), c["i"].alias("last"),
        )
        return F.when(free, added).otherwise(s)

    chains = found.groupBy(*_KEYS).agg(F.array_sort(F.collect_list(item)).alias("c"))
    return chains.select(*_KEYS, F.explode(F.aggregate("c", start, step)["rows"]).alias("r")).select(*_KEYS, "r.*")


def starts_by_shape(body: DataFrame) -> DataFrame:
    """``(doc, card, i, name)`` where no syntax vouches for names: one plainly spelled word in the name
    column with text to its right, the first time it occurs.  Without a header there must be a gutter."""
    bare = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    told = body.withColumn("name", F.regexp_extract(bare, r"^([^ ]+) (?U:\s*\S)", 1)).withColumn("at", _indent(F.col("line")))
    fits = (F.col("at") <= F.col("indent") + NAME_SLACK) & (F.col("edge").isNull() | (F.col("at") + F.length("name") <= F.col("edge")))
    return told.where(fits & (F.col("headed") | F.col("edge").isNotNull()) & (F.length("name") >= LEAST) & F.col("name").rlike(_PLAIN_NAME)).groupBy(*_KEYS, "name").agg(F.min("i").alias("i")).select(*_KEYS, "i", "name")


def without_own_name(name: Column, text: Column) -> Column:
    """A row's text without its own name before it, which the name column leaves there."""
    quoted = F.concat(F.lit(r"(?i)^[\s({]*\Q"), name, F.lit(r"\E[\s)}:.,—–-]*"))
    return F.trim(F.regexp_replace(text, quoted, F.lit("")))


def parameter_rows(card_lines: DataFrame, header: str = _HEADER, tail: str | None = _HEADER_TAIL, *, headerless: bool = False) -> DataFrame:
    """``(doc, card, name, text, description)``: the rows of every card's table.

    ``text`` is all that stands between a row's beginning and the next, what stands above the first
    row too; ``description`` is that without the row's own name.  Cards whose syntax vouches for no
    row are read by shape.
    """
    card_lines = spread(card_lines, *_KEYS)
    body = keep(table_body(card_lines, header, tail, headerless=headerless), "table-bodies")
    starts = keep(row_starts(candidates(body, keep(vocabulary(card_lines), "vocabularies"))), "table-rows")
    shaped = starts_by_shape(body).join(starts.select(*_KEYS).distinct(), _KEYS, "left_anti")
    starts = starts.unionByName(shaped)
    up_to = Window.partitionBy(*_KEYS).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    cut = body.join(starts, [*_KEYS, "i"], "left").withColumn("row", F.greatest(F.count("name").over(up_to), F.lit(1)))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), " ")
    rows = cut.groupBy(*_KEYS, "row").agg(F.max("name").alias("name"), T.one_spaced(whole).alias("text")).where("name IS NOT NULL")
    return rows.select(*_KEYS, "name", "text", without_own_name(F.col("name"), F.col("text")).alias("description"))
