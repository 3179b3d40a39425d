"""Manuals that reached us as paged word files: their pages put in order, their cards found.

Such a file has two layers.  What is positioned on a page comes an interval (up to a running footer)
late, so each interval's flow waits until a positioned page was put before it.  Pages wait in a
queue that gives one page an interval: page j of arrival a(j) leaves at j + max over i <= j of
(a(i) - i), a running maximum.  Titles are printed over up to three lines, forms over up to eight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profiles import section_part

#: Over how many lines a title may be printed; what an unfinished line ends with, and
#: what goes on with one begins with; dot leaders; a negation in brackets.
TITLE_REACH = 3
_ENDS_OPEN = r"[-|{\[,/]$"
_GOES_ON = r"^[|}\],]"
_LEADER = r"\.{4,}"
_OPTIONAL_NO = r"^\[\s*no\s*\]\s*"


def page_order(paragraphs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by..., n, positioned, text, page_footer)`` -> ``(by..., place, text)`` in reading order.

    A footer line ends an interval.  The first positioned line of an interval is its running header;
    where it stands again another page begins.  Headers, footers and empty lines are dropped.
    """
    by = by or ["doc"]
    over = Window.partitionBy(*by).orderBy("n")
    before, up_to = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, 0)
    told = paragraphs.withColumn("text", F.trim("text")).where("text <> ''").withColumn("is_footer", F.rlike("text", F.col("page_footer")))
    told = told.withColumn("interval", F.coalesce(F.sum(F.col("is_footer").cast("long")).over(before), F.lit(0)))
    whole = Window.partitionBy(*by)
    ended = F.sum(F.col("is_footer").cast("long")).over(whole) - 1
    told = told.withColumn("last", F.greatest(ended, F.max(F.when(~F.col("is_footer"), F.col("interval"))).over(whole))).where("NOT is_footer")
    header = F.first("text").over(Window.partitionBy(*by, "interval").orderBy("n"))
    pages = told.where("positioned").withColumn("opens", F.col("text") == header)
    pages = pages.withColumn("page", F.sum(F.col("opens").cast("long")).over(up_to) - 1)  # from 0 over the document
    arrival = F.col("interval") - F.col("page")  # equal on all lines of a page
    leaves = F.col("page") + F.max(arrival).over(up_to)
    pages = pages.withColumn("leaves", leaves).where("NOT opens")
    # at its step a page stands before the flow of the interval before; what still waits comes last
    turn = F.when(F.col("leaves") <= F.col("last"), F.struct((2 * F.col("leaves")).alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct((2 * F.col("last") + 4).alias("a"), F.col("page").alias("b")))
    flow = told.where("NOT positioned").withColumn("turn", F.struct((2 * F.col("interval") + 3).alias("a"), F.lit(0).cast("long").alias("b")))
    whole = pages.withColumn("turn", turn).select(*by, "turn", "n", "text").unionByName(flow.select(*by, "turn", "n", "text"))
    return whole.select(*by, F.row_number().over(Window.partitionBy(*by).orderBy("turn", "n")).alias("place"), "text")


def titled(lines: DataFrame, by: list[str]) -> DataFrame:
    """``(by..., n, line, is_heading, titles)`` -> adds ``title``, null where none begins, and drops the
    lines that a title goes on over.  ``titles`` maps lower case to the title; the shortest run of
    lines that is one counts, and the lines of a title begin no other."""
    over = Window.partitionBy(*by).orderBy("n")
    ahead = [F.col("line"), *(F.lead("line", k).over(over) for k in range(1, TITLE_REACH))]
    runs = [F.when(F.lit(True) if k == 0 else ahead[k].isNotNull(), F.lower(F.concat_ws(" ", *ahead[: k + 1]))) for k in range(TITLE_REACH)]
    told = lines.withColumn("at", F.row_number().over(over)).withColumn("runs", F.array(*runs))
    hits = F.transform("runs", lambda r, k: F.when(r.isNotNull(), F.struct(F.col("titles")[r].alias("title"), (k + 1).alias("span"))))
    first = F.get(F.filter(hits, lambda h: h["title"].isNotNull()), F.lit(0))
    told = told.withColumn("hit", F.when(~F.col("is_heading"), first)).drop("runs")
    # runs of lines close enough to overlap are settled together, from above
    near = F.lag("at").over(over)
    starts = told.where("hit IS NOT NULL").withColumn("group", F.sum(F.when(F.col("at") - F.coalesce(near, F.lit(-9)) >= TITLE_REACH, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    groups = starts.groupBy(*by, "group").agg(F.array_sort(F.collect_list(F.struct("at", "hit"))).alias("g"))
    empty = F.struct(F.lit(0).alias("until"), F.array().cast("array<struct<at:int,title:string,span:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        taken = F.struct((x["at"] + x["hit"]["span"] - 1).alias("until"), F.array_append(s["out"], F.struct(x["at"].alias("at"), x["hit"]["title"].alias("title"), x["hit"]["span"].alias("span"))).alias("out"))
        return F.when(x["at"] > s["until"], taken).otherwise(s)

    taken = groups.select(*by, F.explode(F.aggregate("g", empty, step)["out"]).alias("t")).select(*by, "t.*")
    done = told.drop("hit").join(taken, [*by, "at"], "left")
    covered = F.max(F.col("at") + F.col("span") - 1).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return done.withColumn("covered", F.coalesce(F.col("at") <= covered, F.lit(False))).where("NOT covered").drop("covered", "at", "span", "titles")


def opened_form(line: Column, command: Column) -> Column:
    """The form that a line begins, null if none: its first word begins like a word of the heading's
    first, or is ``no``.  A negation in brackets is closed up; a capital at the start of a line that
    is lower case otherwise is put back down."""
    bare = F.trim(F.regexp_replace(line, _OPTIONAL_NO, "[no] "))
    negated = line.rlike(_OPTIONAL_NO)
    openers = F.array_append(F.regexp_extract_all(F.split(command, " ")[0], F.lit("([A-Za-z][A-Za-z0-9-]*)"), 1), F.lit("no"))
    named = lambda word: F.exists(openers, lambda o: F.when(o == "no", word == "no").otherwise(word.startswith(o)))
    words = F.split(bare, r"\s+")
    first = F.when(negated, F.get(words, F.lit(1))).otherwise(words[0])
    lowered = F.concat(F.lower(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20))
    low_first = F.split(lowered, r"\s+")[0]
    return F.when(F.coalesce(named(first), F.lit(False)), bare).when(~negated & (lowered != bare) & (lowered == F.lower(lowered)) & named(low_first), lowered)


def forms(lines: Column) -> Column:
    """The forms of a block of ``(line, opened)``: a line is joined on where the form above is visibly
    unfinished or the line visibly goes on, without a blank after a hyphen; other lines that open no
    form are dropped."""

    def step(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(last, F.when(last.endswith("-"), "").otherwise(" "), x["line"])
        goes_on = F.coalesce(last.rlike(_ENDS_OPEN) | (last.isNotNull() & x["line"].rlike(_GOES_ON)), F.lit(False))
        return F.when(goes_on, F.array_append(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), joined)).when(x["opened"].isNotNull(), F.array_append(done, x["opened"])).otherwise(done)

    return F.aggregate(lines, F.array().cast("array<string>"), step)


def paged_cards(paragraphs: DataFrame, told: DataFrame) -> DataFrame:
    """``(doc, n, positioned, text)`` -> the rows of ``cards_by_profile``, as each profile that lists its
    block titles reads the word files."""
    able = told.where("size(sections) > 0")
    key = F.transform("sections", lambda s: F.struct(F.lower(s).alias("k"), s.alias("v")))
    able = able.withColumn("titles", F.map_from_entries(key)).select("name", "heading", "page_header", "page_footer", "titles", "syntax_sections", "parameter_sections", "purpose_sections")
    each = paragraphs.select("doc", "n", "positioned", "text").join(F.broadcast(able.select("name", "page_footer")))
    by = ["doc", "name"]
    lines = page_order(each, by).withColumnRenamed("text", "line").withColumnRenamed("place", "n").join(F.broadcast(able), "name")
    lines = lines.where(~F.col("line").rlike(_LEADER) & ~F.rlike("line", F.col("page_header"))).withColumn("is_heading", F.rlike("line", F.col("heading")))
    found = titled(lines, by)
    up_to = lambda *keys: Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("card", F.sum(F.col("is_heading").cast("int")).over(up_to(*by))).where("card > 0")
    of_card = [*by, "card"]
    whole = Window.partitionBy(*of_card)
    found = found.withColumn("block", F.count("title").over(up_to(*of_card))).withColumn("section", F.last("title", ignorenulls=True).over(up_to(*of_card)))
    found = found.withColumn("command", F.first(F.when(F.col("is_heading"), F.trim(F.expr("regexp_extract(line, heading, 1)"))), ignorenulls=True).over(whole)).withColumn("part", section_part(F.col("section")))
    had = lambda p: F.bool_or(F.col("title").isNotNull() & (F.col("part") == p)).over(whole)
    found = found.withColumn("had_syntax", had("syntax")).withColumn("had_parameters", had("parameters")).where("had_syntax OR had_parameters")
    keep_ = ["doc", "name", "card", "command", "had_syntax", "had_parameters"]
    heads = found.where("is_heading").select(*keep_, "n", F.lit("heading").alias("part"), "line")
    content = found.where("NOT is_heading AND title IS NULL AND section IS NOT NULL")
    plain = content.where("part IN ('parameters', 'purpose')").select(*keep_, "n", "part", "line")
    item = F.struct("n", F.trim("line").alias("line"), opened_form(F.trim("line"), F.col("command")).alias("opened"))
    blocks = content.where("part = 'syntax'").groupBy(*keep_, "block").agg(F.min("n").alias("first"), F.array_sort(F.collect_list(item)).alias("lines"))
    written = blocks.select(*keep_, "first", F.posexplode(forms(F.col("lines"))).alias("i", "line")).select(*keep_, (F.col("first") + F.col("i")).alias("n"), F.lit("syntax").alias("part"), "line")
    return heads.unionByName(plain).unionByName(written)
