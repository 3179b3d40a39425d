"""Profiles: how manuals of one shape head their cards and word their tables, as data.

A profile is a JSON file; a folder of them becomes a table that documents are joined with, so that a
run reads manuals of many shapes in one plan.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUILT_IN = Path(__file__).resolve().parents[1] / "profiles"
_TEXTS = "name language heading parameter_header header_tail no_parameters_word no_parameters_phrase page_header page_footer domain address effect".split()
_LISTS = "syntax_sections parameter_sections purpose_sections sections ranges".split()
SCHEMA = ", ".join([*(f"{n} string" for n in _TEXTS), *(f"{n} array<string>" for n in _LISTS), "rank int, min_cards long, min_conforming double"])
_REQUIRED = "name heading syntax_sections parameter_sections parameter_header no_parameters_word no_parameters_phrase".split()
_ANY_CASE = "(?iU)"
_NOTHING = "(?!)"  # matches nowhere: a profile without a vocabulary gives no evidence


def profile_row(given: dict) -> dict:
    """A profile's row of the table.  Names without a value are refused; patterns that decide on words
    ignore case, those of headings and pages don't."""
    if missing := [n for n in _REQUIRED if not given.get(n)]:
        raise ValueError(f"profile without {', '.join(missing)}")
    flat = given | given.get("lexicon", {})
    row = {n: flat.get(n) for n in _TEXTS} | {n: list(flat.get(n) or []) for n in _LISTS}
    for n in ("no_parameters_word", "no_parameters_phrase", "domain", "address", "effect"):
        row[n] = _ANY_CASE + row[n] if row[n] else _NOTHING
    for n in ("heading", "parameter_header", "header_tail", "page_header", "page_footer"):
        row[n] = "(?U)" + row[n] if row[n] else _NOTHING
    row["ranges"] = [_ANY_CASE + p for p in row["ranges"]]
    row["language"] = row["language"] or ""
    return row | {"rank": int(given.get("rank", 1000)), "min_cards": int(given.get("min_cards", 20)), "min_conforming": float(given.get("min_conforming", 0.9))}


def profiles(spark: SparkSession, folder: str | Path = BUILT_IN) -> DataFrame:
    """The profiles of a folder on the driver, in the columns of ``SCHEMA``; ``rank`` and name say which
    is tried first."""
    rows = [profile_row(json.loads(p.read_text(encoding="utf-8"))) for p in sorted(Path(folder).glob("*.json"))]
    return spark.createDataFrame(rows, SCHEMA)


def section_part(title: Column) -> Column:
    """Which part of a card a title opens, by the profile's columns."""
    named = lambda c: F.array_contains(F.col(c), title)
    return F.when(named("syntax_sections"), "syntax").when(named("parameter_sections"), "parameters").when(named("purpose_sections"), "purpose").otherwise("other")


def cards_by_profile(lines: DataFrame, told: DataFrame) -> DataFrame:
    """``(doc, n, line)`` -> ``(doc, name, card, command, n, part, line, had_syntax, had_parameters)``: the
    parts of all cards, as each profile of ``told`` (a table of profiles, a few rows) reads them.

    Headings and bold titles count outside of fences; syntax and parameters within them, purpose
    anywhere.  A card whose heading is followed by neither a syntax nor a parameters title is
    none, as in a table of contents.
    """
    line = F.col("line")
    fenced = line.rlike(r"^\s*(?:```|~~~)")
    up_to = lambda *by: Window.partitionBy(*by).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    base = lines.select("doc", "n", "line").withColumn("is_fence", fenced).withColumn("inside", (F.sum(F.col("is_fence").cast("int")).over(up_to("doc")) % 2 == 1) & ~F.col("is_fence"))
    each = base.where(~F.col("is_fence")).join(F.broadcast(told.select("name", "heading", *[n for n in _LISTS if n != "ranges"])))
    title = F.when(~F.col("inside"), F.regexp_extract(line, r"^\s*\*\*(.+?)\*\*\s*:?\s*$", 1))
    each = each.withColumn("is_heading", ~F.col("inside") & F.rlike(line, F.col("heading"))).withColumn("title", F.when(~F.col("is_heading") & (title != ""), F.trim(title)))
    by = ["doc", "name"]
    each = each.withColumn("card", F.sum(F.col("is_heading").cast("int")).over(up_to(*by))).where("card > 0")
    of_card = [*by, "card"]
    each = each.withColumn("part", F.last(F.when(F.col("title").isNotNull(), section_part(F.col("title"))), ignorenulls=True).over(up_to(*of_card)))
    whole = Window.partitionBy(*of_card)
    command = F.trim(F.expr("regexp_extract(line, heading, 1)"))
    each = each.withColumn("command", F.first(F.when(F.col("is_heading"), command), ignorenulls=True).over(whole))
    opened = lambda p: F.bool_or(F.col("title").isNotNull() & (F.col("part") == p)).over(whole)
    each = each.withColumn("had_syntax", opened("syntax")).withColumn("had_parameters", opened("parameters")).where("had_syntax OR had_parameters")
    content = line.rlike(r"(?U)\S") & ~F.col("is_heading") & F.col("title").isNull() & ((F.col("part").isin("syntax", "parameters") & F.col("inside")) | (F.col("part") == "purpose"))
    return each.where(content | F.col("is_heading")).select("doc", "name", "card", "command", "n", F.when(F.col("is_heading"), "heading").otherwise(F.col("part")).alias("part"), "line", "had_syntax", "had_parameters")


def picked(read: DataFrame, told: DataFrame) -> DataFrame:
    """``(doc, name)``: the first profile, by rank and name, that reads a document as enough cards of
    which enough have syntax and a parameters part; documents that suit none are left out."""
    per_card = read.groupBy("doc", "name", "card").agg((F.bool_or(F.col("part") == "syntax") & F.bool_or("had_parameters")).alias("structured"))
    per_doc = per_card.groupBy("doc", "name").agg(F.count("*").alias("cards"), F.count_if("structured").alias("structured"))
    fits = per_doc.join(F.broadcast(told.select("name", "rank", "min_cards", "min_conforming")), "name").where("cards >= min_cards AND structured >= min_conforming * cards")
    return fits.groupBy("doc").agg(F.min(F.struct("rank", "name"))["name"].alias("name"))
