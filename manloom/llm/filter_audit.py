"""Walsh-Hadamard audit of how filters overlap: what each removes in every order they may run in.

Every document fails some set of the filters: a mask of bits.  For every set S of filters Spark adds
up the signs (-1)^|mask and S| per part and label: 32 sums for five filters, which add up on the map
side, so that only a few rows per part are shuffled.  The transform is its own inverse up to
the factor 32, so the sums turn back into the exact number of documents of each mask.  All orders,
steps and Shapley values are read off those cells, without another look at a document.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

_BLANK = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that look at one text alone, by name: true where the text fails.

    A: under 100 words; B: under 80 distinct words in a hundred; C: over one capital A-Z in ten
    code points; D: one of ``#$%&*|`` occurs.  An empty text fails A only.
    """
    words = F.array_remove(F.split(text, _BLANK), "")
    return {
        "A": F.size(words) < 100,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 80,
        "C": F.length(F.regexp_replace(text, "[^A-Z]++", "")) * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def _bits(failures: dict[str, Column]) -> Column:
    return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(failures.values())), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, good, toxic, mask)``, one row per input row; bit i of ``mask`` stands for filter
    ``"ABCDE"[i]``.

    E fails where a row with a smaller id has the same whole text (by SHA-256 of its UTF-8).  Null
    texts are empty texts, null parts the part ``''``.  Rows with a null id fail E never and make no
    row fail it; rows that repeat an id count each, and fail E together.  ``good`` and ``toxic`` are
    whether any label of the id is 1; ids without labels, and labels without documents, are neither.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    seen = keep(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _bits(text_failures(F.col("text"))).alias("alone")), "audit-rows")
    # the least id of a text meets its own rows only, so a text with very many copies is no hot key
    firsts = seen.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t")).where("doc_id IS NOT NULL")
    told = told.groupBy("doc_id").agg(F.bool_or("q").alias("good"), F.bool_or("t").alias("toxic"))
    again = F.when(F.col("doc_id").isNotNull() & F.col("is_first").isNull(), 16).otherwise(0)
    joined = seen.join(firsts, ["doc_id", "digest"], "left").join(told, "doc_id", "left")
    return joined.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), (F.col("alone") + again).alias("mask"))


def parity_sums(masked: DataFrame, filters: int) -> DataFrame:
    """``(part, good, toxic, sums)``: for each set S of filters, in numeric order, the sum of
    (-1)^|mask and S| over the rows of a part and label."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)
    sums = masked.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s)).alias(f"s{s}") for s in range(1 << filters)])
    return sums.select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(1 << filters)]).alias("sums"))


def cells(sums: DataFrame, filters: int) -> DataFrame:
    """``(part, mask, n, good, toxic)``: the rows of each mask, by inverting the sums exactly."""
    signed = F.transform("sums", lambda w, s: w * (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)))
    count = F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x), filters)  # a multiple of 2**filters
    each = sums.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1)))).withColumn("n", count)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")])


def orders(counted: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of ``cells``.

    Among the orders of k filters, a document that fails j of them is removed by each of those in
    k!/j: that sum over cells is the filter's Shapley value times k!.
    """
    k = len(names)
    per = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2**k of them
    per = per.withColumn("filter_order", F.explode(F.array(*[F.lit("".join(o)) for o in permutations(names)])))
    per = per.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = f"shiftleft(1, instr('{names}', substring(filter_order, {{}}, 1)) - 1)"
    per = per.withColumn("own", F.expr(bit.format("step"))).withColumn("before", F.expr(f"aggregate(sequence(1, {k}), 0, (a, i) -> a + if(i < step, {bit.format('i')}, 0))"))

    def total(which, amount) -> Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda a, c: a + amount(c))

    hit = lambda c, bits: c["mask"].bitwiseAND(F.col(bits)) != 0
    removed = lambda c: hit(c, "own") & ~hit(c, "before")
    n = lambda c: c["n"]
    return per.select(
        "part", "filter_order", "step",
        total(lambda c: ~hit(c, "own") & ~hit(c, "before"), n).alias("kept"),
        total(removed, n).alias("removed"),
        total(lambda c: hit(c, "own") & hit(c, "before"), n).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own"), n).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: hit(c, "own"), lambda c: c["n"] * F.floor(F.lit(factorial(k)) / F.bit_count(c["mask"]))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley)`` for the five filters, zeros included: 600 rows per part.

    Counts are documents of the part: left after the step; removed by it; failing its filter but
    removed before; failing its filter only; removed with a good, with a toxic label; and
    ``shapley`` adds up what the filter removes over all 120 orders.  An empty table has no parts
    and gives no rows, empty labels give no losses; other columns are ignored whatever their names.
    """
    return orders(cells(parity_sums(masks(docs, labels, id_col, text_col, part_col), 5), 5), "ABCDE")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first_id FROM d),
f AS (
  SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, map {
    'A': len(words) < 100,
    'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(first_id < w.doc_id, false)} AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
),
m AS (
  SELECT part, good, toxic, fails['A'] AS a, fails['B'] AS b, fails['C'] AS c, fails['D'] AS d, fails['E'] AS e, count(*) AS n
  FROM f GROUP BY ALL
),
cell AS (SELECT part, good, toxic, n, list_concat([]::VARCHAR[], list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: CASE x WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END)) AS failed FROM m),
x(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
st AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, string_split(substr(filter_order, 1, step - 1), '') AS before FROM o, generate_series(1, 5) g(step)),
r AS (SELECT st.*, cell.*, list_contains(failed, own) AS hit, len(list_intersect(failed, before)) > 0 AS gone FROM st, cell)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN failed = [own] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN hit AND NOT gone AND good THEN n ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN hit AND NOT gone AND toxic THEN n ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN hit THEN n * (120 // len(failed)) ELSE 0 END) AS BIGINT) AS shapley
FROM r GROUP BY part, filter_order, step
"""
