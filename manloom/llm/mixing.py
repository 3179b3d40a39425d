"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source should be taken ``target / source_size`` times.  The whole part is
certain; the fraction is a probability whose mass in words is ``fraction * size``.  Two documents
at a time play: mass moves from one to the other, in a direction drawn so that no expectation
changes, until one of them holds none or all of its size.  Total mass never changes, so a source
ends within one document of its target.  Leaf buckets of about ``fan`` documents play first, and
their one survivor each goes up a reduction tree.  A reserve of some hundred documents per source
joins at the root, largest first, so that what is left at last is small; one further document of
about the size of the last rounding error is turned over where that brings the sum closer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

_UNIT = 1 << 53


def word_count(text: Column) -> Column:
    """Number of runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    marked = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^\x20\x09-\x0D]++", "x")
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")).cast("long")


def _let(value: Column, body) -> Column:
    """Names ``value`` once within a higher-order function's lambda."""
    return F.transform(F.array(value), body)[0]


def _running(df: DataFrame, order: list[Column], sums: dict[str, str], name: str) -> DataFrame:
    """Adds global running sums (this row included) in ``order``, without a global window: range
    partitions are summed apart and shifted by the totals of those before them."""
    dealt = keep(df.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), name)
    totals = dealt.groupBy("pid").agg(*[F.sum(c).alias(f"of_{o}") for o, c in sums.items()])
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = totals.select("pid", *[F.coalesce(F.sum(f"of_{o}").over(before), F.lit(0)).alias(f"of_{o}") for o in sums])
    own = Window.partitionBy("pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(shifts, "pid").select(*[c for c in dealt.columns if c != "pid"], *[(F.sum(c).over(own) + F.col(f"of_{o}")).alias(o) for o, c in sums.items()])


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` -> ``(source, source_size, target)``.

    Sources in code point order, null last, weigh ``weights`` in turn and divide ``share`` times
    all sizes.  No target exceeds ``most`` times its source's size; the excess goes to the rest by
    weight.  That is one level ``x`` with ``target = min(most * size, x * weight)``.
    """
    placed = _running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], {"place": "one"}, "mix-places")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    order = [F.col("full_at").asc(), F.col("source").asc_nulls_last()]
    levels = _running(capped.drop("place", "one"), order, {"caps": "cap", "weight_sum": "weight"}, "mix-levels")
    whole = levels.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("all_weight"))
    # with all sources before this one full, the level is what they leave over the weight they leave
    level = (F.col("words") * F.lit(float(share)) - (F.col("caps") - F.col("cap"))) / (F.col("all_weight") - F.col("weight_sum") + F.col("weight"))
    found = levels.join(F.broadcast(whole)).withColumn("level", level).where("level <= full_at").agg(F.min_by("level", F.struct("full_at", F.col("weight_sum"))).alias("x"))
    return levels.join(F.broadcast(found)).select("source", "source_size", F.coalesce(F.least("cap", F.col("x") * F.col("weight")), "cap").alias("target"))


def _played(buckets: DataFrame, seed: int) -> DataFrame:
    """Plays each row's array ``items``; adds ``out`` (decided) and ``left`` (the survivor)."""

    def with_mass(item: Column, mass: Column) -> Column:
        return F.struct(*[item[c].alias(c) for c in ("ord", "h", "doc_id", "copy", "size")], mass.alias("mass"))

    def step(state: Column, x: Column) -> Column:
        a = state["left"]

        def moved(t: Column) -> Column:
            gains = t["u"] * (t["up"] + t["down"]) < t["down"]
            mass_a = F.when(gains, F.when(t["up"] == a["size"] - a["mass"], a["size"].cast("double")).otherwise(a["mass"] + t["up"])).otherwise(a["mass"] - t["down"])
            mass_x = F.when(gains, x["mass"] - t["up"]).otherwise(F.when(t["down"] == x["size"] - x["mass"], x["size"].cast("double")).otherwise(x["mass"] + t["down"]))
            return F.struct(mass_a.alias("a"), mass_x.alias("x"))

        def settled(m: Column) -> Column:
            open_a = (m["a"] > 0) & (m["a"] < a["size"])
            return F.struct(
                F.concat(state["out"], F.array(F.when(open_a, with_mass(x, m["x"])).otherwise(with_mass(a, m["a"])))).alias("out"),
                F.when(open_a, with_mass(a, m["a"])).otherwise(with_mass(x, m["x"])).alias("left"),
            )

        up, down = F.least(a["size"] - a["mass"], x["mass"]), F.least(a["mass"], x["size"] - x["mass"])
        u = F.pmod(F.xxhash64(F.lit(seed), a["h"], x["h"]), F.lit(_UNIT)) / F.lit(float(_UNIT))
        return _let(_let(F.struct(up.alias("up"), down.alias("down"), u.alias("u")), moved), settled)

    items = F.col("items")
    start = F.struct(F.slice(items, 1, 0).alias("out"), items[0].alias("left"))
    return buckets.withColumn("s", F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, step)).select("source", "bucket", "s.out", "s.left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, size_col: str | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, fan: int = 64, reserve: int = 512, seed: int = 7) -> DataFrame:
    """One row per input row: ``(doc_id, source, copy, size, source_size, target, copies, taken)``.

    ``size`` counts the words of the whole text (null: 0).  ``taken`` is ``copies * size``, at most
    ``most`` times the size; a source's ``taken`` adds up to its target within one small document.
    ``size_col`` names a column of words already counted, to be used instead of a text.
    Rows that repeat doc_id, source and size are told apart by ``copy`` (from 1).  Documents
    without words are taken 0 words.  Null sources form one source, placed last; null ids are
    ordinary ids.  Draws depend on seed, source, doc_id, size and copy only, so reruns agree
    whatever the partitions.  An empty table gives no rows; other columns are ignored.
    """
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (word_count(F.col(text_col)) if size_col is None else F.coalesce(F.col(size_col).cast("long"), F.lit(0))).alias("size"))
    rows = keep(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("m")).otherwise(0)).alias("n"))
    goals = targets(per_source.select("source", "source_size"), weights, share, most)
    goals = keep(goals.alias("g").join(per_source.alias("p"), F.col("g.source").eqNullSafe(F.col("p.source"))).select("g.*", "p.n"), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    units = (
        rows.alias("r")
        .join(goals.alias("g"), F.col("r.source").eqNullSafe(F.col("g.source")))
        .select("r.doc_id", "r.source", "r.size", "g.source_size", "g.target", "g.n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.m"))).alias("copy"))
        .withColumn("whole", F.floor(rate))
        .withColumn("mass", (rate - F.floor(rate)) * F.col("size"))
        .withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id", "size", "copy"))
    )
    units = keep(units, "mix-units")
    leaves = F.greatest(F.ceil(F.col("n") / fan), F.lit(1))
    held_back = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(_UNIT)) < F.least(F.lit(1.0), F.lit(float(reserve)) / F.col("n")) * F.lit(float(_UNIT))
    item = F.struct((-F.col("size")).alias("ord"), "h", "doc_id", "copy", "size", "mass").alias("item")
    players = units.where("mass > 0 AND size > 0").select("source", F.pmod(F.xxhash64(F.lit(seed + 2), "h"), leaves).alias("bucket"), held_back.alias("held_back"), item)
    waiting, at_root = players.where("not held_back").drop("held_back"), players.where("held_back").select("source", F.lit(0).cast("long").alias("bucket"), "item")
    most_leaves = goals.agg(F.max(leaves)).first()[0] or 1
    levels = 0
    while fan**levels < most_leaves:
        levels += 1
    decided = []
    for _ in range(levels):
        buckets = waiting.groupBy("source", "bucket").agg(F.array_sort(F.collect_list("item")).alias("items"))
        played = keep(_played(buckets, seed), "mix-level")
        decided.append(played.select("source", F.explode("out").alias("item")))
        waiting = played.select("source", F.floor(F.col("bucket") / fan).alias("bucket"), F.col("left").alias("item"))
    roots = waiting.unionByName(at_root).groupBy("source", F.lit(0).cast("long").alias("bucket")).agg(F.array_sort(F.collect_list("item")).alias("items"))
    # the last survivor of a source takes the nearer end; what that adds or lacks is made up by the
    # one decided document of the root whose size comes nearest to it, if that brings the sum closer
    over = F.when(F.col("left.mass") * 2 >= F.col("left.size"), F.col("left.size") - F.col("left.mass")).otherwise(-F.col("left.mass"))
    ended = _played(roots, seed).withColumn("over", over)
    able = F.filter("out", lambda x: F.when(F.col("over") > 0, x["mass"] > 0).otherwise(x["mass"] == 0))
    nearest = F.array_min(F.transform(able, lambda x: F.struct(F.abs(x["size"] - F.abs("over")).alias("gap"), x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["copy"].alias("copy"))))
    ended = ended.withColumn("fix", F.when(nearest["gap"] < F.abs("over"), nearest))
    items = ended.select("source", "fix", F.explode(F.concat(F.transform("out", lambda x: F.struct(x.alias("item"), F.lit(False).alias("is_last"))), F.array(F.struct(F.col("left").alias("item"), F.lit(True).alias("is_last"))))).alias("e")).select("source", "fix", "e.*")
    bit = F.when(F.col("is_last"), F.col("item.mass") * 2 >= F.col("item.size")).otherwise(F.col("item.mass") > 0)
    is_fix = F.coalesce(~F.col("is_last") & F.col("fix.doc_id").eqNullSafe(F.col("item.doc_id")) & (F.col("fix.h") == F.col("item.h")) & (F.col("fix.copy") == F.col("item.copy")), F.lit(False))
    chosen = items.select("source", "item.doc_id", "item.size", "item.copy", (bit != is_fix).alias("extra"))
    for part in decided:
        chosen = chosen.unionByName(part.select("source", "item.doc_id", "item.size", "item.copy", (F.col("item.mass") > 0).alias("extra")))
    same = F.col("u.source").eqNullSafe(F.col("c.source")) & F.col("u.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("u.size") == F.col("c.size")) & (F.col("u.copy") == F.col("c.copy"))
    copies = F.col("u.whole") + F.coalesce(F.col("c.extra"), F.lit(False)).cast("long")
    return units.alias("u").join(chosen.alias("c"), same, "left").select("u.doc_id", "u.source", "u.copy", "u.size", "u.source_size", "u.target", copies.alias("copies"), (copies * F.col("u.size")).alias("taken"))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
