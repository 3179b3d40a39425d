"""Connected components of an edge table by alternating star contractions.

Every step is a grouped minimum (combined map-side) and an equi-join, so one vertex with very
many neighbours costs a skewed join that the adaptive planner splits, never one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, keep


def _toward_minimum(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges ``(a, b)`` with ``a > b``.

    ``large``: every vertex links its larger neighbours to the least vertex of its star.
    Otherwise every vertex links itself and its smaller neighbours to the least of them.
    """
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        linked = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return linked.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any orientation -> ``(node, root)`` for every vertex that has an edge;
    ``root`` is the least vertex of its component (the root itself included).

    Null ends and loops are ignored; repeated edges do no harm; no edges give no rows.
    """
    now = keep(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or seen[0] == 0:
            break
        mark = tuple(seen)
        before, now = now, keep(_toward_minimum(_toward_minimum(now, True), False), "edges")
        drop(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
