"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors lie in shards.  The index of a shard is its postings, one for each component that isn't
zero, cut into segments by quantised impact (the size of the value) and, within an impact, by
dimension; with them stands how long each vector still is below each impact.  It is written once
and read by the queries.  A block of queries takes the segments by falling impact and adds up what
they hold.  What is left of a vector can't add more than its remaining length times the query's
own, so a query leaves as soon as that proves all but a few vectors unable to enter its best ``k``;
those few are scored again exactly, from the integers.  Segments below the last impact that a query
of the block needs are never touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

_LEVELS = 16
_TOGETHER = 32  # queries that add up at once, so that their sums stay in the processor's cache
_PACKED = "part long, n int, dims int, ids binary, vectors binary"
_INDEXED = f"{_PACKED}, width long, rows binary, vals binary, starts binary, rests binary"


def scaled(embedding: Column, scale: float) -> Column:
    """``floor(scale * x)`` of every component, each taken as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def is_usable(embedding: Column) -> Column:
    """No null vector and no null, NaN or infinite component."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def packed(vectors: DataFrame, most: int) -> DataFrame:
    """Rows of up to ``most`` vectors of a partition as two binaries (little-endian int64)."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, piece = [], [], 0
        own = TaskContext.get().partitionId() << 32
        for pdf in batches:
            ids += pdf["id"].tolist()
            rows += list(pdf["v"])
            while len(ids) >= most:
                yield one(own + piece, ids[:most], rows[:most])
                ids, rows, piece = ids[most:], rows[most:], piece + 1
        if ids:
            yield one(own + piece, ids, rows)

    def one(part: int, ids: list, rows: list) -> pd.DataFrame:
        dims = max(map(len, rows))
        table = np.zeros((len(rows), dims), "<i8")  # shorter vectors end in zeros
        for i, row in enumerate(rows):
            table[i, : len(row)] = row
        return pd.DataFrame({"part": [part], "n": [len(ids)], "dims": [dims], "ids": [np.array(ids, "<i8").tobytes()], "vectors": [table.tobytes()]})

    return vectors.mapInPandas(each, _PACKED)


class ImpactIndex:
    """The segments of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, width: int, rows: np.ndarray, values: np.ndarray, starts: np.ndarray, rests: np.ndarray) -> None:
        self.ids, self.vectors, self.width, self.rows, self.values = ids, vectors, width, rows, values.astype(float)
        self.starts = starts  # of the segments, falling impact by falling impact, dimension by dimension
        self.rests = rests  # length of each vector that is left after each impact, a row an impact
        self.touched = 0  # postings times the queries that took them

    @classmethod
    def built(cls, ids: np.ndarray, vectors: np.ndarray) -> ImpactIndex:
        n, dims = vectors.shape
        width = int(np.abs(vectors).max(initial=0)) // _LEVELS + 1
        falling = _LEVELS - 1 - np.abs(vectors) // width  # 0 for the largest impact
        row, dim = np.nonzero(vectors)
        segment = falling[row, dim] * dims + dim
        order = np.argsort(segment, kind="stable")
        squares = np.stack([np.where(falling > level, vectors, 0).astype(float) for level in range(_LEVELS)]) if n else np.zeros((_LEVELS, 0, dims))
        rests = np.sqrt((squares * squares).sum(axis=2))
        return cls(ids, vectors, width, row[order].astype("<i4"), vectors[row, dim][order], np.searchsorted(segment[order], np.arange(_LEVELS * dims + 1)).astype("<i8"), rests)

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and scores of its ``k`` best vectors, its own id left out."""
        return [found for at in range(0, len(query_ids), _TOGETHER) for found in self._best(query_ids[at : at + _TOGETHER], queries[at : at + _TOGETHER], k)]

    def _best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, dims = self.vectors.shape
        own = self.ids[:, None] == query_ids[None, :]
        q = queries.astype(float)
        lengths = np.sqrt((q * q).sum(axis=1))
        whole = np.sqrt((self.vectors.astype(float) ** 2).sum(axis=1))
        rounding = 4 * (dims + 8) * np.finfo(float).eps  # of sums whose parts add up to no more than both lengths
        seen = np.zeros((n, len(q)))  # a vector a row, so that a posting adds to all queries at once
        possible: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        active = np.arange(len(q))
        for level in range(_LEVELS):
            first, last = self.starts[level * dims], self.starts[(level + 1) * dims]
            by_dim = np.ascontiguousarray(q[active].T)
            for d in range(dims) if last > first else ():
                lo, hi = self.starts[level * dims + d], self.starts[level * dims + d + 1]
                if hi > lo:
                    seen[self.rows[lo:hi]] += self.values[lo:hi, None] * by_dim[d]
                    self.touched += int(hi - lo) * len(active)
            left = self.rests[level]
            if level + 1 < _LEVELS and (last == first or np.median(left) > 0.45 * np.median(whole)):
                continue  # too little seen for a proof
            reach = (left + rounding * whole)[:, None] * lengths[active]
            low = np.where(own[:, active], -np.inf, seen - reach)
            bar = np.partition(np.ascontiguousarray(low.T), n - k, axis=1)[:, n - k] if n > k else np.full(len(active), -np.inf)
            can = (seen + reach >= bar) & ~own[:, active]
            proven = can.sum(axis=0) <= max(8 * k, n // 16)
            if level + 1 == _LEVELS:
                proven[:] = True
            for column in np.flatnonzero(proven):
                possible[active[column]] = np.flatnonzero(can[:, column])
            active, seen = active[~proven], seen[:, ~proven]
            if not len(active):
                break
        out = []
        for row, places in enumerate(possible):
            scores = self.vectors[places] @ queries[row]
            order = np.lexsort((self.ids[places], -scores))[:k]
            out.append((self.ids[places][order], scores[order]))
        return out


def _usable(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("e")).where("id IS NOT NULL").where(is_usable(F.col("e")))
    return rows.select("id", scaled(F.col("e"), scale).alias("v"))


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: float = 256.0, shard_rows: int = 8192) -> DataFrame:
    """One row per shard of up to ``shard_rows`` vectors with its segments, to be written and searched."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                one = ImpactIndex.built(np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(r.n, r.dims))
                told = {"width": one.width, "rows": one.rows.tobytes(), "vals": one.values.astype("<f8").tobytes(), "starts": one.starts.tobytes(), "rests": one.rests.astype("<f8").tobytes()}
                yield pd.DataFrame([{"part": r.part, "n": r.n, "dims": r.dims, "ids": r.ids, "vectors": r.vectors, **told}])

    return packed(_usable(vectors, id_col, vector_col, scale), shard_rows).mapInPandas(each, _INDEXED)


def search(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: float = 256.0, block_rows: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from a written ``build_index`` of the same scale."""
    blocks = packed(_usable(queries, id_col, vector_col, scale), block_rows)
    cells = max(1, index.count())
    shards = index.select([F.col(c).alias(f"s_{c}") for c in index.columns]).withColumn("cell", F.pmod(F.xxhash64("s_part"), F.lit(cells)))
    blocks = blocks.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    met = blocks.join(shards, "cell")  # every query block meets every shard once

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, shard = None, None
        for pdf in batches:
            for r in pdf.itertuples():
                if held != r.s_part:
                    held = r.s_part
                    shard = ImpactIndex(
                        np.frombuffer(r.s_ids, "<i8"), np.frombuffer(r.s_vectors, "<i8").reshape(r.s_n, r.s_dims), r.s_width, np.frombuffer(r.s_rows, "<i4"), np.frombuffer(r.s_vals, "<f8"),
                        np.frombuffer(r.s_starts, "<i8"), np.frombuffer(r.s_rests, "<f8").reshape(_LEVELS, r.s_n),
                    )
                ids, table = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(r.n, r.dims)
                if r.dims < r.s_dims:
                    table = np.pad(table, ((0, 0), (0, r.s_dims - r.dims)))
                found = shard.best(ids, table[:, : r.s_dims], k)
                sizes = [len(f[0]) for f in found]
                yield pd.DataFrame(
                    {
                        "part": r.part, "row": np.repeat(np.arange(r.n), sizes), "query_id": np.repeat(ids, sizes),
                        "vec_id": np.concatenate([f[0] for f in found]), "score": np.concatenate([f[1] for f in found]),
                    }
                )

    best = met.mapInPandas(each, "part long, row long, query_id long, vec_id long, score long")
    place = Window.partitionBy("part", "row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", *, scale: float = 256.0, shard_rows: int = 8192, block_rows: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query row's ``k`` best vectors by integer inner
    product, ties to the smaller id, all of them if fewer.

    A query's own id is not among its candidates.  Vectors that are null or hold null, NaN or
    infinite components and rows with a null id take no part; shorter vectors count as ending in
    zeros; repeated candidates each take a rank and repeated queries are answered each; empty
    tables give no rows.  Other columns are ignored whatever their names.  Scores are exact while
    they fit a long and components stay below 2**53.
    """
    index = keep(build_index(vectors, id_col, vector_col, scale=scale, shard_rows=shard_rows), "topk-index")
    return search(index, queries, k, id_col, vector_col, scale=scale, block_rows=block_rows)


def op2_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
