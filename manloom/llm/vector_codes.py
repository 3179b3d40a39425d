"""Product codes of vectors: parts of a vector are replaced by the nearest entry of a codebook each.

Nearest entries are found by annular pruning.  Entries lie sorted by norm.  An entry whose norm is
further from a part's norm than some known entry is from the part can't be nearer, so the distance
of the best entry found so far bounds an interval of norms; its ends are found by binary search, and
only the entries within, ends included, are compared exactly, in integers.

Codebooks are learned in rounds: every task adds its parts up by nearest entry, Spark adds up the
tasks' sums, and the next codebooks (as many numbers as ``entries`` vectors have) go to the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep
from .topk import is_usable

_BLOCK = 2048  # parts compared at once
_SIDE = 8  # entries on either side of the norm that are compared before the interval is set anew
_FAR = np.iinfo(np.int64).max
_MOST = 1 << 27  # components are held within this, so that 64 squared differences fit a long


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index and squared distance of each point's nearest entry, ties to the lower index, and
    how many exact comparisons that took.  Both arrays hold integers, one vector a row."""
    length = lambda v: np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
    norms = length(entries)
    order = np.argsort(norms, kind="stable")
    norms, columns, k = norms[order], np.ascontiguousarray(entries[order].T), len(entries)
    index, distance, compared = np.empty(len(points), np.int64), np.empty(len(points), np.int64), 0
    sides = np.concatenate([-1 - np.arange(_SIDE), np.arange(_SIDE)])
    for at in range(0, len(points), _BLOCK):
        rows, block = np.arange(at, min(at + _BLOCK, len(points))), points[at : at + _BLOCK]
        own, best, which = length(block), np.full(len(rows), _FAR), np.full(len(rows), k)
        left = np.searchsorted(norms, own)  # entries from left to right have been compared
        right, low, high = left, np.zeros_like(left), np.full_like(left, k)
        while len(rows):
            place = np.where(sides < 0, left[:, None], right[:, None]) + sides
            within = (place >= low[:, None]) & (place < high[:, None])
            place = np.where(within, place, 0)
            compared += int(within.sum())
            found = sum((x[:, None] - column[place]) ** 2 for x, column in zip(block.T, columns, strict=True))
            found = np.where(within, found, _FAR)
            least = np.minimum(best, found.min(axis=1))
            tied = np.where(found == least[:, None], order[place], k).min(axis=1)
            which, best = np.minimum(np.where(least < best, k, which), tied), least
            left, right = np.maximum(left - _SIDE, 0), np.minimum(right + _SIDE, k)
            reach = np.sqrt(best.astype(np.float64))
            reach += 1e-9 * (own + reach + 1)  # norms and roots are rounded
            low, high = np.searchsorted(norms, own - reach, "left"), np.searchsorted(norms, own + reach, "right")
            more = (left > low) | (right < high)
            index[rows[~more]], distance[rows[~more]] = which[~more], best[~more]
            rows, block, own, best, which, left, right, low, high = (v[more] for v in (rows, block, own, best, which, left, right, low, high))
    return index, distance, compared


def _integers(lists: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are usable, and ``floor(scale * x)`` of those, padded with zeros to ``dims``."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls turn into NaN
    row = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    usable = lists.is_valid().to_numpy(zero_copy_only=False).copy()
    fine = np.isfinite(values)
    usable[row[~fine]] = False
    out = np.zeros((len(lists), dims), np.int64)
    row, place, values = row[fine], place[fine], values[fine]
    out[row, place] = np.clip(np.floor(scale * values), -_MOST, _MOST).astype(np.int64)
    return usable, out[usable]


def _vectors(vectors: DataFrame, *columns: str) -> DataFrame:
    return vectors.select(*[F.col(c).alias(n) for c, n in zip(columns[:-1], ("vec_id", "label"), strict=False)], F.col(columns[-1]).cast("array<double>").alias("v"))


def first_entries(vectors: DataFrame, id_col: str, vector_col: str, *, parts: int, entries: int, scale: float) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` out of the usable vectors of the smallest ids; of rows
    that repeat an id the lesser vectors first, null ids last."""
    usable = _vectors(vectors, id_col, vector_col).where(is_usable(F.col("v")))
    dims = -(-(usable.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    first = usable.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    if isinstance(first, pa.ChunkedArray):
        first = pa.concat_arrays(first.chunks) if first.num_chunks else pa.array([], pa.list_(pa.float64()))
    _, whole = _integers(first, dims, scale)
    return whole.reshape(len(whole), parts, dims // parts if parts else 0).transpose(1, 0, 2)


def _next_entries(vectors: DataFrame, vector_col: str, books: np.ndarray, scale: float) -> np.ndarray:
    parts, entries, width = books.shape

    def each(batches):
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, whole = _integers(batch.column(0), parts * width, scale)
            for part in range(parts):
                points = whole[:, part * width : (part + 1) * width]
                index, _, _ = nearest(points, books[part])
                np.add.at(sums[part], index, points)
                counts[part] += np.bincount(index, minlength=entries)
        part, entry = np.nonzero(counts)
        held = sums[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(held.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part * entries + entry), pa.array(counts[part, entry]), lists], ["cell", "n", "sums"])

    added = _vectors(vectors, vector_col).mapInArrow(each, "cell long, n long, sums array<long>")
    added = added.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    out = books.copy().reshape(parts * entries, width)
    for r in added.collect():  # at most one row per entry of a codebook
        out[r["cell"]] = np.array(r["sums"], np.int64) // r["n"]  # rounds down
    return out.reshape(books.shape)


def fit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> np.ndarray:
    """Codebooks ``[part, entry, position]`` of integers, in units of ``1 / scale``.

    They start as the parts of the ``entries`` smallest ids' vectors.  A round assigns every part to
    its nearest entry and replaces each entry by the rounded down mean of its parts; entries
    without parts stay.
    """
    books = first_entries(vectors, id_col, vector_col, parts=parts, entries=entries, scale=scale)
    if books.shape[1] and books.shape[2]:
        for _ in range(rounds):
            books = _next_entries(vectors, vector_col, books, scale)
    return books


def encode(vectors: DataFrame, books: np.ndarray, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, scale: float = 256.0) -> DataFrame:
    """``(vec_id, label, code, error)`` per usable vector: the nearest entries' indices in two hex
    digits a part, and the squared distances added up.  At most 256 entries a part."""
    parts, entries, width = books.shape
    told = _vectors(vectors, id_col, label_col, vector_col)
    digits = np.array([f"{i:02x}" for i in range(256)], "U2")
    schema = f"vec_id {told.schema['vec_id'].dataType.simpleString()}, label {told.schema['label'].dataType.simpleString()}, code string, error long"

    def each(batches):
        for batch in batches:
            usable, whole = _integers(batch.column(2), parts * width, scale)
            index, error = np.zeros((len(whole), parts), np.int64), np.zeros(len(whole), np.int64)
            for part in range(parts if width else 0):
                index[:, part], distance, _ = nearest(whole[:, part * width : (part + 1) * width], books[part])
                error += distance
            codes = np.ascontiguousarray(digits[index]).view(f"U{2 * parts}")[:, 0] if len(whole) else np.array([], "U1")
            held = pa.array(usable)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(held), batch.column(1).filter(held), pa.array(codes, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return told.mapInArrow(each, schema)


def decoded(code: Column, books: np.ndarray, scale: float = 256.0) -> Column:
    """The vector that a code stands for: the middles of the integers' unit cells."""
    table = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / scale) for x in entry]) for entry in book]) for book in books])
    index = lambda i: F.conv(F.substring(code, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda i: F.get(F.get(table, i), index(i))))


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(coded: DataFrame, share: int = 256) -> DataFrame:
    """Adds ``label_error``: ``error`` added up over rows of an equal label, nulls together; null
    where that exceeds a long.

    Labels that hold over a ``share``-th of all rows, fewer than ``share`` of them, are shared with
    every task; the rows of the rest meet their sums by label.
    """
    coded = keep(coded, "vector-codes")
    sums = keep(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    total = sums.agg(F.sum("n")).first()[0] or 0
    common, rare = sums.where(F.col("n") * share > total).drop("n"), sums.where(F.col("n") * share <= total).drop("n")
    c = coded.alias("c")
    same = F.col("c.label").eqNullSafe(F.col("s.label"))
    often = c.join(F.broadcast(common.alias("s")), same).select("c.*", "s.label_error")
    seldom = c.join(F.broadcast(common.alias("s")), same, "left_anti").join(rare.alias("s"), same).select("c.*", "s.label_error")
    return often.unionByName(seldom)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0) -> DataFrame:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)``, one row per usable vector.

    Vectors that are null or hold null, NaN or infinite components are left out.  Vectors shorter
    than the longest, and a length that ``parts`` doesn't divide, count as ending in zeros; empty
    vectors are all zeros.  Repeated rows are coded each, a null id is the largest, fewer rows than
    ``entries`` give fewer entries, ties go to the lower index.  An empty table gives no rows; other
    columns are ignored whatever their names.  Components beyond 2**27 / ``scale`` count as that.
    """
    books = fit(vectors, id_col, vector_col, parts=parts, entries=entries, rounds=rounds, scale=scale)
    if not books.shape[1]:  # no usable vector
        vectors, books = vectors.limit(0), np.zeros((parts, 1, 1), np.int64)
    coded = encode(vectors, books, id_col, vector_col, label_col, scale=scale)
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(books_digest(books)))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


_ASSIGN = """
a{r} AS (
  SELECT rid, part, min(list_sum(list_transform(list_zip(v, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 64 + entry) AS k
  FROM p JOIN c{r} USING (part) GROUP BY rid, part
)"""
_UPDATE = """
u{r} AS (SELECT part, k % 64 AS entry, pos, sum(v[pos])::BIGINT AS s, count(*) AS n FROM a{r} JOIN p USING (rid, part), range(1, 5) g(pos) GROUP BY ALL),
c{n} AS (
  SELECT part, entry, coalesce(m.e, c{r}.e) AS e FROM c{r}
  LEFT JOIN (SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS e FROM u{r} GROUP BY part, entry) m USING (part, entry)
)"""
OP13_SQL = (
    """
WITH d AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
p AS (SELECT rid, part, v[part * 4 + 1 : part * 4 + 4] AS v FROM d, range(16) g(part)),
c0 AS (SELECT part, rid AS entry, v AS e FROM p WHERE rid < 64),"""
    + ",".join(_ASSIGN.format(r=r) + ("," + _UPDATE.format(r=r, n=r + 1) if r < 2 else "") for r in range(3))
    + """,
b AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
r AS (SELECT rid, string_agg(printf('%02x', k % 64), '' ORDER BY part) AS code, sum(k // 64)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN d USING (rid), b
"""
)
