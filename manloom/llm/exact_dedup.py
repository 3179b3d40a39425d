"""Exact dedup by composable polynomial fingerprints.

A text is a polynomial over its UTF-8 bytes, taken modulo two primes.  Fingerprints compose:
``h(xy) = h(x) * B**len(y) + h(y)``, so segments of a very long text are hashed by separate tasks
and joined by length-shifted arithmetic.  Texts of equal fingerprint and length are then compared
with the keeper of their group chunk by chunk, in a streaming window over salted slices of the
group; those that differ form a new group and go through the same comparison again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import keep

#: Two primes below 2**31 and a base for each.
MODULI = (2147483647, 2147483629)
BASES = (1099087573, 1442695041)
_BLOCK = 4096


class Polynomial:
    """Fingerprints modulo ``moduli``; smaller moduli serve to test collisions."""

    def __init__(self, moduli: tuple[int, int] = MODULI) -> None:
        self.moduli = moduli
        # byte * power sums to less than 2**51 over a block, so float64 products are exact
        self.powers = np.array([[pow(b, i, m) for b, m in zip(BASES, moduli, strict=True)] for i in range(_BLOCK - 1, -1, -1)], np.float64)

    def of(self, raw: bytes) -> tuple[int, int]:
        if not raw:
            return 0, 0
        padded = np.frombuffer(bytes(-len(raw) % _BLOCK) + raw, np.uint8).reshape(-1, _BLOCK)  # leading zeros weigh nothing
        total = (0, 0)
        for at in range(0, len(padded), 256):
            for sums in (padded[at : at + 256].astype(np.float64) @ self.powers).astype(np.int64).tolist():
                total = self.joined(total, tuple(sums), _BLOCK)
        return total

    def joined(self, left: tuple[int, int], right: tuple[int, int], right_bytes: int) -> tuple[int, int]:
        """The fingerprint of two texts put together."""
        return tuple((x * pow(b, right_bytes, m) + y) % m for x, y, b, m in zip(left, right, BASES, self.moduli, strict=True))

    def packed(self, pair: tuple[int, int]) -> int:
        return pair[0] << 31 | pair[1]

    def unpacked(self, fp: int) -> tuple[int, int]:
        return fp >> 31, fp & ((1 << 31) - 1)


def normalised(text: Column) -> Column:
    """Each run of 0x20 and 0x09-0x0D becomes one space; null becomes empty."""
    changes = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"  # the runs that aren't one space already
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), changes, " ")


def _hashed(rows: DataFrame, poly: Polynomial) -> DataFrame:
    """``(doc_id, digest, mark, part, norm)`` -> ``(doc_id, digest, mark, part, n_bytes, fp)``."""

    def each(batches):
        for batch in batches:
            raws = batch.column(4).cast(pa.binary()).to_pylist()
            fps = pa.array([poly.packed(poly.of(r)) for r in raws], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([len(r) for r in raws], pa.int64()), fps], ["doc_id", "digest", "mark", "part", "n_bytes", "fp"])

    return rows.select("doc_id", "digest", "mark", "part", "norm").mapInArrow(each, "doc_id long, digest string, mark long, part long, n_bytes long, fp long")


def fingerprints(rows: DataFrame, poly: Polynomial, segment: int) -> DataFrame:
    """``(doc_id, digest, mark, n_bytes, fp, copies)``: one row per distinct doc_id and text.

    ``rows(doc_id, raw, mark, norm, digest)``; of raw texts that are equal once normalised the least
    ``mark`` stands for all.  Texts over ``segment`` bytes are hashed in parts that are dealt over
    all tasks.
    """
    is_long = F.octet_length(F.coalesce("raw", F.lit(""))) > segment
    short = _hashed(rows.where(~is_long).withColumn("part", F.lit(0).cast("long")), poly)
    step = F.greatest(F.lit(segment), F.ceil(F.length("norm") / 64)).cast("int")
    parts = rows.where(is_long).withColumn("step", step).withColumn("part", F.explode(F.expr("sequence(0L, greatest(ceil(length(norm) / step) - 1, 0L))")))
    parts = parts.withColumn("norm", F.expr("substring(norm, cast(part * step + 1 as int), step)")).repartition("doc_id", "digest", "part")
    parts = _hashed(parts, poly).groupBy("doc_id", "digest", "part").agg(F.min("mark").alias("mark"), F.first("n_bytes").alias("n_bytes"), F.first("fp").alias("fp"), F.count("*").alias("copies"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pair, size = (0, 0), 0
        for row in pdf.sort_values("part").itertuples():
            pair, size = poly.joined(pair, poly.unpacked(row.fp), row.n_bytes), size + row.n_bytes
        return pdf.head(1).assign(fp=poly.packed(pair), n_bytes=size)[["doc_id", "digest", "mark", "n_bytes", "fp", "copies"]].astype({"doc_id": "Int64"})

    long = parts.groupBy("doc_id", "digest").applyInPandas(whole, "doc_id long, digest string, mark long, n_bytes long, fp long, copies long")
    short = short.groupBy("doc_id", "digest", "n_bytes", "fp").agg(F.min("mark").alias("mark"), F.count("*").alias("copies"))
    return short.unionByName(long)


def _same_row(left: str, right: str) -> Column:
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (F.col(f"{left}.digest") == F.col(f"{right}.digest"))


def _compared(rows: DataFrame, members: DataFrame, chunk: int, slice_rows: int) -> DataFrame:
    """Every member against its keeper, chunk by chunk: ``(doc_id, digest, keep_id, keep_digest, same)``.

    A group's chunk is cut into slices of about ``slice_rows`` members; the keeper's chunk is
    written once into each slice, sorts first there, and streams past as the window's first value.
    """
    # raw texts meet the members by id and mark; only those that are members are normalised again
    same = F.col("t.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("t.mark") == F.col("m.mark"))
    texts = rows.select("doc_id", "mark", "raw").alias("t").join(members.hint("shuffle_hash").alias("m"), same).select("m.*", normalised(F.col("t.raw")).alias("norm"))
    pieces = texts.withColumn("step", F.greatest(F.lit(chunk), F.ceil(F.col("n_bytes") / 64)).cast("int")).select(
        "doc_id", "digest", "keep_id", "keep_digest", "k",
        F.posexplode(F.expr("transform(sequence(0L, greatest(ceil(length(norm) / step) - 1, 0L)), i -> substring(norm, cast(i * step + 1 as int), step))")).alias("chunk_no", "piece"),
    )
    slices = F.ceil(F.col("k") / slice_rows)
    leads = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("digest") == F.col("keep_digest"))
    dealt = pieces.withColumn("leads", leads).withColumn(
        "slice", F.explode(F.when(F.col("leads"), F.sequence(F.lit(0).cast("long"), slices - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id", "digest"), slices))))
    )
    first = F.first("piece").over(Window.partitionBy("keep_id", "keep_digest", "chunk_no", "slice").orderBy(F.desc("leads")))
    return dealt.withColumn("same", F.col("piece") == first).groupBy("doc_id", "digest", "keep_id", "keep_digest").agg(F.min("same").alias("same"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, segment: int = 1 << 20, chunk: int = 1 << 16, slice_rows: int = 64, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """One row per input row: ``(doc_id, keep_id, group_size, kept, text_sha256, mark)``; ``mark`` is
    ``xxhash64`` of one of the raw texts that the row's id has for this text, the same for all of them.

    Texts are equal when identical after every run of white space became one space (no trimming).
    Null text counts as empty; all empty texts are one group.  Of equal texts the row with the
    smallest doc_id stays; a null doc_id stays only if no other row has the text.  Of rows that
    repeat both doc_id and text exactly one is kept; equal doc_ids with different texts are
    separate.  An empty table gives no rows.  Other columns are ignored whatever their names.
    """
    poly = Polynomial(moduli)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("raw"))
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("raw", F.lit(""))))
    hashed = rows.withColumn("norm", normalised(F.col("raw"))).withColumn("digest", F.sha2("norm", 256))
    found = keep(fingerprints(hashed, poly, segment), "exact-fingerprints")
    pending, settled = found.select("doc_id", "digest", "mark", "n_bytes", "fp"), []
    while True:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest"))
        # written apart, so that both sides of the join are plain shuffles and a huge group can be split
        groups = keep(pending.groupBy("fp", "n_bytes").agg(first.alias("keeper"), F.count("*").alias("k")).where("k > 1"), "exact-groups")
        members = pending.join(groups, ["fp", "n_bytes"]).select("doc_id", "digest", "mark", "n_bytes", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.digest").alias("keep_digest"), "k")
        checked = keep(_compared(rows, members, chunk, slice_rows), "exact-checked")
        settled.append(checked.where("same").drop("same"))
        differ = checked.where("not same")
        if differ.isEmpty():
            break
        pending = keep(differ.alias("x").join(found.alias("f"), _same_row("x", "f")).select("f.doc_id", "f.digest", "f.mark", "f.n_bytes", "f.fp"), "exact-pending")
    known = settled[0]
    for more in settled[1:]:
        known = known.unionByName(more)
    by_row = found.alias("f").join(known.alias("s"), _same_row("f", "s"), "left").select(
        "f.doc_id", "f.digest", "f.mark", "f.copies",
        F.when(F.col("s.keep_digest").isNull(), F.col("f.doc_id")).otherwise(F.col("s.keep_id")).alias("keep_id"),
        F.coalesce("s.keep_digest", "f.digest").alias("keep_digest"),
    )
    by_row = keep(by_row, "exact-rows")
    sizes = keep(by_row.groupBy("keep_id", "keep_digest").agg(F.sum("copies").alias("n")).where("n > 1"), "exact-sizes")
    same_group = F.col("r.keep_id").eqNullSafe(F.col("z.keep_id")) & (F.col("r.keep_digest") == F.col("z.keep_digest"))
    return (
        by_row.alias("r")
        .join(sizes.alias("z"), same_group, "left")
        .select("r.doc_id", "r.keep_id", F.coalesce("z.n", F.lit(1)).alias("group_size"), "r.digest", "r.mark", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.copies"))).alias("copy"))
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), F.col("digest").alias("text_sha256"), "mark")
    )


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("mark")


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t
"""
