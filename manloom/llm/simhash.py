"""SimHash near-duplicates found by covering locality-sensitive hashing.

Fingerprints: XXH64 of every word shingle, one majority bit per position.  Search: position
``i`` of a fingerprint carries a non-zero vector ``phi(i)`` over GF(2) of ``radius + 1``
dimensions; table ``v`` keeps the positions whose vector is not orthogonal to ``v``.  At most
``radius`` differing positions span a proper subspace, so some ``v`` is orthogonal to all of them
and its table drops every differing position: each pair within the radius shares a bucket.

Only distinct fingerprints are searched.  A bucket emits a spanning forest of its links, not its
pairs.  A bucket larger than ``block`` is split by what its table leaves out: of ``radius + 1`` parts
of those positions, a pair within the radius agrees in one, so every pair stays together in one
of them.  What is still larger is compared as pairs of blocks in separate tasks.

``near_copies`` serves whole corpora: fingerprints of words find the candidates, and one of
five-word shingles must agree as well.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import keep

_PART = 1 << 16


def fingerprint(raw: bytes, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes.  A-Z are lower-cased, words are runs of bytes
    other than 0x20 and 0x09-0x0D; no words give 0, fewer than ``width`` give one shingle."""
    text = b" ".join(raw.lower().split())
    if not text:
        return 0
    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.append(spaces, len(text))
    n = max(1, len(starts) - width + 1)
    starts, ends = starts[:n], ends[-n:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, _PART):  # bounded memory for very long texts
        cut = slice(at, min(n, at + _PART))
        hashes = np.array([digest(text[s:e], seed) for s, e in zip(starts[cut].tolist(), ends[cut].tolist(), strict=True)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column, width: int = 4) -> Column:
    """Fingerprint of each text as a signed long.  Null text counts as empty."""

    @F.pandas_udf("long")
    def each(raws: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(r or b"", width) for r in raws], np.uint64).view(np.int64))

    return each(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row ``(doc_id, fp)`` per input row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint_of(F.col(text_col), width).alias("fp"))


def covering_masks(radius: int) -> list[int]:
    """The ``2**(radius+1) - 1`` masks over 64 bits, as signed longs."""
    size = 1 << (radius + 1)
    masks = []
    for v in range(1, size):
        mask = sum(1 << i for i in range(64) if ((i % (size - 1) + 1) & v).bit_count() & 1)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _left_out(masks: list[int], parts: int) -> list[list[int]]:
    """The positions that each mask leaves out, in so many masks of their own."""
    told = []
    for mask in masks:
        out = [i for i in range(64) if not mask >> i & 1]
        own = [sum(1 << i for i in out[p::parts]) for p in range(parts)]
        told.append([m - (1 << 64) if m >> 63 else m for m in own])
    return told


def _forest(left: np.ndarray, right: np.ndarray, radius: int, guard_radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between (or, if the same array, within) two blocks of rows
    ``(node, fp, guard)``, or of fingerprints that are nodes themselves."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out, of = [], min(1, left.shape[1] - 1)
    for at in range(0, len(left), 256):
        part = left[at : at + 256]
        near = np.bitwise_count(part[:, of, None] ^ right[None, :, of]) <= radius
        if left.shape[1] > 2:
            near &= np.bitwise_count(part[:, 2, None] ^ right[None, :, 2]) <= guard_radius
        i, j = np.nonzero(near)
        for a, b in zip(part[i, 0].tolist(), right[j, 0].tolist(), strict=True):
            if a != b and (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def _block_links(radius: int, guard_radius: int):
    """Over rows sorted by (tab, key, i, j): the links of each pair of blocks."""

    def links(rows: np.ndarray) -> list[tuple[int, int]]:
        i, j, own, told = rows[0, 2], rows[0, 3], rows[:, 4], np.ascontiguousarray(rows[:, 5:]).view(np.uint64)
        first = told[own == i]
        return _forest(first, first if i == j else told[own == j], radius, guard_radius)

    def each(batches):
        held = None
        for batch in batches:
            told = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            held = told if held is None else np.concatenate([held, told])
            if not len(held):
                continue
            cuts = np.flatnonzero((held[1:, :4] != held[:-1, :4]).any(axis=1)) + 1
            out = [e for part in np.split(held, cuts)[:-1] for e in links(part)]
            held = held[cuts[-1] :] if len(cuts) else held
            yield from edges(out)
        if held is not None and len(held):
            yield from edges(links(held))

    def edges(out):
        if out:
            a, b = np.array(out, np.uint64).view(np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return each


def _links(nodes: DataFrame, fps: list[str], told: list[str], radius: int, block: int, guard_radius: int) -> DataFrame:
    """Edges over ``nodes``; ``told`` names the node (and guard, if any), ``fps`` its fingerprints."""
    masks = covering_masks(radius)
    tables = [F.struct(F.lit(s * len(masks) + t).alias("tab"), F.col(f).bitwiseAND(F.lit(m)).alias("key"), F.col(f).alias("fp")) for s, f in enumerate(fps) for t, m in enumerate(masks)]
    columns = ["fp"] if told == fps else [told[0], "fp", *told[1:]]
    others = [c for c in columns if c != "fp"]
    keyed = nodes.select(*others, F.explode(F.array(*tables)).alias("k")).select("k.tab", "k.key", *[F.col("k.fp") if c == "fp" else F.col(c) for c in columns])
    node = columns[0]
    buckets = keep(keyed.groupBy("tab", "key").agg(F.count("*").alias("n"), F.min(node).alias("a"), F.max(node).alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2 AND a <> b").select("a", "b")
    if len(columns) == 1:
        pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    else:  # nodes don't tell their fingerprints
        side = lambda end: nodes.select(F.col(node).alias(end), F.struct(*fps, *columns[2:]).alias(f"of_{end}"))
        pairs = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
        differ = lambda c: F.bit_count(F.col(f"of_a.{c}").bitwiseXOR(F.col(f"of_b.{c}")))
        pairs = pairs.where((F.least(*map(differ, fps)) <= radius) & (F.greatest(F.lit(0), *map(differ, columns[2:])) <= guard_radius)).select("a", "b")
    alone = F.lit(0).cast("long")
    small = keyed.join(buckets.where((F.col("n") > 2) & (F.col("n") <= block)).select("tab", "key"), ["tab", "key"]).select("tab", "key", alone.alias("i"), alone.alias("j"), alone.alias("own"), *columns)
    apart = F.array(*[F.array(*[F.lit(m) for m in parts]) for parts in _left_out(masks, radius + 1)])
    hot = keyed.join(buckets.where(F.col("n") > block).select("tab", "key"), ["tab", "key"])
    hot = hot.withColumn("apart", F.get(apart, F.pmod("tab", F.lit(len(masks))))).select("*", F.posexplode("apart").alias("part", "mask"))
    hot = hot.select((F.col("tab") * 64 + F.col("part") + 64).alias("tab"), F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), *columns)
    hot = keep(hot, "hot-buckets")
    sizes = hot.groupBy("tab", "key").agg(F.ceil(F.count("*") / block).alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    spread = (
        hot.join(sizes, ["tab", "key"])
        .withColumn("own", F.pmod(F.xxhash64(*columns), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("tab", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)
    )
    dealt = small.unionByName(spread).repartition("tab", "key", "i", "j").sortWithinPartitions("tab", "key", "i", "j")
    return pairs.union(dealt.mapInArrow(_block_links(radius, guard_radius), "a long, b long")).distinct()


def near_links(fps: DataFrame, radius: int = 4, block: int = 1024) -> DataFrame:
    """Edges ``(a, b)`` whose components are those of "differ in at most ``radius`` bits" over the
    distinct non-null values of ``fps.fp``.  Exact for every bucket size."""
    return _links(fps, ["fp"], ["fp"], radius, block, 64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per input row.

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing
    bits, itself included.  Null and empty texts have fingerprint 0 and link like any other; rows
    with a null doc_id keep their row and lend no id; repeated rows all get the same component; an
    empty table gives no rows; other columns are ignored whatever their names.
    """
    found = keep(fingerprints(docs, id_col, text_col, width), "simhash")
    distinct = keep(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    return found.join(_rooted(distinct, "fp", near_links(distinct.select("fp"), radius)), "fp").select("doc_id", "fp", "component_id")


def _rooted(distinct: DataFrame, node: str, links: DataFrame) -> DataFrame:
    """``(node, component_id)`` from ``distinct(node, least)`` and its links.

    Nodes without a link are components of their own.  Of the others the least id is taken in two
    steps, so that a component of very many nodes is not read by one task."""
    roots = keep(connected_components(links), "simhash-roots").withColumnRenamed("node", node)
    linked = keep(distinct.join(roots, node, "left"), "simhash-rooted")
    dealt = linked.where("root IS NOT NULL").groupBy("root", F.pmod(F.xxhash64(node), F.lit(64)).alias("slice")).agg(F.min("least").alias("least"))
    least = dealt.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long"))))
    told = linked.where("root IS NOT NULL").withColumn("slice", F.pmod(F.xxhash64(node), F.lit(64))).join(least, ["root", "slice"]).select(node, "component_id")
    return told.unionByName(linked.where("root IS NULL").select(node, F.col("least").alias("component_id")))


def copy_fingerprints(raw: bytes, shingle: int = 5) -> tuple[int, int, int]:
    """Two SimHashes of the words, each weighed by the root of its count, under two seeds, and the
    SimHash of the shingles."""
    counts = Counter(raw.lower().split())
    if not counts:
        return 0, 0, 0
    words, weights = list(counts), np.sqrt(np.array(list(counts.values()), float))
    found = []
    for seed in (42, 43):
        sums = np.zeros(64)
        for at in range(0, len(words), _PART):
            hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in words[at : at + _PART]], "<u8")
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += weights[at : at + _PART] @ bits
        found.append(int(np.packbits(2 * sums > weights.sum(), bitorder="little").view("<u8")[0]))
    return *found, fingerprint(raw, shingle)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 5, shingle_radius: int = 14, block: int = 1024) -> DataFrame:
    """``(doc_id, mark, component_id)``, one row per input row; ``mark`` is ``xxhash64`` of its text.

    Texts link if one of two SimHashes of their words differs in at most ``radius`` bits, found by
    covering tables, and the SimHash of their five-word shingles in at most ``shingle_radius``.
    Texts of a shingle similarity of 0.8 differ in some ten bits of that, unrelated ones in 32; over
    shingles alone, few pairs of 0.8 come within a radius that tables can cover.  Nulls, ties,
    repeats and empty tables are as in ``near_duplicates``.
    """

    @F.pandas_udf("a1 long, a2 long, guard long")
    def each(raws: pd.Series) -> pd.DataFrame:
        told = np.array([copy_fingerprints(r or b"", shingle) for r in raws], np.uint64).reshape(-1, 3).view(np.int64)
        return pd.DataFrame(told, columns=["a1", "a2", "guard"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), each(text.cast("binary")).alias("f"))
    found = keep(found.select("doc_id", "mark", "f.*"), "copies")
    key = ["a1", "a2", "guard"]
    distinct = keep(found.groupBy(*key).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "copies-distinct")  # numbered once, as written
    links = _links(distinct.select("node", *key), ["a1", "a2"], ["node", "guard"], radius, block, shingle_radius)
    rooted = distinct.select("node", *key).join(_rooted(distinct.select("node", "least"), "node", links), "node")
    return found.join(rooted.drop("node"), key).select("doc_id", "mark", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
