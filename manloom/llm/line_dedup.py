"""Line dedup by pairwise alignment of documents that share lines.

Anchors are runs of whole lines that just reach so many words: from every line that is not blank
onward, and back from it; a long line is an anchor by itself, short ones are together with their
neighbours.  The holders of a rare anchor meet each other; those of a frequent one meet its first
holder only, so a line that a third of all documents share gives one pair per document, not one per
pair of them; a document meets the partners of all its anchors.  Each pair is aligned by patience diff over line
hashes: lines unique on both sides, in longest increasing order, widened while neighbours agree, and
again within every gap.  What moved or repeats is aligned after that, anchored at its runs.  Aligned
blocks of enough words are deleted from the later document, and nothing else is; the first holder of a
block never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import keep


def hashed_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and word count of every line; lines are equal up to white space."""
    words = [line.split() for line in text.encode().split(b"\n")]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(w)) for w in words], np.uint64).view(np.int64)
    return hashes, np.array([len(w) for w in words], np.int32)


_ODD = 0x9E3779B97F4A7C17  # 3 modulo 4, so that neighbours that change places change the hash
_BACK = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)


def runs(hashes: np.ndarray, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash)`` of the runs of lines that just reach ``least`` words: onward from every
    line that is not blank, and back from it.  A line of ``least`` words gives itself.

    Blocks of at least ``least`` words that two texts share hold the same runs, and these cover all
    of their lines but blank ones at the edges."""
    n, least = len(words), max(1, least)
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    told = np.flatnonzero(np.asarray(words) > 0)
    onward = np.searchsorted(total, total[told] + least)  # the first end with enough words
    back = np.searchsorted(total, total[told + 1] - least, "right") - 1  # the last start with enough
    fits = onward <= n
    start, end = np.concatenate([told[fits], back[back >= 0]]), np.concatenate([onward[fits], told[back >= 0] + 1])
    pairs = np.unique(np.stack([start, end]), axis=1)
    sums = np.concatenate([np.zeros(1, np.uint64), (np.asarray(hashes, np.int64).view(np.uint64) * _powers(_ODD, n)[:n]).cumsum(dtype=np.uint64)])
    found = (sums[pairs[1]] - sums[pairs[0]]) * _powers(_BACK, n)[pairs[0]]
    return pairs[0], pairs[1], found.view(np.int64)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, sorted by their first part, whose second parts increase."""
    tops: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        back[i] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [y], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks ``(start in a, start in b, length)`` of two sequences, in order.

    Gaps without a line unique on both sides are anchored at the n-th occurrences of each line."""
    matched: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        once = {x for x, n in in_a.items() if n == 1 and in_b.get(x) == 1}
        if once:
            at_b = {b[j]: j for j in range(b0, b1) if b[j] in once}
            pairs = [(i, at_b[a[i]]) for i in range(a0, a1) if a[i] in once]
        else:
            seen_b: Counter = Counter()
            nth_b = {}
            for j in range(b0, b1):
                if b[j] in in_a:
                    seen_b[b[j]] += 1
                    nth_b[b[j], seen_b[b[j]]] = j
            seen_a: Counter = Counter()
            pairs = []
            for i in range(a0, a1):
                seen_a[a[i]] += 1
                if (j := nth_b.get((a[i], seen_a[a[i]]))) is not None:
                    pairs.append((i, j))
        left_a, left_b = a0, b0
        for i, j in [*_increasing(pairs), (a1, b1)]:
            if i < a1:
                matched.append((i, j))
            if pairs and left_a < i and left_b < j:
                todo.append((left_a, i, left_b, j))
            left_a, left_b = i + 1, j + 1
    blocks: list[tuple[int, int, int]] = []
    for i, j in sorted(set(matched)):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1] = (blocks[-1][0], blocks[-1][1], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    return blocks


def aligned_lines(a: np.ndarray, b: np.ndarray, a_words: np.ndarray, b_words: np.ndarray, block_words: int) -> list[int]:
    """Lines of ``b`` in blocks of at least ``block_words`` words that align with ``a``.

    Both whole texts are aligned first.  What moved or repeats is left over: a run that ``a`` holds
    too anchors both sides there, and the two runs are aligned."""
    left, right = a.tolist(), b.tolist()
    gone = np.zeros(len(b), bool)

    def align(at_a: int, end_a: int, at_b: int, end_b: int) -> None:
        for _, j, n in patience(left[at_a:end_a], right[at_b:end_b]):
            if int(b_words[at_b + j : at_b + j + n].sum()) >= block_words:
                gone[at_b + j : at_b + j + n] = True

    align(0, len(a), 0, len(b))
    if not gone.all():
        start_a, _, held = runs(a, a_words, block_words)
        place = dict(zip(held[::-1].tolist(), start_a[::-1].tolist(), strict=True))  # the first of equal runs
        start, end, found = runs(b, b_words, block_words)
        for k in np.flatnonzero(np.isin(found, held)):
            if not gone[start[k] : end[k]].all():
                p = place[int(found[k])]
                align(p, p + int(end[k] - start[k]), int(start[k]), int(end[k]))
    return np.flatnonzero(gone).tolist()


def _line_table(rows: DataFrame, line_words: int) -> DataFrame:
    def each(batches):
        for batch in batches:
            found = [hashed_lines(t.as_py()) for t in batch.column(2)]
            lists = [pa.array([h for h, _ in found], pa.list_(pa.int64())), pa.array([w for _, w in found], pa.list_(pa.int32()))]
            anchors = pa.array([np.unique(runs(h, w, line_words)[2]) for h, w in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, anchors], ["doc_id", "mark", "hashes", "words", "anchors"])

    return rows.select("doc_id", "mark", "text").mapInArrow(each, "doc_id long, mark long, hashes array<long>, words array<int>, anchors array<long>")


def shared_line_pairs(lines: DataFrame, rare: int = 4) -> DataFrame:
    """``(first, later, line_docs)``: documents that share an anchor; ``line_docs`` counts the holders
    of their rarest one.

    The holders of a rare anchor, one that at most ``rare`` documents hold, meet each other.  Those
    of a more frequent one meet its first holder only: that reaches every block, as the first holder
    of a run never loses it, and gives one pair a holder, however many there are."""
    held = keep(lines.select(F.struct("doc_id", "mark").alias("doc"), F.explode("anchors").alias("line")), "line-anchors")
    holders = keep(held.groupBy("line").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1"), "line-holders")
    # written apart: the planner may cut this join where a line is hot, as nothing is grouped by line after it
    met = keep(held.join(holders, "line").where((F.col("n") <= rare) | (F.col("first") != F.col("doc"))), "line-met")
    often = met.where(F.col("n") > rare).select("first", F.col("doc").alias("later"), "n")
    few = met.where(F.col("n") <= rare).groupBy("line", "n").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
    few = few.select("n", "docs", F.posexplode("docs").alias("place", "later")).select("n", "later", F.explode(F.expr("slice(docs, 1, place)")).alias("first"))
    return often.unionByName(few).groupBy("first", "later").agg(F.min("n").alias("line_docs"))


def _aligned(pairs: DataFrame, lines: DataFrame, block_words: int, slice_pairs: int = 2048) -> DataFrame:
    """``(doc_id, mark, from_id, gone array<int>)``: the lines of each later document to delete.

    A document that very many others meet is written into slices of about ``slice_pairs`` of them."""
    side = lambda name: lines.select(F.struct("doc_id", "mark").alias(name), F.col("hashes").alias(f"{name}_lines"), F.col("words").alias(f"{name}_words"))
    hot = keep(pairs.groupBy("first").agg(F.ceil(F.count("*") / slice_pairs).alias("slices")).where("slices > 1"), "line-hot")
    dealt = pairs.join(hot, "first", "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("later"), F.col("slices")), F.lit(0).cast("long"))).drop("slices")
    firsts = side("first").join(hot, "first", "left").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1).cast("long")) - 1))).drop("slices")
    both = dealt.join(side("later"), "later").join(firsts, ["first", "slice"])

    def each(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                gone = aligned_lines(r.first_lines, r.later_lines, r.first_words, r.later_words, block_words)
                if gone:
                    out.append((r.doc_id, r.mark, r.from_id, gone))
            yield pd.DataFrame(out, columns=["doc_id", "mark", "from_id", "gone"])

    rows = both.select("later.doc_id", "later.mark", F.col("first.doc_id").alias("from_id"), "first_lines", "later_lines", "first_words", "later_words")
    return rows.mapInPandas(each, "doc_id long, mark long, from_id long, gone array<int>")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, line_words: int = 8, block_words: int = 8, rare: int = 4) -> DataFrame:
    """One row per input row: ``(doc_id, n_lines, removed array<int>, from_ids array<long>, text)``.

    With ``block_words`` equal to ``line_words``, every line with words goes that lies in a block of
    so many words which an earlier document holds too, long or short as its lines may be.

    ``removed`` are the line numbers (from 0) deleted, ``from_ids`` earlier documents that hold
    them (all that share a rare run, the first holder of a frequent one), ``text`` what stays.  Null text counts as empty, which is one empty line.  Rows with
    a null id keep their text and lend no lines; rows that repeat an id are ordered by text hash;
    rows that repeat id and text are one document and lose the same lines.  Without shared lines,
    or on an empty table, nothing is removed.  Other columns are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    lines = keep(_line_table(rows.where("doc_id IS NOT NULL"), line_words).dropDuplicates(["doc_id", "mark"]), "line-hashes")
    pairs = keep(shared_line_pairs(lines, rare), "line-pairs")
    aligned = _aligned(pairs, lines, block_words)
    gone = aligned.groupBy("doc_id", "mark").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"), F.array_sort(F.collect_set("from_id")).alias("from_ids"))
    gone = keep(gone, "lines-gone")

    def each(batches):
        for batch in batches:
            texts, counts, numbers = [], [], batch.column(2).to_pylist()
            for text, removed in zip(batch.column(1), numbers, strict=True):
                whole = text.as_py()
                counts.append(whole.count("\n") + 1)
                dropped = set(removed or ())
                texts.append("\n".join(line for i, line in enumerate(whole.split("\n")) if i not in dropped) if dropped else whole)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array([n or [] for n in numbers], pa.list_(pa.int32())), pa.array([f or [] for f in batch.column(3).to_pylist()], pa.list_(pa.int64())), pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "removed", "from_ids", "text"],
            )

    joined = rows.join(gone.hint("shuffle_hash"), ["doc_id", "mark"], "left").select("doc_id", "text", "removed", "from_ids")
    return joined.mapInArrow(each, "doc_id long, n_lines long, removed array<int>, from_ids array<long>, text string")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
