"""Best-fit packing of token sequences, planned over a histogram of lengths.

Best fit places long pieces first, each into the fullest sequence that still takes it.  Which pieces
have a length doesn't matter to that, only how many; so the plan is made over the counts of the at
most ``size`` lengths, with sequences that look alike as one group.  It comes out as runs: ``n``
pieces of one length, by rank, over consecutive sequences at one offset.  Filling a group to the end
leaves it less than half its room, and at most one group is split per length, so a plan has
O(size log size) runs however many documents there are.

Runs are spread out into slots, and pieces take theirs by joining on rank within length.  Ranks need
no sort: each task numbers its pieces of a length as it writes them, and counts of tasks shift them.
"""

from __future__ import annotations

import bisect
import json
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _byte_letters
from .scratch import keep

_KEPT_CHARS = 64
#: Fixed value: how the tokenizer cuts texts before its merges.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CHUNK = 1 << 16  # slots of a run that one task spreads out


class Words(dict):
    """Maps what follows a blank in a text, up to the next blank before a letter or sign, to the
    packed ids of the blank and it.

    The tokenizer's pattern always begins a new piece at a blank before something that is not white
    space, so texts may be cut there.  Words of up to 64 characters are kept; a full table steps
    back, and what is asked for again moves over from it into the next.  Where merges rank as their
    ids do, words are encoded by rank (tiktoken), which is quicker and gives the same ids; the rest,
    and texts with special tokens, are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str, max_kept: int = 250_000) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranked = _ranked(path)
        self.max_kept, self.older = max_kept, {}

    def whole(self, text: str) -> bytes:
        """The packed ids of a text, by the library itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        """The packed ids of a text without special tokens."""
        if self.ranked is None:
            return self.whole(text)
        try:
            ids = array("I", self.ranked.encode_ordinary(text))
        except ValueError:  # very long white space overflows its pattern matcher
            return self.whole(text)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __missing__(self, word: str) -> bytes:
        packed = self.older.get(word)
        if packed is None:
            packed = self.part(" " + word)
        if len(word) <= _KEPT_CHARS:
            if len(self) >= self.max_kept:
                self.older = dict(self)
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text, as the library gives them."""
        if any(s in text for s in self.special):
            return self.whole(text)
        words = _cuts(text)
        return self.part(words[0]) + b"".join(map(self.__getitem__, words[1:]))


def _ranked(path: str):
    """The vocabulary as ranks of byte strings, if joining ranks as the joined tokens' ids do."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    joined = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not spec.get("normalizer") and not model.get("ignore_merges")
    if not plain or any(a >= b for a, b in zip(joined, joined[1:], strict=False)) or min(joined, default=0) < 256:
        return None
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranked", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _cuts(text: str) -> list[str]:
    """The text cut at every blank that something other than white space follows."""
    words = text.split(" ")
    if not any(w == "" or w[0].isspace() for w in words[1:]):
        return words
    out = words[:1]
    for w in words[1:]:
        if w == "" or w[0].isspace():
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@lru_cache(maxsize=2)
def load(path: str) -> Words:
    """The vocabulary of a Python worker, read once."""
    return Words(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, dealt, nth)``, and ``ids`` (packed) if asked for.

    A text's ids and ``end`` make a document's tokens.  Only those of over ``size`` tokens are cut,
    into pieces of ``size`` after a first piece of the remainder.  ``dealt`` is the task that read
    the document, and ``nth`` (from 0) counts its pieces of the same length.  Null and empty texts
    are ``end`` alone; repeated rows and null ids have their own pieces; an empty table gives none.
    """
    path = vocabulary or default_vocabulary()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "dealt", "nth"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    last = int(end).to_bytes(4, "little")

    def each(batches):
        words, own, seen = load(path), TaskContext.get().partitionId(), [0] * (size + 1)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = memoryview(words.encode(text.as_py() or "") + last)
                start, total, piece = 0, len(data) // 4, 0
                while start < total:
                    length = (total % size or size) if piece == 0 else size
                    held = data[4 * start : 4 * (start + length)]
                    rows.append((doc, piece, start, length, zlib.crc32(held), own, seen[length], *([bytes(held)] * with_ids)))
                    seen[length] += 1
                    start, piece = start + length, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, dealt int, nth long"
    return read.mapInArrow(each, schema + ", ids binary" * with_ids)


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs ``(length, rank, n, each, sequence, place)``: the ``n`` pieces of a length from ``rank``
    (from 0) on go to the sequences from ``sequence`` on, ``each`` of them side by side in one, the
    first at ``place``.

    Longest first, always into the sequences with the least room that is enough.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups of (first sequence, sequences)
    order: list[int] = []  # the rooms, ascending
    runs, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(order, room)
            rooms[room].append((first, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(order, length)
            if at < len(order):
                room = order[at]
                first, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            each = room // length
            full = min(n, left // each)  # sequences that take as many as fit
            if full:
                runs.append((length, rank, full * each, each, first, size - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                rest = left if left < each else 0
                if rest:
                    runs.append((length, rank, rest, each, first + full, size - room))
                    put(room - rest * length, first + full, 1)
                    rank, left, full = rank + rest, 0, full + 1
                put(room, first + full, n - full)
    return runs


def slots(spark, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """``(length, rank, sequence_id, offset)``: every place of a plan, spread out by Spark."""
    table = spark.createDataFrame(runs, "length long, rank long, n long, each long, sequence long, place long")
    cut = table.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {_CHUNK}L)")))
    cut = cut.repartition("length", "rank", "from").withColumn("i", F.explode(F.expr(f"sequence(`from`, least(`from` + {_CHUNK} - 1, n - 1))")))
    step = F.col("i") % F.col("each") * F.col("length")
    return cut.select("length", (F.col("rank") + F.col("i")).alias("rank"), (F.col("sequence") + F.floor(F.col("i") / F.col("each"))).alias("sequence_id"), (F.col("place") + step).alias("offset"))


def packed(cut: DataFrame, size: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` (from 0) and ``offset`` to a written table of ``pieces``.  Sequences hold
    at most ``size`` tokens, side by side from 0."""
    counts = keep(cut.groupBy("dealt", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most size rows
    before = Window.partitionBy("length").orderBy("dealt").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    shifts = counts.select("dealt", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts.hint("merge"), ["dealt", "length"]).withColumn("rank", F.col("shift") + F.col("nth"))
    placed = slots(cut.sparkSession, plan(histogram, size))
    return ranked.join(placed.hint("merge"), ["length", "rank"]).drop("dealt", "nth", "shift", "rank")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 2048, end: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` per piece of every
    document, and ``ids`` (packed as little-endian uint32) if asked for: see ``pieces``."""
    cut = keep(pieces(docs, id_col, text_col, size=size, end=end, vocabulary=vocabulary, with_ids=with_ids), "packing-pieces")
    return packed(cut, size)


def sequences(filled: DataFrame) -> DataFrame:
    """``(sequence_id, length, doc_ids, ids)`` of a packing with ids: what a trainer reads.  A
    sequence gathers at most ``size`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    whole = filled.groupBy("sequence_id").agg(parts.alias("p"))
    joined = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    return whole.select("sequence_id", F.aggregate("p.length", F.lit(0).cast("long"), lambda a, x: a + x).alias("length"), F.col("p.doc_id").alias("doc_ids"), joined.alias("ids"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
