"""BPE encoding and decoding for a vocabulary file with word ends.

A word is encoded over contiguous arrays: the boundaries of its parts, the id of each part, and
the rank of joining each part with the next.  The least rank is found by a scan, its boundary is
deleted and the two ranks beside it are looked up again.  Words over ``SCAN_LIMIT`` parts use a
heap over the same ranks, which makes the same merges in the same order.  Encoded pieces of up to
``KEPT_CHARS`` characters are kept in a table of each Python worker, which is bounded in bytes by
that and by its number of entries: a full table steps back, and what is asked for again moves over
from it into the next.  Longer pieces are encoded each time.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN_LIMIT = 64
KEPT_CHARS = 64
_NONE = 1 << 60
#: White space of the tokenizer's patterns; the four separators 0x1C-0x1F are not among it.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def _char_class(*majors: str) -> str:
    """The characters whose general category begins with one of ``majors``, as a class body."""
    spans: list[list[int]] = []
    for code in range(sys.maxunicode + 1):
        if unicodedata.category(chr(code))[0] in majors:
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)


def _byte_letters() -> list[str]:
    """One printable character for each byte: itself if visible Latin-1, else the next from 256."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in seen:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class WordBpe(dict):
    """Maps a blank-separated piece of raw text to its ids, packed as little-endian uint32."""

    def __init__(self, path: str, max_kept: int = 250_000) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.joined = [vocab[a + b] for a, b in merges]  # by rank
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        letters = _byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.last = [vocab[c + self.end] for c in letters]
        letter, number = _char_class("L"), _char_class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+")
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.max_kept, self.older = max_kept, {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            ids = array("I")
            for m in self.words.finditer(self._normal(piece)):
                ids.extend(self.word(m[0].encode()))
            if sys.byteorder == "big":
                ids.byteswap()
            packed = ids.tobytes()
        if len(piece) <= KEPT_CHARS:
            if len(self) >= self.max_kept:  # what is asked for again moves over, the rest is let go
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    @staticmethod
    def _normal(text: str) -> str:
        """NFC, then each character's own lower case (a final sigma is not told apart)."""
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word(self, raw: bytes) -> list[int]:
        ids = [self.inner[b] for b in raw[:-1]] + [self.last[raw[-1]]]
        if len(ids) > SCAN_LIMIT:
            return self._long_word(ids)
        rank = self.ranks.get
        ranks = [rank(pair, _NONE) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) != _NONE:
            at = ranks.index(least)
            ids[at] = self.joined[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], ids[at]), _NONE)
            if at < len(ranks):
                ranks[at] = rank((ids[at], ids[at + 1]), _NONE)
        return ids

    def _long_word(self, ids: list[int]) -> list[int]:
        """The same merges by a heap of (rank, place); an entry holds while the pair at its place has
        its rank, which no other pair has."""
        n, rank_of = len(ids), self.ranks.get
        parts, before, after = array("q", ids), array("q", range(-1, n - 1)), array("q", [*range(1, n), -1])
        queue = [rank << 40 | i for i in range(n - 1) if (rank := rank_of((parts[i], parts[i + 1]), _NONE)) != _NONE]
        heapq.heapify(queue)
        while queue:
            rank, i = divmod(heapq.heappop(queue), 1 << 40)
            j = after[i] if parts[i] >= 0 else -1
            if j < 0 or rank_of((parts[i], parts[j]), _NONE) != rank:
                continue  # a part of this pair has been merged since
            parts[i], parts[j] = self.joined[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (found := rank_of((parts[left], parts[right]), _NONE)) != _NONE:
                    heapq.heappush(queue, found << 40 | left)
        return [p for p in parts if p >= 0]

    def _plain(self, text: str) -> bytes:
        if any(sep in text for sep in "\x1c\x1d\x1e\x1f"):  # str.split() would take these for white space
            return b"".join(map(self.__getitem__, re.split(f"[{_SPACE}]+", text)))
        return b"".join(map(self.__getitem__, text.split()))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text; strings of special tokens in it get their own ids."""
        if self.special is None or not self.special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.specials[m[0]]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*out, self._plain(text[at:])]), "<u4")

    def decode(self, ids) -> str:
        """The tokens of the ids, joined by spaces: this vocabulary names no other decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """The vocabulary of a Python worker, read once."""
    return WordBpe(path)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, decoded)``, one row per input row: the ids of the whole text, and the text
    that they decode to.

    Null and empty texts, and texts of white space only, have no ids and decode to the empty
    string; repeated rows and null ids keep their rows; an empty table gives no rows; other
    columns are ignored whatever their names.  ``vocabulary`` is a path that every worker can read.
    """
    path = vocabulary or default_vocabulary()

    def each(batches):
        bpe = load(path)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = bpe.encode(text.as_py() or "")
                yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([bpe.decode(ids)])], ["doc_id", "ids", "decoded"])

    return _rows(docs, id_col, text_col).mapInArrow(each, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the same encoding and decoding, without
    sending ids and decoded texts out of the workers."""
    path = vocabulary or default_vocabulary()

    def each(batches):
        bpe = load(path)
        for batch in batches:
            sizes, ids_sums, text_sums = [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py() or "")
                sizes.append(len(ids))
                ids_sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sums.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
