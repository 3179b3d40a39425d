import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from manloom.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")


def library():
    t = tokenizers.Tokenizer.from_file(P.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def best_fit(lengths, size):
    """How many sequences plain best fit decreasing takes, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= x]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - x)
        else:
            rooms.append(size - x)
    return len(rooms)


def check_plan(lengths, size):
    spots = {}
    for length, rank, n, each, sequence, place in P.plan(Counter(lengths), size):
        for i in range(n):
            assert (length, rank + i) not in spots
            spots[length, rank + i] = (sequence + i // each, place + i % each * length)
    assert sorted(spots) == sorted((x, i) for x, n in Counter(lengths).items() for i in range(n))
    filled = {}
    for (length, _), (sequence, place) in spots.items():
        filled.setdefault(sequence, []).append((place, length))
    for held in filled.values():
        at = 0
        for place, length in sorted(held):
            assert place == at
            at += length
        assert at <= size
    assert sorted(filled) == list(range(len(filled)))
    assert len(filled) == best_fit(lengths, size)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    check_plan([], 10)
    check_plan([10] * 7, 10)
    for size in (7, 32, 100):
        for _ in range(60):
            most = rng.choice([3, size // 2, size])
            check_plan([rng.randint(1, most) for _ in range(rng.choice([1, 5, 60, 400]))], size)
    check_plan([16] * 500 + [33] * 300 + [1] * 90 + [51] * 100, 100)


def test_plans_stay_small():
    rng = random.Random(2)
    runs = P.plan({x: rng.randint(1, 10**9) for x in range(1, 2049)}, 2048)
    assert len(runs) < 11 * 4 * 2048


def texts():
    rng = random.Random(3)
    pool = list(" \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 'sdtreml019aZé漢ß٣½_-#.,\U0001f600​") + ["  ", " \n", "\n ", " a", "'ll ", "\x00"]
    odd = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    return odd + ["", " ", "   ", "a  b", "a \n b", " a", "a ", "x<|endoftext|> y", "tab\t word", " " * 40_000 + "x", "y" + " " * 40_000, "z" * 5_000, "ab cd " * 3_000, "Don't I'LL we've"]


def test_ids_are_the_library_s():
    words, t = P.Words(P.default_vocabulary(), max_kept=50), library()
    assert words.ranked is not None
    for text in texts():
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text[:80])
    words.ranked = None
    for text in texts()[:50]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def check(spark, rows, size):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash")).withColumn("rank", F.lit(1)).repartition(3)
    filled = P.pack(df, size=size, with_ids=True)
    got = filled.collect()
    t = library()
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % size or size
        cuts = [0, *range(first, len(ids), size), len(ids)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            packed = np.array(ids[a:b], "<u4").tobytes()
            want.append((i, k, a, b - a, zlib.crc32(packed), packed))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.ids)))
    for parts in held.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [sum(n for _, n, _ in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n, _ in parts) <= size
    if rows:
        assert len(held) == best_fit([r[3] for r in want], size)
    whole = {r.sequence_id: bytes(r.ids) for r in P.sequences(filled).collect()}
    assert whole == {s: b"".join(b for _, _, b in parts) for s, parts in held.items()}


def test_packs_whole_documents(spark):
    rng = random.Random(4)
    words = "the of a night Fluss río 42 well-known, I'm".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 20, 200])))) for i in range(150)]
    rows += [(500 + i, "same text again") for i in range(80)] + [(900, None), (901, ""), (None, "no id"), (3, rows[3][1]), (3, rows[3][1]), (902, "long " * 3_000)]
    check(spark, rows, 64)
    check(spark, rows, 2048)


def test_edges(spark):
    check(spark, [], 64)
    check(spark, [(1, None)], 64)
    check(spark, [(1, " ".join(["a"] * 127))], 64)  # two full pieces
