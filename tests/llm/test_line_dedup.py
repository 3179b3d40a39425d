import random

import numpy as np
from pyspark.sql import functions as F

from manloom.llm import line_dedup as L


def brute_common(a, b):
    """Length of a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_patience_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(500):
        a = [rng.randint(0, 12) for _ in range(rng.randint(0, 14))]
        b = [rng.randint(0, 12) for _ in range(rng.randint(0, 14))]
        blocks = L.patience(a, b)
        assert all(a[i : i + n] == b[j : j + n] and n for i, j, n in blocks)
        assert all(x[0] + x[2] <= y[0] and x[1] + x[2] <= y[1] for x, y in zip(blocks, blocks[1:], strict=False))
        assert sum(n for *_, n in blocks) <= brute_common(a, b)


def test_patience_finds_all_of_unique_lines():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.sample(range(100), 20)
        b = sorted(rng.sample(a, 10), key=a.index)
        for x in range(200, 205):
            b.insert(rng.randint(0, len(b)), x)
        assert sum(n for *_, n in L.patience(a, b)) == 10
    assert L.patience([1, 2, 1], [1, 3, 1]) == [(0, 0, 1), (2, 2, 1)]
    assert sum(n for *_, n in L.patience([5, 1, 1, 6], [7, 1, 8, 1])) == 2
    many = list(range(50_000))
    assert L.patience(many, many) == [(0, 0, 50_000)]


def line(i, words=12):
    return " ".join(f"w{i}x{k}" for k in range(words))


def run(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).withColumn("mark", F.lit(1))
    return sorted(L.dedup_lines(docs, **options).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.text))


def test_later_documents_lose_shared_blocks(spark):
    rows = [
        (1, "\n".join([line(1), "short", line(2), line(3)])),
        (2, "\n".join(["own", line(1), "short", line(2), line(9)])),
        (3, "\n".join([line(9), "The.", line(3).replace(" ", "\t ")])),
        (4, "short\nThe.\nown"),
        (5, line(4)), (5, line(4)), (None, line(4)), (6, None), (7, ""),
    ]
    got = run(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows)
    assert by[1][0].removed == [] and by[1][0].n_lines == 4
    assert by[2][0].removed == [1, 2, 3] and by[2][0].text == "own\n" + line(9) and by[2][0].from_ids == [1]
    assert by[3][0].removed == [0, 2] and by[3][0].text == "The." and by[3][0].from_ids == [1, 2]
    assert by[4][0].removed == [] and [r.removed for r in by[5]] == [[], []]
    assert by[None][0].text == line(4) and by[6][0].text == "" and by[7][0].n_lines == 1
    assert run(spark, []) == []


def test_first_holder_keeps_every_line(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(line(rng.randint(0, 40)) if rng.random() < 0.7 else line(1000 + 50 * i + j) for j in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(200 + i, "\n".join([line(5), line(90_000 + i), line(5)])) for i in range(60)]
    got = run(spark, rows)
    texts = dict(rows)
    held = {x for t in texts.values() for x in t.split("\n")}
    left = {}
    for r in got:
        lines = texts[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in set(r.removed))
        for i in r.removed:  # an earlier document named holds the line
            assert any(lines[i] in texts[f].split("\n") and f < r.doc_id for f in r.from_ids)
        for x in r.text.split("\n"):
            left.setdefault(x, []).append(r.doc_id)
    assert held == set(left) - {""}
    assert all(min(left[x]) == min(i for i, t in rows if x in t.split("\n")) for x in held)
    assert sum(len(r.removed) for r in got if r.doc_id >= 200) == 120


def test_runs_are_the_least_that_reach_so_many_words():
    rng = random.Random(4)
    lines = [rng.randrange(-(2**63), 2**63) for _ in range(9)]
    for _ in range(300):
        words = np.array([rng.choice([0, 1, 2, 3, 7, 9]) for _ in range(rng.randint(0, 12))], np.int32)
        hashes = np.array([rng.choice(lines) for _ in words], np.int64)
        want = set()
        for i in np.flatnonzero(words):
            want |= {(i, min(e for e in range(len(words) + 1) if words[i:e].sum() >= 8)) for _ in "x" if words[i:].sum() >= 8}
            want |= {(max(k for k in range(i + 1) if words[k : i + 1].sum() >= 8), i + 1) for _ in "x" if words[: i + 1].sum() >= 8}
        start, end, found = L.runs(hashes, words, 8)
        assert set(zip(start.tolist(), end.tolist(), strict=True)) == want
        by = {}
        for i, e, h in zip(start, end, found, strict=True):
            assert by.setdefault(tuple(hashes[i:e]), h) == h
        assert len(set(by.values())) == len(by)


def test_equal_texts_of_short_lines(spark):
    verse = [line(i, 7) for i in range(1000)]
    got = run(spark, [(1, "\n".join(verse)), (2, "\n".join(verse)), (3, "\n".join([line(5000, 7), *verse[10:12], line(5001, 3)])), (4, "\n".join([verse[20], "x", verse[21]]))])
    assert [len(r.removed) for r in got] == [0, 1000, 2, 0] and got[2].removed == [1, 2]


def test_short_lines_against_all_shared_blocks(spark):
    rng = random.Random(5)
    pool = [line(i, rng.choice([1, 2, 3, 5, 7, 9])) for i in range(25)]
    texts = []
    for _ in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.6 else line(rng.randint(100, 9999), 4) for _ in range(rng.randint(1, 12))]
        if texts and rng.random() < 0.6:
            other = rng.choice(texts)
            at = rng.randint(0, len(other) - 1)
            lines[rng.randint(0, len(lines)) :] = other[at : at + rng.randint(1, 5)]
        texts.append(lines or ["."])
    got = run(spark, [(i, "\n".join(t)) for i, t in enumerate(texts)])
    for r, mine in zip(got, texts, strict=True):
        want = set()
        for i in range(len(mine)):
            for e in range(i + 1, len(mine) + 1):
                if sum(len(x.split()) for x in mine[i:e]) >= 8 and any(mine[i:e] == other[k : k + e - i] for other in texts[: r.doc_id] for k in range(len(other))):
                    want |= set(range(i, e))
        assert set(r.removed) == want


def test_blocks_whose_first_holders_differ_and_hot_lines(spark):
    """Every lost line against all pairs, with short lines, a line that all share and a hot holder."""
    rng = random.Random(6)
    block = [line(i, 3) for i in range(40)]
    long = line(777)
    rows = [(0, "\n".join([long, "own one two"])), (1, "\n".join([long, *block])), (2, "\n".join([*block, long])), (3, "\n".join(["x", *block])), (4, "\n".join([*block[:5], "y", *block[5:]]))]
    rows += [(10 + i, "\n".join([long, line(10_000 + i), *rng.sample(block, 3)])) for i in range(60)]
    texts = {i: t.split("\n") for i, t in rows}
    got = run(spark, rows)
    for r in got:
        mine, want = texts[r.doc_id], set()
        for i in range(len(mine)):
            for e in range(i + 1, len(mine) + 1):
                if sum(len(x.split()) for x in mine[i:e]) >= 8 and any(mine[i:e] == o[k : k + e - i] for d, o in texts.items() if d < r.doc_id for k in range(len(o))):
                    want |= set(range(i, e))
        assert set(r.removed) == want
    by = {r.doc_id: r for r in got}
    assert len(by[3].removed) == 40 and by[3].from_ids == [1, 2] and len(by[4].removed) == 40
    lines = L._line_table(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(0).cast("long")), 8)
    pairs = L.shared_line_pairs(lines)
    assert pairs.count() < 3 * len(rows)  # the shared line gives one pair a document
    one = sorted(map(str, L._aligned(pairs, lines, 8).collect()))
    assert one == sorted(map(str, L._aligned(pairs, lines, 8, slice_pairs=3).collect()))  # a hot holder in slices


def test_very_long_text(spark):
    many = [f"w{i} x{i} y{i}" for i in range(200_000)]
    got = run(spark, [(1, "\n".join(many)), (2, "\n".join([*many[:100_000], "z", *many[100_000:]])), (3, "a " * 500_000)])
    assert [len(r.removed) for r in got] == [0, 200_000, 0]


def test_only_aligned_lines_go(monkeypatch):
    rng = random.Random(7)
    words = lambda v: np.full(len(v), 5, np.int32)
    pairs = []
    for _ in range(200):
        a = np.array(rng.sample(range(40), 14))
        b = np.concatenate([a[8:12], rng.sample(range(50, 90), 3), a[1:5], a[2:4]])  # a moved block and a repeated one
        pairs.append((a, b))
    for a, b in pairs:
        assert L.aligned_lines(a, b, words(a), words(b), 8) == [*range(4), *range(7, 13)]
    monkeypatch.setattr(L, "patience", lambda a, b: [])
    assert all(L.aligned_lines(a, b, words(a), words(b), 8) == [] for a, b in pairs)


def test_equal_run_hashes_of_different_lines_delete_nothing(monkeypatch):
    monkeypatch.setattr(L, "runs", lambda h, w, least: (np.array([0]), np.array([2]), np.array([1])))
    five = np.array([5, 5], np.int32)
    assert L.aligned_lines(np.array([1, 2]), np.array([3, 4]), five, five, 8) == []
