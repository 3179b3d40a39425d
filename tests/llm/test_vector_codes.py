import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from manloom.llm import vector_codes as V


def brute(rows, parts, entries, rounds):
    """All entries against all parts, in plain integers."""
    usable = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not usable:
        return []
    dims = -(-max(len(v) for _, v, _ in usable) // parts) * parts
    width = dims // parts
    usable = sorted(((i, v + [0] * (dims - len(v)), g) for i, v, g in usable), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in usable[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, v, _ in usable:
            for p, x in enumerate(cut(v)):
                held[p][best(x, books[p])[1]].append(x)
        books = [[[sum(c) // len(xs) for c in zip(*xs, strict=True)] if xs else e for e, xs in zip(book, hs, strict=True)] for book, hs in zip(books, held, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    coded = [(i, g, [best(x, books[p]) for p, x in enumerate(cut(v))]) for i, v, g in usable]
    total = {}
    for _, g, b in coded:
        total[g] = total.get(g, 0) + sum(d for d, _ in b)
    return [(i, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b), total[g], digest) for i, g, b in coded]


def check(spark, rows, parts=4, entries=8, rounds=2):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("clash")).withColumn("v", F.lit(1)).repartition(3)
    as_floats = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    got = V.compress(df, parts=parts, entries=entries, rounds=rounds).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got), key=key) == sorted(brute(as_floats, parts, entries, rounds), key=key)


def test_brute_force(spark):
    rng = random.Random(3)
    vector = lambda n=16: [rng.gauss(0, 0.3) for _ in range(n)]
    rows = [(i, vector(), rng.choice([0, 0, 0, 1, 2, None])) for i in range(200)]
    rows += [(300 + i, rows[2][1], 5) for i in range(70)]  # copies
    rows += [(400, None, 1), (401, [None] * 16, 1), (402, [float("nan")] * 16, 1), (403, [float("-inf")] + [0.0] * 15, 1), (None, vector(), 1), (404, [], 2), (405, vector(5), 2), (3, vector(), 9), (3, vector(), 9)]
    check(spark, rows)
    check(spark, rows, parts=3, entries=5, rounds=1)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None, 2)])
    check(spark, [(7, [0.5, -0.25, 0.0, 3.0], None)])
    check(spark, [(7, [], None), (8, [], 1)])
    check(spark, [(i, [0.1, 0.2, 0.3, 0.4], i) for i in range(12)], entries=4)


def test_ties_go_to_the_lower_index_and_few_entries_are_compared():
    rng = np.random.default_rng(4)
    entries = rng.integers(-200, 200, (64, 4))
    entries[40] = entries[3]
    points = np.concatenate([entries, rng.integers(-300, 300, (500, 4)), entries[rng.integers(0, 64, 5000)] + rng.integers(-40, 40, (5000, 4))])
    index, distance, compared = V.nearest(points, entries)
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and index[40] == 3
    assert compared < 0.5 * every.size
    same = np.array([[3, 4], [-3, 4], [5, 0]])  # equal norms, equal distances
    assert V.nearest(np.array([[0, 4], [0, 0]]), same)[0].tolist() == [0, 0]


def test_decodes_to_the_entries(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)], 0) for i in range(50)], "vec_id long, embedding array<double>, label int")
    books = V.fit(df, parts=4, entries=6)
    for r in V.encode(df, books).withColumn("back", V.decoded(F.col("code"), books)).collect():
        want = [(x + 0.5) / 256 for p in range(4) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)].tolist()]
        assert r.back == want


def test_common_labels_are_shared_and_rare_ones_meet(spark):
    df = spark.createDataFrame([(i, i % 50 if i < 100 else None, f"{i}", i) for i in range(400)], "vec_id long, label int, code string, error long")
    want = {}
    for r in df.collect():
        want[r.label] = want.get(r.label, 0) + r.error
    got = V.with_label_error(df, share=8).collect()
    assert len(got) == 400 and all(r.label_error == want[r.label] for r in got)
