import math
import random

import numpy as np
from pyspark.sql import functions as F

from manloom.llm import topk as K


def brute(rows, queries, k):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [math.floor(256 * x) for x in v]

    usable = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for qi, qv in queries:
        if qi is None or (q := whole(qv)) is None:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(q, w, strict=False)), i) for i, w in usable if i != qi))[:k]
        out += [(qi, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def check(spark, rows, k=5, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("part", F.lit(1)).repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats
    got = K.top_k(df, df.where("vec_id % 5 = 0"), k, **options).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows, [r for r in rows if r[0] is not None and r[0] % 5 == 0], k)


def test_brute_force(spark):
    rng = random.Random(1)
    vector = lambda s=1.0: [rng.gauss(0, s) for _ in range(16)]
    centers = [vector() for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)] if i % 2 else vector(0.2)) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)] + [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] + [0.0] * 15), (None, vector()), (505, []), (506, vector()[:4]), (1, vector())]
    for shard, block in ((50, 7), (8192, 256)):
        check(spark, rows, shard_rows=shard, block_rows=block)
    check(spark, [(0, [1.0, 2.0]), (1, [3.0, -1.0])])
    check(spark, [(0, [1000.5, -4000.25])] + [(i, [1e4 * i, 3.0]) for i in range(1, 9)])
    check(spark, [(5, [1.0])])
    check(spark, [])


def test_one_shard_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 32))
    v = np.floor(60 * (centers[rng.integers(0, 40, 3000)] + 0.2 * rng.normal(size=(3000, 32)))).astype(np.int64)
    ids = rng.permutation(3000)
    index = K.ImpactIndex.built(ids, v)
    found = index.best(ids[:50], v[:50], 5)
    for (got, scores), q, own in zip(found, v[:50], ids[:50], strict=True):
        s = v @ q
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:5]
        assert got.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()
    assert index.touched < 0.5 * 50 * np.count_nonzero(v)  # brute force takes every posting for every query


def test_large_values_keep_the_proof_exact():
    """Scores near 2**60, where sums of doubles round."""
    rng = np.random.default_rng(4)
    v = rng.integers(-(2**27), 2**27, (600, 24))
    v[300:] = v[:300] + rng.integers(0, 2, (300, 24))
    ids = np.arange(600)
    found = K.ImpactIndex.built(ids, v).best(ids[:40], v[:40], 5)
    for (got, scores), q, own in zip(found, v[:40], ids[:40], strict=True):
        s = v @ q
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:5]
        assert got.tolist() == ids[order].tolist() and scores.tolist() == s[order].tolist()


def test_written_index_is_searched(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    K.build_index(df, shard_rows=64).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    held = [(r.vec_id, r.embedding) for r in df.collect()]
    got = K.search(index, df.where("vec_id < 9"), 3).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(held, [r for r in held if r[0] < 9], 3)
