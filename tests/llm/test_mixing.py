import random
from collections import defaultdict

from pyspark.sql import functions as F

from manloom.llm import mixing as M


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out = share * sum(sizes.values()), {}
    free = list(order)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > most * sizes[s] + 1e-9]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def test_word_count(spark):
    texts = ["", None, " ", "a", " a  b\n\tc\x0b", "\xa0", "é ü", "x" * 5000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(M.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3, 1, 2, 1]


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(4):
        sizes = {rng.choice([None, "a", "B", "é", "z", "src1", "src10", "", "\U0001f600", "！"]): rng.choice([0, 1, 50, 1000, 9000]) for _ in range(9)}
        got = {r.source: r.target for r in M.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = slow_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def mixed(spark, rows, parts=3, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1)).repartition(parts)
    return M.mix(docs, **options).collect()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * int(rng.lognormvariate(4, 1)), rng.choice(["a", "b", "c", "d", None] + ["hot"] * 5)) for i in range(1500)]
    rows += [(7, "x y", "a")] * 3 + [(None, "x y z", "b")] * 40 + [(2000, None, "a"), (2001, " ", "only blank"), (2002, "one", "single")]
    for fan, reserve in ((64, 512), (4, 8)):
        got = mixed(spark, rows, fan=fan, reserve=reserve)
        assert sorted((r.doc_id is not None, r.doc_id or 0, str(r.source), r.size) for r in got) == sorted((i is not None, i or 0, str(s), len((t or "").split())) for i, t, s in rows)
        by = defaultdict(list)
        for r in got:
            by[r.source].append(r)
            assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        for part in by.values():
            sizes = sorted(r.size for r in part)
            assert part[0].source_size == sum(sizes)
            assert abs(sum(r.taken for r in part) - part[0].target) <= max(1, sizes[len(sizes) // 2])
    again = mixed(spark, rows, parts=7, fan=4, reserve=8)
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixed(spark, []) == []


def test_chances_are_kept(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(60)]
    total, rounds = defaultdict(int), 12
    for seed in range(rounds):
        for r in mixed(spark, rows, fan=4, reserve=4, seed=seed):
            total[r.source] += r.copies
            rate = r.target / r.source_size
            assert r.copies in (int(rate), int(rate) + 1)
    for s, n in total.items():
        rate = next(r.target / r.source_size for r in mixed(spark, rows) if r.source == s)
        assert abs(n / rounds / 20 - rate) < 0.12


def test_many_sources_and_counted_words(spark):
    rows = [(i, i % 400, 1 + (i * 7) % 23) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, s int, n int").selectExpr("doc_id", "concat('s', lpad(s, 4, '0')) AS source", "n AS words")
    got = M.mix(docs, size_col="words").collect()
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    want = slow_targets({s: sum(r.size for r in part) for s, part in by.items()})
    assert len(by) == 400 and sorted((r.doc_id, r.size) for r in got) == sorted((i, n) for i, _, n in rows)
    for s, part in by.items():
        assert abs(part[0].target - want[s]) < 1e-6 * want[s] and abs(sum(r.taken for r in part) - want[s]) <= max(r.size for r in part)
