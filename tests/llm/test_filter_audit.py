import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from manloom.llm import filter_audit as A


def failed(text, smaller_same):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else ""
    out += "D" if re.search(r"[#$%&*|]", text) else ""
    return set(out + ("E" if smaller_same else ""))


def brute(docs, labels):
    """Runs every filter over every document in every order."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = [(i, p, failed(t, i is not None and any(j is not None and j < i and s == t for j, s, _ in docs))) for i, t, p in docs]
    out = {}
    for part in {p for _, p, _ in fails}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for i, p, f in fails if p == part]
            gone = []
            for step, x in enumerate(order, 1):
                hit = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                redundant = sum(x in f for _, f in gone)
                gone += hit
                shapley[x] += len(hit)
                unique = sum(f == {x} for _, p, f in fails if p == part)
                out[part, order, step] = [len(left), len(hit), redundant, unique, sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit), x]
        for key in out:
            if key[0] == part:
                out[key][6] = shapley[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def check(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash")).withColumn("good", F.lit(1)).repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit("clash"))
    got = A.audit(d, lab).collect()
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got})
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(docs, labels)


def test_brute_force(spark):
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(400)] + ["LOUD", "NOISE", "a#b", "50%", "\x0b", "ü\xa0x"]
    texts = [" ".join(rng.choices(pool if rng.random() < 0.5 else pool[:90], k=rng.choice([3, 99, 100, 101, 180]))) for _ in range(40)] + ["A" * 50, "", None, " \t\n ", "word " * 60_000]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    docs += [(None, texts[0], "en"), (None, texts[0], "en"), docs[3], docs[3], (7, texts[1], "xx")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    check(spark, docs, labels)


def test_edges(spark):
    check(spark, [], [(1, 1, 1)])
    check(spark, [(1, "x", None)], [])
    check(spark, [(None, None, None)], [])
    check(spark, [(5, "same", "en"), (5, "same", "en"), (6, "same", "de"), (2, "other", "de")], [(6, 1, 0)])


def test_sums_invert_to_cells(spark):
    rng = random.Random(6)
    rows = [(rng.choice("pq"), rng.random() < 0.5, rng.random() < 0.2, rng.randrange(8)) for _ in range(500)]
    masked = spark.createDataFrame(rows, "part string, good boolean, toxic boolean, mask int")
    sums = A.parity_sums(masked, 3)
    assert all(r["sums"][0] == sum(x[:3] == (r.part, r.good, r.toxic) for x in rows) for r in sums.collect())
    got = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in A.cells(sums, 3).collect()}
    assert len(got) == 16
    for (p, m), v in got.items():
        mine = [x for x in rows if x[0] == p and x[3] == m]
        assert v == (len(mine), sum(x[1] for x in mine), sum(x[2] for x in mine))
