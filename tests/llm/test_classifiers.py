import random
import re
from binascii import crc32
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from manloom.llm import quality as Q
from manloom.llm import toxicity as X


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(20, 200))) + "."
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        if bad:
            text = rng.choice([text.upper(), text.replace(" ", "$$$ ").replace("e", "#"), " | ".join(text.split()), " ".join([text.split()[0]] * 80)])
        if toxic:
            parts = text.split(" ")
            for _ in range(3):
                parts.insert(rng.randint(0, len(parts)), rng.choice(["bleh", "grumpfoo", "grumpbar", "zorkish"]))
            text = " ".join(parts)
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def held(i, modulus, left):
    return crc32(str(i).encode()) % modulus == left


def test_quality(spark):
    docs, labels = corpus()
    extra = [(9000, ""), (9001, None), (None, docs[0][1]), (3, docs[3][1]), (9002, "long text " * 50_000)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("x", F.lit(0))
    lab = spark.createDataFrame([*labels, (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    got = Q.score_quality(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: q for i, q, _ in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (r.doc_id is not None and held(r.doc_id, 4, 2)) for r in got)
    # held-out labels are never read
    other = spark.createDataFrame([(i, 1 - q if held(i, 4, 2) else q, t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    scores = {r.doc_id: r.score for r in Q.score_quality(d, other).collect()}
    assert all(abs(scores[r.doc_id] - r.score) < 1e-9 for r in got)
    assert {r.score for r in Q.score_quality(d, lab.limit(0)).collect()} == {0.5} and Q.score_quality(d.limit(0), lab).count() == 0
    assert {r.score for r in Q.score_quality(d, lab.where("quality = 1")).collect()} == {1.0}


def test_discriminant_against_plain_formula(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, len(Q.NAMES))) * 2 + 1
    y = (x[:, 0] + rng.normal(size=300) > 1).astype(int)
    model = Q.fit(spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y, strict=True)], "x array<double>, label int"), 0.3)
    pooled = np.diag(x.var(axis=0))
    logs = []
    for k in (0, 1):
        part = x[y == k]
        c = 0.7 * np.cov(part.T, bias=True) + 0.3 * pooled
        z = x - part.mean(axis=0)
        logs.append(np.log(len(part) / 300) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(c), z))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_toxicity(spark):
    docs, labels = corpus()
    extra = [(9000, ""), (9001, None), (None, "bleh zorkish"), (9003, "a grumpunseen bleh word")]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("terms", F.lit("clash")).withColumn("label", F.lit(0))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = X.score_toxicity(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 100 and np.mean(right) > 0.95
    by = {r.doc_id: r for r in got}
    assert by[9000].predicted == 0 and by[9001].evidence == [] and by[None].predicted == 1 and not by[None].held_out and by[9003].predicted == 1
    assert all(e.doc_id != r.doc_id and not held(e.doc_id, 3, 1) and 0 < e.cosine <= 1 + 1e-9 for r in got for e in r.evidence)
    few = [r.predicted == truth[r.doc_id] for r in X.score_toxicity(d, lab, max_examples=120).collect() if r.held_out and r.doc_id in truth]  # sixty of either label
    assert np.mean(few) > 0.9
    assert len({r.score for r in X.score_toxicity(d, lab.limit(0)).collect()}) == 1 and X.score_toxicity(d.limit(0), lab).count() == 0


def rare_words(n_words=150, each=10, n_clean=9_000, seed=5):
    """Toxic documents with one word each, which few others hold."""
    rng = random.Random(seed)
    filler = [f"common{i}" for i in range(300)]
    rare = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(8)) for _ in range(n_words)]
    texts = [(w, 1) for w in rare for _ in range(each)] + [(rng.choice(filler), 0) for _ in range(n_clean)]
    rng.shuffle(texts)
    docs = [(i, " ".join([*rng.sample(filler, 9), w])) for i, (w, _) in enumerate(texts)]
    return docs, [(i, label) for i, (_, label) in enumerate(texts)]


def test_toxicity_by_rare_words(spark):
    docs, labels = rare_words()
    got = X.score_toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).where("held_out").collect()
    truth = dict(labels)
    assert np.mean([r.predicted for r in got if truth[r.doc_id]]) > 0.9 and np.mean([r.predicted for r in got if not truth[r.doc_id]]) < 0.01


def test_nearest_are_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(500):
        at = np.sort(rng.choice(60, rng.integers(1, 9), replace=False, p=np.arange(60, 0, -1) / 1830))
        w = rng.random(len(at)) * 20.0 ** -(at % 7) + 0.001
        vectors.append((at, w / np.sqrt((w * w).sum())))
    ids = rng.permutation(500).tolist()
    index = X.BlockMaxIndex(ids, vectors, [0] * 500, 60)
    dense = np.zeros((500, 60))
    for i, (at, w) in zip(ids, vectors, strict=True):
        dense[i, at] = w
    queries = [*vectors[:120], (np.zeros(0, np.int64), np.zeros(0))]
    got = index.nearest(queries, 15, [7] * 120 + [None])
    for (at, w), (places, scores) in zip(queries, got, strict=True):
        q = np.zeros(60)
        q[at] = w
        cosines = dense @ q
        order = sorted((i for i in range(500) if cosines[i] > 0 and i != 7), key=lambda i: (-round(cosines[i], 9), i))[:15]
        assert index.ids[places].tolist() == order and np.allclose(scores, cosines[order])
    assert index.scored < 120 * len(index.cuts)  # blocks were left out on proof


def test_toxicity_query_against_brute_force(spark):
    """Neighbours, cosines and scores of every document from vectors over all terms, by plain sums."""
    docs, labels = corpus(300, seed=9)
    docs += [(8000, docs[5][1]), (8001, ""), (8002, " ".join(t for _, t in docs[:120])), (8003, docs[5][1])]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.score_toxicity(d, lab).collect()}
    bag = {i: Counter(t for w in re.findall(r"\w+", text.lower()) for t in X.terms_of(w)) for i, text in docs}
    known = {i: t for i, _, t in labels if not held(i, 3, 1)}
    df = Counter(t for b in bag.values() for t in b)
    of = [Counter(t for i, y in known.items() if y == k for t in bag[i]) for k in (0, 1)]
    n = [sum(y == k for y in known.values()) for k in (0, 1)]
    names = sorted(of[0] | of[1])
    rel = dict(zip(names, X.relevance(np.array([of[1][t] for t in names]), np.array([of[0][t] for t in names]), n[1], n[0]), strict=True))

    def vector(i):
        v = {t: (1 + np.log(c)) * (np.log((1 + len(docs)) / (1 + df[t])) + 1) * rel[t] for t, c in bag[i].items() if t in rel}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(i) for i in bag}
    for i, r in got.items():
        cosines = {j: sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()) for j in known if j != i}
        order = sorted((j for j, c in cosines.items() if c > 0), key=lambda j: (-round(cosines[j], 9), j))[:15]
        assert [e.doc_id for e in r.evidence] == order[:3] and np.allclose([e.cosine for e in r.evidence], [cosines[j] for j in order[:3]])
        assert [e.label for e in r.evidence] == [known[j] for j in order[:3]]
    assert got[8000].score == got[8003].score and got[8001].evidence == [] and len(got[8002].evidence) == 3
