import random
from itertools import combinations

import xxhash
from pyspark.sql import functions as F

from manloom.llm import simhash as S
from manloom.llm.components import connected_components


def slow_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(pairs_of, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs_of:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_fingerprints():
    rng = random.Random(1)
    for n in [0, 1, 3, 4, 5, 50, 300]:
        text = "".join(rng.choice(["Word", "É", "x", "ab"]) + rng.choice([" ", "\n", "\t\x0b ", "\xa0"]) for _ in range(n))
        assert S.fingerprint(text.encode()) == slow_fingerprint(text)
    assert S.fingerprint(b"") == S.fingerprint(b" \n") == 0


def test_every_pair_within_the_radius_shares_a_table():
    for radius in (1, 2, 4):
        masks = [m & (1 << 64) - 1 for m in S.covering_masks(radius)]
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(2)
        for bits in [*combinations(range(64), min(radius, 2)), *(rng.sample(range(64), radius) for _ in range(20_000))]:
            diff = sum(1 << b for b in set(bits))
            assert any(not m & diff for m in masks)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(1, 200)] + [(5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == slow_components(real, {x for e in real for x in e})
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_near_fingerprints(spark):
    rng = random.Random(4)
    values = [rng.getrandbits(64) for _ in range(60)]
    for v in list(values):
        w = v
        for _ in range(rng.randint(0, 6)):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                w ^= 1 << b
            values.append(w)
    center = rng.getrandbits(64)
    values += [center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(200)]  # one crowded bucket
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    for block in (16, 1024):
        links = S.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, block).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
        want = slow_components([(a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4], signed)
        assert slow_components([(r.a, r.b) for r in links], signed) == want


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base), (9, base.upper().replace(" ", "\n")), (4, base.replace("w7 ", "q ")), (8, None), (7, ""), (None, base), (2, "other text here now please"), (2, "other text here now please")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = S.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for r in got:
        texts.setdefault(r.fp, set()).add(r.component_id)
    fps = {i: slow_fingerprint(t or "") for i, t in rows}
    near = slow_components([(a, b) for a, b in combinations([i for i in fps if i is not None], 2) if (fps[a] ^ fps[b]).bit_count() <= 4], [i for i in fps if i is not None])
    assert all(r.component_id == (near[r.doc_id] if r.doc_id is not None else 3) for r in got)
    assert near[9] == 3 and near[8] == 7
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_left_out_parts_keep_near_pairs_together():
    masks = S.covering_masks(4)
    rng = random.Random(5)
    for mask, parts in zip(masks, S._left_out(masks, 5), strict=True):
        told = [p & (1 << 64) - 1 for p in parts]
        out = ~mask & (1 << 64) - 1
        assert sum(told) == out and all(not a & b for a, b in combinations(told, 2))
        places = [i for i in range(64) if out >> i & 1]
        for _ in range(100):
            diff = sum(1 << b for b in rng.sample(places, 4))
            assert any(not p & diff for p in told)


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.randint(0, 99_999)}"
    return words


def test_near_copies_of_a_shingle_similarity(spark):
    """Pairs of 0.8 or more over five-word shingles are found, unrelated texts are not."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)]
    shares = [1 / (i + 3) for i in range(400)]
    texts = []
    for _ in range(150):
        words = rng.choices(vocabulary, shares, k=rng.randint(150, 500))
        texts += [words, edited(rng, words, max(1, len(words) // 70))]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(900, None), (901, ""), (None, "a b"), (902, "one two"), (903, "one three")], "doc_id long, text string").withColumn("node", F.lit("clash"))
    of = {r.doc_id: r.component_id for r in S.near_copies(docs, block=64).collect()}
    pairs = [(i, i + 1) for i in range(0, 300, 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) >= 0.8]
    assert len(pairs) > 100 and sum(of[a] == of[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(of[i] >= i - i % 2 for i in range(300))  # with no other pair
    assert of[900] == of[901] == 900 and of[902] != of[903] and of[None] is None and S.near_copies(docs.limit(0)).count() == 0
