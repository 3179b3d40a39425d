import random
import re
from collections import defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from manloom.llm import exact_dedup as E


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        out.append((i, min(ids) if ids else None, len(groups[t]), sha256(t.encode()).hexdigest()))
    return out


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")).withColumn("fp", F.lit(0)).repartition(3)
    got = E.exact_dedup(docs, **options).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=key) == sorted(brute(rows), key=key)
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert all(n == 1 for n in kept.values())


def test_polynomials_compose():
    rng = random.Random(4)
    for moduli in (E.MODULI, (97, 89)):
        poly = E.Polynomial(moduli)
        for _ in range(60):
            raw = rng.randbytes(rng.choice([0, 1, 5, 4095, 4096, 4097, 9000]))
            plain = tuple(sum(c * pow(b, len(raw) - 1 - i, m) for i, c in enumerate(raw)) % m for b, m in zip(E.BASES, moduli, strict=True))
            cut = rng.randint(0, len(raw))
            assert poly.of(raw) == plain == poly.joined(poly.of(raw[:cut]), poly.of(raw[cut:]), len(raw) - cut)
            assert poly.unpacked(poly.packed(plain)) == plain


def test_brute_force(spark):
    rng = random.Random(5)
    texts = ["", None, " ", "a b", "a\t\nb", " a b", "é\xa0x", "x" * 300, "x" * 299 + "y", "long " * 5000, "long\n" * 5000, "long " * 4999 + "lonh "]
    rows = [(i, rng.choice(texts)) for i in range(80)] + [(7, "a b"), (7, "a b"), (7, "other"), (None, "alone"), (None, "a b"), (None, None)]
    check(spark, rows, segment=1000, chunk=64, slice_rows=4)
    check(spark, [(1, "x")])
    check(spark, [])


def test_colliding_fingerprints_are_told_apart(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("ab") for _ in range(6))) for i in range(150)]
    check(spark, rows, moduli=(2, 3), chunk=2, slice_rows=4)


def test_one_text_holds_most_rows(spark):
    check(spark, [(i, "same text" if i % 3 else f"t{i}") for i in range(900)], slice_rows=16)
