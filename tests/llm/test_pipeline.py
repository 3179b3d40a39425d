from collections import Counter, defaultdict
from hashlib import sha256

import corpus_pipeline as P
from tokenizers import Tokenizer

from manloom.llm import bpe, quality
from tests.llm.test_classifiers import corpus


def test_stages(spark, tmp_path):
    texts, labels = corpus(400)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts]
    rows += [(1000 + i, texts[i][1], "en", "s1", 1) for i in range(40)] + [(2000 + i, texts[i][1] + " end", "de", None, 1) for i in range(40)] + [(7, texts[7][1], "en", "s3", 1), (None, "", None, None, None), (3000, None, "fr", "s0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, seen[-1], str(tmp_path)).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == docs.columns for d in seen[:-1])
    start, good, exact, near, mix, tokens = [d.collect() for d in seen]
    scores = defaultdict(list)
    for r in quality.score_quality(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect():
        scores[r.doc_id].append(r.predicted)
    assert Counter(r.doc_id for r in good) == Counter({i: sum(p) for i, p in scores.items() if sum(p)})
    assert {" ".join((r.text or "").split()) for r in exact} == {" ".join((r.text or "").split()) for r in good} and len(exact) == len({" ".join((r.text or "").split()) for r in good})
    assert {r.doc_id for r in near} <= {r.doc_id for r in exact} and 0 < len(near) <= len(exact)
    assert {r.doc_id for r in mix} <= {r.doc_id for r in near} and max(Counter(r.doc_id for r in mix).values()) <= 2
    words = lambda rs: sum(len((r.text or "").split()) for r in rs)
    assert abs(words(mix) - 1.5 * words(near)) < 0.05 * words(near)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter()
    for r in mix:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in tokens) == want
    assert sorted(map(str, P.run(spark, str(tmp_path)).collect())) == sorted(map(str, tokens))


def test_other_columns_of_any_name(spark, tmp_path):
    """Columns named like the stages' own pass through with their values; empty tables pass, too."""
    texts, labels = corpus(80, seed=4)
    names = ["kept_id", "copies", "digest", "near_fp", "nth", "mark", "own", "id", "row", "component_id", "size", "copy", "label", "x"]
    rows = [(i, t, "en", f"s{i % 3}", len(t), *[f"{n}{i}" for n in names], {"k": i}) for i, t in texts]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"{n} string" for n in names], "extra map<string, int>"]))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        now = table
        for k, (_, stage) in enumerate(P.STAGES):
            where = str(tmp_path / f"{k}-{table is docs}")
            stage(spark, now, str(tmp_path)).write.parquet(where)
            before, now = now, spark.read.parquet(where)
            if k < 4:
                assert now.columns == docs.columns
                assert all(r[n] == f"{n}{r.doc_id}" for r in now.collect() for n in names)
        assert (now.count() > 20) == (table is docs)


def test_empty_and_one_sided_labels(spark, tmp_path):
    texts, labels = corpus(60, seed=9)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts] + [(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows in (("none", []), ("good", [(i, 1, 0) for i, _, _ in labels]), ("bad", [(i, 0, 0) for i, _, _ in labels])):
        spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        kept = P.good_quality(spark, docs, str(tmp_path / name)).count()
        assert kept in (0, docs.count())  # nothing tells them apart
        assert name != "bad" or kept == 0
