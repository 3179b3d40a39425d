"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings; every term of the labelled examples counts.  Inverse document
frequencies are counted over all documents and multiplied by a relevance that is small for terms
that are spread evenly over the labels and grows with the evidence that a term is not: over plain
frequencies the neighbours of long texts share filler.  No term is dropped, and every document is
held against the examples.

The examples form an inverted index.  A term that few of them hold has a list of postings, which is
read whole; terms that many hold are stored in blocks of examples with the largest weight of each
term in each block.  A query takes blocks by falling upper bound and leaves out those that provably
can't reach its k-th best cosine, so the neighbours are exact.  Neighbours vote with weights that
fall with distance, and a logistic curve fitted on the examples' own left-one-out votes turns votes
into probabilities.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import learning_row
from .scratch import keep

_WORD = re.compile(r"\w+")
_BEGIN = (5,)  # letters of the beginnings that are terms
_BLOCK = 128
_BATCH = 128
_FLOOR = 0.02  # relevance of a term that says nothing about the label
_ENOUGH = 15.0  # likelihood ratio at which a term counts half of its log odds


def terms_of(word: str) -> list[str]:
    """The word, and its beginning of five letters marked as such."""
    return [word, *("^" + word[:k] for k in _BEGIN if len(word) > k)]


def relevance(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Weight of terms held by so many toxic and clean examples: a floor, and the log odds ratio
    toward the toxic label as far as the likelihood ratio supports it."""
    a, b = toxic.astype(float), clean.astype(float)
    odds = np.log((a + 0.5) / (n_toxic + 1.0)) - np.log((b + 0.5) / (n_clean + 1.0))
    expected = np.maximum((a + b) * (n_toxic / max(1, n_toxic + n_clean)), 1e-12)
    others = np.maximum(a + b - expected, 1e-12)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.where(a > 0, a * np.log(a / expected), 0.0) + np.where(b > 0, b * np.log(b / others), 0.0))
    return _FLOOR + np.maximum(odds, 0.0) / (1 + np.exp(-np.clip((ratio - _ENOUGH) / 2, -50, 50)))


def _chosen_labels(labels: DataFrame, id_col: str, label_col: str, max_examples: int) -> tuple[DataFrame, dict[int, int]]:
    """``(ex_id, label)`` of at most ``max_examples`` learning rows, half of either label at most and
    spread by hash: small enough to broadcast; and how many there are of each label."""
    known = labels.select(F.col(id_col).cast("long").alias("ex_id"), F.col(label_col).cast("int").alias("label")).where("ex_id IS NOT NULL AND label IN (0, 1)")
    known = keep(known.where(learning_row(F.col("ex_id"), 3, 1)).groupBy("ex_id").agg(F.max("label").alias("label")), "toxicity-known")
    of_label = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    halves = [known.where(F.col("label") == y).orderBy(F.xxhash64("ex_id"), "ex_id").limit(max(1, max_examples // 2)) for y in (0, 1)]
    return halves[0].unionByName(halves[1]), of_label


def _term_counts(examples: DataFrame) -> DataFrame:
    """``(text, label)`` -> ``(term, toxic, clean)``: examples of either label with the term.
    Tasks add up what they read before the shuffle."""

    def each(batches):
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in {t for w in set(_WORD.findall(text.lower())) for t in terms_of(w)}:
                    seen.setdefault(term, [0, 0])[label] += 1
            if len(seen) > 500_000:
                yield flushed(seen)
        yield flushed(seen)

    def flushed(seen):
        names, counts = list(seen), np.array(list(seen.values()), np.int64).reshape(-1, 2)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts[:, 1]), pa.array(counts[:, 0])], ["term", "toxic", "clean"])

    parts = examples.mapInArrow(each, "term string, toxic long, clean long")
    return parts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _beginnings(words, size: int) -> list[str]:
    return [w[:size] for w in words if len(w) > size]


class Vocabulary:
    """Places of the examples' terms: of words, and of beginnings by their length."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.words = {t: i for i, t in enumerate(terms) if t[0] != "^"}
        self.begun = {k: {t[1:]: i for i, t in enumerate(terms) if t[0] == "^" and len(t) == k + 1} for k in _BEGIN}

    def __getstate__(self):
        return self.terms

    def __setstate__(self, terms):
        self.__init__(terms)

    def counted(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and counts of the known terms of a whole text, by place."""
        found = _WORD.findall(text.lower())
        parts = [(self.words, Counter(found)), *((self.begun[k], Counter(_beginnings(found, k))) for k in _BEGIN)]
        at = np.array([p for known, counts in parts for p in map(known.get, counts, repeat(-1))], np.int64)
        tf = np.array([n for _, counts in parts for n in counts.values()], np.int64)
        order = np.argsort(at, kind="stable")
        order = order[np.searchsorted(at[order], 0) :]  # what no example holds stands first
        return at[order], tf[order]


def _held_by(docs: DataFrame, vocabulary) -> DataFrame:
    """``(at, n)``: how many of all documents hold each term of the vocabulary."""

    def each(batches):
        words = vocabulary.value
        tables = [words.words, *(words.begun[k] for k in _BEGIN)]
        seen = [Counter() for _ in tables]
        for batch in batches:
            for text in batch.column(0):
                own = set(_WORD.findall(text.as_py().lower()))
                seen[0].update(own)
                for counts, k in zip(seen[1:], _BEGIN, strict=True):
                    counts.update(set(_beginnings(own, k)))
            if sum(map(len, seen)) > 500_000:
                yield flushed(tables, seen)
        yield flushed(tables, seen)

    def flushed(tables, seen):
        told = {at: n for table, counts in zip(tables, seen, strict=True) for term, n in counts.items() if (at := table.get(term)) is not None}
        for counts in seen:
            counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(told), pa.int64()), pa.array(list(told.values()), pa.int64())], ["at", "n"])

    return docs.select("text").mapInArrow(each, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))


class BlockMaxIndex:
    """Examples as unit vectors: postings of rare terms, blocks with largest weights for the others."""

    def __init__(self, ids, vectors, labels, n_terms: int) -> None:
        heaviest = [int(at[np.argmax(w)]) if len(at) else -1 for at, w in vectors]
        order = sorted(range(len(ids)), key=lambda i: (heaviest[i], ids[i]))  # alike examples side by side
        self.ids = np.array([ids[i] for i in order], np.int64)
        self.labels = np.array([labels[i] for i in order], np.int64)
        n = len(order)
        sizes = [len(vectors[i][0]) for i in order]
        dims = np.concatenate([np.zeros(0, np.int32), *(vectors[i][0] for i in order)]).astype(np.int32)
        values = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        rows = np.repeat(np.arange(n, dtype=np.int32), sizes)
        held = np.bincount(dims, minlength=n_terms)
        often = np.flatnonzero(held > max(8, n // 16))
        self.column = np.full(n_terms, -1, np.int64)
        self.column[often] = np.arange(len(often))
        dense = self.column[dims] >= 0
        self.table = np.zeros((n, len(often)))
        self.table[rows[dense], self.column[dims[dense]]] = values[dense]
        dims, rows, values = dims[~dense], rows[~dense], values[~dense]
        by_term = np.argsort(dims, kind="stable")
        self.rows, self.values = rows[by_term], values[by_term]
        self.starts = np.searchsorted(dims[by_term], np.arange(n_terms + 1))
        self.cuts = np.arange(0, n, _BLOCK)
        self.tops = np.maximum.reduceat(self.table, self.cuts, axis=0) if n else np.zeros((0, len(often)))
        self.scored = 0  # pairs of query and block, for measuring

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms and weights) the positions and cosines of the exact ``k`` nearest
        examples with a cosine above 0, ties to the smaller id; ``without`` leaves out one id."""
        n, m = len(self.ids), len(queries)
        if not n:
            return [(np.zeros(0, np.int64), np.zeros(0))] * m
        q = np.repeat(np.arange(m), [len(at) for at, _ in queries])
        at, w = np.concatenate([a for a, _ in queries]), np.concatenate([v for _, v in queries])
        column = self.column[at]
        dense = np.zeros((m, self.table.shape[1]))
        dense[q[column >= 0], column[column >= 0]] = w[column >= 0]
        scores = np.zeros((m, n))
        for i, (at, w) in enumerate(queries):
            rare = self.column[at] < 0
            starts = self.starts[at[rare]]
            sizes = self.starts[at[rare] + 1] - starts
            ends = np.cumsum(sizes)
            if len(ends) and ends[-1]:
                each = np.arange(ends[-1])
                each += np.repeat(starts - (ends - sizes), sizes)
                scores[i] = np.bincount(self.rows[each], weights=self.values[each] * np.repeat(w[rare], sizes), minlength=n)
        bounds = np.maximum.reduceat(scores, self.cuts, axis=1) + dense @ self.tops.T
        own = {}
        for i, one in enumerate(without):
            if one is not None:
                own[i] = np.flatnonzero(self.ids == one)
        best, done = np.zeros((m, k)), np.zeros((m, len(self.cuts)), bool)
        order = np.argsort(-bounds.max(axis=0), kind="stable")
        for group in [order[:1], order[1:4], *(order[g : g + 16] for g in range(4, len(order), 16))]:
            rows = np.flatnonzero(((bounds[:, group] > 0) & (bounds[:, group] >= best[:, :1] - 1e-9)).any(axis=1))  # the k-th best so far
            if not len(rows):
                continue
            examples = np.concatenate([np.arange(self.cuts[b], min(n, self.cuts[b] + _BLOCK)) for b in group])
            part = scores[np.ix_(rows, examples)] + dense[rows] @ self.table[examples].T
            for i, places in own.items():
                if (at_row := np.searchsorted(rows, i)) < len(rows) and rows[at_row] == i:
                    part[at_row, np.isin(examples, places)] = 0.0
            scores[np.ix_(rows, examples)] = part
            done[np.ix_(rows, group)] = True
            self.scored += len(rows) * len(group)
            both = np.concatenate([best[rows], part], axis=1)
            best[rows] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        out = []
        for i in range(m):
            seen = np.repeat(done[i], _BLOCK)[:n]
            places = np.flatnonzero(seen & (scores[i] > 0) & (scores[i] >= best[i, 0] - 1e-8))
            found = scores[i, places]
            order = np.lexsort((self.ids[places], -np.round(found, 9)))[:k]
            out.append((places[order], found[order]))
        return out


@dataclass
class ToxicityModel:
    """What is shared with the workers: the examples as term counts, from which each worker builds
    the index once."""

    words: Vocabulary
    weight: np.ndarray  # inverse document frequency times relevance, by term
    ids: np.ndarray
    labels: np.ndarray
    sizes: np.ndarray  # terms of each example
    at: np.ndarray  # their places and counts, example after example
    tf: np.ndarray
    base: float  # smoothed share of the toxic among all learning rows
    stands_for: np.ndarray  # how many learning rows an example of each label stands for
    k: int
    curve: tuple[float, float] = (0.0, 1.0)

    def __getstate__(self):
        return {name: value for name, value in self.__dict__.items() if name != "index"}

    @cached_property
    def index(self) -> BlockMaxIndex:
        cuts = np.cumsum(self.sizes)[:-1]
        vectors = [self.unit(a, t) for a, t in zip(np.split(self.at, cuts), np.split(self.tf, cuts), strict=True)] if len(self.ids) else []
        return BlockMaxIndex(self.ids, vectors, self.labels, len(self.words.terms))

    def unit(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(tf)) * self.weight[at]
        return at, w / np.sqrt((w * w).sum()) if len(w) else w

    def votes(self, texts: list[str], without: list[int | None]) -> list[tuple[float, np.ndarray, np.ndarray, list[str]]]:
        """Vote, neighbours, cosines and the heaviest terms of each text."""
        queries = [self.unit(*self.words.counted(t)) for t in texts]
        out = []
        for (places, cosines), (at, w) in zip(self.index.nearest(queries, self.k, without), queries, strict=True):
            weights = np.exp(-4 * (1 - cosines)) * self.stands_for[self.index.labels[places]]
            vote = float(((weights * self.index.labels[places]).sum() + 0.5 * self.base) / (weights.sum() + 0.5))
            out.append((vote, places, cosines, [self.words.terms[i] for i in at[np.argsort(-w, kind="stable")[:5]]]))
        return out

    def calibrated(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * _logit(vote)))))


def _logit(p):
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fitted_curve(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """A logistic curve over the logits of votes, by damped Newton steps with a small ridge."""
    if not len(votes) or labels.min() == labels.max():
        return 0.0, 1.0
    x, t, weights = np.stack([np.ones(len(votes)), _logit(votes)], axis=1), np.array([0.0, 1.0]), weights / weights.mean()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (weights * (labels - p)) - 0.1 * (t - [0.0, 1.0])
        hess = (x * (weights * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t = t + step * min(1.0, 2 / max(1e-9, np.abs(step).max()))
    return float(t[0]), float(max(t[1], 0.0))


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))


def _voted(rows: DataFrame, shared) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, vote, evidence, terms)``; an example is no neighbour of itself."""

    def each(batches):
        model: ToxicityModel = shared.value
        own, done = set(model.index.ids.tolist()), {}
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                docs = part.column(0).to_pylist()
                texts = part.column(1).to_pylist()
                without = [d if d in own else None for d in docs]
                keys = [(xxhash.xxh3_128_digest(t), d) for t, d in zip(texts, without, strict=True)]  # copies vote alike
                if len(done) > 20_000:
                    done.clear()
                fresh = {key: i for i, key in enumerate(keys) if key not in done}
                told = model.votes([texts[i] for i in fresh.values()], [without[i] for i in fresh.values()]) if fresh else []
                for key, (vote, places, cosines, terms) in zip(fresh, told, strict=True):
                    near = [{"doc_id": int(model.index.ids[p]), "cosine": float(c), "label": int(model.index.labels[p])} for p, c in zip(places[:3], cosines[:3], strict=True)]
                    done[key] = vote, near, terms
                votes, evidence, terms = zip(*map(done.__getitem__, keys), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.float64()), pa.array(evidence, _EVIDENCE), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "vote", "evidence", "terms"])

    return rows.select("doc_id", "text").mapInArrow(each, "doc_id long, vote double, evidence array<struct<doc_id: long, cosine: double, label: int>>, terms array<string>")


def toxicity_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = 4_000, k: int = 15) -> tuple[ToxicityModel, DataFrame]:
    """The model, and ``(doc_id, vote, evidence, terms)`` of all documents.

    ``max_examples`` bounds the labelled rows learned from, half of either label at most, and by
    them the terms and what reaches the driver and the workers.  Votes and the curve weigh each
    label by the learning rows that its examples stand for.  Document frequencies cover all documents.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chosen, of_all = _chosen_labels(labels, id_col, label_col, max_examples)
    chosen = keep(chosen, "toxicity-labels")
    examples = rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("ex_id")).groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("v"))
    examples = keep(examples.select("doc_id", "v.*"), "toxicity-examples")  # at most max_examples rows, one an id
    counts = _term_counts(examples.select("text", "label")).toArrow().sort_by("term")
    of_label = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = of_label.get(1, 0), of_label.get(0, 0)
    words = Vocabulary(counts["term"].to_pylist())
    vocabulary = spark.sparkContext.broadcast(words)
    held = _held_by(rows, vocabulary).toPandas()
    idf = np.log(1 + rows.count()) + 1 - np.log1p(np.bincount(held["at"], weights=held["n"], minlength=len(words.terms)))
    weight = idf * relevance(counts["toxic"].to_numpy(), counts["clean"].to_numpy(), n_toxic, n_clean)

    def each(batches):
        for batch in batches:
            found = [vocabulary.value.counted(t.as_py()) for t in batch.column(1)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a for a, _ in found], kind), pa.array([t for _, t in found], kind)], ["doc_id", "label", "at", "tf"])

    known = examples.select("doc_id", "text", "label").mapInArrow(each, "doc_id long, label int, at array<int>, tf array<int>").toPandas().sort_values("doc_id")
    all_toxic, everything = of_all.get(1, 0), sum(of_all.values())
    shares = np.array([of_all.get(0, 0) / max(1, n_clean), all_toxic / max(1, n_toxic)]) * (n_clean + n_toxic) / max(1, everything)
    joined = lambda column: np.concatenate([np.zeros(0, np.int32), *known[column]])
    model = ToxicityModel(
        words, weight, known["doc_id"].to_numpy(np.int64), known["label"].to_numpy(np.int8), known["at"].map(len).to_numpy(np.int32), joined("at"), joined("tf"), (all_toxic + 0.5) / (everything + 5), shares, k
    )
    shared = spark.sparkContext.broadcast(model)
    own = _voted(examples.repartition(32), shared).select("doc_id", "vote").join(examples.select("doc_id", "label"), "doc_id").toPandas()
    labels_of = own["label"].to_numpy(int)
    model.curve = _fitted_curve(own["vote"].to_numpy(float), labels_of, model.stands_for[labels_of])
    return model, _voted(rows, shared)


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence, terms)``, one row per input row.

    ``evidence`` lists up to three nearest examples (id, cosine, label), ``terms`` the five terms of
    the document that weigh most.  A document is never its own neighbour.  Null and empty texts
    have no neighbours and score the base rate, calibrated; a null id is never held out; repeated
    rows repeat; equal texts score alike unless one is an example itself; without labels every
    score is the base rate; an empty table gives no rows.  Other columns are ignored whatever their
    names.
    """
    model, voted = toxicity_model(docs, labels, **options)
    a, b = model.curve
    p = F.greatest(F.least(F.col("vote"), F.lit(1 - 1e-4)), F.lit(1e-4))
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.log(p / (1 - p)))))
    scored = voted.withColumn("score", score)
    held = ~learning_row(F.col("doc_id"), 3, 1)
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "evidence", "terms")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
