"""Quality classifier: a regularised quadratic discriminant over document statistics.

Statistics of the whole text are log ratios, smoothed toward fixed typical values so that short
texts carry little evidence.  Class moments are sums over all labelled rows, gathered by Spark; the
class covariances are shrunk toward the pooled variances.  A score is the difference of the two
Gaussian log densities, from Mahalanobis distances through Cholesky factors computed once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: Smoothing in characters or words, and the typical value of each ratio.
_SMOOTH = 8.0
NAMES = ("words", "upper", "digit", "stop", "bar", "symbol", "word_length", "distinct_words", "full_stops")
_UPPER, _DIGIT, _SPACE, _STOP, _BAR, _SYMBOL = range(1, 7)


def _byte_classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)  # letters, and every byte of a character beyond ASCII
    for b in range(128):
        c = chr(b)
        if c.isupper():
            kind[b] = _UPPER
        elif c.isdigit():
            kind[b] = _DIGIT
        elif c in " \t\n\x0b\x0c\r":
            kind[b] = _SPACE
        elif c in ".,;:'\"?()-":
            kind[b] = _STOP
        elif c == "|":
            kind[b] = _BAR
        elif not c.islower():
            kind[b] = _SYMBOL
    return kind


_KIND = _byte_classes()


def statistics(raw: bytes) -> list[float]:
    """The transformed statistics of a whole text, in the order of ``NAMES``."""
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=seen, minlength=7)
    words = raw.split()
    n, solid = len(words), len(raw) - kinds[_SPACE]

    def ratio(part: float, whole: float, typical: float) -> float:
        return float(np.log((part + _SMOOTH * typical) / (whole + _SMOOTH)))

    return [
        float(np.log(n + 5.0)),
        ratio(kinds[_UPPER], solid, 0.04),
        ratio(kinds[_DIGIT], solid, 0.01),
        ratio(kinds[_STOP], solid, 0.04),
        ratio(kinds[_BAR], solid, 0.002),
        ratio(kinds[_SYMBOL], solid, 0.002),
        float(np.log((solid + 5 * _SMOOTH) / (n + _SMOOTH))),
        ratio(len(set(words)), n, 0.9),
        ratio(int(seen[ord(".")]), n, 0.1),
    ]


def statistics_of(text: Column) -> Column:
    """Array of ``statistics`` per row; null text counts as empty."""

    @F.pandas_udf("array<double>")
    def each(raws: pd.Series) -> pd.Series:
        return pd.Series([statistics(r or b"") for r in raws], dtype=object)

    return each(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def _below(lower: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a lower triangular system, row by row."""
    out = np.empty_like(right)
    for i, row in enumerate(lower):
        out[i] = (right[i] - row[:i] @ out[:i]) / row[i]
    return out


@dataclass(frozen=True)
class Discriminant:
    """Class priors, means and shrunk covariances; index 1 is the class scored high."""

    priors: tuple[float, float]
    means: np.ndarray
    covariances: np.ndarray

    @cached_property
    def factors(self) -> list[tuple[np.ndarray, float]]:
        lowers = [np.linalg.cholesky(c) for c in self.covariances]
        return [(lower, float(np.log(np.diag(lower)).sum())) for lower in lowers]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if min(self.priors) == 0:
            return np.full(len(x), self.priors[1])
        logs = []
        for prior, mean, (lower, log_det) in zip(self.priors, self.means, self.factors, strict=True):
            z = _below(lower, (x - mean).T)
            logs.append(np.log(prior) - log_det - 0.5 * (z * z).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))

    def score_of(self, stats: Column) -> Column:
        """Score column from a column of statistics."""
        model = self

        @F.pandas_udf("double")
        def each(xs: pd.Series) -> pd.Series:
            return pd.Series(model.scores(np.stack(xs.to_numpy())) if len(xs) else [], dtype="float64")

        return each(stats)


def fit(labelled: DataFrame, shrinkage: float = 0.2) -> Discriminant:
    """From all rows of ``(x array<double>, label int)``; labels other than 0 and 1 are ignored.

    One row of sums per class comes to the driver.  Without rows the priors are even; with one
    class only, every score is that class.
    """
    d = len(NAMES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(d)] + [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    rows = {r["label"]: r for r in labelled.where("label IN (0, 1)").groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    counts = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    total = sum(counts)
    means, scatters = np.zeros((2, d)), np.zeros((2, d, d))
    for k, r in rows.items():
        means[k] = [r[f"s{i}"] / r["n"] for i in range(d)]
        for i, j in pairs:
            scatters[k, i, j] = scatters[k, j, i] = r[f"q{i}_{j}"] - r["n"] * means[k, i] * means[k, j]
    if not total:
        return Discriminant((0.5, 0.5), means, np.stack([np.eye(d)] * 2))
    grand = (means * np.array(counts)[:, None]).sum(axis=0) / total
    spread = sum(np.diag(scatters[k]) + counts[k] * (means[k] - grand) ** 2 for k in (0, 1)) / total
    target = np.diag(np.maximum(spread, 1e-6))
    covariances = np.stack([(1 - shrinkage) * scatters[k] / max(counts[k], 1) + shrinkage * target for k in (0, 1)])
    return Discriminant((counts[0] / total, counts[1] / total), means, covariances)


def learning_row(doc_id: Column, modulus: int, left_out: int) -> Column:
    """False where crc32 of the id as text leaves ``left_out``: those labels are never read."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus != left_out, F.lit(True))


def quality_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.2) -> tuple[Discriminant, DataFrame]:
    """The model fitted on all learning rows, and ``(doc_id, x)`` with one row per document."""
    stats = keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), statistics_of(F.col(text_col)).alias("x")), "quality-statistics")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id IS NOT NULL").where(learning_row(F.col("doc_id"), 4, 2))
    return fit(stats.join(known, "doc_id").select("x", "label"), shrinkage), stats


def sampled_model(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", shrinkage: float = 0.2, max_examples: int = 50_000) -> Discriminant:
    """The model fitted on at most ``max_examples`` learning rows, spread by hash, so that statistics
    are taken of their texts only; for where every text is read once more anyway."""
    known = labels.select(F.col(id_col).cast("long").alias("ex_id"), F.col(label_col).cast("int").alias("label")).where("ex_id IS NOT NULL AND label IN (0, 1)").where(learning_row(F.col("ex_id"), 4, 2))
    known = keep(known.orderBy(F.xxhash64("ex_id"), "ex_id", "label").limit(max_examples), "quality-labels")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), F.col("doc_id") == F.col("ex_id"))
    return fit(rows.select(statistics_of(F.col("text")).alias("x"), "label"), shrinkage)


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row.

    Null and empty texts are scored like any text of no words; a null id is never held out and
    never learned from; repeated rows repeat; repeated labels count as often as they stand there;
    empty tables give no rows.  Other columns are ignored whatever their names.
    """
    model, stats = quality_model(docs, labels, **options)
    scored = stats.select("doc_id", (~learning_row(F.col("doc_id"), 4, 2)).alias("held_out"), model.score_of(F.col("x")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
