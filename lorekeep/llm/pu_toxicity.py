"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic documents are taken as labelled; all other text is
unlabelled, some of it toxic too. With the share of toxic documents (the class
prior) p, a classifier's risk is  p R(toxic as toxic) + R(unlabelled as clean)
- p R(toxic as clean).  The last two terms estimate the risk on clean text, which
can't be negative; where a sample makes them so, the gradient is reversed until
they are not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, save

#: Documents of each kind that the classifier is fitted on, at most: those of the smallest hash.
MOST_POSITIVE = 6000
MOST_UNLABELLED = 12000
#: Features of the classifier at most.
MOST_FEATURES = 20000
#: A feature needs so many confirmed documents, so many times its share in unlabelled text, and so many deviations from chance.
LEAST_POSITIVE = 3
LEAST_LIFT = 2.0
LEAST_Z = 3.0
#: Letters of the word beginnings that are features besides whole words.
STEM = 4
#: Words of a text that are matched at once.
WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Distinct lower-case words of a text, and the beginnings of the longer ones."""
    words = set(WORD.findall((text or "").lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class SparseRows:
    """Binary rows as feature numbers one after another."""

    def __init__(self, rows: list) -> None:
        self.n = len(rows)
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.feature = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows]) if sizes.sum() else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.feature], minlength=self.n)

    def transpose_dot(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.feature, weights=g[self.row], minlength=width)


def fit_nnpu(
    positive: SparseRows, unlabelled: SparseRows, width: int, prior: float,
    steps: int = 300, rate: float = 0.1, penalty: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier that minimise the non-negative PU risk (sigmoid loss, Adam)."""
    w, b = np.zeros(width), -1.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)

    def slope(rows: SparseRows, s: np.ndarray, sign: float) -> np.ndarray:
        g = sign * s * (1 - s) / max(rows.n, 1)
        return np.append(rows.transpose_dot(g, width), g.sum())

    for t in range(1, steps + 1):
        sp, su = _sigmoid(positive.dot(w) + b), _sigmoid(unlabelled.dot(w) + b)
        clean_risk = su.mean() - prior * sp.mean()
        clean = slope(unlabelled, su, 1.0) - prior * slope(positive, sp, 1.0)
        g = -clean if clean_risk < 0 else clean + prior * slope(positive, sp, -1.0)
        g += penalty * np.append(w, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, b


class Classifier:
    """A fitted classifier: small enough to go to every task (at most ``MOST_FEATURES`` features)."""

    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        get = self.weights.get
        z = self.bias + sum(get(f, 0.0) for f in features(text))
        return float(_sigmoid(np.float64(z)))


def _smallest(ids: DataFrame, most: int) -> DataFrame:
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    text_col: str = "text",
    prior: float | None = None,
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
) -> Classifier:
    """Fit on documents for which ``learn`` (a condition on ``doc_id``) holds.

    ``labels`` has (doc_id, toxic). Ones are the confirmed documents; zeros and
    missing labels are unlabelled alike. ``prior`` is the share of toxic documents;
    if None, that among the labelled ones is taken. Samples are bounded by the two
    parameters; they are documents of the smallest hash of their ids. Other columns
    of ``docs`` are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        counts = known.agg(F.avg(F.when(F.col("toxic") == 1, 1.0).when(F.col("toxic") == 0, 0.0))).head()
        prior = counts[0] or 0.0
    positive = _smallest(known.where("toxic = 1").select("doc_id"), most_positive)
    every = _smallest(docs.where(learn).select("doc_id").where("doc_id is not null").distinct(), most_unlabelled)
    sample = F.broadcast(  # at most most_positive + most_unlabelled ids
        positive.select(F.col("doc_id").alias("id"), F.lit(True).alias("confirmed")).unionByName(
            every.select(F.col("doc_id").alias("id"), F.lit(False).alias("confirmed"))
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(features(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.list_(pa.string()))], names=["confirmed", "features"]
            )

    rows = save(
        docs.join(sample, F.col("doc_id") == F.col("id"))
        .select("confirmed", "text")
        .mapInArrow(run, "confirmed boolean, features array<string>"),
        "toxicity-sample",
    )
    n1, n0 = (rows.where("confirmed").count(), rows.where("not confirmed").count())
    if not n1 or not n0:
        return Classifier({}, -40.0)
    confirmed = F.col("confirmed").cast("int")
    counted = rows.select("confirmed", F.explode("features").alias("f")).groupBy("f").agg(
        F.sum(confirmed).alias("c1"), F.sum(1 - confirmed).alias("c0")
    )
    p1, p0 = F.col("c1") / n1, F.col("c0") / n0
    pooled = (F.col("c1") + F.col("c0")) / (n1 + n0)
    z = (p1 - p0) / F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0) + 1e-12)
    chosen = (
        counted.where((F.col("c1") >= LEAST_POSITIVE) & (p1 >= LEAST_LIFT * p0) & (z >= LEAST_Z))
        .orderBy(z.desc(), "f")
        .limit(MOST_FEATURES)
        .toPandas()["f"]
        .tolist()
    )
    if not chosen:
        return Classifier({}, -40.0)
    index = {f: k for k, f in enumerate(chosen)}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[index[f] for f in fs if f in index] for fs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(found, pa.list_(pa.int32()))], names=["confirmed", "numbers"]
            )

    numbered = rows.mapInArrow(number, "confirmed boolean, numbers array<int>").toPandas()
    w, b = fit_nnpu(
        SparseRows(numbered.loc[numbered.confirmed, "numbers"].tolist()),
        SparseRows(numbered.loc[~numbered.confirmed, "numbers"].tolist()),
        len(chosen),
        min(max(prior, 1e-3), 0.9),
    )
    return Classifier(dict(zip(chosen, w.tolist())), float(b))


def score_documents(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row and its whole text; null texts score as empty ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [classifier.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, score double"
    )


def reject(docs: DataFrame, classifier: Classifier, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([classifier.score(t) for t in texts], dtype="float64")

    return docs.where(score(F.col(text_col).cast("string")) < threshold)


def toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, text_col: str = "text", prior: float | None = None
) -> DataFrame:
    """Score every document: doc_id, held_out, score, predicted, one row per row of ``docs``.

    * Rows whose crc32(doc_id as text) modulo ``folds`` is 0 are held out of the fit.
    * A null or empty text gets the classifier's score for a text without words.
    * Repeated rows score alike; a null id gives a null ``held_out``.
    * Without confirmed documents all scores are near 0. No rows give no rows.
    """
    classifier = fit(docs, labels, crc_mod("doc_id", folds) != 0, text_col, prior)
    return score_documents(docs, classifier, text_col).select(
        "doc_id",
        (crc_mod("doc_id", folds) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
