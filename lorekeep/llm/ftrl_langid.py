"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters and single spaces of a text give n-grams of one to three characters,
hashed to a fixed number of columns. Their document frequencies are counted over
all documents that may be learnt from. The classifier is fitted by
follow-the-regularised-leader with an elastic-net penalty (L1 keeps most weights
zero) on a bounded sample, and its scores are calibrated by one temperature, on
documents of the sample that the fit left out.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import crc_mod, save

COLUMNS = 1 << 16
ORDERS = 3
#: Documents that the classifier is fitted on, at most; a tenth of them calibrate it.
MOST_FITTED = 3000
LETTER = regex.compile(r"\p{L}")
NO_LANGUAGE = "und"


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter or a mark on one."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)])


def grams(text: str) -> np.ndarray:
    """Column numbers of all n-grams of a text, repeats included."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    a = np.where(_letters()[a], a, np.uint32(32))
    blank = a == 32
    a = a[~(blank & np.concatenate([[False], blank[:-1]]))]
    a = np.concatenate([[32], a, [32]]).astype(np.uint32)
    x, found = a, []
    for n in range(ORDERS):
        if n:
            x = x[:-1] * np.uint32(0x01000193) + a[n:]
        y = (x + np.uint32(n)) * np.uint32(0x9E3779B1)
        found.append((y ^ (y >> np.uint32(15))) & np.uint32(COLUMNS - 1))
    return np.concatenate(found).astype(np.int32)


def _counted(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    columns, counts = np.unique(found, return_counts=True)
    return columns, counts


def gram_documents(texts: DataFrame) -> np.ndarray:
    """In how many of all ``texts`` (text) each column occurs; each task sends one row a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last, k = np.zeros(COLUMNS, dtype=np.int64), np.full(COLUMNS, -1, dtype=np.int64), 0
        for b in batches:
            for t in b.column(0):
                found = grams(t.as_py())
                new = found[last[found] != k]
                last[new] = k
                # of a column's places in this text, count one
                place = np.empty(COLUMNS, dtype=np.int32) if k == 0 else place
                at = np.arange(len(new), dtype=np.int32)
                place[new] = at
                total[new[place[new] == at]] += 1
                k += 1
        columns = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns.astype(np.int32)), pa.array(total[columns])], names=["gram", "n"]
        )

    summed = texts.mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(COLUMNS)
    out[summed["gram"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy()
    return out


class Model:
    """A fitted model: a table of ``COLUMNS`` rows and one column a language, whatever the corpus."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf = languages, idf.astype(np.float32)
        self.weights = np.zeros((COLUMNS, len(languages)), dtype=np.float32)
        self.bias = np.zeros(len(languages))
        self.temperature = 1.0
        self.table = None

    def vector(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF values over columns, scaled to a sum of ``SCALE``."""
        columns, counts = _counted(found)
        values = counts * self.idf[columns]
        return columns, (SCALE * values / max(values.sum(), 1e-9)).astype(np.float32)

    def logits(self, text: str) -> np.ndarray:
        if self.table is None:  # what a gram adds to each language, and its own weight
            self.table = np.column_stack([self.idf[:, None] * self.weights, self.idf])
        *sums, norm = self.table.take(grams(text), axis=0).sum(axis=0, dtype=np.float64)
        return SCALE * np.array(sums) / max(norm, 1e-9) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not LETTER.search(text) or not self.languages:
            return NO_LANGUAGE, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


SCALE = 20.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(
    model: Model, rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray,
    epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1,
) -> None:
    """Follow the proximally regularised leader, one document after another."""
    k = len(model.languages)
    z, n = np.zeros((COLUMNS, k)), np.zeros((COLUMNS, k))
    bias_rate = 0.05

    def weights(columns: np.ndarray) -> np.ndarray:
        zc = z[columns]
        shrunk = np.sign(zc) * np.maximum(np.abs(zc) - l1, 0.0)
        return -shrunk / ((beta + np.sqrt(n[columns])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            columns, values = rows[i]
            w = weights(columns)
            error = softmax(values @ w + model.bias)
            error[target[i]] -= 1.0
            g = values[:, None] * error
            g2 = g * g
            nc = n[columns]
            z[columns] += g - (np.sqrt(nc + g2) - np.sqrt(nc)) / alpha * w
            n[columns] = nc + g2
            model.bias -= bias_rate * error
    model.weights = weights(np.arange(COLUMNS)).astype(np.float32)


def calibrate(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of the smallest log loss, from a fixed grid."""
    if not len(target):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.2), np.log(5.0), 61))
    loss = [-np.log(softmax(logits / t)[np.arange(len(target)), target] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, learn: Column, text_col: str = "text", most_fitted: int = MOST_FITTED) -> Model:
    """Fit on documents with a language for which ``learn`` (a condition on ``doc_id``) holds.

    Document frequencies are of all of them; the weights are fitted on at most
    ``most_fitted``, those of the smallest hash of their ids.
    """
    known = docs.where(learn & F.col("lang").isNotNull() & F.col(text_col).isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    )
    ids = F.broadcast(  # at most most_fitted ids
        known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_fitted).withColumnRenamed("doc_id", "id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = [_counted(grams(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1),
                    pa.array([c.tolist() for c, _ in pairs], pa.list_(pa.int32())),
                    pa.array([n.tolist() for _, n in pairs], pa.list_(pa.int32())),
                ],
                names=["doc_id", "lang", "columns", "counts"],
            )

    sample = save(
        known.join(ids, F.col("doc_id") == F.col("id"))
        .select("doc_id", "lang", "text")
        .mapInArrow(run, "doc_id long, lang string, columns array<int>, counts array<int>"),
        "language-sample",
    ).toPandas().sort_values(["doc_id", "lang"], kind="stable")
    in_all = gram_documents(known.select("text"))
    languages = sorted(set(sample["lang"]))
    total = max(in_all.max(), 1.0)
    model = Model(languages, np.log((1 + total) / (1 + in_all)) + 1.0)
    if len(languages) < 1:
        return model
    target = np.array([languages.index(x) for x in sample["lang"]])
    rows = []
    for columns, counts in zip(sample["columns"], sample["counts"]):
        values = np.asarray(counts) * model.idf[np.asarray(columns, dtype=np.int64)]
        rows.append((np.asarray(columns, dtype=np.int64), (SCALE * values / max(values.sum(), 1e-9)).astype(np.float32)))
    checks = np.arange(len(rows)) % 10 == 9
    fitted = np.flatnonzero(~checks)
    fit_ftrl(model, [rows[i] for i in fitted], target[fitted])
    held = np.flatnonzero(checks)
    if len(held):
        logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in held])
        model.temperature = calibrate(logits, target[held])
    return model


def identify(docs: DataFrame, folds: int = 3, held: int = 1, text_col: str = "text") -> DataFrame:
    """Predict every document's language: doc_id, held_out, lang_pred, score, one row per row of ``docs``.

    * Rows whose crc32(doc_id as text) modulo ``folds`` is ``held`` are not learnt from.
    * ``lang_pred`` is ``und``, with score 0, for null texts and texts without a letter.
    * ``score`` is the calibrated probability of the predicted language.
    * Repeated rows get equal predictions; a null id gives a null ``held_out``.
      Without anything to learn from all are ``und``. No rows give no rows.
    """
    model = fit(docs, crc_mod("doc_id", folds) != held, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return (
        docs.select(F.col("doc_id").cast("long"), F.col(text_col).cast("string"))
        .mapInArrow(run, "doc_id long, lang_pred string, score double")
        .select("doc_id", (crc_mod("doc_id", folds) == held).alias("held_out"), "lang_pred", "score")
    )
