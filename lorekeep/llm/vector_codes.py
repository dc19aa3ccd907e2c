"""Compression of vectors into codes: product codebooks, assigned by exponion search.

A vector is cut into parts; each part position has a codebook, and a vector's code
is the number of the nearest entry for each part. Assignment starts at the entry a
part had before. With u the distance to it, any nearer entry lies within 2u of that
entry, so only the beginning of its list of neighbours, sorted by distance, is
looked at. All distances are squares of integers, so the bound is exact, and ties go
to the lower index.

Tasks keep codes beside the vectors and send sums for each entry; only codebooks,
whose size doesn't depend on the rows, come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import save

PARTS = 16
ENTRIES = 64
ROUNDS = 2
#: Components are multiplied by this and rounded down.
SCALE = 256
#: Integer components are held within this, so that no sum of squares leaves 64 bits.
REACH = 1 << 24
#: Neighbours looked at in one step.
STEP = 8


def usable(col: str = "embedding") -> Column:
    """Whether a vector takes part: not null, no null or non-finite component."""
    bad = F.exists(col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.col(col).isNotNull() & ~F.coalesce(bad, F.lit(False))


def whole(col: str = "embedding", scale: int = SCALE, reach: int = REACH) -> Column:
    """The components as integers: scaled, rounded down, held within ``reach``."""
    held = lambda c: F.greatest(F.least(c.cast("double") * scale, F.lit(float(reach))), F.lit(-float(reach)))
    return F.transform(col, lambda c: F.floor(held(c)).cast("long"))


@dataclass
class Codebook:
    """The entries of one part position, and for each entry all entries by their squared distance from it, itself first."""

    entries: np.ndarray
    order: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Codebook:
        squares = ((entries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index = np.broadcast_to(np.arange(len(entries)), squares.shape)
        own = index.T != index  # an equal entry doesn't come before the entry itself
        order = np.lexsort((index, own, squares), axis=1)
        return cls(entries, order, np.take_along_axis(squares, order, axis=1))


def exponion(points: np.ndarray, book: Codebook, previous: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry, its squared distance, number of distances taken) of integer ``points``.

    ``previous`` holds an entry for each point to start at. For an entry at distance v <= u of a point, with u that of
    the previous entry, the two entries are at most u + v <= 2u apart: its squared distance is at most 4u squared.
    """
    k = len(book.entries)
    best = ((points - book.entries[previous]) ** 2).sum(axis=1)
    taken = len(points)
    key = best * k + previous  # by distance, then by index
    for a in np.unique(previous).tolist():
        rows = np.flatnonzero(previous == a)
        within = np.searchsorted(book.squares[a], 4 * best[rows], side="right")
        for s in range(1, k, STEP):
            more = within > s
            rows, within = rows[more], within[more]
            if not len(rows):
                break
            near = book.order[a, s : s + STEP]
            d = ((points[rows][:, None, :] - book.entries[near][None]) ** 2).sum(axis=2) * k + near
            inside = np.arange(s, s + len(near)) < within[:, None]
            taken += int(inside.sum())
            key[rows] = np.minimum(key[rows], np.where(inside, d, np.iinfo(np.int64).max).min(axis=1))
    return key % k, key // k, taken


def _points(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten()).astype(np.int64).reshape(batch.num_rows, dim)


def _assign(rows: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """``rows`` with the code and error of this round; ``code`` is where the search starts, entry 0 at first."""
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _points(b, dim)
            before = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(len(v), len(books))
            code, error = np.empty_like(before), np.zeros(len(v), dtype=np.int64)
            for p, book in enumerate(books):
                found, square, _ = exponion(v[:, p * width : (p + 1) * width], book, before[:, p].astype(np.int64))
                code[:, p] = found
                error += square
            columns = {n: b.column(n) for n in b.schema.names} | {"code": pa.array([r.tobytes() for r in code], pa.binary()), "error": pa.array(error)}
            yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(run, rows.schema)


def _sums(rows: DataFrame, parts: int, entries: int, dim: int) -> DataFrame:
    """(part, entry, at, total, n): of the parts assigned to each entry; one row for each of them and task."""
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for b in batches:
            if b.num_rows:
                v = _points(b, dim).reshape(b.num_rows, parts, width)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), dtype=np.uint8).reshape(len(v), parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], v[:, p])
                    n[p] += np.bincount(code[:, p], minlength=entries)
        part, entry = np.nonzero(n)
        if len(part):
            part, entry = np.repeat(part, width), np.repeat(entry, width)
            at = np.tile(np.arange(width), len(part) // width)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (part, entry, at, total[part, entry, at], n[part, entry])], names=["part", "entry", "at", "total", "n"]
            )

    summed = rows.select("v", "code").mapInArrow(run, "part long, entry long, at long, total long, n long")
    return summed.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def compress(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of integer vectors, and the codebooks: one array of entries by components for each part.

    ``rows`` has (vec_id, label, v) with ``v`` an array of longs. The result has vec_id, label, code (binary, a byte for
    each part), error (the squared distances of all parts), a row for each row.

    * Codebooks start as the parts of the ``entries`` smallest ids, null ids last and ties by vector. In each round
      parts go to their nearest entry, ties to the lower index, and entries become the means of their parts, rounded
      down; entries without parts stay. Rows that repeat an id or a vector count as often as they occur.
    * Vectors have the length that most have, ties to the shorter. A row of another length, or any row if that length
      isn't a multiple of ``parts``, has no code: ``code`` and ``error`` are null, and it changes no codebook.
    * Fewer rows than ``entries`` give fewer entries, and no rows none.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept = save(rows.select("vec_id", "label", "v"), "code-vectors")
    most = kept.groupBy(F.size("v").alias("dim")).count().orderBy(F.col("count").desc(), "dim").head(1)
    dim = most[0]["dim"] if most else 0
    good = F.size("v") == (dim if dim and dim % parts == 0 else -1)
    first = kept.where(good).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    if not first:
        none = kept.select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, [np.zeros((0, 0), dtype=np.int64) for _ in range(parts)]
    width = dim // parts
    books = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), parts, width).swapaxes(0, 1).copy()
    state = kept.where(good).withColumn("code", F.lit(bytes(parts))).withColumn("error", F.lit(0).cast("long"))
    for _ in range(rounds):
        state = save(_assign(state, [Codebook.of(e) for e in books], dim), "code-round")
        for r in _sums(state, parts, len(first), dim).collect():  # parts x entries x width rows
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    coded = _assign(state, [Codebook.of(e) for e in books], dim).select("vec_id", "label", "code", "error")
    other = kept.where(~good).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.unionByName(other), list(books)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(x) for e in books for x in e.ravel().tolist()).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the errors of its label summed; null labels count as one label."""
    coded = save(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")
