"""What the corpus operators share: reading tables, cutting lineage, keeping rows by id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.lineage import save, scratch_dir

__all__ = [
    "SPACE", "MayHold", "crc_mod", "join_decisions", "join_row_decisions", "keep_rows", "save", "scratch_dir", "table", "text_key", "text_or_empty",
    "text_steps",
]

#: Runs of these characters separate words in every contract of this package.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text whose words a task holds at once; a longer text is held alone.
STEP_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark alone so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_mod(doc_id: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def join_decisions(docs: DataFrame, decisions: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` joined to one decision row per ``doc_id``, null ids included.

    The decision columns must not clash with columns of ``docs``.
    """
    d = decisions.withColumnRenamed("doc_id", "__decided_id")
    return docs.join(d, docs["doc_id"].eqNullSafe(d["__decided_id"]), how).drop("__decided_id")


def text_key(text_col: str = "text") -> Column:
    """A 64-bit name of a text, which with ``doc_id`` tells rows apart; null texts have one too."""
    return F.xxhash64(F.col(text_col).cast("string"))


def join_row_decisions(docs: DataFrame, decisions: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` joined to one decision for each (``doc_id``, ``text_key``), null ids included.

    Only one column is added, a struct of the decision's other columns; its name, which is
    returned too, is none of the columns of ``docs``.
    """
    own, key, name = (free_name(docs, n) for n in ("decided_id", "decided_key", "decision"))
    values = [c for c in decisions.columns if c not in ("doc_id", "text_key")]
    d = decisions.select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.struct(*values).alias(name))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col(own)) & (text_key(text_col) == F.col(key))
    return docs.join(d, same).select(*(docs[c] for c in docs.columns), name), name


class MayHold:
    """A table of bits that tells which ids may be among those of ``ids``: all of them, and few others.

    It has one size whatever the corpus, 2 MB, so at most 513 rows of 4 kB come to the driver
    and go to the tasks. Where ids are many it lets more others through; nothing else changes.
    """

    BITS, PRIME, WIDTH = 1 << 24, 16777213, 4096

    def __init__(self, ids: DataFrame, col: str) -> None:
        slot = F.pmod(F.coalesce(F.col(col), F.lit(-1)), F.lit(self.PRIME))
        parts = (
            ids.groupBy(F.bitmap_bucket_number(slot).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
            .collect()
        )
        self.table = np.zeros((self.BITS // (8 * self.WIDTH) + 2) * self.WIDTH, dtype=np.uint8)
        for r in parts:
            self.table[r["part"] * self.WIDTH : (r["part"] + 1) * self.WIDTH] = np.frombuffer(r["bits"], dtype=np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        """Whether each id may be among them."""
        k = ids.astype(np.int64) % self.PRIME
        at = np.where(k > 0, 8 * self.WIDTH + k - 1, 0)  # bucket p holds the slots from 1 + (p - 1) * 8 * WIDTH on
        return (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def text_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose texts, in the last column, are cut into steps of ``STEP_BYTES``."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.columns[-1]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + STEP_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to clash with no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, kept: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``kept`` (``doc_id``, ``text_key``, ``n_rows``) names, one of each name.

    ``n_rows`` is how many rows of ``docs`` have that name: the same id and the same text.
    """
    cols = docs.columns
    marked, decision = join_row_decisions(docs, kept, text_col)
    n = F.col(decision)["n_rows"]
    once = marked.where(n == 1).select(*cols)
    key = free_name(marked, "same_text")
    again = marked.where(n > 1).withColumn(key, text_key(text_col)).dropDuplicates(["doc_id", key]).select(*cols)
    return once.unionByName(again)
