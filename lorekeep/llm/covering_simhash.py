"""SimHash near-duplicates by covering locality-sensitive hashing.

Each text gets a 64-bit fingerprint. For radius 2, every bit position is given
one of the seven non-zero vectors of three bits, and each such vector v makes a
mask: the positions whose own vector has an odd inner product with v. Any two
positions have some v orthogonal to both, so two fingerprints that differ in at
most two bits agree under at least one of the seven masks: no pair within the
radius is missed. Seven tables of 36 or 37 bits take the place of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import save, text_key
from lorekeep.llm.components import components

BITS = 64
RADIUS = 2
WORDS = 3
SEED = 42
#: Fingerprints in a bucket up to which its pairs are compared; larger buckets go by shared neighbours.
SMALL_BUCKET = 32


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The covering masks of a radius, as unsigned integers."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if (v & (i % vectors + 1)).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned SimHash of a text's word shingles; 0 without words."""
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not w:
        return 0
    shingles = zip(*(w[k:] for k in range(words))) if len(w) >= words else iter([w])
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.fromiter((digest(join(s), seed) for s in shingles), dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py()) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long"), text_key(text_col), F.col(text_col).cast("string")).mapInArrow(
        run, "doc_id long, text_key long, fp long"
    )


def fingerprint_links(fps: DataFrame, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints of ``fps`` (fp) that keep all components within radius 2.

    In a bucket of up to ``small_bucket`` fingerprints all pairs are compared. In
    a larger one each fingerprint is written under itself and under itself with
    one unmasked bit turned: two of the bucket differ in at most two bits exactly
    if they share such a code, and all that share one link to the least of them.
    That is 28 or 29 rows for each fingerprint, whatever the size of the bucket.
    """
    tables = masks()
    keys = F.explode(
        F.array(
            *(
                F.struct(F.lit(k).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                for k, m in enumerate(tables)
            )
        )
    ).alias("t")
    keyed = fps.select("fp", keys).select("fp", "t.mask", "t.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = save(keyed.join(sizes, ["mask", "key"]), "simhash-buckets")
    small = met.where(F.col("n") <= small_bucket)
    pairs = (
        small.select("mask", "key", F.col("fp").alias("a"))
        .join(small.select("mask", "key", F.col("fp").alias("b")), ["mask", "key"])
        .where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
        .select("a", "b")
        .distinct()
    )
    free = F.array(
        *(
            F.array(F.lit(0).cast("long"), *(F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1))
            for m in tables
        )
    )
    codes = met.where(F.col("n") > small_bucket).select(
        "mask", "key", "fp", F.explode(F.element_at(free, F.col("mask") + 1)).alias("bit")
    )
    codes = codes.select("mask", "key", "fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("code"))
    least = codes.groupBy("mask", "key", "code").agg(F.min("fp").alias("b"), F.max("fp").alias("high"))
    shared = (
        codes.join(least.where("high > b").drop("high"), ["mask", "key", "code"])
        .where("fp > b")
        .select(F.col("fp").alias("a"), "b")
        .distinct()
    )
    return pairs.unionByName(shared)


def near_duplicates(docs: DataFrame, text_col: str = "text", small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Components of near-duplicates: doc_id, fingerprint, component_id, root, text_key, one row per row of ``docs``.

    * Two documents link if their fingerprints differ in at most two bits;
      ``component_id`` is the smallest id that links reach.
    * Texts without words, null ones too, have fingerprint zero and link like any
      other. Very short texts are one shingle. Repeated rows share a component.
    * Rows with a null id take part, and never name a component with others in it;
      ``root`` names each component, those without ids too.
    * No rows give no rows; other columns are not read.
    """
    rows = save(fingerprints(docs, text_col), "simhash")
    first = save(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(fingerprint_links(first.select("fp"), small_bucket)).select(
        F.col("node").alias("fp"), "root"
    )
    rooted = first.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(named, "root").select("fp", "component_id", "root")
    return rows.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", "text_key"
    )
