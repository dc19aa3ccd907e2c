"""Exact deduplication by deterministic block naming.

Every text is normalised and cut into blocks of a fixed size. All blocks of the
corpus are sorted and numbered, equal blocks alike, so that a text becomes a
short sequence of integers. Then, level by level, all adjacent pairs of integers
are sorted and numbered in the same way, until each text is one integer. Two
texts of equally many blocks are equal exactly if that integer is the same: no
step identifies different contents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import SPACE, save, text_key, text_or_empty

#: Characters in a block. Larger blocks mean fewer levels, smaller ones less to sort at once.
BLOCK_CHARS = 4096


def _blocks(norm: Column, block_chars: int) -> Column:
    """The text in pieces of ``block_chars``; an empty text is one empty block."""
    last = F.greatest(F.lit(0), F.ceil(F.length(norm) / block_chars).cast("int") - 1)
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.substring(norm, i * block_chars + 1, F.lit(block_chars)),
    )


def _handle(seed: int, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), block)


def _block_names(texts: DataFrame, block_chars: int, seed: int) -> tuple[DataFrame, int]:
    """Integer names of all distinct blocks as (handle, name), and the seed of the handles.

    A 64-bit handle stands for a block's contents in the joins, so that texts are
    shuffled once only. Sorting all blocks by handle shows whether two contents
    share one; then the next seed is taken, until the handles are injective.
    """
    blocks = texts.select(F.explode(_blocks(F.col("norm"), block_chars)).alias("block"))
    while True:
        sorted_blocks = (
            blocks.select(_handle(seed, F.col("block")).alias("handle"), "block")
            .groupBy("handle")
            .agg(F.min("block").alias("low"), F.max("block").alias("high"))
            .select("handle", (F.col("low") != F.col("high")).alias("clash"))
            .sortWithinPartitions("handle")
            .withColumn("name", F.monotonically_increasing_id())
        )
        names = save(sorted_blocks, "block-names")
        if not names.where("clash").head(1):
            return names.select("handle", "name"), seed
        seed += 1


def block_identities(
    docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, seed: int = 1
) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, text_sha256 (binary), row, n_blocks, name.

    (n_blocks, name) is the identity of the normalised text. ``row`` tells rows
    apart that repeat an id. Only ``doc_id`` and the text are read.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(text_col).alias("text_key"),
        F.regexp_replace(text_or_empty(text_col), SPACE, " ").alias("norm"),
    )
    names, seed = _block_names(texts, block_chars, seed)
    rows = save(
        texts.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "text_key",
            F.unhex(F.sha2("norm", 256)).alias("digest"),
            F.transform(_blocks(F.col("norm"), block_chars), lambda b: _handle(seed, b)).alias("handles"),
        ),
        "block-rows",
    )
    longest = rows.agg(F.max(F.size("handles"))).head()[0] or 1
    level = (
        rows.select("row", F.size("handles").alias("n_blocks"), F.posexplode("handles").alias("pos", "handle"))
        .join(names, "handle")
        .select("row", "n_blocks", F.col("n_blocks").alias("left"), "pos", "name")
    )
    done = []
    while True:
        level = save(level, "block-level")
        done.append(level.where("left = 1").select("row", "n_blocks", "name"))
        if longest <= 1:
            break
        longest = -(-longest // 2)
        pairs = (
            level.where("left > 1")
            .groupBy("row", "n_blocks", "left", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
            .agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            )
        )
        pairs = save(pairs, "block-pairs")
        numbered = (
            pairs.select("first", "second")
            .distinct()
            .sortWithinPartitions("first", "second")
            .withColumn("name", F.monotonically_increasing_id())
        )
        level = pairs.join(numbered, ["first", "second"]).select(
            "row", "n_blocks", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name"
        )
    identity = done[0]
    for d in done[1:]:
        identity = identity.unionByName(d)
    return rows.select("row", "doc_id", "text_key", F.col("digest").alias("text_sha256")).join(identity, "row")


def exact_duplicates(
    docs: DataFrame, text_col: str = "text", block_chars: int = BLOCK_CHARS, seed: int = 1
) -> DataFrame:
    """Group equal texts: doc_id, keep_id, group_size, kept, text_sha256, text_key, one row per row of ``docs``.

    * Texts are equal if they are the same after each run of white space became
      one space. A null text counts as empty; all empty texts are equal.
    * The smallest ``doc_id`` of a group stays; null ids come last. Of rows that
      repeat the smallest id with an equal text, exactly one has ``kept`` set.
    * No rows give no rows. Other columns of ``docs`` are neither read nor kept,
      whatever their names.
    """
    ids = save(block_identities(docs, text_col, block_chars, seed), "block-identities")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = ids.groupBy("n_blocks", "name").agg(
        F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size")
    )
    groups = save(groups, "block-groups")  # between two plain shuffles, Spark can split the rows of a large group
    return ids.join(groups, ["n_blocks", "name"]).select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("text_sha256")).alias("text_sha256"),
        "text_key",
    )
