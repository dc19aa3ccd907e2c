"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import (
    block_naming,
    compact_windows,
    covering_simhash,
    ftrl_langid,
    hard_negatives,
    hilbert_ann,
    license_scan,
    line_dedup,
    nnls_packing,
    pivotal_mixing,
    pu_toxicity,
    suffix_dedup,
    vector_codes,
)
from lorekeep.llm.common import table
from lorekeep.llm.sql import ORACLE_SQL

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.substring_duplicates(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op4_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("root", "text_key")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ftrl_langid.identify(table(spark, sf_dir, "documents"))


def op7_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivotal_mixing.mix(table(spark, sf_dir, "documents")).drop("text_key")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.array_join("removed_lines", ",").alias("removed_lines"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return left.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.embedded(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label))


def op13_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(vector_codes.usable()).select("vec_id", "label", vector_codes.whole().alias("v"))
    coded, books = vector_codes.compress(rows)
    return vector_codes.label_errors(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pu_toxicity,
        op2_compact_windows,
        op3_exact_dedup,
        op4_covering_simhash,
        op5_license_scan,
        op6_language_id,
        op7_hilbert_neighbours,
        op8_nnls_packing,
        op9_source_mixing,
        op10_line_dedup,
        op11_suffix_dedup,
        op12_hard_negatives,
        op13_exponion_codes,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
