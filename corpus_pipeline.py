"""A training-data pipeline of corpus operators: each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import block_naming, covering_simhash, nnls_packing, pivotal_mixing, pu_toxicity
from lorekeep.llm.common import crc_mod, join_row_decisions, keep_rows, save, table
from lorekeep.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    classifier = pu_toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return pu_toxicity.reject(docs, classifier)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, that with the smallest id."""
    found = save(block_naming.exact_duplicates(docs), "pipeline-exact")
    rows = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows"), F.max("kept").alias("kept"))
    return keep_rows(docs, rows.where("kept").drop("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that with the smallest id; null ids come last."""
    found = save(covering_simhash.near_duplicates(docs), "pipeline-near")
    rows = found.groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n_rows"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n_rows")
    return keep_rows(docs, rows.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key", "first.n_rows"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows of one id and text are one document in as many copies."""
    copies = pivotal_mixing.mix(docs).groupBy("doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("copies").cast("int").alias("copies")
    )
    copies = save(copies.where("copies > 0"), "pipeline-copies")
    once, decision = join_row_decisions(docs, copies.where("n_rows = 1"))
    times = F.explode(F.sequence(F.lit(1), F.col(decision)["copies"]))
    again, also = join_row_decisions(keep_rows(docs, copies.where("n_rows > 1").select("doc_id", "text_key", "n_rows")), copies.where("n_rows > 1"))
    more = F.explode(F.sequence(F.lit(1), F.col(also)["copies"]))
    return once.select(*docs.columns, times.alias(decision)).drop(decision).unionByName(
        again.select(*docs.columns, more.alias(also)).drop(also)
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in sequences of 1024 tokens."""
    return nnls_packing.pack(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Drawn copies, trained scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the input of the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = save(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
