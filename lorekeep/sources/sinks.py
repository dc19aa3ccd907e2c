"""Sinks: catalogs, content-addressed stores, census texts, reports. Each is published whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.errors import assert_none
from lorekeep.operators.audit import duplicates


def write_catalog(articles: DataFrame, path: str) -> None:
    """Articles in order of their key, compressed; keys must be unique. Spark's committer publishes the whole write."""
    assert_none(duplicates(articles, ["project", "page_id"]), "DuplicatePage", "project", "page_id")
    articles.repartitionByRange("project", "page_id").sortWithinPartitions("project", "page_id").write.option(
        "compression", "zstd"
    ).parquet(path)


def write_objects(objects: DataFrame, path: str) -> None:
    """A content-addressed store of (content): one object for each digest, by its first two hex digits."""
    stored = objects.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    stored.withColumn("prefix", F.substring("sha256", 1, 2)).write.partitionBy("prefix").parquet(path)


def write_census(ids: DataFrame, path: str) -> None:
    """Distinct ids, ascending over the files in name order, one a line."""
    ids.select(F.col("id").cast("long")).distinct().repartitionByRange("id").sortWithinPartitions("id").select(
        F.col("id").cast("string").alias("value")
    ).write.text(path)


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON, one a line, fields in column order, nulls written."""
    report.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)
