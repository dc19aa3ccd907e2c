"""Versions of a table set: written aside, then published at once; readers see the last one published.

A version is a folder of its own; publishing adds one row to a small table of
versions, which is one atomic commit. A failed build leaves an unpublished folder
and the readers' version as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError

LISTED = "number long, version string, published_at timestamp, active boolean"


def versions(spark: SparkSession, root: str) -> DataFrame:
    """(number, version, published_at, active): what has been published and removed, a row for each act."""
    try:
        return spark.read.schema(LISTED).parquet(f"{root}/versions")
    except Exception as missing:  # no version yet
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LISTED)


def _next(spark: SparkSession, root: str, version: str, active: bool) -> None:
    number = (versions(spark, root).agg(F.max("number")).head()[0] or 0) + 1
    row = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(version).alias("version"), F.current_timestamp().alias("published_at"), F.lit(active).alias("active"))
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(version, number, published_at) of the versions that are there, newest first."""
    last = versions(spark, root).groupBy("version").agg(F.max(F.struct("number", "published_at", "active")).alias("v"))
    return last.where("v.active").select("version", "v.number", "v.published_at").orderBy(F.col("number").desc())


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that was published last."""
    row = listed(spark, root).head()
    if row is None:
        raise LorekeepError("NothingPublished", {"root": root})
    return f"{root}/{row['version']}"


def publish(spark: SparkSession, root: str, build: Callable[[str], None], verify: Callable[[str], None] | None = None) -> str:
    """Build a version aside, verify it, and make it the readers' own; its folder."""
    version = f"v-{uuid.uuid4().hex}"
    build(f"{root}/{version}")
    if verify is not None:
        verify(f"{root}/{version}")
    _next(spark, root, version, True)
    return f"{root}/{version}"


def switch(spark: SparkSession, root: str, version: str, required: DataFrame | None = None, objects: DataFrame | None = None) -> None:
    """Make an earlier version current again, if every ``required`` (digest) is among ``objects`` (digest)."""
    if not listed(spark, root).where(F.col("version") == version).head(1):
        raise LorekeepError("UnknownVersion", {"version": version})
    if required is not None:
        lost = required.join(objects, "digest", "left_anti").agg(F.min("digest")).head()[0]
        if lost is not None:
            raise LorekeepError("MissingObject", {"digest": lost})
    _next(spark, root, version, True)


def remove(spark: SparkSession, root: str, version: str) -> None:
    """Take a version off the list; the current one stays. Its files are left to the clean-up of the store."""
    if current(spark, root).endswith(f"/{version}"):
        raise LorekeepError("VersionInUse", {"version": version})
    _next(spark, root, version, False)
