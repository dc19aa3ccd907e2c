"""Audits: set differences, order and range checks, constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.lineage import save

EXAMPLES = 12


def census_diff(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Missing and unexpected ids: counts, and the first twelve of each side. One row.

    The sides are pre-aggregated to distinct ids and joined once; what differs is saved.
    The examples come from a top-k that each task prunes, not from gathering the difference.
    """
    e = expected.select(F.col(key).alias("id")).distinct().withColumn("e", F.lit(True))
    o = observed.select(F.col(key).alias("id")).distinct().withColumn("o", F.lit(True))
    both = save(e.join(o, "id", "full_outer").where("o is null or e is null"), "census-diff")
    missing, extra = both.where("o is null"), both.where("e is null")

    def side(rows: DataFrame, name: str) -> DataFrame:
        few = rows.select("id").orderBy("id").limit(EXAMPLES).agg(F.array_sort(F.collect_list("id")).alias(f"{name}_ids"))
        return rows.agg(F.count(F.lit(1)).alias(name)).join(few)

    return side(missing, "missing").join(side(extra, "unexpected"))


def not_increasing(rows: DataFrame, member: str, position: list[str], key: str) -> DataFrame:
    """Rows whose key does not exceed the one before, per member; ``position`` must be a total order."""
    before = F.lag(key).over(Window.partitionBy(member).orderBy(*position))
    return rows.withColumn("previous", before).where(F.col(key) <= F.col("previous"))


def not_increasing_overall(rows: DataFrame, position: str, key: str) -> DataFrame:
    """Rows, in the order of ``position`` over all of them, whose key does not exceed the one before.

    Spark sorts by range; each task looks at its own rows, and the rows at the tasks' borders, two
    from each, are compared with each other.
    """
    placed = save(rows.select(position, key).repartitionByRange(position).withColumn("part", F.spark_partition_id()), "in-order")
    inside = not_increasing(placed, "part", [position], key)
    ends = placed.groupBy("part").agg(F.min(F.struct(position, key)).alias("first"), F.max(F.struct(position, key)).alias("last"))
    before = F.lag("last").over(Window.orderBy("part"))  # over a row of each task
    borders = ends.withColumn("before", before).where(F.col(f"first.{key}") <= F.col(f"before.{key}"))
    return inside.select(position, key, "previous").unionByName(
        borders.select(F.col(f"first.{position}").alias(position), F.col(f"first.{key}").alias(key), F.col(f"before.{key}").alias("previous"))
    )


def overlaps(ranges: DataFrame, start: str, end: str, group: str, tie: str) -> DataFrame:
    """Ranges that begin before the furthest end so far; ``tie`` orders equal ranges."""
    w = Window.partitionBy(group).orderBy(start, end, tie).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("furthest", F.max(end).over(w)).where(F.col(start) <= F.col("furthest"))


def outside_range(ids: DataFrame, ranges: DataFrame, member: str, key: str, start: str, end: str) -> DataFrame:
    """Ids outside the range that their member declares."""
    return ids.join(ranges, member).where((F.col(key) < F.col(start)) | (F.col(key) > F.col(end)))


def running_offsets(frames: DataFrame, shard: str, order: str, size: str) -> DataFrame:
    """Where each frame starts: the sizes before it in its shard."""
    w = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("offset", F.coalesce(F.sum(size).over(w), F.lit(0)))


def orphans(rows: DataFrame, owners: DataFrame, on: list[str]) -> DataFrame:
    """Rows that no owner refers to."""
    return rows.join(owners.select(*on).distinct(), on, "left_anti")


def duplicates(rows: DataFrame, keys: list[Column | str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
