"""The media registry: owners, notices, required bytes, clean-up plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.operators.audit import orphans


def unowned(objects: DataFrame, owners: DataFrame) -> DataFrame:
    """Registered objects without an owner."""
    return orphans(objects, owners, ["digest"])


def clean_up_plan(objects: DataFrame, owners: DataFrame) -> DataFrame:
    """One row: objects that can go and their bytes."""
    return unowned(objects, owners).agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def dangling(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """References to objects that are not registered."""
    return orphans(refs, objects, ["digest"])


def required_bytes(uses: DataFrame, objects: DataFrame) -> DataFrame:
    """Distinct bytes that each owner needs: an object used twice counts once."""
    return uses.select("owner_id", "digest").distinct().join(objects, "digest").groupBy("owner_id").agg(
        F.count(F.lit(1)).alias("objects"), F.sum("bytes").alias("bytes")
    )


def owner_counts(owners: DataFrame) -> DataFrame:
    return owners.groupBy("digest").agg(F.count(F.lit(1)).alias("owners"), F.countDistinct("kind").alias("kinds"))


def mime_conflicts(uses: DataFrame) -> DataFrame:
    """Digests that are declared with more than one type."""
    return uses.groupBy("digest").agg(F.countDistinct("mime").alias("types"), F.min("mime").alias("first")).where("types > 1")


def remove_owner(owners: DataFrame, kind: str, owner_id: int) -> DataFrame:
    return owners.where(~((F.col("kind") == kind) & (F.col("owner_id") == owner_id)))


def register(owners: DataFrame, batch: DataFrame) -> DataFrame:
    """Owners with a batch added; what is there already stays as it is."""
    return owners.unionByName(batch).distinct()


def inventory_totals(required: DataFrame) -> DataFrame:
    """One row: distinct required objects, their bytes, and how many statements differ from another of the same digest."""
    stated = required.select("digest", "bytes", "mime").distinct()
    per_digest = stated.groupBy("digest").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return per_digest.agg(
        F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("conflicts")
    )


def least_warnings(warnings: DataFrame, most: int = 256, notice: str = "more warnings left out") -> DataFrame:
    """(place, warning): the ``most`` least distinct warnings, and a notice after them if there are more.

    Each task keeps its least ones; only ``most`` + 1 rows meet.
    """
    least = warnings.select("warning").distinct().orderBy("warning").limit(most + 1)
    place = F.row_number().over(Window.orderBy("warning"))  # over most + 1 rows
    return least.select(place.alias("place"), "warning").select(
        "place", F.when(F.col("place") > most, F.lit(notice)).otherwise(F.col("warning")).alias("warning")
    )
