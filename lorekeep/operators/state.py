"""State tables as pure functions: each takes tables and returns their next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.errors import LorekeepError


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Latest row of each key, changes over current rows of the same version."""
    every = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), F.col("__new").desc())
    return every.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__new")


def latest(rows: DataFrame, keys: list[str], order: list[Column], value: str) -> DataFrame:
    """The last value of each key by aggregation, so that a hot key is combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value))


def conditional(rows: DataFrame, settings: DataFrame, key: str, expected: str) -> DataFrame:
    """Rows, if a setting has the expected value; none otherwise (compare and swap, consent, generation)."""
    ok = settings.where((F.col("key") == key) & (F.col("value") == expected)).limit(1).count() == 1
    return rows if ok else rows.limit(0)


def compare_and_swap(settings: DataFrame, key: str, old: str, new: str) -> DataFrame:
    swap = (F.col("key") == key) & (F.col("value") == old)
    return settings.withColumn("value", F.when(swap, F.lit(new)).otherwise(F.col("value")))


def cascade_delete(threads: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Threads, and their messages, without the threads in ``gone`` (conv_id)."""
    ids = gone.select("conv_id").distinct()
    return threads.join(ids, "conv_id", "left_anti"), messages.join(ids, "conv_id", "left_anti")


def exchanges(messages: DataFrame) -> DataFrame:
    """User turns with the assistant's reply that directly follows: (conv_id, turn, question, answer)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return (
        messages.where("role in ('user', 'assistant')")
        .withColumn("next_role", F.lead("role").over(w))
        .withColumn("answer", F.lead("text").over(w))
        .where("role = 'user' and next_role = 'assistant'")
        .select("conv_id", "turn", F.col("text").alias("question"), "answer")
    )


def recent_within(messages: DataFrame, budget: int, most: int) -> DataFrame:
    """Newest turns of each conversation while their bytes fit the budget, at most ``most``; stops at the first that doesn't fit."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    size = F.octet_length("text")
    return (
        messages.withColumn("n", F.row_number().over(w))
        .withColumn("used", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("used") <= budget) & (F.col("n") <= most))
        .select("conv_id", "turn", "role", "used")
    )


def evict(cache: DataFrame, owner: str, order: list[Column], size: str, max_rows: int, max_bytes: int) -> DataFrame:
    """What stays of a cache: the newest entries whose rows and bytes fit."""
    w = Window.partitionBy(owner).orderBy(*order)
    return (
        cache.withColumn("kept_rows", F.row_number().over(w))
        .withColumn("kept_bytes", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .where((F.col("kept_rows") <= max_rows) & (F.col("kept_bytes") <= max_bytes))
    )


def bounded(rows: DataFrame, order: list[Column | str], most: int) -> DataFrame:
    """The first ``most`` rows; one more is an error, not a truncation."""
    few = rows.orderBy(*order).limit(most + 1)
    if few.count() > most:
        raise LorekeepError("TooMany")
    return few


def due(last_success: int | None, now: int, interval_seconds: int) -> bool:
    """Whether maintenance is due; intervals are between a minute and 30 days."""
    if not 60 <= interval_seconds <= 30 * 86400:
        raise LorekeepError("InvalidInterval")
    return last_success is None or now - last_success >= interval_seconds


def save_exchanges(
    threads: DataFrame, messages: DataFrame, citations: DataFrame, batch: DataFrame, settings: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Threads, messages and citations with a batch of cited exchanges added, all three or none.

    ``batch`` has exchange (a number in order), generation, project, page_id, revision_id, question,
    answer, cited (block ids). Exchanges of another generation than the setting's are left out. Each
    starts a thread; new ids follow those that are there. A batch is a user's few exchanges.
    """
    now = settings.where(F.col("key") == "generation").select(F.col("value").cast("long").alias("generation"))
    fresh = batch.join(F.broadcast(now), "generation")  # one setting
    last = threads.agg(F.coalesce(F.max("thread_id"), F.lit(0)).alias("t")).crossJoin(messages.agg(F.coalesce(F.max("message_id"), F.lit(0)).alias("m")))
    n = F.row_number().over(Window.orderBy("exchange"))
    own = fresh.withColumn("n", n).crossJoin(F.broadcast(last)).select("*", (F.col("t") + F.col("n")).alias("thread_id"), (F.col("m") + 2 * F.col("n") - 1).alias("first"))
    new_threads = own.select("thread_id", "project", "page_id", "revision_id", F.col("question").alias("title"))
    turns = F.explode(F.array(
        F.struct(F.col("first").alias("message_id"), F.lit("user").alias("role"), F.col("question").alias("text")),
        F.struct((F.col("first") + 1).alias("message_id"), F.lit("assistant").alias("role"), F.col("answer").alias("text")),
    ))
    new_messages = own.select("thread_id", turns.alias("m")).select("m.message_id", "thread_id", "m.role", "m.text")
    new_citations = own.select((F.col("first") + 1).alias("message_id"), F.posexplode("cited").alias("place", "block_id"))
    return threads.unionByName(new_threads), messages.unionByName(new_messages), citations.unionByName(new_citations)


def saved_panel(bookmarks: DataFrame, history: DataFrame, settings: DataFrame, generation: int, most: int = 100) -> DataFrame:
    """One consistent view of the saved panel: (kind, place, page_id, at), bookmarks, then recent history if it is kept.

    All in one plan over one version of the tables; nothing at another generation.
    """
    ok = settings.where((F.col("key") == "generation") & (F.col("value") == str(generation))).select(F.lit(1).alias("one"))
    kept = settings.where((F.col("key") == "keep_history") & (F.col("value") == "true")).select(F.lit(1).alias("two"))

    def newest(rows: DataFrame, kind: str) -> DataFrame:
        top = rows.select("page_id", "at").orderBy(F.col("at").desc(), "page_id").limit(most)
        place = F.row_number().over(Window.orderBy(F.col("at").desc(), "page_id"))  # over ``most`` rows
        return top.select(F.lit(kind).alias("kind"), place.alias("place"), "page_id", "at")

    return newest(bookmarks, "bookmark").unionByName(newest(history, "visit").crossJoin(kept).drop("two")).crossJoin(ok).drop("one")
