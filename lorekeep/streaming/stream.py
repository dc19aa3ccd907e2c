"""Structured Streaming twins of the stateful scans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.errors import LorekeepError


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def windowed_counts(events: DataFrame, delay: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Events (ts, user_id, event_type) by window and type; late ones beyond ``delay`` are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("start"), "event_type", "n"
    )


def first_of_each(events: DataFrame, key: str, delay: str = "2 hours") -> DataFrame:
    """Events without repeats of a key within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def audit_shards(rows: DataFrame) -> DataFrame:
    """Ids (member, seq, id) of each member must increase; the first one that doesn't poisons the member.

    State is the last id and whether the member is poisoned. Rows of one batch are
    taken in the order of ``seq``. One row a member and batch: (member, seen, last_id, poisoned).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, poisoned = state.get if state.exists else (0, 0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        for i in rows["id"].tolist():
            if poisoned:
                break
            if i <= last:
                poisoned = True
            else:
                seen, last = seen + 1, i
        state.update((seen, last, poisoned))
        yield pd.DataFrame({"member": [key[0]], "seen": [seen], "last_id": [last], "poisoned": [poisoned]})

    return rows.groupBy("member").applyInPandasWithState(
        step, "member string, seen long, last_id long, poisoned boolean", "seen long, last long, poisoned boolean",
        "update", GroupStateTimeout.NoTimeout,
    )


def split_frames(buffer: str, budget: int = 1 << 20) -> tuple[list[str], str]:
    """Complete event-stream frames of a buffer, their data joined, and what is left over."""
    text = buffer.replace("\r\n", "\n") if not buffer.endswith("\r") else buffer[:-1].replace("\r\n", "\n") + "\r"
    *whole, rest = text.split("\n\n")
    if len(rest) > budget:
        raise LorekeepError("FrameTooLarge")
    frames = []
    for frame in whole:
        data = [line[5:].removeprefix(" ") for line in frame.split("\n") if line.startswith("data:")]
        if data:
            frames.append("\n".join(data))
    return frames, rest


def decode_events(chunks: DataFrame) -> DataFrame:
    """Event-stream frames of chunks (stream, seq, chunk), however they were cut: (stream, frame)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (rest,) = state.get if state.exists else ("",)
        frames: list[str] = []
        for chunk in pd.concat(list(batches)).sort_values("seq")["chunk"]:
            more, rest = split_frames(rest + chunk)
            frames += more
        state.update((rest,))
        yield pd.DataFrame({"stream": [key[0]] * len(frames), "frame": frames})

    return chunks.groupBy("stream").applyInPandasWithState(
        step, "stream string, frame string", "rest string", "append", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop, each batch appended to a Parquet table."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a batch run again replaces itself

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
