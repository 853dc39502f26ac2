"""Structured Streaming over event files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.session import ensure_checkpoint_dir, ship

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, *, pattern: str = "events*.parquet", files: int = 100) -> DataFrame:
    """The event files of a folder as a stream, with `at` as a time that can carry a watermark."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> None:
    """R-1: everything there is, batch by batch through `each`; with a lasting `checkpoint` a later call sees only what is new."""
    spark = stream.sparkSession
    at = checkpoint or f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()


def to_table(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream that has run to its end, as a table in the shared folder; `complete` keeps the last state."""
    spark = stream.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/result-{uuid.uuid4().hex}"
    # a folder for each batch: one that is tried again replaces itself, and a complete result is that of the last batch
    ids: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        ids.append(batch)

    run_available(stream, write, mode)
    return spark.read.parquet(f"{path}/batch={max(ids)}" if mode == "complete" else path).drop("batch")


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """R-7: tumbling windows with a watermark."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("value"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """R-7: sessions of a user."""
    return stream.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"))


def distinct_events(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """R-7: each event id once within the watermark."""
    return stream.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def clicks_before_purchases(stream: DataFrame, hours: int = 1) -> DataFrame:
    """R-7: a join of two streams with time bounds, so that its state can be dropped."""
    clicks = stream.where("event_type = 'click'").withWatermark("at", "1 hour").select(F.col("user_id").alias("c_user"), F.col("at").alias("clicked"), F.col("event_id").alias("click"))
    buys = stream.where("event_type = 'purchase'").withWatermark("at", "1 hour").select("user_id", F.col("at").alias("bought"), F.col("event_id").alias("purchase"))
    return buys.join(clicks, F.expr(f"user_id = c_user AND clicked <= bought AND clicked >= bought - interval {hours} hours")).select("purchase", "click")


def gap_state(stream: DataFrame) -> DataFrame:
    """R-5: user_id, events, mean_gap: running gaps between the events of a user, in seconds.

    The state of a user is three numbers. The events of a batch are taken in the order of their time; an event older than the last
    of an earlier batch counts without a gap.
    """
    ship(stream.sparkSession)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, last = state.get if state.exists else (0, 0.0, float("nan"))
        for at in sorted(x for f in frames for x in f["seconds"]):
            if n and at >= last:
                total += at - last
            last = at if not n or at > last else last
            n += 1
        state.update((n, total, last))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "mean_gap": [total / (n - 1) if n > 1 else None]})

    seconds = stream.select("user_id", (F.unix_micros("at") / 1e6).alias("seconds"))
    return seconds.groupBy("user_id").applyInPandasWithState(step, "user_id long, events long, mean_gap double", "n long, total double, last double", "update", GroupStateTimeout.NoTimeout)
