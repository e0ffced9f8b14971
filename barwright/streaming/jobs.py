"""Structured Streaming: candles from event files, upserts, and sticky ownership with checkpointed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barwright.operators import live
from barwright.sources import candles


def stream_of(spark: SparkSession, path: str, schema: str, format: str = "parquet", files_per_batch: int = 16) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def stream_bars(events: DataFrame, length: str = "1 hour", interval: str = "1h", late: str = "2 hours", offset: float = 1000.0) -> DataFrame:
    """Candles by event type, each given out once no event may come for it any more."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", (F.lit(offset) + F.col("value")).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("k")).withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", length).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("k").alias("volume")
    )
    return grouped.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("ts"), *candles.PRICES, "volume")


def upsert_into(path: str):
    """A foreachBatch sink that puts each batch's bars into a candle table; a batch that is run again changes nothing."""

    def sink(batch: DataFrame, _: int) -> None:
        candles.merge(path, batch)

    return sink


def sticky_targets(polls: DataFrame, max_position: int) -> DataFrame:
    """Priority combination over a stream of polls(symbol, ts, live_id, quantity): each symbol's owner is kept as state."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        owner, out = live.fold_polls(key, frames, None if owner is None or owner < 0 else int(owner), max_position)
        state.update((-1 if owner is None else owner,))
        yield out

    return polls.groupBy("symbol").applyInPandasWithState(fold, "symbol string, ts timestamp, owner long, target int", "owner long", "append", GroupStateTimeout.NoTimeout)


def decision_lines(out: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Write decisions as JSON lines, in a folder for each UTC day."""
    writer = out.withColumn("day", F.to_date("ts")).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="900 seconds")).start()
