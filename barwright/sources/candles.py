"""Candle tables: schemas, bars from events, cleaning, upserts and checkpoints of ingestion."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions.windows import kept

PRICES = ("open", "high", "low", "close")
COLUMNS = ("symbol", "interval", "ts", *PRICES, "volume")
SCHEMA = "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"
CHECKPOINTS = "symbol string, interval string, last_ts timestamp, rows long, updated_at timestamp"
KEY = ("symbol", "interval", "ts")
#: Column that says which of several rows of a bar came last.
ARRIVAL = "_arrival"
#: A candle table's partitions: an upsert rewrites the months that it touches.
PARTITIONS = ("symbol", "interval", "month")


def bars(events: DataFrame, ts: Column, price: Column, volume: Column, symbol: Column, length: str = "1 hour", interval: str = "1h") -> DataFrame:
    """Open, high, low, close and volume of each symbol's events by stretches of time, in one aggregation with map-side combining."""
    rows = events.select(symbol.alias("symbol"), ts.cast("timestamp").alias("at"), price.alias("price"), volume.alias("volume"))
    grouped = rows.groupBy("symbol", F.window("at", length).alias("w")).agg(
        F.min_by("price", "at").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "at").alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.select("symbol", F.lit(interval).alias("interval"), F.col("w.start").alias("ts"), *PRICES, "volume")


def event_bars(events: DataFrame, symbol: Column | None = None, length: str = "1 hour", interval: str = "1h", offset: float = 1000.0) -> DataFrame:
    """Candles of the `events` table: price offset + value, volume the k of props; by event type unless a symbol is given."""
    k = F.get_json_object("props", "$.k").cast("double")
    return bars(events, F.col("ts"), F.lit(offset) + F.col("value"), k, F.col("event_type") if symbol is None else symbol, length, interval)


def order_bars(orders: DataFrame, symbol: Column | None = None) -> DataFrame:
    """Daily candles of order prices; within a day orders stand in the order of their keys, and volume counts them."""
    rows = orders.select((F.col("o_orderstatus") if symbol is None else symbol).alias("symbol"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").cast("double").alias("p"))
    grouped = rows.groupBy("symbol", "day").agg(F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "k").alias("close"), F.count("*").cast("double").alias("volume"))
    return grouped.select("symbol", F.lit("1d").alias("interval"), F.col("day").cast("timestamp").alias("ts"), *PRICES, "volume")


def read(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Raw bars from Parquet, ORC, CSV or JSON; column names in lower case; all five values must be there.

    ARRIVAL orders the rows: by time of the file, its name, and their places in it.
    """
    reader = spark.read.format(format).options(**options)
    df = (reader.schema(SCHEMA) if format in ("csv", "json") else reader).load(path)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    df = df.select(*[F.col(f"`{c}`").alias(c.lower()) for c in df.columns], place.alias(ARRIVAL))
    if missing := [c for c in (*PRICES, "volume") if c not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    return df


def in_utc(df: DataFrame, zone: str | None = None, column: str = "ts") -> DataFrame:
    """Timestamps without a zone are taken as UTC, or as local times of `zone`. The session's zone must be UTC."""
    ts = F.col(column).cast("timestamp")
    return df.withColumn(column, F.to_utc_timestamp(ts, zone) if zone else ts)


def keep_last(df: DataFrame, sequence: str) -> DataFrame:
    """One row for each bar: the one that came last by `sequence`."""
    newest = Window.partitionBy(*KEY).orderBy(F.col(sequence).desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def complete(df: DataFrame) -> DataFrame:
    """Bars with all four prices; volume may be missing."""
    return df.select([F.nanvl(c, F.lit(None)).alias(c) if c in (*PRICES, "volume") else F.col(c) for c in df.columns]).na.drop(subset=list(PRICES))


def lookback(df: DataFrame, days: int = 720) -> DataFrame:
    """The last `days` days of each series."""
    last = df.groupBy("symbol", "interval").agg(F.max("ts").alias("_last"))
    return df.join(last, ["symbol", "interval"]).where(F.col("ts") >= F.col("_last") - F.make_interval(days=F.lit(days))).drop("_last")


def in_order(df: DataFrame, sequence: str | None = None) -> DataFrame:
    """With ARRIVAL: the column `sequence`; or if that is None what read() has put there, or else the order of the rows."""
    if sequence is not None:
        return df.withColumn(ARRIVAL, F.col(sequence))
    return df if ARRIVAL in df.columns else df.withColumn(ARRIVAL, F.monotonically_increasing_id())


def upsert(stored: DataFrame, arriving: DataFrame, sequence: str | None = None) -> DataFrame:
    """Stored bars with arriving ones added or put in their place; a missing volume is stored as 0.

    Of several arriving rows of a bar the last counts, see in_order().
    """
    last = keep_last(in_order(arriving, sequence), ARRIVAL)
    both = stored.select(*COLUMNS, F.lit(0).alias("_new")).unionByName(last.select(*COLUMNS, F.lit(1).alias("_new")))
    newest = Window.partitionBy(*KEY).orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select(*COLUMNS[:-1], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def _by_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("ts", "yyyyMM").cast("int"))


def write(df: DataFrame, path: str) -> None:
    """Replace the months of the series in `df` in a table partitioned by symbol, interval and month, and leave all else alone."""
    rows = _by_month(df.select(*COLUMNS)).repartition(*PARTITIONS).sortWithinPartitions(*PARTITIONS, "ts")
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*PARTITIONS).parquet(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """A candle table; one that isn't there yet is empty."""
    try:
        return spark.read.schema(f"{SCHEMA}, month int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], f"{SCHEMA}, month int")


def merge(path: str, arriving: DataFrame, sequence: str | None = None) -> None:
    """upsert() into the table at `path`: only the months of the series that `arriving` has bars of are read and written."""
    fresh = kept(in_order(arriving, sequence).select(*COLUMNS, ARRIVAL), f"{path}_checkpoints")
    touched = _by_month(fresh).select(*PARTITIONS).distinct()
    stored = table(arriving.sparkSession, path).join(F.broadcast(touched) if touched.count() < 10_000 else touched, list(PARTITIONS), "left_semi")
    write(kept(upsert(stored, fresh)), path)


def checkpoint(df: DataFrame) -> DataFrame:
    """CHECKPOINTS: last bar and number of rows of each series, as of now."""
    return df.groupBy("symbol", "interval").agg(F.max("ts").alias("last_ts"), F.count("*").alias("rows")).withColumn("updated_at", F.current_timestamp())


def arrived(raw: DataFrame, sequence: str | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Raw bars as they go into a table, one row each, the last of several (see in_order()); and their summary (symbol, interval, rows, start, end)."""
    rows = complete(keep_last(in_order(in_utc(raw), sequence), ARRIVAL))
    rows = (lookback(rows, days) if days else rows).select(*COLUMNS)
    return rows, rows.groupBy("symbol", "interval").agg(F.count("*").alias("rows"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def ingest(stored: DataFrame | None, arriving: DataFrame, sequence: str | None = None, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after an ingestion, and its summary of the arriving bars; see arrived()."""
    rows, summary = arrived(arriving, sequence, days)
    return upsert(rows.limit(0) if stored is None else stored, rows), summary


def load(table: DataFrame, symbol: str | None = None, interval: str | None = None) -> DataFrame:
    """Bars of one series, or all; both filters reach the table's partitions."""
    df = table
    for name, value in (("symbol", symbol), ("interval", interval)):
        df = df.where(F.col(name) == value) if value is not None else df
    return df.select(*COLUMNS).orderBy("symbol", "interval", "ts")
