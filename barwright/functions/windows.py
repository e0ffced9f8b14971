"""Ordered windows per candle series, with undefined values as NULL, and tables kept for several jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A candle series: one symbol at one bar length.
SERIES = ("symbol", "interval")


def ordered():
    return Window.partitionBy(*SERIES).orderBy("ts")


def so_far():
    return ordered().rowsBetween(Window.unboundedPreceding, 0)


def last_rows(n: int):
    return ordered().rowsBetween(-(n - 1), 0)


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(aggregate, x: str | Column, n: int) -> Column:
    """aggregate(x) over the last n rows; NULL unless all n values are there."""
    x = col(x)
    return F.when(F.count(x).over(last_rows(n)) == n, aggregate(x).over(last_rows(n)))


def before(x: str | Column, n: int = 1) -> Column:
    return F.lag(col(x), n).over(ordered())


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def held(value: Column) -> Column:
    """The last non-NULL value so far."""
    return F.last(value, ignorenulls=True).over(so_far())


def true(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def sign(x: Column) -> Column:
    """-1, 0 or 1; NULL counts as 0."""
    return F.coalesce(F.signum(x), F.lit(0.0))


def plain(x: Column) -> Column:
    """NaN as NULL."""
    return F.nanvl(x.cast("double"), F.lit(None).cast("double"))


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A reliable checkpoint, in the folder of spark.checkpoint.dir, or if that is unset in `folder` or a local one (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None) or folder
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="barwright-"))
    return df.checkpoint()
