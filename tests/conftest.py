import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


def made_bars(seed: int, n: int = 600, symbol: str = "X"):
    """Hourly bars of a market with regimes, jumps, a stretch without trades and a weekend: each bar is a path of eight ticks."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(seed)
    ticks = rng.standard_t(4, (n, 8)) * 0.0012 + 0.0004 * np.sin(np.arange(n) // 75)[:, None]
    ticks[rng.choice(n, 6, replace=False), 0] += rng.choice([-0.05, 0.04], 6)  # jumps at the open
    quiet = slice(n // 3, n // 3 + 7)
    ticks[quiet] = 0.0
    path = 40.0 * np.exp(np.cumsum(ticks.ravel())).reshape(n, 8)
    volume = np.floor(rng.lognormal(6, 1.2, n))
    volume[quiet] = 0.0
    hours = np.arange(n) + np.where(np.arange(n) >= 2 * n // 3, 47, 0)
    return pd.DataFrame(
        {"symbol": symbol, "interval": "1h", "ts": pd.Timestamp("2023-03-06 05:00") + pd.to_timedelta(hours, unit="h"), "open": path[:, 0], "high": path.max(1), "low": path.min(1), "close": path[:, -1], "volume": volume}
    )


@pytest.fixture(scope="session")
def series():
    return made_bars(11)


@pytest.fixture(scope="session")
def bars(spark, series):
    from barwright.sources.candles import SCHEMA

    return spark.createDataFrame(series, SCHEMA).checkpoint()
