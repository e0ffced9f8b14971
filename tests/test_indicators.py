"""Indicators against plain pandas formulas, and their invariants."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import indicators as ta
from barwright.functions.sheet import Sheet
from barwright.operators.recurrences import ewm
from barwright.sources.candles import SCHEMA


def values(bars, *wanted):
    s = Sheet()
    names = []
    for make, params in wanted:
        made = make(s, **params)
        names += list(made) if isinstance(made, tuple) else [made]
    return s.apply(bars).orderBy("symbol", "ts").toPandas(), names


def close_to(got, want, tolerance=1e-9):
    got, want = np.asarray(pd.to_numeric(got), float), np.asarray(want, float)
    assert (np.isnan(got) == np.isnan(want)).all()
    assert np.nanmax(np.abs(got - want), initial=0) < tolerance * max(1, np.nanmax(np.abs(want), initial=0))


def test_moving_averages(bars, series):
    df, (sma, ema, wma) = values(bars, (ta.sma, {"n": 20}), (ta.ema, {"n": 20}), (ta.wma, {"n": 10}))
    c = series["close"]
    close_to(df[sma], c.rolling(20, min_periods=20).mean())
    close_to(df[ema], c.ewm(span=20, adjust=False, min_periods=20).mean())
    close_to(df[wma], c.rolling(10).apply(lambda x: (x * np.arange(1, 11)).sum() / 55, raw=True))


@pytest.mark.parametrize("gaps", [(), (0, 1, 2), (5, 6, 20), (0, 3, 4, 5, 50, 59)])
@pytest.mark.parametrize("least", [0, 1, 10])
def test_ewm_with_gaps(gaps, least):
    x = pd.Series(np.random.default_rng(3).normal(size=60))
    x.iloc[list(gaps)] = np.nan
    want = x.ewm(alpha=0.2, adjust=False, min_periods=least).mean()
    close_to(ewm(x.to_numpy(), 0.2, least), want, 1e-12)


def test_momentum(bars, series):
    df, (rsi, mom, roc, k, d) = values(bars, (ta.rsi, {}), (ta.momentum, {}), (ta.roc, {}), (ta.stochastic, {}))
    c, h, low = series["close"], series["high"], series["low"]
    diff = c.diff()
    gain, loss = (x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean() for x in (diff.clip(lower=0), (-diff).clip(lower=0)))
    close_to(df[rsi], 100 - 100 / (1 + gain / loss))
    assert df[rsi].dropna().between(0, 100).all()
    close_to(df[mom], c.diff(10))
    close_to(df[roc], 100 * (c / c.shift(12) - 1))
    fast = (100 * (c - low.rolling(14).min()) / (h.rolling(14).max() - low.rolling(14).min())).rolling(3).mean()
    close_to(df[k], fast)
    close_to(df[d], fast.rolling(3).mean())


def test_bands_and_ranges(bars, series):
    df, names = values(bars, (ta.bollinger, {}), (ta.donchian, {}), (ta.atr, {}), (ta.true_range, {}))
    mid, upper, lower, _, _, top, bottom, _, atr, tr = names
    c = series["close"]
    close_to(df[upper], c.rolling(20).mean() + 2 * c.rolling(20).std(ddof=0), 1e-8)
    full = df.dropna(subset=[upper])
    assert (full[lower] <= full[mid]).all() and (full[mid] <= full[upper]).all()
    close_to(df[top], series["high"].rolling(20).max())
    close_to(df[bottom], series["low"].rolling(20).min())
    assert (df[atr].dropna() >= 0).all()
    assert df[tr].iloc[0] == pytest.approx(series["high"][0] - series["low"][0])


def test_macd_histogram(bars):
    df, (line, signal, hist) = values(bars, (ta.macd, {}))
    full = df.dropna(subset=[hist])
    assert np.allclose(full[line] - full[signal], full[hist])


def test_directions(bars):
    df, (line, way, sar) = values(bars, (ta.supertrend, {}), (ta.parabolic_sar, {}))
    assert set(df[way]) <= {1.0, -1.0} and (df[way].iloc[:9] == 1).all()
    assert df[line].isna().sum() >= 10 and df[sar].notna().all()


def test_session_vwap_starts_anew(spark):
    rows = [("X", "1h", "2024-06-03 13:30:00", 110.0, 100.0, 105.0, 1000.0), ("X", "1h", "2024-06-03 14:30:00", 112.0, 102.0, 107.0, 2000.0), ("X", "1h", "2024-06-04 13:30:00", 200.0, 190.0, 195.0, 500.0)]
    df = spark.createDataFrame(rows, "symbol string, interval string, ts string, high double, low double, close double, volume double").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("open", F.col("close"))
    got, (vwap,) = values(df, (ta.vwap, {}))
    assert got[vwap].tolist() == pytest.approx([105.0, 106 + 1 / 3, 195.0])


ALL = [(f, {}) for f in (ta.sma, ta.wma, ta.ema, ta.macd, ta.atr, ta.adx, ta.aroon, ta.parabolic_sar, ta.ichimoku, ta.supertrend, ta.rsi, ta.stochastic, ta.stoch_rsi, ta.cci, ta.williams_r, ta.roc, ta.momentum, ta.tsi, ta.bollinger, ta.keltner, ta.donchian, ta.fair_value_gap, ta.obv, ta.vwap, ta.cmf, ta.mfi, ta.ad_line, ta.force_index, ta.ease_of_movement)]


def test_nothing_looks_ahead(spark, series):
    changed = series.copy()
    changed.loc[400:, ["open", "high", "low", "close", "volume"]] *= 3
    one, names = values(spark.createDataFrame(series, SCHEMA), *ALL)
    two, _ = values(spark.createDataFrame(changed, SCHEMA), *ALL)
    for n in dict.fromkeys(names):
        close_to(two[n].iloc[:400], one[n].iloc[:400], 1e-8)


@pytest.mark.parametrize("n", [0, 1, 2, 29])
def test_short_flat_and_separate_series(spark, series, n):
    flat = series.head(n).assign(symbol="flat", open=5.0, high=5.0, low=5.0, close=5.0, volume=0.0)
    both = pd.concat([series.head(60), flat])
    one, names = values(spark.createDataFrame(both, SCHEMA), *ALL)
    alone, _ = values(spark.createDataFrame(series.head(60), SCHEMA), *ALL)
    for x in dict.fromkeys(names):
        close_to(one.loc[one["symbol"] == "X", x], alone[x], 1e-8)
    assert (one["symbol"] == "flat").sum() == n
