"""Recurrences in parts of time against whole series, and against loops over the bars."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import signals
from barwright.operators import recurrences
from barwright.plans import search
from barwright.sources.candles import SCHEMA
from tests.conftest import made_bars

EVERY = {"e": ("ema", 12), "m": ("macd", 12, 26, 9), "a": ("atr", 14), "x": ("adx", 14), "r": ("rsi", 14), "t": ("tsi", 25, 13), "f": ("force", 13), "p": ("psar", 0.02, 0.2), "q": ("psar", 0.04, 0.2), "s": ("supertrend", 10, 3.0)}


def loop(x, alpha, least):
    out, level, weight, count = np.full(len(x), np.nan), np.nan, 1.0, 0
    for i, v in enumerate(x):
        weight *= 1.0 - alpha
        if v == v:
            level = (weight * level + alpha * v) / (weight + alpha) if count else v
            weight, count = 1.0, count + 1
        if count and count >= least:
            out[i] = level
    return out


@pytest.mark.parametrize("seed", range(20))
def test_averages_of_stretches(seed):
    rng = np.random.default_rng(seed)
    for share in (0.0, 0.1, 0.9, 1.0):
        n, alpha, least = int(rng.integers(0, 400)), float(rng.choice([0.01, 0.3, 2 / 3, 1 / 14])), int(rng.integers(0, 20))
        x = np.where(rng.random(n) < share, np.nan, rng.standard_normal(n) * 10)
        want = loop(x, alpha, least)
        np.testing.assert_allclose(recurrences.ewm(x, alpha, least), want, rtol=1e-11, atol=1e-12)
        state, got, edges = recurrences.NEW, [], [0, *sorted(rng.integers(0, n + 1, 5)), n]
        for a, b in zip(edges, edges[1:], strict=False):
            got.append(recurrences.ewm(x[a:b], alpha, least, state))
            state = recurrences.advance(state, recurrences.ewm_map(x[a:b], alpha))
        np.testing.assert_allclose(np.concatenate(got), want, rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("seed", range(50))
def test_stops_of_stretches(seed):
    """Stops handed on over stretches are the loop's, bit by bit."""
    bars = made_bars(seed, 300)
    prices = np.stack([bars[c].to_numpy(float) for c in recurrences.PRICES])
    whole = recurrences.Bars(prices)
    want = [whole.psar(0.02, 0.2), *whole.supertrend(10, 2.0)]
    got, before = [], None
    for lo in range(0, 300, 37):
        part = recurrences.Bars(prices[:, lo : lo + 37], before, noting=True)
        if before is not None:
            before.known["atr", 10] = average
        got.append([part.psar(0.02, 0.2), *part.supertrend(10, 2.0)])
        average = recurrences.advance(average if lo else recurrences.NEW, part.maps["atr", 10])
        before = recurrences.Before(prices[:, : lo + 37][:, -2:].T.tolist(), guess=part.ends)
    np.testing.assert_array_equal(np.concatenate([g[0] for g in got]), want[0])
    for k in (1, 2):
        np.testing.assert_allclose(np.concatenate([g[k] for g in got]), want[k], rtol=1e-12)


@pytest.fixture(scope="module")
def several(spark):
    """Long and short series, some of one and two bars, in no order."""
    rows = pd.concat([made_bars(1, 600, "A"), made_bars(2, 350, "B"), made_bars(3, 60, "C")[:1], made_bars(4, 60, "D")[:2]])
    return spark.createDataFrame(rows.sample(frac=1, random_state=1), SCHEMA).checkpoint()


def sheet(df):
    return df.toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True)


@pytest.mark.parametrize("parts", [1, 5, 20, 120])
def test_in_parts(several, parts):
    """Ranges of about 50 bars and fewer, so that most begin within a series."""
    want, got = sheet(recurrences.add(several, EVERY)), sheet(recurrences.add(several, EVERY, parts))
    assert list(got.columns) == list(want.columns) and len(got) == 953
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9, check_dtype=False)


def test_few_ranges_are_gone_through_again(several):
    order = ["symbol", "interval", "ts"]
    ranged = several.repartitionByRange(12, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).checkpoint()
    before, rounds = recurrences.befores(ranged, EVERY)
    print(f"ranges gone through in each round: {rounds}; again: {sum(rounds[2:]) / rounds[1]:.2f} of those with a stretch to go on")
    assert rounds[0] == 12 and sum(rounds[2:]) < 4 * rounds[1]
    keys = {k for b in before.values() for k in b.known}
    assert all(set(b.known) == keys and len(b.tail) == 2 for b in before.values())


def test_nothing_and_gaps(spark, several):
    assert recurrences.add(several.limit(0), EVERY, 4).count() == 0
    holes = several.withColumn("close", F.when(F.hour("ts") % 5 != 0, F.col("close"))).withColumn("volume", F.when(F.hour("ts") != 7, F.col("volume"))).checkpoint()
    wanted = {k: v for k, v in EVERY.items() if v[0] in ("ema", "macd", "atr", "tsi", "force", "rsi")}
    pd.testing.assert_frame_equal(sheet(recurrences.add(holes, wanted, 15)), sheet(recurrences.add(holes, wanted)), rtol=1e-9, atol=1e-9, check_dtype=False)


def test_votes_and_search_in_parts(several, monkeypatch):
    """A series longer than a task's bars is searched like any other."""
    some = [signals.instance("ema_cross", fast=10, slow=50), signals.instance("supertrend_dir", period=10, multiplier=2.0), signals.instance("fvg_dir", min_gap_atr=0.5)]
    want, got = sheet(signals.with_votes(several, some, adx=14)), sheet(signals.with_votes(several, some, adx=14, parts=9))
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, check_dtype=False)
    config = search.Config(categories=("trend",), max_combo_size=1, dense=False, adx_filters=(None, 20.0))
    bars = several.where("symbol IN ('A', 'B')")
    want = {(r["symbol"], r["ordinal"]): r["dedup_key"] for r in search.search_all(bars, config).collect()}
    monkeypatch.setattr(search, "BARS_A_TASK", 100)
    assert {(r["symbol"], r["ordinal"]): r["dedup_key"] for r in search.search_all(bars, config, 2_000).collect()} == want
