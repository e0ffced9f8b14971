"""Votes, combinations, enumeration, backtests and search."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions import signals
from barwright.operators import backtest as bt
from barwright.operators import report
from barwright.operators.tally import Tally
from barwright.plans import search, selection
from barwright.sources.candles import SCHEMA
from tests.conftest import made_bars

SMALL = search.Config(max_combo_size=2, dense=False)


def test_votes_are_discrete(bars):
    found = signals.votes(bars, signals.enumerate_instances()).select("vote").distinct().toPandas()
    assert set(found["vote"]) <= {-1.0, 0.0, 1.0}


def test_instances():
    every = signals.enumerate_instances()
    assert len(every) == 71 and len(signals.enumerate_instances(dense=True)) == 401
    assert len({i.key for i in every}) == 71
    assert all(dict(i.params)["fast"] < dict(i.params)["slow"] for i in every if "fast" in dict(i.params))
    assert [sum(i.category == c for i in every) for c in signals.CATEGORIES] == [42, 12, 10, 7]


@pytest.mark.parametrize(("dense", "want"), [(False, [142, 6110, 55502, 196622]), (True, [802, 208946, 9752450, 146538050])])
def test_counts(dense, want):
    assert [search.count(search.Config(max_combo_size=k, dense=dense)) for k in (1, 2, 3, 4)] == want


def test_exhaustive_counts():
    assert [search.count(search.Config(max_combo_size=k, cross_category_only=False)) for k in (1, 2, 3, 4)] == [802, 321602, 42988002, 4288294802]


@pytest.mark.parametrize("cross", [True, False])
def test_ordinals_are_the_nested_loops(cross):
    from itertools import combinations, product

    c = search.Config(categories=("volatility", "volume"), max_combo_size=3, dense=False, adx_filters=(None, 25.0), cross_category_only=cross)
    space = search.Space(c)
    pools = [[i for i in space.instances if i.category == name] for name in signals.CATEGORIES if name in c.categories]
    want = []
    for k in (1, 2) if cross else (1, 2, 3):
        if k == 1 or not cross:
            groups = list(combinations(space.instances, k))
        else:
            groups = [g for chosen in combinations(pools, k) for g in product(*chosen)]
        for g, mode, adx, rule in product(groups, c.modes, c.adx_filters, c.combines if k > 1 else c.combines[:1]):
            want.append(search.Spec(tuple(g), mode, adx, rule))
    got = dict(space.specs(np.arange(space.total)))
    assert [got[i] for i in range(space.total)] == want
    assert len({s.signature for s in want}) == len(want)
    assert all(search.Spec.from_json(s.to_json()) == s for s in want[:50])


def test_specifications_frame(spark):
    df = search.specifications(spark, SMALL, 100, 400)
    assert df.count() == 300 and df.select("signature").distinct().count() == 300


def test_buy_and_hold(bars, series):
    got = bt.backtest(bars.withColumn("position", F.lit(1.0)), 0.0).first()
    c, n = series["close"], len(series)
    assert got["total_return"] == pytest.approx(c.iloc[-1] / c.iloc[0] - 1)
    assert got["exposure"] == pytest.approx((n - 1) / n)
    assert (got["trade_count"], got["num_trades"], got["n_bars"]) == (1, 1, n)


def test_flat_is_zero_and_costs_cost(bars):
    flat = bt.backtest(bars.withColumn("position", F.lit(0.0))).first()
    assert all(flat[m] == 0 for m in bt.METRICS if m != "n_bars")
    turn = bars.withColumn("position", (F.hour("ts") % 2).cast("double"))
    assert bt.backtest(turn, 10.0).first()["total_return"] < bt.backtest(turn, 0.0).first()["total_return"]


def test_hourly_bars_a_year(bars):
    assert bt.periods_per_year(bars).first()["ppy"] == pytest.approx(8766)


def test_split_is_chronological_and_uses_doubles(spark):
    rows = spark.range(720).select(F.lit("X").alias("symbol"), F.lit("1h").alias("interval"), F.timestamp_seconds(F.col("id") * 3600).alias("ts"))
    halves = {r["half"]: r["count"] for r in bt.halves(rows).groupBy("half").count().collect()}
    assert halves == {"is": 503, "oos": 217}


@pytest.mark.parametrize("part", [16 << 20, 1, 9_000])
def test_matrix_agrees_with_windows(bars, monkeypatch, part):
    """The search's evaluator and the relational backtest give the same metrics, also where a series is in parts of a bar each."""
    monkeypatch.setattr(search, "PART_VOTES", part)
    config = replace(SMALL, adx_filters=(None, 25.0))
    space = search.Space(config)
    rows = [r.asDict() for r in search.prepare(bars, config).orderBy("part").collect()]
    assert [r["at"] for r in rows] == list(np.cumsum([0] + [len(r["close"]) // 8 for r in rows])[:-1]) and sum(len(r["close"]) // 8 for r in rows) == rows[0]["n"] == 600
    for ordinal in (0, 3, 160, 291, 300, 5001, 9002, 12001):
        spec = dict(space.specs(np.array([ordinal])))[ordinal]
        row = next(search.evaluate(space, map(search._unpacked, rows), np.array([ordinal]))).to_pylist()[0]
        got = {"is": row["train"], "oos": row["test"]}
        for r in bt.split_backtest(search.spec_positions(bars, spec)).collect():
            for m in bt.METRICS:
                assert got[r["half"]][m] == pytest.approx(r[m], rel=1e-8, abs=1e-10), (spec.signature, r["half"], m)


def plain_metrics(close, position, ppy, cost_bps):
    """One strategy over a whole series, as a loop over its bars and trades."""
    n = len(close)
    asset = np.concatenate(([0.0], close[1:] / close[:-1] - 1))[:n]
    held = np.concatenate(([0], position[:-1]))[:n]
    step = np.diff(held, prepend=0)
    r = held * asset - abs(step) * cost_bps / 1e4
    if not abs(r).sum():
        return {m: n if m == "n_bars" else 0 for m in bt.METRICS}
    equity, peak, deepest = 1.0, -np.inf, 0.0
    for x in r:
        equity *= 1 + x
        peak = max(peak, equity)
        deepest = min(deepest, equity / peak - 1)
    trades, log = [], None
    for k in range(n):
        if step[k] and log is not None:
            trades.append(log)
            log = None
        if held[k]:
            log = (log or 0.0) + np.log1p(max(r[k], bt.LOSS_FLOOR))
    trades += [] if log is None else [log]
    active, falls = held != 0, r[r < 0]
    cagr = np.expm1(np.log(equity) * ppy / n) if equity > 0 else 0.0
    cagr = cagr if np.isfinite(cagr) else 0.0
    off, down, won = r.std(), falls.std() if len(falls) else 0.0, sum(t > bt.WIN for t in trades)
    gain, loss = r[active & (r > 0)].sum(), -r[active & (r < 0)].sum()
    return {
        "total_return": equity - 1, "cagr": cagr, "ann_vol": off * ppy**0.5, "sharpe": r.mean() * ppy**0.5 / off if off > 0 else 0.0, "sortino": r.mean() * ppy**0.5 / down if down > 0 else 0.0,
        "max_drawdown": deepest, "calmar": cagr / -deepest if deepest < 0 else 0.0, "win_rate": (active & (r > 0)).sum() / active.sum() if active.any() else 0.0, "trade_win_rate": won / len(trades) if trades else 0.0,
        "trade_wins": won, "trade_count": len(trades), "profit_factor": gain / loss if loss > 0 else 0.0, "exposure": active.mean(), "num_trades": (step != 0).sum(), "n_bars": n,
    }


@pytest.mark.parametrize("seed", range(12))
def test_tallies_of_stretches(seed):
    """Bars added whole, in some stretches and one by one; with jumps by which a short loses more than all."""
    rng = np.random.default_rng(seed)
    n, m = int(rng.integers(1, 300)), 40
    close = 40 * np.exp(np.cumsum(rng.standard_t(2, n) * 0.05))
    if seed % 2:
        close = close * (1 + 1.6 * (rng.random(n) < 0.05))
    position = rng.integers(-1, 2, (m, n)).astype(np.int8)
    position[:8] = 0
    for k in range(8, 30):
        position[k] = np.repeat(rng.integers(-1, 2, n), 9)[:n]
    want = [plain_metrics(close, position[k].astype(int), 8766.0, 5.0) for k in range(m)]
    for cuts in ([], sorted(rng.integers(0, n + 1, 6)), range(n)):
        tally, edges = Tally(m, 5.0), [0, *cuts, n]
        for a, b in zip(edges, edges[1:], strict=False):
            tally.add(close[a:b], position[:, a:b])
        got = tally.metrics(8766.0)
        for k in range(m):
            for name in bt.METRICS:
                assert got[name][k] == pytest.approx(want[k][name], rel=1e-9, abs=1e-12), (cuts, k, name)


def test_search_in_parts_of_time(bars, monkeypatch):
    config = replace(SMALL, categories=("volume",), adx_filters=(None, 20.0))
    want = {r["ordinal"]: r for r in search.search_all(bars, config).collect()}
    for most in (search.MOST_BROADCAST, 0):
        monkeypatch.setattr(search, "MOST_BROADCAST", most)
        packed = search.kept(search.prepare(bars, config, 400).repartition(3, F.rand(7)))  # parts in any order
        assert packed.count() > 10
        got = {r["ordinal"]: r for r in search.first_of_each(search.search(packed, config)).collect()}
        assert set(got) == set(want)
        for o, r in got.items():
            assert [r[c] for c in ("signature", "run_id", "num_trades", "dedup_key")] == [want[o][c] for c in ("signature", "run_id", "num_trades", "dedup_key")]
            assert [r[c] for c in ("score", "oos_return", "oos_max_drawdown", "win_rate")] == pytest.approx([want[o][c] for c in ("score", "oos_return", "oos_max_drawdown", "win_rate")], rel=1e-9, abs=1e-12)


def test_search_report_and_selection(spark, bars, tmp_path):
    path = str(tmp_path)
    config = replace(SMALL, categories=("volatility", "volume"))
    total = search.count(config)
    (run,) = search.run_search(spark, bars, config, path, chunk=100, most_chunks=2)
    assert search.results(spark, path).select(F.max("ordinal")).first()[0] < 200
    assert search.run_search(spark, bars, config, path, chunk=100) == [run]  # goes on where it stopped
    stored = search.results(spark, path)
    whole = search.search_all(bars, config)
    assert sorted(r["ordinal"] for r in stored.collect()) == sorted(r["ordinal"] for r in whole.collect())
    assert stored.count() == stored.select("dedup_key").distinct().count()
    other = search.run_search(spark, bars, replace(config, cost_bps=1.0), str(tmp_path / "b"), chunk=1000)
    assert other != [run]  # costs are part of a run's identity

    top = report.ranked(stored, 10).collect()
    assert [r["score"] for r in top] == sorted((r["score"] for r in top), reverse=True) and len(top) == 10
    shaped = report.top_strategies(stored, 5, min_oos_trades=2).collect()
    assert all(r["oos_trades"] >= 2 and r["strategy"] for r in shaped)
    for r in stored.limit(50).collect():
        spec = search.Spec.from_json(r["spec_json"])
        assert spec == dict(search.Space(config).specs(np.array([r["ordinal"]])))[r["ordinal"]] and r["signature"] == spec.signature
    runs = search.runs(spark, path)
    status = report.run_status(runs, stored).first()
    assert status["completed"] == stored.count() and status["total_combos"] == status["completed_combos"] == total
    assert status["status"] == "completed" and status["finished_at"] >= status["started_at"]

    empty = spark.createDataFrame([], selection.LIVE)
    some = selection.Criteria(min_trades=1, min_oos_trades=1)
    live = selection.auto_select(empty, stored, 3, some, runs)
    assert live.where("status = 'active'").count() == 3
    again = selection.auto_select(live, stored, 1, some, runs)
    assert again.where("status = 'active'").count() == 1 and again.count() == 4
    none = selection.Criteria(min_trades=10**6)
    assert selection.of_result(stored, 3, "other").isEmpty() and selection.of_result(stored, stored.first()["ordinal"], run).count() == 1
    assert selection.auto_select(live, stored, 3, none, runs).where("status = 'active'").count() == 3  # nothing qualifies: nothing changes
    assert selection.newest(live).first()["live_id"] == 3
    with pytest.raises(ValueError, match="no such result"):
        selection.promote(live, stored.where("ordinal < 0"))


def test_report_reads_malformed_metrics(spark):
    rows = spark.createDataFrame([(1, "r", "{", '{"instances": [{"factory": "sma_cross", "params": {"fast": 1}}, {"factory": "odd", "params": {}}], "mode": "long_only"}', 1.0, 1.0, 1.0, 0.1, -0.1, 5, 0.5, 0.5, 0.5)], "ordinal long, run_id string, metrics_json string, spec_json string, score double, is_sharpe double, oos_sharpe double, oos_return double, oos_max_drawdown double, num_trades long, win_rate double, is_win_rate double, oos_win_rate double")
    r = report.top_strategies(rows, 3).first()
    assert (r["oos_trades"], r["combine"], r["detail"]["is"]["losses"]) == (0, "and", 0)
    assert [i["category"] for i in r["indicators"]] == ["trend", "unknown"]


def test_insert_or_ignore(spark):
    s = "run_id string, ordinal long, signature string, dedup_key string"
    stored = spark.createDataFrame([("r", 1, "a", "k1")], s)
    new = spark.createDataFrame([("r", 2, "b", "k1"), ("r", 3, "a", "k3"), ("r", 5, "d", "k5"), ("r", 4, "c", "k5")], s)
    assert [r["ordinal"] for r in search.insert_or_ignore(stored, new).collect()] == [4]


def test_runs_stop_restart_and_follow_each_other(spark, tmp_path):
    path, two = str(tmp_path), pd.concat([made_bars(3, 200, "A"), made_bars(4, 200, "B")])
    bars = spark.createDataFrame(two, SCHEMA)
    config = replace(SMALL, categories=("volume",), max_combo_size=1)
    first = search.run_search(spark, bars, config, path, chunk=5, most_chunks=1)
    assert len(first) == 2 and {(r["status"], r["completed_combos"], r["finished_at"]) for r in search.runs(spark, path).collect()} == {("running", 5, None)}
    began = {r["id"]: r["started_at"] for r in search.runs(spark, path).collect()}
    search.run_search(spark, bars, config, path, chunk=5)
    done = search.runs(spark, path).collect()
    assert {r["status"] for r in done} == {"completed"} and {r["id"]: r["started_at"] for r in done} == began
    (later,) = search.run_search(spark, bars.where("symbol = 'A'"), replace(config, cost_bps=9.0), path)
    assert report.latest_run(search.runs(spark, path)).first()["id"] == later  # by time, whatever its id
    stored = search.results(spark, path)
    assert {r["run_id"] for r in report.of_run(stored, search.runs(spark, path)).select("run_id").collect()} == {later}
    some = selection.Criteria(min_trades=0, min_oos_trades=0)
    assert {r["run_id"] for r in selection.select_top(stored, 2, some, search.runs(spark, path)).collect()} == {later}
    assert selection.select_top(stored, 2, some).groupBy("run_id").count().where("count = 2").count() == 3  # of each run
    search.run_search(spark, bars, config, path, chunk=4, most_chunks=1, restart=True)
    again = {r["id"]: r["completed_combos"] for r in search.runs(spark, path).collect()}
    assert again == {first[0]: 4, first[1]: 4, later: search.count(config)}
    assert search.results(spark, path).where(F.col("run_id").isin(first)).select(F.max("ordinal")).first()[0] < 4


def test_small_and_large_votes_give_the_same(bars, monkeypatch):
    config = replace(SMALL, categories=("volume",))
    want = sorted(search.search_all(bars, config).collect())
    monkeypatch.setattr(search, "MOST_BROADCAST", 0)
    assert sorted(search.search_all(bars, config).collect()) == want


def test_manifest_is_a_set_of_intervals(spark):
    rows = [("a", 0, 3), ("a", 3, 6), ("a", 2, 5), ("a", 9, 12), ("b", 4, 40), ("c", 0, 14), ("other", 0, 1)]
    manifest = spark.createDataFrame([(high, run, low) for run, low, high in rows], search.MANIFEST)
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "run_id string")
    assert sorted(map(tuple, search.gaps(manifest, ids, 14).collect())) == [("a", 6, 9), ("a", 12, 14), ("b", 0, 4), ("d", 0, 14)]


@pytest.mark.parametrize("sizes", [(3, 6), (5, 4)])
def test_a_run_goes_on_with_other_chunks(spark, tmp_path, sizes):
    """No run is completed with a gap, and none is evaluated twice, whatever chunks it was stopped with."""
    path, bars = str(tmp_path), spark.createDataFrame(pd.concat([made_bars(3, 200, "A"), made_bars(4, 200, "B")]), SCHEMA)
    config = replace(SMALL, categories=("volume",), max_combo_size=1)
    total = search.count(config)
    search.run_search(spark, bars, config, path, chunk=sizes[0], most_chunks=2)
    half = {r["completed_combos"] for r in search.runs(spark, path).collect()}
    assert half == {min(2 * sizes[0], total)}
    search.run_search(spark, bars.where("symbol = 'A'"), config, path, chunk=sizes[1], most_chunks=1)
    search.run_search(spark, bars, config, path, chunk=sizes[1])
    assert {(r["status"], r["completed_combos"]) for r in search.runs(spark, path).collect()} == {("completed", total)}
    raw = search._read(spark, f"{path}/results", f"{search.RESULTS}, run_id string, low long")
    assert raw.count() == raw.select("run_id", "ordinal").distinct().count() == 2 * total
