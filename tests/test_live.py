"""Market hours, risk, combination, ledger, candles and streaming."""

import glob
import os
from datetime import UTC, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import cli
from barwright.functions import signals
from barwright.operators import live, report
from barwright.plans import search, selection, trading
from barwright.sources import candles
from barwright.streaming import jobs
from tests.conftest import made_bars


@pytest.mark.parametrize(
    ("at", "want"),
    [("2026-06-10 14:00:00", True), ("2026-06-10 13:00:00", False), ("2026-06-10 20:30:00", False), ("2026-01-15 15:00:00", True), ("2026-01-15 14:00:00", False), ("2026-01-15 20:30:00", True), ("2026-06-13 15:00:00", False), ("2026-06-10 13:30:00", True), ("2026-06-10 20:00:00", True), ("2026-06-10 20:00:01", False)],
)
def test_market_hours(spark, at, want):
    assert spark.range(1).select(live.market_open(F.lit(at).cast("timestamp"))).first()[0] is want


@pytest.mark.parametrize(("signal", "short", "kill", "want"), [(1, True, False, 10), (1, True, True, 0), (-1, False, False, 0), (-1, True, False, -10), (0, True, False, 0)])
def test_sleeves(spark, signal, short, kill, want):
    assert spark.range(1).select(live.sleeve_quantity(F.lit(float(signal)), 10, short, kill)).first()[0] == want


@pytest.mark.parametrize(("q", "want", "why"), [(10, 10, "ok"), (30, 10, "capped"), (-30, -10, "capped")])
def test_clamp(spark, q, want, why):
    assert tuple(spark.range(1).select(live.clamp(F.lit(q), 10), live.clamp_reason(F.lit(q), 10)).first()) == (want, why)


def test_risk_from_env():
    assert live.Risk.from_env({}) == live.Risk(10, 10, True, False)
    assert live.Risk.from_env({"ORDER_QTY": "5", "MAX_POSITION": " ", "ALLOW_SHORT": "no", "KILL_SWITCH": "1"}) == live.Risk(5, 10, False, True)


def targets(spark, *rows):
    return spark.createDataFrame([("X", f"2024-01-01 {h:02d}:00:00", t, p) for h, t, p in rows], "symbol string, ts string, target int, price double").withColumn("ts", F.col("ts").cast("timestamp"))


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, 10, 100.0)], [("OPEN", "LONG", 10, None, None)]),
        ([(0, 10, 100.0), (2, 0, 105.0)], [("OPEN", "LONG", 10, None, None), ("CLOSE", "LONG", 10, 5.0, "2h00m")]),
        ([(0, -10, 100.0), (1, 0, 95.0)], [("OPEN", "SHORT", 10, None, None), ("CLOSE", "SHORT", 10, 5.0, "1h00m")]),
        ([(0, 10, 100.0), (1, 10, 101.0)], [("OPEN", "LONG", 10, None, None)]),
        ([(0, 10, 100.0), (1, -10, 90.0)], [("OPEN", "LONG", 10, None, None), ("CLOSE", "LONG", 10, -10.0, "1h00m"), ("OPEN", "SHORT", 10, None, None)]),
        ([(0, 10, 100.0), (1, 20, 90.0)], [("OPEN", "LONG", 10, None, None), ("ADJUST", "LONG", 20, None, None)]),
    ],
)
def test_ledger(spark, rows, want):
    got = live.ledger(targets(spark, *rows)).orderBy("ts", "place").collect()
    assert [(r["event"], r["side"], r["quantity"], r["move_pct"] and round(r["move_pct"], 6), r["holding"]) for r in got] == want
    assert all("X" in r["line"] for r in live.ledger_lines(live.ledger(targets(spark, *rows))).collect())


POLLS = [(0, 1, 0), (0, 2, 5), (1, 1, 10), (1, 2, -5), (2, 1, 10), (2, 2, 0), (3, 1, 0), (3, 2, 0)]
OWNERS = [(2, 5), (2, -5), (1, 8), (None, 0)]


def polls(spark):
    rows = [("X", f"2024-01-01 {h:02d}:00:00", i, q) for h, i, q in POLLS]
    return spark.createDataFrame(rows, "symbol string, ts string, live_id long, quantity int").withColumn("ts", F.col("ts").cast("timestamp"))


def test_sticky_owner(spark):
    got = live.combine_priority(polls(spark), 8).orderBy("ts").collect()
    assert [(r["owner"], r["target"]) for r in got] == OWNERS
    assert [r["target"] for r in live.combine_net(polls(spark), 8).orderBy("ts").collect()] == [5, 5, 8, 0]


def test_sticky_owner_over_a_stream(spark, tmp_path):
    rows = polls(spark)
    for k, half in enumerate(("hour(ts) < 2", "hour(ts) >= 2")):
        rows.where(half).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={k}"))
        stream = jobs.stream_of(spark, str(tmp_path / "in"), "symbol string, ts timestamp, live_id long, quantity int, b int")
        jobs.decision_lines(jobs.sticky_targets(stream.drop("b"), 8), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.json(str(tmp_path / "out")).orderBy("ts").collect()
    assert [(r["owner"] if "owner" in r else None, r["target"]) for r in got] == OWNERS


def test_stream_bars_and_upserts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = events.schema.simpleString()[7:-1].replace(":", " ")
    stream = jobs.stream_bars(jobs.stream_of(spark, str(tmp_path / "in"), schema), late="40 days")
    sink = stream.writeStream.foreachBatch(jobs.upsert_into(str(tmp_path / "table"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True)
    sink.start().awaitTermination()
    # With no event after them, no bar is final yet; a batch of bars is put in place by key, twice the same.
    bars = candles.event_bars(events)
    put = jobs.upsert_into(str(tmp_path / "table"))
    put(bars.where("symbol = 'view'"), 0)
    put(bars, 1)
    put(bars, 1)
    got = spark.read.schema(candles.SCHEMA).parquet(str(tmp_path / "table"))
    assert got.count() == bars.count() and got.select(*candles.COLUMNS).exceptAll(bars.select(*candles.COLUMNS)).count() == 0


def test_candle_cleaning(spark):
    rows = [("X", 0, 1.0, 5.0, 1), ("X", 0, 2.0, None, 2), ("X", 1, None, 1.0, 1), ("Y", 0, float("nan"), 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, h int, close double, volume double, seq int").select("symbol", F.lit("1h").alias("interval"), F.timestamp_seconds(F.col("h") * 3600).alias("ts"), F.lit(1.0).alias("open"), F.lit(1.0).alias("high"), F.lit(1.0).alias("low"), "close", "volume", "seq")
    table, summary = candles.ingest(None, df, "seq")
    assert [(r["symbol"], r["close"], r["volume"]) for r in table.collect()] == [("X", 2.0, 0.0)]
    assert summary.first()["rows"] == 1
    newer = table.withColumn("close", F.lit(9.0))
    assert [r["close"] for r in candles.upsert(table, newer).collect()] == [9.0]
    assert candles.checkpoint(table).first()["rows"] == 1


def test_candle_files(spark, bars, tmp_path):
    candles.write(bars, str(tmp_path / "t"))
    got = candles.load(spark.read.schema(candles.SCHEMA).parquet(str(tmp_path / "t")), "X", "1h")
    assert got.count() == 600
    bars.withColumnsRenamed({"close": "Close"}).write.parquet(str(tmp_path / "p"))
    assert "close" in candles.read(spark, str(tmp_path / "p")).columns
    bars.drop("close").write.parquet(str(tmp_path / "q"))
    with pytest.raises(ValueError, match="close"):
        candles.read(spark, str(tmp_path / "q"))


def test_ledger_keeps_what_took_the_trade(spark):
    rows = targets(spark, (0, 10, 100.0), (2, 0, 105.0)).withColumn("label", F.when(F.col("target") != 0, "rsi(n=2) [long_only,and]"))
    lines = [r["line"] for r in live.ledger_lines(live.ledger(rows)).orderBy("ts").collect()]
    assert lines[0].endswith("@ 100.00 by rsi(n=2) [long_only,and]") and lines[1].endswith("@ 105.00 move +5.00% held 2h00m")


def asked(spark, *quantities):
    rows = [("X", k + 1, f"s{k + 1}", f"l{k + 1}", "LONG", "2024-01-01 00:00:00", 100.0 + k, q) for k, q in enumerate(quantities)]
    df = spark.createDataFrame(rows, "symbol string, live_id long, name string, label string, signal string, as_of string, price double, quantity int")
    return df.withColumn("as_of", F.col("as_of").cast("timestamp"))


@pytest.mark.parametrize(
    ("quantities", "owner", "position", "rule", "want"),
    [
        ((0, 5), None, 0, "priority", (2, None, 5, "s2 took the trade", 0, "BUY", 101.0)),
        ((10, 5), 2, 5, "priority", (2, None, 5, "ok", 5, "HOLD", 101.0)),  # sticky
        ((10, -5), 2, 5, "priority", (2, None, -5, "ok", 5, "SELL", 101.0)),  # of the other sign too
        ((30, 0), 2, 5, "priority", (1, None, 12, "capped", 5, "BUY", 100.0)),
        ((0, 0), 1, 10, "priority", (None, None, 0, "no strategy firing", 10, "SELL", 100.0)),
        ((10, -4), None, 0, "net", (None, 6, 6, "ok", 0, "BUY", 100.0)),
        ((10, 10), None, -3, "net", (None, 20, 12, "capped", -3, "BUY", 100.0)),
    ],
)
def test_reconciled(spark, quantities, owner, position, rule, want):
    before = spark.createDataFrame([("X", owner, position)], "symbol string, owner long, position int")
    r = live.reconciled(asked(spark, *quantities), before, live.Risk(max_position=12), rule).first()
    assert (r["owner"], r["net_target"], r["target"], r["risk"], r["prev_position"], r["action"], r["price"]) == want
    assert r["delta"] == r["target"] - r["prev_position"] and len(r["sleeves"]) == len(quantities)


def test_decisions_look_back_sixty_days_at_least(spark):
    rows = spark.range(100).select(F.lit("X").alias("symbol"), F.lit("1d").alias("interval"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), F.lit(1.0).alias("close"))
    assert [live.recent(rows, d).count() for d in (None, 7, 80)] == [100, 61, 81]


@pytest.fixture()
def market(spark, tmp_path):
    """Candles of two symbols, and a search over them."""
    path = str(tmp_path)
    bars = spark.createDataFrame(pd.concat([made_bars(5, 300, "A"), made_bars(6, 300, "B")]), candles.SCHEMA)
    candles.write(bars, f"{path}/candles")
    search.run_search(spark, bars, search.Config(categories=("volume",), max_combo_size=2, dense=False, cross_category_only=False), f"{path}/search")
    return path, bars


def test_polls(spark, market):
    path, bars = market
    session = trading.Session(spark, path, live.Risk(max_position=10), auto=True, criteria=selection.Criteria(min_trades=1, min_oos_trades=1), strategies=3, reselect_on_flat=True)
    at = lambda day, hour: datetime(2024, 1, day, hour, tzinfo=UTC)
    made = [session.step(at(1, 15)).collect(), session.step(at(1, 16)).collect()]
    live_now = session.live().where("status = 'active'").collect()
    assert len(live_now) == 3 and len({r["symbol"] for r in live_now}) == 1  # of the latest run
    for rows in made:
        (r,) = rows
        assert len(r["sleeves"]) == 3 and abs(r["target"]) <= 10
        spec = search.Spec.from_json(live_now[0]["spec_json"])
        last = search.spec_positions(bars.where(F.col("symbol") == r["symbol"]), spec).orderBy(F.desc("ts")).first()
        assert [s["quantity"] for s in r["sleeves"] if s["live_id"] == live_now[0]["live_id"]] == [int(10 * last["position"])]
    assert made[1][0]["prev_position"] == made[0][0]["target"]  # the state is what the polls before say
    session.step(at(2, 15))
    assert session.live().count() == 6  # selected anew on another day
    assert session.polls().count() == 3 and trading.ledger(session.polls()).count() == (made[0][0]["target"] != 0)
    none = trading.Session(spark, path, auto=True, criteria=selection.Criteria(min_trades=10**6))
    assert none.step(at(3, 15)) is None and session.polls().count() == 3
    with pytest.raises(ValueError, match="no live strategy"):
        trading.decide(bars, session.live().where("false"))


def test_command_line(spark, market, capsys):
    path, _ = market
    run = lambda *args: (cli.main(["--data", path, *args]), capsys.readouterr().out)
    code, out = run("optimize", "--dry-run", "--sparse", "--max-combo-size", "2")
    assert code == 0 and out.startswith("6,110 strategies")
    code, out = run("report", "--top", "3")
    assert code == 0 and len(out.splitlines()) == 3
    latest = report.latest_run(search.runs(spark, f"{path}/search")).first()
    assert run("promote", "--result-id", "0")[0] == 0
    row = selection.newest(trading.Session(spark, path).live()).first()
    assert (row["result_id"], row["symbol"]) == (0, latest["symbol"])
    assert run("auto-select", "--top", "2", "--min-trades", "1", "--min-oos-trades", "1")[0] == 0
    assert run("live-run", "--once")[0] == 0 and trading.Session(spark, path).polls().count() == 1
    assert run("status")[0] == 0 and run("ledger")[0] == 0 and run("live-signal")[0] == 0
    assert run("optimize", "--sparse", "--max-combo-size", "1", "--max-combos", "6", "--name", "few", "--workers", "3", "--symbol", "A")[0] == 0
    assert "few" in run("status")[1] and {r["name"] for r in search.runs(spark, f"{path}/search").collect()} == {"default", "few"}


def test_command_line_follows_a_folder(spark, bars, tmp_path, capsys):
    data = str(tmp_path / "d")
    assert cli.main(["--data", data, "init"]) == 0 and cli.main(["--data", data, "init"]) == 0
    assert candles.table(spark, f"{data}/candles").count() == trading.Session(spark, data).polls().count() == 0
    spec = search.Spec((signals.instance("sma_cross", fast=5, slow=20),), "long_short").to_json()
    spark.createDataFrame([(1, 1, "one", "X", "1h", spec, "active")], selection.LIVE).write.mode("overwrite").parquet(f"{data}/live")
    bars.limit(50).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert cli.main(["--data", data, "live-run", "--follow", str(tmp_path / "in"), "--once", "--ignore-market-hours"]) == 0
    assert trading.Session(spark, data).polls().count() == candles.table(spark, f"{data}/candles").count() == 50
    assert cli.main(["--data", data, "ledger"]) == 0 and "OPEN" in capsys.readouterr().out


@pytest.mark.parametrize("chunk", [1, 7, 256])
def test_owners_by_composed_chunks(spark, monkeypatch, chunk):
    """Owners of many polls, some symbols with one before, against the fold of one poll after another."""
    monkeypatch.setattr(live, "CHUNK", chunk)
    rng, rows, start = np.random.default_rng(chunk), [], {"A": 2, "B": None, "C": 99}
    for symbol in "ABCD":
        for k in range(60 if symbol != "D" else 1):
            for sleeve in range(1, 5):
                rows.append((symbol, k, sleeve, int(rng.choice([0, 0, 0, 5, -7]))))
    df = spark.createDataFrame(rows, "symbol string, k int, live_id long, quantity int").withColumn("ts", F.timestamp_seconds(F.col("k") * 900)).repartition(3)
    firing = df.groupBy("symbol", "ts").agg(F.array_sort(F.collect_list(F.when(F.col("quantity") != 0, F.struct("live_id", "quantity")))).alias("firing"))
    before = spark.createDataFrame(list(start.items()), "symbol string, owner long")
    for state, first in ((None, {}), (before, start)):
        want = []
        for symbol in "ABCD":
            owner = first.get(symbol)
            for k in range(60 if symbol != "D" else 1):
                owner, quantity = live.sticky_owner(owner, {i: q for s, h, i, q in rows if (s, h) == (symbol, k)})
                want.append((symbol, k, owner, quantity))
        got = live.owners(firing, state).select("symbol", (F.unix_seconds("ts") / 900).cast("int"), "owner", "quantity")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def comparable(polls):
    columns = ("symbol", "ts", "owner", "net_target", "target", "risk", "prev_position", "delta", "action", "price", "label")
    return sorted((tuple(r[c] for c in columns) + tuple((x["live_id"], x["quantity"], x["signal"]) for x in r["sleeves"]) for r in polls.collect()), key=str)


@pytest.mark.parametrize("rule", ["priority", "net"])
def test_a_stream_of_bars_across_restarts(spark, market, tmp_path_factory, rule):
    """Micro-batches, each by a query and a session started anew, give the polls of one batch, and those of single polls."""
    path, bars = market
    old, folder, risk = bars.where("ts < '2023-03-14'"), tmp_path_factory.mktemp(rule), live.Risk(order_qty=7, max_position=10)
    new = bars.where("ts >= '2023-03-14'").checkpoint()
    session = trading.Session(spark, path, risk, rule=rule, strategies=3, criteria=selection.Criteria(min_trades=1, min_oos_trades=1))
    assert session.reselect()
    (symbol,) = {r["symbol"] for r in selection.active(session.live()).collect()}
    data = str(folder / "data")
    candles.write(old, f"{data}/candles")
    session.live().write.parquet(f"{data}/live")
    edges = ["2023-03-14", "2023-03-14 09:00:00", "2023-03-15 20:00:00", "2024-01-01"]
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        new.where(f"ts >= '{lo}' AND ts < '{hi}'").coalesce(1).write.mode("append").parquet(str(folder / "in" / f"b={k}"))
        stream = jobs.stream_of(spark, str(folder / "in"), f"{candles.SCHEMA}, b int").drop("b")
        trading.Session(spark, data, risk, rule=rule).follow(stream, once=True, market_hours_only=False).awaitTermination()
    got = trading.Session(spark, data, risk, rule=rule).polls()
    none = spark.createDataFrame([], "symbol string, owner long, position int")
    whole = trading.decide_over_time(bars, selection.active(session.live()), new, none, risk, rule)
    assert comparable(got) == comparable(whole) and got.count() == new.where(f"symbol = '{symbol}'").count() > 100
    assert len({r["owner"] for r in got.collect()}) > 1 or rule == "net"
    for at in ("2023-03-14 08:00:00", "2023-03-17 03:00:00"):
        before = trading.state_of(got.where(f"ts < '{at}'"))
        one = trading.decide_once(bars.where(f"ts <= '{at}'"), selection.active(session.live()), before, risk, rule, at=datetime.fromisoformat(f"{at}+00:00"))
        assert comparable(one) == comparable(got.where(f"ts = '{at}'"))
    assert candles.table(spark, f"{data}/candles").count() == bars.count()
    late = trading.Session(spark, data, risk, rule=rule)
    last = got.select(F.max("batch")).first()[0]
    late.bars_arrived(new.where("ts >= '2023-03-15 20:00:00'"), last, False)  # the last batch once more, as after a failure
    assert comparable(late.polls()) == comparable(whole)
    late.bars_arrived(new.where("ts < '2023-03-15'"), last + 1, False)  # bars that are late
    assert comparable(late.polls()) == comparable(whole)


def test_a_stream_selects_anew_each_day(spark, market):
    path, bars = market
    session = trading.Session(spark, path, live.Risk(), auto=True, reselect_on_flat=True, strategies=2, criteria=selection.Criteria(min_trades=1, min_oos_trades=1))
    some = bars.where("ts >= '2023-03-16 20:00:00' AND ts < '2023-03-17 03:00:00'")
    session.bars_arrived(some, 0, False)
    first = comparable(session.polls())
    chosen = session.live().count()
    again = trading.Session(spark, path, live.Risk(), auto=True, reselect_on_flat=True, strategies=2, criteria=selection.Criteria(min_trades=1, min_oos_trades=1))
    again.bars_arrived(some, 0, False)
    assert comparable(again.polls()) == first and len(first) == 7 and again.live().count() == chosen == 2
    none = trading.Session(spark, path, live.Risk(), auto=True, criteria=selection.Criteria(min_trades=10**6))
    none.bars_arrived(bars.where("ts >= '2023-03-18' AND ts < '2023-03-18 02:00:00'"), 1, False)
    assert comparable(again.polls()) == first  # no strategy qualifies


def test_the_last_row_of_a_bar_counts_on_every_way_in(spark, bars, tmp_path, capsys):
    data, rows = str(tmp_path / "d"), bars.limit(40).toPandas()
    twice = pd.concat([rows.assign(close=1.0), rows.assign(close=2.0), rows.assign(close=3.0)])
    twice.to_csv(tmp_path / "a.csv", index=False)
    assert cli.main(["--data", data, "ingest", str(tmp_path / "a.csv"), "--format", "csv"]) == 0
    got = candles.table(spark, f"{data}/candles")
    assert got.count() == 40 and {r["close"] for r in got.collect()} == {3.0}
    (tmp_path / "more").mkdir()
    for k, close in enumerate((9.0, 5.0)):  # of two files the newer one, whatever their names
        at = tmp_path / "more" / f"{'za'[k]}.csv"
        rows.assign(close=close).to_csv(at, index=False)
        os.utime(at, (1_700_000_000 + k, 1_700_000_000 + k))
    assert cli.main(["--data", data, "ingest", str(tmp_path / "more"), "--format", "csv"]) == 0
    assert {r["close"] for r in candles.table(spark, f"{data}/candles").collect()} == {5.0}
    arriving = spark.createDataFrame(twice, candles.SCHEMA)
    assert {r["close"] for r in candles.upsert(bars.limit(0), arriving).collect()} == {3.0}
    assert {r["close"] for r in candles.upsert(bars, arriving.withColumn("seq", -F.col("close")), "seq").join(bars.limit(40).select("ts"), "ts").collect()} == {1.0}
    capsys.readouterr()


def test_an_upsert_writes_the_months_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.range(3650).select(F.lit("X").alias("symbol"), F.lit("1d").alias("interval"), F.timestamp_seconds(F.col("id") * 86400).alias("ts"), *[F.lit(1.0).alias(c) for c in (*candles.PRICES, "volume")])
    candles.write(days, path)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}
    before = files()
    assert len(before) == 120
    candles.merge(path, days.where("ts = '1975-05-05'").withColumn("close", F.lit(7.0)))
    after = files()
    assert {f for f in before if after.get(f) != before[f]} == {f for f in before if "month=197505" in f} and len(after) == 120
    got = candles.table(spark, path)
    assert got.count() == 3650 and [str(r["ts"])[:10] for r in got.where("close = 7").collect()] == ["1975-05-05"]
