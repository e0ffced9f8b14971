"""The registered queries over the given tables, each with its SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright import twins as q
from barwright.functions import indicators as ta
from barwright.functions import signals
from barwright.functions.sheet import Sheet
from barwright.functions.signals import instance
from barwright.operators import backtest as bt
from barwright.operators import combine, live, report
from barwright.plans import search, selection, trading
from barwright.sources import candles

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.event_bars(table(spark, sf_dir, "events"))


def all_events(spark: SparkSession, sf_dir: str, length: str = "1 hour", interval: str = "1h") -> DataFrame:
    return candles.event_bars(table(spark, sf_dir, "events"), F.lit("ALL"), length, interval)


def rounded(df: DataFrame, keys: tuple[str, ...], values: dict[str, str], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(name) for name, c in values.items()])


def register(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql is not None:
        _sql[name] = sql


# candles

OHLCV = ("open", "high", "low", "close", "volume")
_bar_columns = "symbol, ts, open, high, low, close, volume"

register("candles_hourly", lambda s, d: rounded(by_type(s, d), ("symbol", "ts"), {c: c for c in OHLCV}), q.Twin(q.BY_TYPE).select(*OHLCV))
register(
    "candles_daily",
    lambda s, d: rounded(candles.order_bars(table(s, d, "orders")), ("symbol", "ts"), {c: c for c in OHLCV}, 2),
    """SELECT o_orderstatus AS symbol, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, round(CAST(arg_min(o_totalprice, o_orderkey) AS DOUBLE), 2) + 0.0 AS open, round(CAST(max(o_totalprice) AS DOUBLE), 2) + 0.0 AS high,
    round(CAST(min(o_totalprice) AS DOUBLE), 2) + 0.0 AS low, round(CAST(arg_max(o_totalprice, o_orderkey) AS DOUBLE), 2) + 0.0 AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2""",
)


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-minute bars stamped with their hour: several rows a bar, some without prices, as an untidy feed has them."""
    fine = candles.event_bars(table(spark, sf_dir, "events"), length="10 minutes")
    broken = F.minute("ts") == 20
    return fine.select("symbol", "interval", F.date_trunc("hour", "ts").alias("ts"), "open", "high", "low", F.when(~broken, F.col("close")).alias("close"), F.when(F.minute("ts") != 40, F.col("volume")).alias("volume"), F.col("ts").alias("seq"))


_RAW = """fine AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '10 minutes', ts) AS seq, arg_min(1000 + value, ts) AS open, max(1000 + value) AS high, min(1000 + value) AS low,
         arg_max(1000 + value, ts) AS close, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS volume FROM events GROUP BY 1, 2
), raw AS (
  SELECT symbol, date_trunc('hour', seq) AS ts, seq, open, high, low, CASE WHEN minute(seq) <> 20 THEN close END AS close, CASE WHEN minute(seq) <> 40 THEN volume END AS volume FROM fine
), lastrow AS (
  SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY symbol, ts ORDER BY seq DESC) = 1
), whole AS (SELECT * FROM lastrow WHERE close IS NOT NULL)"""
_plain = "round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(volume, 6) + 0.0 AS volume"

_values = {c: c for c in OHLCV}
register("candles_keep_last", lambda s, d: rounded(candles.keep_last(_raw(s, d), "seq"), ("symbol", "ts"), _values), f"WITH {_RAW} SELECT symbol, ts, {_plain} FROM lastrow")
register("candles_complete", lambda s, d: rounded(candles.complete(candles.keep_last(_raw(s, d), "seq")), ("symbol", "ts"), _values), f"WITH {_RAW} SELECT symbol, ts, {_plain} FROM whole")
register(
    "candles_lookback",
    lambda s, d: rounded(candles.lookback(by_type(s, d), 7), ("symbol", "ts"), _values),
    f"WITH {q.BY_TYPE}, l AS (SELECT symbol, max(ts) AS m FROM bars GROUP BY 1) SELECT symbol, ts, {_plain} FROM bars JOIN l USING (symbol) WHERE ts >= m - INTERVAL 7 DAY",
)
register(
    "candles_upsert",
    lambda s, d: rounded(candles.upsert(by_type(s, d), candles.complete(candles.keep_last(_raw(s, d), "seq"))), ("symbol", "ts"), _values),
    f"WITH {_RAW}, {q.BY_TYPE}, u AS (SELECT {_bar_columns} FROM whole UNION ALL SELECT {_bar_columns} FROM bars b WHERE NOT EXISTS (SELECT 1 FROM whole w WHERE w.symbol = b.symbol AND w.ts = b.ts)) "
    "SELECT symbol, ts, round(open, 6) + 0.0 AS open, round(high, 6) + 0.0 AS high, round(low, 6) + 0.0 AS low, round(close, 6) + 0.0 AS close, round(coalesce(volume, 0), 6) + 0.0 AS volume FROM u",
)
register("candles_checkpoint", lambda s, d: candles.checkpoint(by_type(s, d)).drop("interval", "updated_at"), f"WITH {q.BY_TYPE} SELECT symbol, max(ts) AS last_ts, count(*) AS rows FROM bars GROUP BY 1")
register("candles_ingest", lambda s, d: candles.ingest(None, _raw(s, d), "seq")[1].drop("interval"), f"WITH {_RAW} SELECT symbol, count(*) AS rows, min(ts) AS start, max(ts) AS end FROM whole GROUP BY 1")
register("candles_load", lambda s, d: rounded(candles.load(by_type(s, d), "view", "1h"), ("symbol", "ts"), _values), f"WITH {q.BY_TYPE} SELECT symbol, ts, {_plain} FROM bars WHERE symbol = 'view'")
register(
    "candles_in_utc",
    lambda s, d: candles.in_utc(table(s, d, "events").select("event_id", "ts"), "America/New_York").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n")),
    "SELECT date_trunc('day', timezone('UTC', timezone('America/New_York', ts))) AS day, count(*) AS n FROM events GROUP BY 1",
)


# indicators


def indicator(name: str, make, twin: q.Twin, columns: tuple[str, ...], digits: int = 6, **params) -> None:
    """make returns the sheet's columns, in the order of the twin's `columns` (None: not shown)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Sheet()
        made = make(s, **params)
        made = made if isinstance(made, tuple) else (made,)
        return rounded(s.apply(by_type(spark, sf_dir)), ("symbol", "ts"), {c: m for c, m in zip(columns, made, strict=True) if c}, digits)

    register(name, query, twin.select(*[c for c in columns if c], digits=digits))


_t = q.Twin
indicator("sma_20", ta.sma, q.sma(_t(), 20), ("sma",))
indicator("sma_1400", ta.sma, q.sma(_t(), 1400), ("sma",), n=1400)
indicator("ema_20", ta.ema, _t().ewm("ema", "close", q.span(20), 20), ("ema",))
indicator("wma_20", ta.wma, q.wma(_t(), 20), ("wma",))
indicator("macd", ta.macd, q.macd(_t()), ("line", "signal", "hist"))
indicator("true_range", ta.true_range, q.true_range(_t()), ("true_range",))
indicator("atr_14", ta.atr, q.atr(_t()), ("atr",))
indicator("adx_14", ta.adx, q.adx(_t()), ("adx", "plus", "minus"))
indicator("aroon_25", ta.aroon, q.aroon(_t(), 25), ("up", "down", "osc"))
indicator("parabolic_sar", ta.parabolic_sar, q.psar(_t()), ("sar",))
indicator("ichimoku", ta.ichimoku, q.ichimoku(_t()), ("tenkan", "kijun", "cloud_a", "cloud_b"))
indicator("supertrend", ta.supertrend, q.supertrend(_t()), ("line", "way"))
indicator("rsi_14", ta.rsi, q.rsi(_t()), ("rsi",))
indicator("stochastic", ta.stochastic, q.stochastic(_t()), ("k", "d"))
indicator("stoch_rsi", ta.stoch_rsi, q.stoch_rsi(_t()), ("k", "slow"))
indicator("cci_20", ta.cci, q.cci(_t()), ("cci",))
indicator("williams_r", ta.williams_r, q.williams(_t()), ("williams",))
indicator("roc_12", ta.roc, _t().add(roc=f"100 * ({q.ratio('close', q.lag('close', 12))} - 1)"), ("roc",))
indicator("momentum_10", ta.momentum, _t().add(momentum=f"close - {q.lag('close', 10)}"), ("momentum",))
indicator("tsi", ta.tsi, q.tsi(_t()), ("tsi",))
indicator("bollinger", ta.bollinger, q.bollinger(_t()), ("mid", "upper", "lower", "width", "pct_b"))
indicator("keltner", ta.keltner, q.keltner(_t()), ("mid", "upper", "lower"))
indicator("donchian", ta.donchian, q.donchian(_t()), ("upper", "lower", "mid"))
indicator("fair_value_gap", ta.fair_value_gap, q.gaps(_t()), ("bull", "bear", "bull_top", "bull_bot", "bear_top", "bear_bot"))
indicator("fair_value_gap_atr", ta.fair_value_gap, q.gaps(_t(), 0.5), ("bull", "bear", "bull_top", "bull_bot", "bear_top", "bear_bot"), least=0.5)
indicator("obv", ta.obv, q.obv(_t()), ("obv",))
indicator("vwap_session", ta.vwap, q.vwap(_t()), ("vwap",))
indicator("cmf_20", ta.cmf, q.cmf(_t()), ("cmf",))
indicator("mfi_14", ta.mfi, q.mfi(_t()), ("mfi",))
indicator("ad_line", ta.ad_line, q.ad_line(_t()), ("ad_line",))
indicator("force_index", ta.force_index, q.force(_t()), ("force_index",))
indicator("ease_of_movement", ta.ease_of_movement, q.ease(_t()), ("ease_of_movement",), digits=2)


# recurrences again, with the bars of all series cut into ranges of time

PARTS = 24
_recurrent = (
    ("ema_20", ta.ema, ("ema",)), ("macd", ta.macd, ("line", "signal", "hist")), ("atr_14", ta.atr, ("atr",)), ("adx_14", ta.adx, ("adx", "plus", "minus")), ("rsi_14", ta.rsi, ("rsi",)), ("tsi", ta.tsi, ("tsi",)),
    ("keltner", ta.keltner, ("mid", "upper", "lower")), ("force_index", ta.force_index, ("force_index",)), ("parabolic_sar", ta.parabolic_sar, ("sar",)), ("supertrend", ta.supertrend, ("line", "way")),
)


def in_parts(make, columns: tuple[str, ...]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Sheet()
        made = make(s)
        made = made if isinstance(made, tuple) else (made,)
        return rounded(s.apply(by_type(spark, sf_dir), PARTS), ("symbol", "ts"), dict(zip(columns, made, strict=True)))

    return query


for _name, _make, _columns in _recurrent:
    register(f"{_name}_in_parts", in_parts(_make, _columns), _sql[_name])


# votes

_first: dict[str, signals.Instance] = {}
for _i in signals.enumerate_instances():
    _first.setdefault(_i.factory, _i)


def votes_of(i: signals.Instance) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return signals.with_votes(by_type(spark, sf_dir), [i]).select("symbol", "ts", (F.col("v0") + F.lit(0.0)).alias("vote"))

    return query


for _name, (_twin, _vote) in q.votes().items():
    register(f"votes_{_name}", votes_of(_first[_name]), _twin.add(vote=_vote).select("vote"))

register(
    "votes_all_sparse",
    lambda s, d: signals.votes(by_type(s, d), signals.enumerate_instances()).groupBy("symbol", "instance_key").agg(F.sum("vote").cast("long").alias("net"), F.count(F.when(F.col("vote") != 0, 1)).alias("voted"), F.count("*").alias("bars")),
)
register(
    "votes_all_dense",
    lambda s, d: signals.votes(by_type(s, d), signals.enumerate_instances(dense=True)).groupBy("symbol", "instance_key").agg(F.sum("vote").cast("long").alias("net"), F.count(F.when(F.col("vote") != 0, 1)).alias("voted"), F.count("*").alias("bars")),
)


# combination

_three = [instance("sma_cross", fast=10, slow=50), instance("donchian_breakout", period=20), instance("vwap_trend")]


def _three_votes() -> q.Twin:
    t = q.sma(q.sma(_t(), 10, name="fast"), 50, name="slow").add(v0=q.sign("fast - slow"))
    q.donchian(t).add(top=q.lag("upper"), bottom=q.lag("lower")).add(v1=q.held_regime("close >= top", "close <= bottom"))
    return q.vwap(t).add(v2=q.sign("close - vwap"))


def _combined(rule: str, mode: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        wide = signals.with_votes(by_type(spark, sf_dir), _three)
        return wide.select("symbol", "ts", combine.combine([F.col(f"v{k}") for k in range(3)], rule, mode).alias("position"))

    return query


_agree = "CASE WHEN v0 = 1 AND v1 = 1 AND v2 = 1 THEN 1.0 WHEN v0 = -1 AND v1 = -1 AND v2 = -1 THEN -1.0 ELSE 0.0 END"
_any = "CASE WHEN 1 IN (v0, v1, v2) AND -1 NOT IN (v0, v1, v2) THEN 1.0 WHEN -1 IN (v0, v1, v2) AND 1 NOT IN (v0, v1, v2) THEN -1.0 ELSE 0.0 END"
for _rule, _expr in (("and", _agree), ("or", _any)):
    for _mode in combine.MODES:
        register(f"combine_{_rule}_{_mode}", _combined(_rule, _mode), _three_votes().add(position=f"greatest({_expr}, 0.0)" if _mode == "long_only" else _expr).select("position"))


def adx_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = signals.with_votes(by_type(spark, sf_dir), [instance("sma_cross", fast=10, slow=50)], adx=14)
    return wide.select("symbol", "ts", combine.combine([F.col("v0")], mode="long_short", adx=F.col("adx"), adx_min=20.0).alias("position"))


register("combine_adx_gate", adx_gate, q.adx(q.sma(q.sma(_t(), 10, name="fast"), 50, name="slow")).add(v0=q.sign("fast - slow")).add(position="CASE WHEN adx >= 20 THEN v0 ELSE 0.0 END").select("position"))


# backtests


def _positions(spark: SparkSession, sf_dir: str, mode: str = "long_only", bars: Query = by_type) -> DataFrame:
    wide = signals.with_votes(bars(spark, sf_dir), _three[:1])
    return wide.select("symbol", "interval", "ts", "close", combine.combine([F.col("v0")], mode=mode).alias("position"))


def _shown(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    real = [m for m in bt.METRICS if m not in bt.COUNTS]
    return df.select(*keys, *[(F.round(m, 6) + F.lit(0.0)).alias(m) for m in real], *[F.col(m).cast("long").alias(m) for m in bt.COUNTS])


def _cross() -> q.Twin:
    return q.sma(q.sma(_t(), 10, name="fast"), 50, name="slow").add(v0=q.sign("fast - slow"))


register("backtest_sma_cross", lambda s, d: _shown(bt.backtest(_positions(s, d)), ("symbol",)), q.metrics(q.with_ppy(_cross(), "greatest(v0, 0.0)"), "po", "symbol"))
register("backtest_long_short", lambda s, d: _shown(bt.backtest(_positions(s, d, "long_short")), ("symbol",)), q.metrics(q.with_ppy(_cross(), "v0"), "po", "symbol"))
register("backtest_split", lambda s, d: _shown(bt.split_backtest(_positions(s, d, "long_short")), ("symbol", "half")), q.metrics(q.with_halves(q.with_ppy(_cross(), "v0")), "ha", "symbol, half"))
register("backtest_combined_or", lambda s, d: _shown(bt.backtest(signals.with_votes(by_type(s, d), _three).withColumn("position", combine.combine([F.col(f"v{k}") for k in range(3)], "or", "long_short"))), ("symbol",)), q.metrics(q.with_ppy(_three_votes(), _any), "po", "symbol"))
register(
    "backtest_score",
    lambda s, d: bt.scored(bt.split_backtest(_positions(s, d, "long_short"))).select("symbol", (F.round("score", 6) + F.lit(0.0)).alias("score"), (F.round("win_rate", 6) + F.lit(0.0)).alias("win_rate")),
    q.metrics(q.with_halves(q.with_ppy(_cross(), "v0")), "ha", "symbol, half", digits=12, finish=False).sql(
        "SELECT symbol, round(min(sharpe), 6) + 0.0 AS score, round(coalesce(sum(trade_wins) / nullif(CAST(sum(trade_count) AS DOUBLE), 0), 0), 6) + 0.0 AS win_rate FROM me GROUP BY symbol"
    ),
)
register("periods_per_year", lambda s, d: rounded(bt.periods_per_year(by_type(s, d)), ("symbol",), {"ppy": "ppy"}), q.with_ppy(_t(), "0.0").sql("SELECT symbol, round(ppy, 6) + 0.0 AS ppy FROM pp"))
register(
    "train_test_split",
    lambda s, d: bt.halves(by_type(s, d)).groupBy("symbol", "half").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end")),
    q.with_halves(q.with_ppy(_t(), "0.0")).sql("SELECT symbol, half, count(*) AS n, min(ts) AS start, max(ts) AS \"end\" FROM ha GROUP BY 1, 2"),
)
register(
    "returns_and_costs",
    lambda s, d: rounded(bt.returns(_positions(s, d, "long_short"), ("symbol",)), ("symbol", "ts"), {"asset": "asset", "held": "held", "r": "r", "seg": "seg"}, 9),
    q.metrics(q.with_ppy(_cross(), "v0"), "po", "symbol", finish=False).sql("SELECT symbol, ts, round(asset, 9) + 0.0 AS asset, round(held, 9) + 0.0 AS held, round(r, 9) + 0.0 AS r, round(CAST(seg AS DOUBLE), 9) + 0.0 AS seg FROM m3"),
)
register(
    "trade_segments",
    lambda s, d: bt.returns(_positions(s, d, "long_short"), ("symbol",)).where("held <> 0").groupBy("symbol", "seg").agg(F.min("ts").alias("start"), F.count("*").alias("bars"), (F.round(F.sum(F.log1p("r")), 6) + F.lit(0.0)).alias("log_return")),
    q.metrics(q.with_ppy(_cross(), "v0"), "po", "symbol", finish=False).sql("SELECT symbol, CAST(seg AS BIGINT) AS seg, min(ts) AS start, count(*) AS bars, round(sum(ln(1 + r)), 6) + 0.0 AS log_return FROM m3 WHERE held <> 0 GROUP BY symbol, seg"),
)


# search, reports, selection

SPARSE_2 = search.Config(max_combo_size=2, dense=False)
_result = ("symbol", "ordinal", "signature", "score", "is_sharpe", "oos_sharpe", "oos_return", "oos_max_drawdown", "num_trades", "win_rate", "is_win_rate", "oos_win_rate")
GATED = search.Config(categories=("trend", "volume"), max_combo_size=2, dense=False, adx_filters=(None, 25.0))
EXHAUSTIVE = search.Config(categories=("momentum",), max_combo_size=2, dense=False, cross_category_only=False)


def found(spark: SparkSession, sf_dir: str, config: search.Config = SPARSE_2) -> DataFrame:
    return search.search_all(by_type(spark, sf_dir), config)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir)


register("search_sparse_2", lambda s, d: found(s, d).select(*_result))
register("search_adx_gated", lambda s, d: found(s, d, GATED).select(*_result))
register("search_exhaustive_pairs", lambda s, d: found(s, d, EXHAUSTIVE).select(*_result))


def search_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three-vote specification by the search's evaluator, to be compared with the relational backtest's SQL."""
    config = search.Config(max_combo_size=1, dense=False, categories=("trend",), modes=("long_short",))
    at = search.Space(config).instances.index(_three[0])
    out = search.search(search.prepare(by_type(spark, sf_dir), config), config, at, at + 1)
    m = F.from_json("metrics_json", report.METRICS_JSON)
    halves = F.explode(F.array(F.struct(F.lit("is").alias("half"), m["is"].alias("m")), F.struct(F.lit("oos").alias("half"), m["oos"].alias("m"))))
    return _shown(out.select("symbol", halves.alias("h")).select("symbol", "h.half", "h.m.*"), ("symbol", "half"))


register("search_one_strategy", search_crosses, q.metrics(q.with_halves(q.with_ppy(_cross(), "v0")), "ha", "symbol, half"))
EACH = ("symbol",)  # a run for each symbol
register("report_top", lambda s, d: report.top_strategies(results(s, d), 25, min_trades=5, by=EACH).drop("indicators", "detail"))
register("report_by_return", lambda s, d: report.top_strategies(results(s, d), 25, order_by="oos_return", min_oos_trades=3, dedupe=False, by=EACH).drop("indicators", "detail"))
register("report_lines", lambda s, d: report.table_lines(report.top_strategies(results(s, d), 15, by=EACH)))
register("report_details", lambda s, d: report.top_strategies(results(s, d), 10, by=EACH).select("symbol", "id", F.explode("indicators").alias("i")).select("symbol", "id", "i.factory", "i.category", "i.label"))


def status(spark: SparkSession, sf_dir: str, config: search.Config = SPARSE_2) -> DataFrame:
    rows = found(spark, sf_dir, config)
    runs = rows.select(F.col("run_id").alias("id"), "symbol", "interval").distinct().withColumn("total_combos", F.lit(search.count(config)).cast("long"))
    return report.run_status(runs, rows)


def live_table(spark: SparkSession, sf_dir: str, config: search.Config = SPARSE_2) -> DataFrame:
    rows = found(spark, sf_dir, config)
    return selection.auto_select(spark.createDataFrame([], selection.LIVE), rows, 3, selection.Criteria(min_trades=5, min_oos_trades=2))


register("run_status", status)
register("select_ensemble", live_table)
register("select_newest", lambda s, d: selection.newest(live_table(s, d)))

# the same over all combinations of up to three of the signals that SQL can say as windows

WINDOWED = search.Config(max_combo_size=3, dense=False, signals=("price_vs_sma", "roc_sign", "momentum_sign", "bollinger_meanrev", "donchian_breakout", "obv_trend", "vwap_trend"))
_ratios = ("score", "is_sharpe", "oos_sharpe", "oos_return", "oos_max_drawdown", "win_rate", "is_win_rate", "oos_win_rate")
_report = ("score", "is_sharpe", "oos_sharpe", "oos_return", "oos_mdd", "win_rate", "is_win_rate", "oos_win_rate")
_named = ("trades", "is_trades", "oos_trades", "mode", "adx_min", "combine", "strategy")
_keys = ("symbol", "id", *_named)
_searched = lambda: q.searched(search.Space(WINDOWED).instances, signals.CATEGORIES)
_report_sql = f"SELECT symbol, ordinal AS id, num_trades AS trades, is_trades, oos_trades, mode, CAST(NULL AS DOUBLE) AS adx_min, rule AS combine, strategy, {q.shown(*_ratios)} FROM tp".replace("AS oos_max_drawdown", "AS oos_mdd")

register("search_windowed", lambda s, d: rounded(found(s, d, WINDOWED), ("symbol", "ordinal", "signature", "num_trades"), {c: c for c in _ratios}), _searched().sql(f"SELECT symbol, ordinal, signature, num_trades, {q.shown(*_ratios)} FROM un"))
_found_sql = _searched().sql(f"SELECT symbol, ordinal, signature, num_trades, {q.shown(*_ratios)} FROM un")
# the same with votes of a few bars at a time, so that every series is searched in many parts of time
register("search_in_parts", lambda s, d: rounded(search.search_all(by_type(s, d), WINDOWED, 500), ("symbol", "ordinal", "signature", "num_trades"), {c: c for c in _ratios}), _found_sql)
register("report_windowed", lambda s, d: rounded(report.top_strategies(found(s, d, WINDOWED), 25, min_trades=5, by=EACH), _keys, {c: c for c in _report}), q.best(_searched(), "num_trades >= 5", 25).sql(_report_sql))
register(
    "report_windowed_by_return",
    lambda s, d: rounded(report.top_strategies(found(s, d, WINDOWED), 25, order_by="oos_return", min_win_rate=0.2, min_oos_trades=3, dedupe=False, by=EACH), _keys, {c: c for c in _report}),
    q.best(_searched(), "oos_trades >= 3 AND win_rate >= 0.2", 25, "oos_return").sql(_report_sql),
)
register(
    "report_windowed_details",
    lambda s, d: report.top_strategies(found(s, d, WINDOWED), 10, by=EACH).select("symbol", "id", F.explode("indicators").alias("i")).select("symbol", "id", "i.factory", "i.category", "i.label"),
    q.best(_searched(), "true", 10).sql("SELECT symbol, ordinal AS id, factory, category, key AS label FROM tp JOIN ins ON ins.i IN (tp.i1, tp.i2, tp.i3)"),
)
_oos = ("oos_sharpe", "oos_sortino", "oos_return", "oos_max_drawdown", "oos_profit_factor", "oos_exposure")
register(
    "report_windowed_trades",
    lambda s, d: rounded(
        report.top_strategies(found(s, d, WINDOWED), 10, by=EACH).select("symbol", "id", "detail.oos.*", F.col("detail.is.total_return").alias("is_return"), F.col("detail.is.cagr").alias("is_cagr")),
        ("symbol", "id", "trades", "wins", "losses"),
        {"is_return": "is_return", "is_cagr": "is_cagr", "oos_sharpe": "sharpe", "oos_sortino": "sortino", "oos_return": "total_return", "oos_max_drawdown": "max_drawdown", "oos_profit_factor": "profit_factor", "oos_exposure": "exposure"},
    ),
    q.best(_searched(), "true", 10).sql(f"SELECT symbol, ordinal AS id, oos_trades AS trades, oos_wins AS wins, oos_trades - oos_wins AS losses, {q.shown('is_return', 'is_cagr', *_oos)} FROM tp"),
)
register(
    "status_windowed",
    lambda s, d: status(s, d, WINDOWED).select("symbol", "interval", "total_combos", "completed", F.round("pct", 6).alias("pct")),
    _searched().sql("SELECT symbol, '1h' AS interval, CAST((SELECT count(*) FROM sp) AS BIGINT) AS total_combos, count(*) AS completed, round(100.0 * count(*) / CAST((SELECT count(*) FROM sp) AS DOUBLE), 6) AS pct FROM un GROUP BY symbol"),
)
_live_sql = "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, ordinal, symbol) AS live_id, ordinal AS result_id, 'strategy ' || ordinal AS name, symbol, '1h' AS interval, spec_json, 'active' AS status FROM tp"
register("select_windowed", lambda s, d: live_table(s, d, WINDOWED), q.best(_searched(), "num_trades >= 5 AND oos_trades >= 2", 3).sql(_live_sql))
register("select_windowed_newest", lambda s, d: selection.newest(live_table(s, d, WINDOWED)), q.best(_searched(), "num_trades >= 5 AND oos_trades >= 2", 3).sql(f"{_live_sql} ORDER BY live_id DESC LIMIT 1"))


# decisions, risk, ledger

register(
    "market_hours",
    lambda s, d: table(s, d, "events").select("event_id", live.market_open(F.col("ts").cast("timestamp")).alias("open")),
    """WITH l AS (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS t FROM events)
    SELECT event_id, isodow(t) <= 5 AND strftime(t, '%H:%M:%S') BETWEEN '09:30:00' AND '16:00:00' AS open FROM l""",
)
register(
    "live_decision",
    lambda s, d: live.decisions(_positions(s, d, "long_short")).select("symbol", "as_of", "target", "side", "changed", (F.round("price", 6) + F.lit(0.0)).alias("price"), "bars"),
    _cross().add(earlier="lag(v0, 1, 0.0) OVER (PARTITION BY symbol ORDER BY ts)", bars="count(*) OVER (PARTITION BY symbol)", back="row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)").sql(
        "SELECT symbol, ts AS as_of, CAST(v0 AS INTEGER) AS target, CASE WHEN v0 > 0 THEN 'LONG' WHEN v0 < 0 THEN 'SHORT' ELSE 'FLAT' END AS side, v0 <> earlier AS changed, round(close, 6) + 0.0 AS price, bars FROM t4 WHERE back = 1"
    ),
)


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll a bar: three sleeves, each the first of its size to be asked."""
    wide = signals.with_votes(by_type(spark, sf_dir), _three)
    sleeves = F.explode(F.array(*[F.struct(F.lit(k + 1).cast("long").alias("live_id"), live.sleeve_quantity(F.col(f"v{k}"), 10 + 5 * k).alias("quantity")) for k in range(3)]))
    return wide.select("symbol", "ts", "close", sleeves.alias("s")).select("symbol", "ts", "close", "s.live_id", "s.quantity")


_POLLS = "SELECT symbol, ts, close, rn, CAST(sign(v0) * 10 AS INTEGER) AS q1, CAST(sign(v1) * 15 AS INTEGER) AS q2, CAST(sign(v2) * 20 AS INTEGER) AS q3 FROM {}"


def _polls() -> q.Twin:
    t = _three_votes()
    return t.with_("pl", _POLLS.format(t.at))


register(
    "risk_sleeves",
    lambda s, d: polls(s, d).select("symbol", "ts", "live_id", "quantity", live.sleeve_quantity(F.signum("quantity"), 10, allow_short=False).alias("no_shorts"), live.clamp(F.col("quantity"), 12).alias("clamped"), live.clamp_reason(F.col("quantity"), 12).alias("reason")),
    _polls().sql(
        "SELECT symbol, ts, CAST(live_id AS BIGINT) AS live_id, quantity, CASE WHEN quantity < 0 THEN 0 ELSE CAST(sign(quantity) * 10 AS INTEGER) END AS no_shorts, greatest(-12, least(12, quantity)) AS clamped, "
        "CASE WHEN abs(quantity) > 12 THEN 'capped' ELSE 'ok' END AS reason FROM (SELECT symbol, ts, unnest([1, 2, 3]) AS live_id, unnest([q1, q2, q3]) AS quantity FROM pl)"
    ),
)
register("combine_net", lambda s, d: live.combine_net(polls(s, d), 25).select("symbol", "ts", "target"), _polls().sql("SELECT symbol, ts, greatest(-25, least(25, q1 + q2 + q3)) AS target FROM pl"))

_keeps = "CASE WHEN r.owner = 1 AND s.q1 <> 0 THEN 1 WHEN r.owner = 2 AND s.q2 <> 0 THEN 2 WHEN r.owner = 3 AND s.q3 <> 0 THEN 3 WHEN s.q1 <> 0 THEN 1 WHEN s.q2 <> 0 THEN 2 WHEN s.q3 <> 0 THEN 3 END"
_starts = "CASE WHEN s.q1 <> 0 THEN 1 WHEN s.q2 <> 0 THEN 2 WHEN s.q3 <> 0 THEN 3 END"
register(
    "combine_priority",
    lambda s, d: live.combine_priority(polls(s, d), 18),
    _polls().with_("ow(symbol, rn, owner)", f"SELECT symbol, rn, {_starts} FROM pl s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {_keeps} FROM ow r JOIN pl s ON s.symbol = r.symbol AND s.rn = r.rn + 1").sql(
        "SELECT pl.symbol, ts, CAST(owner AS BIGINT) AS owner, CAST(greatest(-18, least(18, CASE owner WHEN 1 THEN q1 WHEN 2 THEN q2 WHEN 3 THEN q3 ELSE 0 END)) AS INTEGER) AS target FROM pl JOIN ow ON pl.symbol = ow.symbol AND pl.rn = ow.rn"
    ),
)


def live_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three live strategies on each series, polled at every bar: owner, target and order of each poll."""
    bars = by_type(spark, sf_dir)
    specs = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("live_id"), F.lit(f"s{k + 1}").alias("name"), F.lit(search.Spec((i,), "long_short").to_json()).alias("spec_json")) for k, i in enumerate(_three)]))
    strategies = bars.select("symbol", "interval").distinct().select("symbol", "interval", specs.alias("s")).select("symbol", "interval", "s.*")
    none = spark.createDataFrame([], "symbol string, owner long, position int")
    polled = trading.decide_over_time(bars, strategies, bars, none, live.Risk(order_qty=10, max_position=8))
    return polled.select("symbol", "ts", "owner", "target", "risk", "prev_position", "delta", "action", (F.round("price", 6) + F.lit(0.0)).alias("price"))


_owner_was = "lag(owner) OVER (PARTITION BY symbol ORDER BY ts)"
register(
    "live_polls",
    live_polls,
    _polls()
    .with_("ow(symbol, rn, owner)", f"SELECT symbol, rn, {_starts} FROM pl s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {_keeps} FROM ow r JOIN pl s ON s.symbol = r.symbol AND s.rn = r.rn + 1")
    .with_("lp", "SELECT pl.*, owner, CAST(8 * sign(CASE owner WHEN 1 THEN q1 WHEN 2 THEN q2 WHEN 3 THEN q3 ELSE 0 END) AS INTEGER) AS target FROM pl JOIN ow ON pl.symbol = ow.symbol AND pl.rn = ow.rn")
    .with_("lq", f"SELECT *, lag(target, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS prev_position, {_owner_was} AS was FROM lp")
    .sql(
        "SELECT symbol, ts, CAST(owner AS BIGINT) AS owner, target, CASE WHEN owner IS NULL THEN 'no strategy firing' ELSE 'capped' END AS risk, prev_position, target - prev_position AS delta, "
        "CASE WHEN target > prev_position THEN 'BUY' WHEN target < prev_position THEN 'SELL' ELSE 'HOLD' END AS action, round(close, 6) + 0.0 AS price FROM lq"
    ),
)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polls(spark, sf_dir).groupBy("symbol", "ts").agg(live.clamp(F.sum("quantity"), 25).alias("target"), F.first("close").alias("price"))


_TG = "SELECT symbol, ts, close AS price, greatest(-25, least(25, q1 + q2 + q3)) AS target FROM pl"
register(
    "broker_orders",
    lambda s, d: live.orders(_targets(s, d)).select("symbol", "ts", "delta", "action"),
    _polls().with_("tg", _TG).sql("SELECT symbol, ts, CAST(d AS INTEGER) AS delta, CASE WHEN d > 0 THEN 'BUY' WHEN d < 0 THEN 'SELL' ELSE 'HOLD' END AS action FROM (SELECT symbol, ts, target - lag(target, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS d FROM tg)"),
)


def _ledger() -> q.Twin:
    return (
        _polls()
        .with_("tg", _TG)
        .with_("t_1", "SELECT *, lag(target, 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM tg")
        .with_("t_2", "SELECT *, CASE WHEN sign(target) <> 0 AND sign(target) <> sign(was) THEN {'ts': ts, 'price': price} END AS opened FROM t_1")
        .with_("t_3", "SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS entry FROM t_2")
        .with_(
            "ev",
            "SELECT *, 'CLOSE' AS event, was AS qty FROM t_3 WHERE sign(was) <> 0 AND sign(target) <> sign(was) UNION ALL SELECT *, 'OPEN', target FROM t_3 WHERE sign(target) <> 0 AND sign(target) <> sign(was) "
            "UNION ALL SELECT *, 'ADJUST', target FROM t_3 WHERE sign(target) = sign(was) AND target <> was",
        )
    )


register(
    "trade_ledger",
    lambda s, d: live.ledger(_targets(s, d)).select("symbol", "ts", "event", "side", "quantity", "entry_ts", (F.round("move_pct", 6) + F.lit(0.0)).alias("move_pct"), "holding"),
    _ledger()
    .sql(
        "SELECT symbol, ts, event, CASE WHEN qty > 0 THEN 'LONG' ELSE 'SHORT' END AS side, abs(qty) AS quantity, CASE WHEN event = 'CLOSE' THEN entry.ts END AS entry_ts, "
        "round(CASE WHEN event = 'CLOSE' THEN 100 * sign(qty) * (price / entry.price - 1) END, 6) + 0.0 AS move_pct, "
        "CASE WHEN event = 'CLOSE' THEN CAST(datediff('minute', entry.ts, ts) // 60 AS VARCHAR) || 'h' || lpad(CAST(datediff('minute', entry.ts, ts) % 60 AS VARCHAR), 2, '0') || 'm' END AS holding FROM ev"
    ),
)
register(
    "ledger_lines",
    lambda s, d: live.ledger_lines(live.ledger(_targets(s, d))),
    _ledger().sql(
        "SELECT symbol, ts, CASE WHEN event = 'OPEN' AND was <> 0 THEN 1 ELSE 0 END AS place, strftime(ts, '%Y-%m-%d %H:%M UTC') || ' (NY ' || strftime(timezone('America/New_York', timezone('UTC', ts)), '%H:%M') || ') ' || event || CASE WHEN qty > 0 THEN ' LONG ' ELSE ' SHORT ' END || abs(qty) || ' ' || symbol || ' @ ' || printf('%.2f', price) || "
        "CASE WHEN event = 'CLOSE' THEN printf(' move %+.2f%%', 100 * sign(qty) * (price / entry.price - 1)) || ' held ' || CAST(datediff('minute', entry.ts, ts) // 60 AS VARCHAR) || 'h' || lpad(CAST(datediff('minute', entry.ts, ts) % 60 AS VARCHAR), 2, '0') || 'm' ELSE '' END AS line FROM ev"
    ),
)


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
