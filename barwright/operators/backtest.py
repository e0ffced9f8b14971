"""Backtests of positions on candles as one plan of windows and aggregations per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.windows import SERIES, ratio

COST_BPS = 5.0
TRAIN = 0.7
YEAR_S = 365.25 * 86400
LOSS_FLOOR = -0.999999
#: A trade whose log return is above this wins; smaller ones are rounding.
WIN = 1e-12
METRICS = ("total_return", "cagr", "ann_vol", "sharpe", "sortino", "max_drawdown", "calmar", "win_rate", "trade_win_rate", "trade_wins", "trade_count", "profit_factor", "exposure", "num_trades", "n_bars")
COUNTS = ("trade_wins", "trade_count", "num_trades", "n_bars")


def periods_per_year(candles: DataFrame, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Bars a year by the median spacing of each series; 252 with fewer than three bars or no spacing."""
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(Window.partitionBy(*by).orderBy("ts"))
    spaced = candles.select(*by, gap.alias("gap")).groupBy(*by).agg(F.count("*").alias("n"), (F.median("gap") / 1e6).alias("step"))
    return spaced.select(*by, F.when((F.col("n") >= 3) & (F.col("step") > 0), YEAR_S / F.nullif("step", F.lit(0.0))).otherwise(252.0).alias("ppy"))


def halves(df: DataFrame, fraction: float = TRAIN, by: tuple[str, ...] = SERIES) -> DataFrame:
    """With half = 'is' for the first int(n * fraction) bars of each series and 'oos' for the rest."""
    row = F.row_number().over(Window.partitionBy(*by).orderBy("ts"))
    n = F.count("*").over(Window.partitionBy(*by))
    return df.withColumn("half", F.when(row <= F.floor(n * F.lit(float(fraction))), "is").otherwise("oos"))


def returns(df: DataFrame, by: tuple[str, ...], cost_bps: float = COST_BPS, position: str = "position") -> DataFrame:
    """With asset, held, turnover, r and seg for each bar: a position decided on a bar is held on the next one.

    r is the held return less the cost of the change; seg numbers the stretches of equal exposure. Each group of `by`
    starts flat, and its first bar has no return.
    """
    w = Window.partitionBy(*by).orderBy("ts")
    df = df.withColumn("asset", F.coalesce(ratio(F.col("close"), F.lag("close").over(w)) - 1.0, F.lit(0.0))).withColumn("held", F.lag(position, 1, 0.0).over(w))
    df = df.withColumn("step", F.col("held") - F.lag("held", 1, 0.0).over(w))
    df = df.withColumn("turnover", F.abs("step")).withColumn("r", F.col("held") * F.col("asset") - F.col("turnover") * F.lit(cost_bps / 1e4))
    return df.withColumn("seg", F.sum((F.col("step") != 0).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def metrics(df: DataFrame, by: tuple[str, ...], ppy: str = "ppy") -> DataFrame:
    """The fifteen metrics of each group of returns(df, by), with a column of bars per year.

    A group whose returns are all 0 has only zeros, but for n_bars. Trades are stretches of one exposure: the cost of the
    entry falls within the trade, that of the exit on the flat bar after it.
    """
    w = Window.partitionBy(*by).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("equity", F.product(1.0 + F.col("r")).over(w))
    df = df.withColumn("under", ratio(F.col("equity"), F.max("equity").over(w)) - 1.0)
    active, n = F.col("held") != 0, F.count("*")
    bars = df.groupBy(*by).agg(
        n.alias("n_bars"),
        F.sum(F.abs("r")).alias("moved"),
        F.max_by("equity", "ts").alias("final"),
        F.first(ppy).alias("ppy"),
        F.avg("r").alias("mean"),
        F.stddev_pop("r").alias("off"),
        F.stddev_pop(F.when(F.col("r") < 0, F.col("r"))).alias("off_down"),
        F.min("under").alias("max_drawdown"),
        F.sum((F.col("turnover") != 0).cast("long")).alias("num_trades"),
        F.avg(F.when(active, (F.col("r") > 0).cast("double"))).alias("win_rate"),
        F.sum(F.when(active & (F.col("r") > 0), F.col("r"))).alias("gain"),
        F.sum(F.when(active & (F.col("r") < 0), -F.col("r"))).alias("loss"),
        F.avg(active.cast("double")).alias("exposure"),
    )
    trade = df.where(active).groupBy(*by, "seg").agg(F.sum(F.log1p(F.greatest("r", F.lit(LOSS_FLOOR)))).alias("log_return"))
    trades = trade.groupBy(*by).agg(F.sum((F.col("log_return") > WIN).cast("long")).alias("trade_wins"), F.count("*").alias("trade_count"))
    both = bars.join(trades, list(by), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trade_wins", "trade_count")})
    year, final = F.sqrt("ppy"), F.col("final")
    cagr = F.when(final > 0, F.expm1(F.ln(F.when(final > 0, final)) * F.col("ppy") / F.col("n_bars")))
    both = both.withColumn("cagr", _or_zero(F.when(F.abs(cagr) < float("inf"), cagr)))
    full = {
        "total_return": final - 1.0,
        "cagr": F.col("cagr"),
        "ann_vol": F.col("off") * year,
        "sharpe": _or_zero(ratio("mean", "off") * year),
        "sortino": _or_zero(ratio("mean", "off_down") * year),
        "max_drawdown": F.col("max_drawdown"),
        "calmar": _or_zero(ratio(F.col("cagr"), F.abs("max_drawdown"))),
        "win_rate": _or_zero(F.col("win_rate")),
        "trade_win_rate": _or_zero(ratio(F.col("trade_wins").cast("double"), F.col("trade_count").cast("double"))),
        "trade_wins": F.col("trade_wins"),
        "trade_count": F.col("trade_count"),
        "profit_factor": _or_zero(ratio("gain", "loss")),
        "exposure": F.col("exposure"),
        "num_trades": F.col("num_trades"),
    }
    dead = F.coalesce(F.col("moved") == 0, F.lit(True))
    zero = {k: F.lit(0) if k in COUNTS else F.lit(0.0) for k in full}
    return both.select(*by, *[F.when(dead, zero[k]).otherwise(x).alias(k) for k, x in full.items()], "n_bars")


def backtest(positions: DataFrame, cost_bps: float = COST_BPS, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Metrics of each series of (…, ts, close, position)."""
    rows = positions.join(periods_per_year(positions, by), list(by))
    return metrics(returns(rows, by, cost_bps), by)


def split_backtest(positions: DataFrame, cost_bps: float = COST_BPS, fraction: float = TRAIN, by: tuple[str, ...] = SERIES) -> DataFrame:
    """Metrics of each series and half ('is', 'oos'): positions are those of the whole series, holdings restart flat in each half."""
    rows = halves(positions.join(periods_per_year(positions, by), list(by)), fraction, by)
    split = (*by, "half")
    return metrics(returns(rows, split, cost_bps), split)


def scored(split: DataFrame, by: tuple[str, ...] = SERIES) -> DataFrame:
    """One row of both halves' metrics (is_…, oos_…) with score, the lesser Sharpe ratio, and win_rate over all trades."""
    one = lambda half: split.where(F.col("half") == half).select(*by, *[F.col(m).alias(f"{half}_{m}") for m in METRICS])
    both = one("is").join(one("oos"), list(by))
    trades = (F.col("is_trade_count") + F.col("oos_trade_count")).cast("double")
    wins = (F.col("is_trade_wins") + F.col("oos_trade_wins")).cast("double")
    return both.withColumn("score", F.least("is_sharpe", "oos_sharpe")).withColumn("win_rate", _or_zero(ratio(wins, trades)))
