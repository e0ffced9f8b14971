"""Ranking and shaping of search results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barwright.functions.signals import CATEGORY

ORDERS = ("score", "oos_sharpe", "oos_return", "win_rate")
#: Scores equal in so many digits are ties: sums in another order must not change a ranking.
DIGITS = 9
#: With `pool=True`, max(50 n, 3000) rows are cut out before the filters that need metrics.
POOL_FACTOR, POOL_LEAST = 50, 3000

HALF = "struct<total_return: double, cagr: double, ann_vol: double, sharpe: double, sortino: double, max_drawdown: double, calmar: double, win_rate: double, trade_win_rate: double, trade_wins: bigint, trade_count: bigint, profit_factor: double, exposure: double, num_trades: bigint, n_bars: bigint>"
METRICS_JSON = f"struct<is: {HALF}, oos: {HALF}>"
SPEC_JSON = "struct<instances: array<struct<factory: string, params: map<string, string>>>, mode: string, adx_min: double, combine: string>"


def categories(spark: SparkSession) -> DataFrame:
    """(factory, category) of all signals."""
    return spark.createDataFrame(list(CATEGORY.items()), "factory string, category string")


def category_of(factory) -> F.Column:
    pairs = [F.lit(x) for pair in CATEGORY.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[factory], F.lit("unknown"))


def detail(half: F.Column) -> F.Column:
    """What a report shows of one half; zeros where the metrics can't be read."""
    zero = lambda name: F.coalesce(half[name], F.lit(0.0))
    n = lambda name: F.coalesce(half[name], F.lit(0).cast("long"))
    return F.struct(
        n("trade_count").alias("trades"),
        n("trade_wins").alias("wins"),
        F.greatest(n("trade_count") - n("trade_wins"), F.lit(0)).alias("losses"),
        zero("trade_win_rate").alias("win_rate"),
        zero("total_return").alias("total_return"),
        zero("cagr").alias("cagr"),
        zero("sharpe").alias("sharpe"),
        zero("sortino").alias("sortino"),
        zero("max_drawdown").alias("max_drawdown"),
        zero("profit_factor").alias("profit_factor"),
        zero("exposure").alias("exposure"),
    )


def ranked(results: DataFrame, n: int = 15, order_by: str = "score", min_win_rate: float = 0.0, min_trades: int = 0, min_oos_trades: int = 0, dedupe: bool = True, pool: bool = False, id_col: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """The best n rows that pass the filters (0: no filter), clones by rounded metrics left out, ties by id.

    One sort: filters, the first of each clone, then the n best. num_trades counts changes of position in both halves,
    min_oos_trades filters trades of the second half. With `by`, such as run_id, the n best of each group.
    """
    order = [F.desc(F.round(order_by if order_by in ORDERS else "score", DIGITS)), F.asc(id_col)]

    def first(rows: DataFrame, most: int, by: tuple) -> DataFrame:
        if not by:
            return rows.orderBy(*order).limit(most)
        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most).drop("_n")

    rows = results.withColumn("m", F.from_json("metrics_json", METRICS_JSON))
    rows = rows.where((F.lit(min_win_rate) <= 0) | (F.col("win_rate") >= min_win_rate)).where((F.lit(min_trades) <= 0) | (F.col("num_trades") >= min_trades))
    if pool and (min_oos_trades > 0 or dedupe):
        rows = first(rows, max(POOL_FACTOR * n, POOL_LEAST), by)
    if min_oos_trades > 0:
        rows = rows.where(F.coalesce(F.col("m.oos.trade_count"), F.lit(0)) >= min_oos_trades)
    if dedupe:
        same = [F.round("is_sharpe", 4) + 0.0, F.round("oos_sharpe", 4) + 0.0, F.round("oos_return", 6) + 0.0, F.round("oos_max_drawdown", 6) + 0.0, F.col("num_trades"), F.round("win_rate", 6)]
        rows = first(rows, 1, (*by, *same))
    return first(rows, n, by)


def shaped(rows: DataFrame, id_col: str = "ordinal", by: tuple[str, ...] = ()) -> DataFrame:
    """The eighteen fields of a report, after those of `by`: labels and categories of the indicators, and detail of both halves."""
    spec = F.from_json("spec_json", SPEC_JSON)
    params = lambda i: F.array_join(F.transform(F.map_entries(i["params"]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    label = lambda i: F.concat(i["factory"], F.lit("("), params(i), F.lit(")"))
    shape = F.transform(F.col("spec.instances"), lambda i: F.struct(i["factory"].alias("factory"), i["params"].alias("params"), category_of(i["factory"]).alias("category"), label(i).alias("label")))
    rows = rows.withColumn("spec", spec).withColumn("indicators", shape).withColumn("detail", F.struct(detail(F.col("m.is")).alias("is"), detail(F.col("m.oos")).alias("oos")))
    return rows.select(
        *by, F.col(id_col).alias("id"), "score", "is_sharpe", "oos_sharpe", "oos_return", F.col("oos_max_drawdown").alias("oos_mdd"), "win_rate", "is_win_rate", "oos_win_rate",
        F.col("num_trades").alias("trades"), F.col("detail.is.trades").alias("is_trades"), F.col("detail.oos.trades").alias("oos_trades"),
        F.col("spec.mode").alias("mode"), F.col("spec.adx_min").alias("adx_min"), F.coalesce("spec.combine", F.lit("and")).alias("combine"),
        F.array_join(F.transform("indicators", lambda i: i["label"]), ", ").alias("strategy"), "indicators", "detail",
    )


def top_strategies(results: DataFrame, n: int = 15, **how) -> DataFrame:
    return shaped(ranked(results, n, **how), how.get("id_col", "ordinal"), how.get("by", ()))


def list_runs(runs: DataFrame) -> DataFrame:
    """Runs(id, symbol, interval, started_at, ...), newest first; runs begun together by symbol and interval."""
    return runs.orderBy(F.desc_nulls_last("started_at"), "symbol", "interval", "id")


def latest_run(runs: DataFrame) -> DataFrame:
    return list_runs(runs).limit(1)


def of_run(results: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Results of one run: the latest unless another is named."""
    if run_id is not None:
        return results.where(F.col("run_id") == run_id)
    return results.join(F.broadcast(latest_run(runs).select(F.col("id").alias("run_id"))), "run_id", "left_semi")


def run_status(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Each run with how many results it has stored, and that as a share of its specifications."""
    stored = results.groupBy("run_id").agg(F.count("*").alias("completed"))
    both = runs.join(stored, runs["id"] == stored["run_id"], "left").drop("run_id").withColumn("completed", F.coalesce("completed", F.lit(0).cast("long")))
    return both.withColumn("pct", F.coalesce(100.0 * F.col("completed") / F.nullif("total_combos", F.lit(0)), F.lit(0.0)))


def table_lines(top: DataFrame) -> DataFrame:
    """One formatted line per strategy, for a terminal."""
    percent = lambda x: F.format_string("%6.2f%%", 100.0 * F.col(x))
    number = lambda x: F.format_string("%7.2f", F.col(x))
    line = F.concat_ws(" ", F.lpad(F.col("id").cast("string"), 8, " "), number("score"), number("is_sharpe"), number("oos_sharpe"), percent("oos_return"), percent("oos_mdd"), percent("win_rate"), F.lpad(F.col("trades").cast("string"), 5, " "), F.rpad("mode", 10, " "), "strategy")
    return top.select("id", line.alias("line"))
