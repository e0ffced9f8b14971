"""Selection of strategies from results, and the table of those that are live."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.operators.report import DIGITS, of_run, ranked

LIVE = "live_id long, result_id long, name string, symbol string, interval string, spec_json string, status string"
DEFAULT_SYMBOL, DEFAULT_INTERVAL = "SPY", "1h"


@dataclass(frozen=True)
class Criteria:
    min_win_rate: float = 0.0
    min_trades: int = 20
    min_oos_trades: int = 10
    order_by: str = "score"
    run_id: str | None = None


def select_top(results: DataFrame, n: int = 1, criteria: Criteria = Criteria(), runs: DataFrame | None = None) -> DataFrame:
    """The best n results of a run, clones left out; fewer if fewer qualify.

    The run is the criteria's, else the latest of `runs`; without either, the best n of each run.
    """
    by = ("run_id",) if criteria.run_id is None and runs is None else ()
    rows = results if by else of_run(results, runs, criteria.run_id)
    return ranked(rows, n, criteria.order_by, criteria.min_win_rate, criteria.min_trades, criteria.min_oos_trades, by=by)


def select_best(results: DataFrame, criteria: Criteria = Criteria(), runs: DataFrame | None = None) -> DataFrame:
    return select_top(results, 1, criteria, runs)


def of_result(results: DataFrame, ordinal: int, run_id: str) -> DataFrame:
    """The result that a run and an ordinal name; every run has the same ordinals."""
    return results.where((F.col("run_id") == run_id) & (F.col("ordinal") == ordinal))


def deactivate_all(live: DataFrame) -> DataFrame:
    return live.withColumn("status", F.lit("disabled"))


def promote(live: DataFrame, chosen: DataFrame, runs: DataFrame | None = None, name: str | None = None, exclusive: bool = True) -> DataFrame:
    """The live table with the chosen results added as active, best first; exclusively, all others are disabled.

    Symbol and interval come from the run, or are the defaults. Ids go on from the largest so far, in order of score.
    """
    if chosen.isEmpty():
        raise ValueError("no such result")
    last = live.agg(F.coalesce(F.max("live_id"), F.lit(0))).first()[0]
    rows = chosen
    if runs is not None:
        rows = rows.drop("symbol", "interval").join(runs.select(F.col("id").alias("run_id"), "symbol", "interval"), "run_id", "left")
    for column, default in (("symbol", DEFAULT_SYMBOL), ("interval", DEFAULT_INTERVAL)):
        rows = rows.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in rows.columns else F.lit(default))
    order = F.row_number().over(Window.orderBy(F.desc(F.round("score", DIGITS)), "ordinal", "symbol", "interval"))  # as many rows as were chosen
    added = rows.select((F.lit(last) + order).cast("long").alias("live_id"), F.col("ordinal").alias("result_id"), (F.lit(name) if name else F.concat(F.lit("strategy "), F.col("ordinal"))).alias("name"), "symbol", "interval", "spec_json", F.lit("active").alias("status"))
    return (deactivate_all(live) if exclusive else live).unionByName(added)


def auto_select(live: DataFrame, results: DataFrame, n: int = 1, criteria: Criteria = Criteria(), runs: DataFrame | None = None) -> DataFrame:
    """The best n results, as select_top has them, as the only active strategies; if none qualifies, the table as it is."""
    chosen = select_top(results, n, criteria, runs)
    return live if chosen.isEmpty() else promote(live, chosen, runs)


def active(live: DataFrame) -> DataFrame:
    """Active strategies, newest first."""
    return live.where("status = 'active'").orderBy(F.desc("live_id"))


def newest(live: DataFrame) -> DataFrame:
    return active(live).limit(1)
