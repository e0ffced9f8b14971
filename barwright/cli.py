"""Command line: python -m barwright.cli COMMAND --data FOLDER ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from barwright.operators import report
from barwright.operators.live import decisions, ledger_lines, recent
from barwright.plans import search, selection, trading
from barwright.sources import candles
from barwright.streaming.jobs import stream_of


def _session() -> SparkSession:
    return SparkSession.builder.appName("barwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _floats(text: str) -> tuple[float | None, ...]:
    """Comma-separated trend strengths; a negative one stands for no gate."""
    return tuple(None if float(x) < 0 else float(x) for x in text.split(","))


def _table(spark: SparkSession, path: str, schema: str):
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="barwright")
    p.add_argument("--data", default="barwright-data", help="folder of all tables")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("check", help="which tables are there")
    sub.add_parser("init", help="make the tables that are not there")
    a = sub.add_parser("ingest", help="put bars from files into the candle table")
    a.add_argument("source")
    a.add_argument("--format", default="parquet")
    a.add_argument("--lookback-days", type=int)
    a = sub.add_parser("optimize", help="search strategies")
    a.add_argument("--restart", action="store_true")
    a.add_argument("--max-combo-size", type=int, choices=range(1, 7), default=4)
    a.add_argument("--adx-filters", type=_floats, default=(None,))
    a.add_argument("--sparse", action="store_true")
    a.add_argument("--dry-run", action="store_true", help="print how many strategies there are and about how long they take")
    a.add_argument("--max-combos", type=int)
    a.add_argument("--rate", type=float, default=RATE, help="strategies a second, for the estimate")
    a.add_argument("--symbol")
    a.add_argument("--name", help="label of the run; default unless it has one")
    a.add_argument("--workers", type=int, help="tasks that hold a job's specifications; four a core unless given")
    sub.add_parser("status", help="runs and how far they are")
    for name in ("report", "auto-select", "live-run"):
        a = sub.add_parser(name)
        a.add_argument("--run-id", help="the latest run unless given")
        a.add_argument("--top", "--strategies", type=int, default=15 if name == "report" else 1)
        a.add_argument("--order-by", choices=report.ORDERS, default="score")
        a.add_argument("--min-win-rate", type=float, default=0.0)
        a.add_argument("--min-trades", type=int, default=0 if name == "report" else 20)
        a.add_argument("--min-oos-trades", type=int, default=0 if name == "report" else 10)
        a.add_argument("--no-dedupe", action="store_true")
    a.add_argument("--auto", action="store_true", help="select strategies anew each day")
    a.add_argument("--combine", choices=("priority", "net"), default="priority")
    a.add_argument("--poll-seconds", type=float, default=900)
    a.add_argument("--once", action="store_true")
    a.add_argument("--ignore-market-hours", action="store_true")
    a.add_argument("--follow", metavar="FOLDER", help="poll each bar of Parquet files that arrive there, as a streaming query")
    a.add_argument("--reselect-on-flat", action=argparse.BooleanOptionalAction)
    a.add_argument("--lookback-days", type=int)
    a = sub.add_parser("promote", help="make one result the live strategy")
    a.add_argument("--result-id", type=int, required=True, help="its ordinal in the run")
    a.add_argument("--run-id", help="the latest run unless given")
    a.add_argument("--name")
    sub.add_parser("live-signal", help="the newest live strategy's decision on the last bar")
    sub.add_parser("ledger", help="the trades of all polls")
    return p


#: Strategies a second that the dry run's estimate takes; measured on eight cores.
RATE = 6000.0


def criteria_of(args) -> selection.Criteria:
    return selection.Criteria(args.min_win_rate, args.min_trades, args.min_oos_trades, args.order_by, args.run_id)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    data = args.data
    config = None
    if args.command == "optimize":
        config = search.Config(max_combo_size=args.max_combo_size, adx_filters=args.adx_filters, dense=not args.sparse)
        if args.dry_run:
            total = search.count(config) if args.max_combos is None else min(search.count(config), args.max_combos)
            print(f"{total:,} strategies a series, about {total / args.rate / 60:,.1f} minutes at {args.rate:,.0f} a second")
            return 0
    spark = _session()
    live = lambda: _table(spark, f"{data}/live", selection.LIVE)
    if args.command == "check":
        for name in ("candles", "search/results", "live"):
            try:
                print(name, spark.read.parquet(f"{data}/{name}").count(), "rows")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                print(name, "is missing")
        return 0
    if args.command == "init":
        for name, schema, by in (("candles", f"{candles.SCHEMA}, month int", candles.PARTITIONS), ("live", selection.LIVE, ()), ("polls", f"{trading.POLLS}, day date, batch long", ("day", "batch"))):
            spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(f"{data}/{name}")
        return 0
    if args.command == "ingest":
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{data}/checkpoints")
        rows, summary = candles.arrived(candles.read(spark, args.source, args.format), days=args.lookback_days)
        candles.merge(f"{data}/candles", rows)
        summary.show(truncate=False)
        return 0
    if args.command == "optimize":
        print(*search.run_search(spark, candles.load(candles.table(spark, f"{data}/candles"), args.symbol), config, f"{data}/search", restart=args.restart, most_combos=args.max_combos, name=args.name, tasks=args.workers), sep="\n")
        return 0
    if args.command == "live-run":
        again = args.auto if args.reselect_on_flat is None else args.reselect_on_flat
        session = trading.Session(spark, data, rule=args.combine, days=args.lookback_days, auto=args.auto, criteria=criteria_of(args), strategies=args.top, reselect_on_flat=again)
        if args.follow:
            query = session.follow(stream_of(spark, args.follow, candles.SCHEMA), args.once, not args.ignore_market_hours)
            query.awaitTermination()
        else:
            session.run(args.poll_seconds, args.once, not args.ignore_market_hours)
        return 0
    if args.command == "ledger":
        print(*(r["line"] for r in ledger_lines(trading.ledger(trading.Session(spark, data).polls())).orderBy("ts", "symbol", "place").collect()), sep="\n")
        return 0
    results, runs = search.results(spark, f"{data}/search"), search.runs(spark, f"{data}/search")
    if args.command == "status":
        report.list_runs(report.run_status(runs, results)).select("id", "name", "symbol", "interval", "status", "completed_combos", "total_combos", "completed", "pct", "started_at", "finished_at").show(truncate=False)
        return 0
    if args.command == "report":
        rows = report.of_run(results, runs, args.run_id)
        top = report.top_strategies(rows, args.top, order_by=args.order_by, min_win_rate=args.min_win_rate, min_trades=args.min_trades, min_oos_trades=args.min_oos_trades, dedupe=not args.no_dedupe)
        print(*(r["line"] for r in report.table_lines(top).collect()), sep="\n")
        return 0
    if args.command == "auto-select":
        chosen = selection.select_top(results, args.top, criteria_of(args), runs)
        if chosen.isEmpty():
            print("no strategy qualifies", file=sys.stderr)
            return 1
        trading.replace(selection.promote(live(), chosen, runs), f"{data}/live")
        return 0
    if args.command == "promote":
        run_id = args.run_id or (report.latest_run(runs).first() or {"id": ""})["id"]
        trading.replace(selection.promote(live(), selection.of_result(results, args.result_id, run_id), runs, name=args.name), f"{data}/live")
        return 0
    row = selection.newest(live()).first()
    if row is None:
        print("no live strategy", file=sys.stderr)
        return 1
    bars = candles.load(candles.table(spark, f"{data}/candles"), row["symbol"], row["interval"])
    decisions(search.spec_positions(recent(bars), search.Spec.from_json(row["spec_json"]))).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
