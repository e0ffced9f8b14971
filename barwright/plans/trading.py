"""Live polls: the active strategies evaluated on the newest bars, one position a symbol, all polls kept as rows."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.operators import live
from barwright.plans import search, selection
from barwright.sources import candles

#: A poll's row, which is also the state that the next one starts from.
SLEEVE = "struct<live_id: bigint, name: string, label: string, signal: string, as_of: timestamp, price: double, quantity: int>"
POLLS = f"ts timestamp, mode string, combine string, symbol string, owner long, net_target int, target int, risk string, prev_position int, delta int, action string, price double, label string, sleeves array<{SLEEVE}>"

_POLL_COLUMNS = [*(c.split()[0] for c in POLLS.split("sleeves")[0].rstrip(", ").split(", ")), "sleeves"]


def decide(bars: DataFrame, strategies: DataFrame, days: int | None = None) -> DataFrame:
    """The decision of each active strategy on the last bar of its series, with its live_id, name and label."""
    rows = strategies.orderBy("live_id").collect()  # the active strategies: a handful
    if not rows:
        raise ValueError("no live strategy")
    bars, parts = live.recent(bars, days), []
    for r in rows:
        spec = search.Spec.from_json(r["spec_json"])
        own = bars.where((F.col("symbol") == r["symbol"]) & (F.col("interval") == r["interval"]))
        label = live.spec_label(F.array(*[F.lit(i.key) for i in spec.instances]), F.lit(spec.mode), F.lit(spec.combine))
        decided = live.decisions(search.spec_positions(own, spec))
        parts.append(decided.withColumns({"live_id": F.lit(r["live_id"]).cast("long"), "name": F.lit(r["name"]), "label": label}))
    return reduce(DataFrame.unionByName, parts)


def decide_once(bars: DataFrame, strategies: DataFrame, before: DataFrame, risk: live.Risk = live.Risk(), rule: str = "priority", days: int | None = None, at: datetime | None = None, mode: str = "dry-run") -> DataFrame:
    """One poll of POLLS for each symbol with active strategies. before: (symbol, owner, position)."""
    polled = live.reconciled(live.sleeves(decide(bars, strategies, days), risk), before, risk, rule)
    named = F.when(F.lit(rule) == "priority", F.col("label"))
    polled = polled.withColumns({"ts": F.lit(at or datetime.now(UTC)).cast("timestamp"), "mode": F.lit(mode), "combine": F.lit(rule), "label": named})
    return polled.select(*_POLL_COLUMNS)


def decide_over_time(bars: DataFrame, strategies: DataFrame, wanted: DataFrame, before: DataFrame, risk: live.Risk = live.Risk(), rule: str = "priority", mode: str = "dry-run") -> DataFrame:
    """Polls of POLLS at each bar of wanted(symbol, interval, ts), one after another from the state `before`.

    Indicators look at earlier bars alone, so a strategy's position on a bar is what a poll right after it would have got.
    """
    specs, parts = [r[0] for r in strategies.select("spec_json").distinct().orderBy("spec_json").collect()], []  # of the active strategies: a handful
    for text in specs:
        spec = search.Spec.from_json(text)
        own = F.broadcast(strategies.where(F.col("spec_json") == text).select("symbol", "interval", F.col("live_id").cast("long").alias("live_id"), "name"))
        label = live.spec_label(F.array(*[F.lit(i.key) for i in spec.instances]), F.lit(spec.mode), F.lit(spec.combine))
        series = bars.join(own.select("symbol", "interval").distinct(), ["symbol", "interval"], "left_semi")
        at = search.spec_positions(series, spec).join(wanted.select("symbol", "interval", "ts"), ["symbol", "interval", "ts"], "left_semi").join(own, ["symbol", "interval"])
        position = F.col("position").cast("int")
        parts.append(at.select("symbol", "ts", F.col("ts").alias("as_of"), position.alias("target"), live.label(position).alias("side"), F.col("close").alias("price"), "live_id", "name", label.alias("label")))
    if not parts:
        raise ValueError("no live strategy")
    asked = live.sleeves(reduce(DataFrame.unionByName, parts), risk, "ts")
    polled = live.reconciled_over_time(asked, before, risk, rule)
    return polled.withColumns({"mode": F.lit(mode), "combine": F.lit(rule), "label": F.when(F.lit(rule) == "priority", F.col("label"))}).select(*_POLL_COLUMNS)


def state_of(polls: DataFrame) -> DataFrame:
    """(symbol, owner, position) after the last poll of each symbol."""
    return polls.groupBy("symbol").agg(F.max_by(F.struct("owner", "target"), "ts").alias("x")).select("symbol", "x.owner", F.col("x.target").alias("position"))


@dataclass
class Session:
    """A run of polls over tables below `data`: candles, search, live, polls. Positions are what the polls before say (dry run)."""

    spark: SparkSession
    data: str
    risk: live.Risk = field(default_factory=live.Risk.from_env)
    rule: str = "priority"
    days: int | None = None
    auto: bool = False
    criteria: selection.Criteria = selection.Criteria()
    strategies: int = 1
    reselect_on_flat: bool = False
    day: object = None

    def polls(self) -> DataFrame:
        return search._read(self.spark, f"{self.data}/polls", f"{POLLS}, day date, batch long")

    def live(self) -> DataFrame:
        return search._read(self.spark, f"{self.data}/live", selection.LIVE)

    def reselect(self, again: bool = True) -> bool:
        """Make the best results of the run the only active strategies; False if none qualifies. Not again: leave them if they are active already."""
        stored, runs = search.results(self.spark, f"{self.data}/search"), search.runs(self.spark, f"{self.data}/search")
        chosen = selection.select_top(stored, self.strategies, self.criteria, runs)
        if chosen.isEmpty():
            return False
        promoted = selection.promote(self.live(), chosen, runs)
        specs = lambda live: sorted(map(tuple, selection.active(live).select("symbol", "interval", "spec_json").collect()))  # noqa: E731  a handful
        if again or specs(promoted) != specs(self.live()):
            replace(promoted, f"{self.data}/live")
        return True

    def poll(self, at: datetime | None = None, reopen: bool = False) -> DataFrame:
        """Decide once and add the poll to the table; `reopen` lets any strategy take the trade."""
        before = search.kept(state_of(self.polls()), f"{self.data}/checkpoints")
        if reopen:
            before = before.withColumn("owner", F.lit(None).cast("long"))
        bars = candles.table(self.spark, f"{self.data}/candles").select(*candles.COLUMNS)
        made = search.kept(decide_once(bars, selection.active(self.live()), before, self.risk, self.rule, self.days, at))
        self._write(made, -1)
        return made

    def _write(self, made: DataFrame, batch: int) -> None:
        """Add polls, below their day; those of a stream's batch take the place of what the same batch wrote before."""
        rows = made.withColumns({"day": F.to_date("ts"), "batch": F.lit(batch).cast("long")}).coalesce(1)
        writer = rows.write.mode("append") if batch < 0 else rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day", "batch").parquet(f"{self.data}/polls")

    def bars_arrived(self, batch: DataFrame, number: int, market_hours_only: bool = True) -> None:
        """A foreachBatch sink for bars: they go into the candle table, and each is polled, as if the poll came right after it.

        All state is in tables: a batch starts from the polls of the batches before it, so it may be run again after a
        failure, and a stream that is started anew goes on as if it had never stopped. A day's first bar selects anew if that
        is automatic. Bars that come late, before the last poll of their symbol, are stored but not polled.
        """
        folder = f"{self.data}/checkpoints"
        fresh, _ = candles.arrived(batch)
        fresh = search.kept(fresh, folder)
        candles.merge(f"{self.data}/candles", fresh)
        earlier = self.polls().where(F.col("batch") < number)
        last = earlier.groupBy("symbol").agg(F.max("ts").alias("_last"))
        wanted = fresh.join(last, "symbol", "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).select("symbol", "interval", "ts")
        wanted = search.kept(wanted.where(live.market_open(F.col("ts"))) if market_hours_only else wanted)
        # Stretches that are polled in one go: all bars of a day, or of a time if what comes next depends on each poll.
        alone = self.days is not None or self.auto and self.reselect_on_flat
        stretch = F.col("ts") if alone else F.to_date("ts")
        stretches = sorted(r[0] for r in wanted.select(stretch.alias("s")).distinct().collect())
        before = search.kept(state_of(earlier))
        day, made = earlier.agg(F.max(F.to_date("ts"))).first()[0], []
        for s in stretches:
            today = s.date() if alone else s
            new_day = self.auto and today != day
            if new_day and not self.reselect(again=False):
                continue
            day, start = today, before.withColumn("owner", F.lit(None).cast("long")) if new_day else before
            now = wanted.where(stretch == F.lit(s))
            bars = candles.table(self.spark, f"{self.data}/candles").where(F.col("ts") <= F.lit(s) if alone else F.to_date("ts") <= F.lit(s)).select(*candles.COLUMNS)
            active = selection.active(self.live())
            if active.isEmpty():
                continue
            polled = search.kept(decide_over_time(live.recent(bars, self.days), active, now, start, self.risk, self.rule))
            if alone and self.reselect_on_flat and self.rule == "priority" and not polled.where("prev_position <> 0 and target = 0").isEmpty():
                day = None
            made.append(polled)
            before = search.kept(state_of(polled).unionByName(before.join(polled.select("symbol").distinct(), "symbol", "left_anti")))
        if made:
            self._write(search.kept(reduce(DataFrame.unionByName, made)), number)

    def follow(self, bars: DataFrame, once: bool = False, market_hours_only: bool = True):
        """A streaming query over a stream of finished bars: polls of each bar, exactly once. Stop it and start it at will."""
        sink = lambda batch, number: self.bars_arrived(batch, number, market_hours_only)
        writer = bars.writeStream.foreachBatch(sink).option("checkpointLocation", f"{self.data}/stream")
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()

    def step(self, at: datetime | None = None) -> DataFrame | None:
        """A poll, after the day's selection if that is automatic; None if no strategy qualifies."""
        at = at or datetime.now(UTC)
        new_day = self.auto and at.date() != self.day
        if new_day:
            if not self.reselect():
                return None
            self.day = at.date()
        made = self.poll(at, reopen=new_day)
        if self.auto and self.reselect_on_flat and self.rule == "priority" and not made.where("prev_position <> 0 and target = 0").isEmpty():
            self.day = None  # a trade was closed: the next poll selects anew
        return made

    def run(self, seconds: float = 900, once: bool = False, market_hours_only: bool = True, most: int | None = None) -> None:
        """Poll until stopped, in market hours; an error of one poll is printed and the next one tries again."""
        n = 0
        while most is None or n < most:
            n += 1
            try:
                open_now = not market_hours_only or self.spark.range(1).select(live.market_open(F.current_timestamp())).first()[0]
                made = self.step() if once or open_now else None
                if made is None:
                    print("[live] no poll:", "no strategy qualifies" if once or open_now else "the market is closed")
                else:
                    print(*made.toJSON().collect(), sep="\n")  # a row for each symbol with a live strategy
            except Exception as e:
                if once:
                    raise
                print("[live] error:", e)
            if once:
                return
            time.sleep(seconds)


def ledger(polls: DataFrame) -> DataFrame:
    """The trades that polls made."""
    return live.ledger(polls.select("symbol", "ts", "target", "price", "label"))


def replace(df: DataFrame, path: str) -> None:
    """Write a small table anew: its old files are read to the end first."""
    rows = df.collect()  # live strategies: a handful
    df.sparkSession.createDataFrame(rows, df.schema).coalesce(1).write.mode("overwrite").parquet(path)
