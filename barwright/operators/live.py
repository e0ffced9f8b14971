"""Decisions, risk limits, combination of sleeves and the trade ledger, as columns and windows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barwright.functions.indicators import NEW_YORK
from barwright.sources.candles import lookback


@dataclass(frozen=True)
class Risk:
    order_qty: int = 10
    max_position: int = 10
    allow_short: bool = True
    kill_switch: bool = False

    @staticmethod
    def from_env(env: dict[str, str] | None = None) -> Risk:
        env = os.environ if env is None else env
        number = lambda name, default: int(env[name]) if env.get(name, "").strip() else default
        flag = lambda name, default: env[name].strip().lower() in ("1", "true", "yes", "on") if env.get(name, "").strip() else default
        return Risk(number("ORDER_QTY", 10), number("MAX_POSITION", 10), flag("ALLOW_SHORT", True), flag("KILL_SWITCH", False))


def sleeve_quantity(signal: Column, order_qty: Column | int, allow_short: Column | bool = True, kill_switch: Column | bool = False) -> Column:
    """What one strategy asks for: nothing under the kill switch, no shorts where they are banned."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(lit(kill_switch), 0).when((signal < 0) & ~lit(allow_short), 0).otherwise(F.signum(signal) * lit(order_qty)).cast("int")


def clamp(quantity: Column, max_position: Column | int) -> Column:
    most = max_position if isinstance(max_position, Column) else F.lit(max_position)
    return F.greatest(-most, F.least(most, quantity)).cast("int")


def clamp_reason(quantity: Column, max_position: Column | int, kill_switch: Column | bool = False) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(lit(kill_switch), "kill_switch").when(clamp(quantity, max_position) != quantity, "capped").otherwise("ok")


def market_open(ts: Column) -> Column:
    """Monday to Friday, 09:30 to 16:00 New York time, both ends included; no holidays."""
    local = F.from_utc_timestamp(ts, NEW_YORK)
    clock = F.date_format(local, "HH:mm:ss")
    return (F.weekday(local) < 5) & (clock >= "09:30:00") & (clock <= "16:00:00")


def label(side: Column) -> Column:
    return F.when(side > 0, "LONG").when(side < 0, "SHORT").otherwise("FLAT")


def decisions(positions: DataFrame) -> DataFrame:
    """The last bar's position of each series, whether it differs from the bar before, and the price it was made at."""
    w = Window.partitionBy("symbol", "interval").orderBy(F.desc("ts"))
    rows = positions.withColumn("n", F.row_number().over(w)).withColumn("earlier", F.lead("position", 1, 0.0).over(w)).withColumn("bars", F.count("*").over(Window.partitionBy("symbol", "interval")))
    return rows.where("n = 1").select("symbol", "interval", F.col("ts").alias("as_of"), F.col("position").cast("int").alias("target"), label(F.col("position")).alias("side"), (F.col("position") != F.col("earlier")).alias("changed"), F.col("close").alias("price"), "bars")


#: Decisions look back so many days at least, for the slow averages.
LEAST_DAYS = 60


def recent(candles: DataFrame, days: int | None = None) -> DataFrame:
    """The bars that a decision is made from: the last `days` days of each series, at least LEAST_DAYS; None: all."""
    return candles if days is None else lookback(candles, max(days, LEAST_DAYS))


def sleeves(decided: DataFrame, risk: Risk, *more: str) -> DataFrame:
    """Decisions with live_id as (symbol, live_id, name, label, signal, as_of, price, quantity): what each strategy asks for."""
    quantity = sleeve_quantity(F.col("target"), risk.order_qty, risk.allow_short, risk.kill_switch)
    return decided.select("symbol", *more, "live_id", "name", "label", F.col("side").alias("signal"), "as_of", "price", quantity.alias("quantity"))


def _gathered(asked: DataFrame, *keys: str) -> DataFrame:
    """The sleeves of each poll in one row: those of a symbol's active strategies, a handful."""
    row = F.struct("live_id", "name", "label", "signal", "as_of", "price", "quantity")
    return asked.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("sleeves"))


def _held(sleeves: Column, owner: Column) -> Column:
    return F.get(F.filter(sleeves, lambda s: s["live_id"] == owner), F.lit(0))


def _judged(rows: DataFrame, risk: Risk, rule: str, before: Column) -> DataFrame:
    """Polls from sleeves, the chosen one `c` and the owner before it; `before`: the position before, which may be a lag of `target`."""
    net = F.aggregate("sleeves", F.lit(0), lambda total, s: total + s["quantity"])
    rows = rows.withColumn("wanted", F.coalesce(F.col("c.quantity"), F.lit(0)) if rule == "priority" else net)
    why = clamp_reason(F.col("wanted"), risk.max_position)
    if rule == "priority":
        took = F.when(F.col("c.live_id") == F.col("_owner"), "ok").otherwise(F.concat(F.col("c.name"), F.lit(" took the trade")))
        why = F.when(F.col("c").isNull(), "no strategy firing").when(why != "ok", why).otherwise(took)
    rows = rows.withColumn("target", clamp(F.col("wanted"), risk.max_position)).withColumn("prev_position", F.coalesce(before, F.lit(0)))
    rows = rows.withColumn("delta", (F.col("target") - F.col("prev_position")).cast("int"))
    action = F.when(F.col("delta") > 0, "BUY").when(F.col("delta") < 0, "SELL").otherwise("HOLD")
    price = F.coalesce(F.col("c.price"), F.get("sleeves", F.lit(0))["price"])
    return rows.select(
        "symbol", *(["ts"] if "ts" in rows.columns else []), F.col("c.live_id").alias("owner"), (F.col("wanted") if rule == "net" else F.lit(None).cast("int")).alias("net_target"), "target", why.alias("risk"),
        "prev_position", "delta", action.alias("action"), price.alias("price"), F.coalesce("c.label", "c.name").alias("label"), "sleeves",
    )


_SLEEVE = "struct<live_id: bigint, name: string, label: string, signal: string, as_of: timestamp, price: double, quantity: int>"


def _known_rule(rule: str) -> None:
    if rule not in ("priority", "net"):
        raise ValueError("the rule must be priority or net")


def reconciled(asked: DataFrame, before: DataFrame, risk: Risk, rule: str = "priority") -> DataFrame:
    """One poll: (symbol, owner, net_target, target, risk, prev_position, delta, action, price, label, sleeves) of each symbol.

    `asked` are sleeves(), `before` is (symbol, owner, position) after the poll before, with owner a live_id. By priority
    the owner keeps the trade while its quantity is not 0, then the first strategy by id that fires takes it; by `net`
    the quantities are added. price and label are the owner's, or without one the first sleeve's price.
    """
    _known_rule(rule)
    rows = _gathered(asked, "symbol").join(before.select("symbol", F.col("owner").alias("_owner"), F.col("position").alias("_position")), "symbol", "left")
    firing = F.filter("sleeves", lambda s: s["quantity"] != 0)
    chosen = F.coalesce(_held(firing, F.col("_owner")), F.get(firing, F.lit(0))) if rule == "priority" else F.lit(None).cast(_SLEEVE)
    return _judged(rows.withColumn("c", chosen), risk, rule, F.col("_position"))


def reconciled_over_time(asked: DataFrame, before: DataFrame, risk: Risk, rule: str = "priority") -> DataFrame:
    """Polls one after another, as reconciled() would make them: `asked` has a column ts more, `before` is the state before all of them."""
    _known_rule(rule)
    rows = _gathered(asked, "symbol", "ts").join(before.select("symbol", F.col("owner").alias("_first"), F.col("position").alias("_position")), "symbol", "left")
    w = Window.partitionBy("symbol").orderBy("ts")
    first = F.row_number().over(w) == 1
    if rule == "priority":
        firing = F.transform(F.filter("sleeves", lambda s: s["quantity"] != 0), lambda s: F.struct(s["live_id"].alias("live_id"), s["quantity"].alias("quantity")))
        now = owners(rows.select("symbol", "ts", firing.alias("firing")), before).select("symbol", "ts", F.col("owner").alias("_now"))
        rows = rows.join(now, ["symbol", "ts"]).withColumn("_owner", F.when(first, F.col("_first")).otherwise(F.lag("_now").over(w))).withColumn("c", _held(F.col("sleeves"), F.col("_now")))
    else:
        rows = rows.withColumn("c", F.lit(None).cast(_SLEEVE))
    return _judged(rows, risk, rule, F.when(first, F.col("_position")).otherwise(F.lag("target").over(w)))


def combine_net(polls: DataFrame, max_position: int) -> DataFrame:
    """Sum of the sleeves' quantities at each poll(ts, symbol, live_id, quantity), within the limit; no sleeve owns it."""
    net = polls.groupBy("symbol", "ts").agg(F.sum("quantity").cast("int").alias("net"))
    return net.select("symbol", "ts", F.lit(None).cast("long").alias("owner"), clamp(F.col("net"), max_position).alias("target"))


def sticky_owner(owner: int | None, quantities: dict[int, int]) -> tuple[int | None, int]:
    """The owner stays while its quantity is not 0, even of the other sign; else the first sleeve by id that fires."""
    if owner is not None and quantities.get(owner, 0):
        return owner, quantities[owner]
    return next(((i, q) for i, q in sorted(quantities.items()) if q), (None, 0))


#: Polls that are gone through one after another; longer runs are composed of such chunks.
CHUNK = 256


def owners(polls: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(symbol, ts, owner, quantity) of polls(symbol, ts, firing), firing being the (live_id, quantity) with a quantity, by id.

    A poll maps each owner to the next one: who fires stays, else the first that fires comes. A chunk of polls is such a
    map too, known by where it leads those that fire in its first poll, and all others. A symbol's chunks are composed in
    order of time, from the owner in before(symbol, owner); then each chunk is gone through from its own first owner.
    """
    step = lambda owner, firing: F.when(F.exists(firing, lambda f: f["live_id"] == owner), owner).otherwise(F.get(firing, F.lit(0))["live_id"])
    after = lambda owner: F.aggregate("polls", owner, lambda o, p: step(o, p["firing"]))
    nobody = F.lit(None).cast("long")
    number = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    numbered = polls.select("symbol", "ts", "firing", (number / CHUNK).cast("long").alias("chunk"))
    chunks = numbered.groupBy("symbol", "chunk").agg(F.array_sort(F.collect_list(F.struct("ts", "firing"))).alias("polls"))

    ids = F.transform(F.get("polls", F.lit(0))["firing"], lambda f: f["live_id"])
    maps = chunks.select("symbol", F.struct("chunk", ids.alias("ids"), F.transform(ids, after).alias("ends"), after(nobody).alias("other")).alias("map"))
    maps = maps.groupBy("symbol").agg(F.array_sort(F.collect_list("map")).alias("maps"))  # a few numbers a chunk
    maps = maps.withColumn("owner", nobody) if before is None else maps.join(before.select("symbol", F.col("owner").cast("long").alias("owner")), "symbol", "left")
    leads = lambda o, m: F.when(F.array_contains(m["ids"], o), F.get(m["ends"], (F.array_position(m["ids"], o) - 1).cast("int"))).otherwise(m["other"])
    begin = F.struct(F.col("owner"), F.array().cast("array<struct<chunk: bigint, owner: bigint>>").alias("starts"))
    add = lambda x, m: F.struct(leads(x["owner"], m).alias("owner"), F.concat(x["starts"], F.array(F.struct(m["chunk"].alias("chunk"), x["owner"].alias("owner")))).alias("starts"))
    starts = maps.select("symbol", F.explode(F.aggregate("maps", begin, add)["starts"]).alias("s")).select("symbol", "s.chunk", "s.owner")

    seen = F.struct(F.col("owner"), F.array().cast("array<bigint>").alias("owners"))
    note = lambda x, p: (lambda now: F.struct(now.alias("owner"), F.concat(x["owners"], F.array(now)).alias("owners")))(step(x["owner"], p["firing"]))
    through = chunks.join(starts, ["symbol", "chunk"]).select("symbol", "polls", F.aggregate("polls", seen, note)["owners"].alias("owners"))
    each = through.select("symbol", F.explode(F.arrays_zip("polls", "owners")).alias("x")).select("symbol", "x.polls.ts", F.col("x.owners").alias("owner"), "x.polls.firing")
    return each.select("symbol", "ts", "owner", F.coalesce(_held(F.col("firing"), F.col("owner"))["quantity"], F.lit(0)).cast("int").alias("quantity"))


def combine_priority(polls: DataFrame, max_position: int) -> DataFrame:
    """Owner and target of each poll(ts, symbol, live_id, quantity)."""
    fires = F.when(F.col("quantity") != 0, F.struct("live_id", "quantity"))
    gathered = polls.groupBy("symbol", "ts").agg(F.array_sort(F.collect_list(fires)).alias("firing"))
    return owners(gathered).select("symbol", "ts", "owner", clamp(F.col("quantity"), max_position).alias("target"))


def orders(targets: DataFrame) -> DataFrame:
    """What a dry-run broker does at each poll: BUY or SELL the difference to the position before, or HOLD."""
    delta = (F.col("target") - F.lag("target", 1, 0).over(Window.partitionBy("symbol").orderBy("ts"))).cast("int")
    return targets.withColumn("delta", delta).withColumn("action", F.when(F.col("delta") > 0, "BUY").when(F.col("delta") < 0, "SELL").otherwise("HOLD"))


def ledger(targets: DataFrame) -> DataFrame:
    """(symbol, ts, event, side, quantity, price, entry_ts, entry_price, move_pct, holding) of targets(symbol, ts, target, price).

    OPEN from flat, CLOSE to flat, a flip is CLOSE and OPEN, ADJUST another size on the same side. A CLOSE has the entry
    it ends, the signed move since, and the time held as 2h05m. A column `label` in targets, what took the trade, is kept.
    """
    w = Window.partitionBy("symbol").orderBy("ts")
    rows = targets.withColumn("earlier", F.lag("target", 1, 0).over(w))
    now, was = F.signum("target"), F.signum("earlier")
    opens, closes = (now != 0) & (now != was), (was != 0) & (now != was)
    adjusts = (now == was) & (now != 0) & (F.col("target") != F.col("earlier"))
    entry = F.when(opens, F.struct(F.col("ts").alias("ts"), F.col("price").alias("price")))
    rows = rows.withColumn("entry", F.last(entry, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    row = lambda name, quantity: F.struct(F.lit(name).alias("event"), quantity.cast("int").alias("quantity"))
    events = F.filter(F.array(F.when(closes, row("CLOSE", F.col("earlier"))), F.when(opens, row("OPEN", F.col("target"))), F.when(adjusts, row("ADJUST", F.col("target")))), lambda x: x.isNotNull())
    labels = [c for c in ("label",) if c in targets.columns]
    rows = rows.select("symbol", "ts", "price", *labels, "entry", F.posexplode(events).alias("place", "e"))
    shut = F.col("e.event") == "CLOSE"
    move = F.when(shut, 100.0 * F.signum("e.quantity") * (F.col("price") / F.nullif("entry.price", F.lit(0.0)) - 1.0))
    minutes = F.floor((F.unix_micros("ts") - F.unix_micros("entry.ts")) / 60e6)
    held = F.when(shut, F.format_string("%dh%02dm", F.floor(minutes / 60), minutes % 60))
    return rows.select("symbol", "ts", "place", F.col("e.event").alias("event"), label(F.col("e.quantity")).alias("side"), F.abs("e.quantity").alias("quantity"), "price", F.when(shut, F.col("entry.ts")).alias("entry_ts"), F.when(shut, F.col("entry.price")).alias("entry_price"), move.alias("move_pct"), held.alias("holding"), *labels)


def ledger_lines(entries: DataFrame) -> DataFrame:
    """One line of text per ledger entry, with the times in UTC and New York."""
    at = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm 'UTC'"), F.lit(" (NY "), F.date_format(F.from_utc_timestamp("ts", NEW_YORK), "HH:mm"), F.lit(")"))
    by = F.coalesce(F.concat(F.lit(" by "), F.col("label")), F.lit("")) if "label" in entries.columns else F.lit("")
    tail = F.when(F.col("event") == "CLOSE", F.concat(F.lit(" move "), F.format_string("%+.2f%%", "move_pct"), F.lit(" held "), F.col("holding"))).otherwise("")
    return entries.select("symbol", "ts", "place", F.concat(at, F.format_string(" %s %s %d %s @ %.2f", "event", "side", "quantity", "symbol", "price"), by, tail).alias("line"))


def spec_label(instances: Column, mode: Column, combine: Column) -> Column:
    return F.concat(F.array_join(instances, " + "), F.lit(" ["), mode, F.lit(","), combine, F.lit("]"))


def fold_polls(key: tuple, frames: Iterator[pd.DataFrame], owner: int | None, max_position: int) -> tuple[int | None, pd.DataFrame]:
    """combine_priority for one symbol and micro-batch, from the owner so far."""
    out = []
    pdf = pd.concat(list(frames)).sort_values(["ts", "live_id"])
    for ts, poll in pdf.groupby("ts", sort=True):
        owner, quantity = sticky_owner(owner, dict(zip(poll["live_id"].tolist(), poll["quantity"].tolist(), strict=True)))
        out.append((key[0], ts, owner, max(-max_position, min(max_position, int(quantity)))))
    return owner, pd.DataFrame(out, columns=["symbol", "ts", "owner", "target"]).astype({"owner": "Int64"})
