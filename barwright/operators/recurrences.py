"""Ordered recurrences: what a bar's value owes to all bars before it.

By default each series is one group and all recurrences that are wanted are made in one pass. In parts, all series are
ranged by time together and every range is a task: what a range needs from before it is a handful of numbers. Exponential
averages over a range are affine maps of the average before it, so ranges are composed by their maps; trailing stops start
from a guess, which the ranges hand on until none of them changes.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.functions.windows import SERIES, kept

#: Columns of each recurrence; "" stands for the recurrence's own name.
PARTS = {
    "ema": ("",),
    "macd": ("line", "signal", "hist"),
    "atr": ("",),
    "adx": ("adx", "plus", "minus"),
    "rsi": ("",),
    "tsi": ("",),
    "force": ("",),
    "psar": ("",),
    "supertrend": ("line", "dir"),
}
PRICES = ("open", "high", "low", "close", "volume")

#: State of an average: its level, bars since its last value, values so far.
Average = tuple[float, int, int]
NEW: Average = (np.nan, 0, 0)


def scan(a: np.ndarray, b: np.ndarray, start: float) -> np.ndarray:
    """y of y[i] = a[i] * y[i - 1] + b[i], with y[-1] = start: blocks of about sqrt(n) run side by side, then one after another."""
    n = len(a)
    width = max(1, int(np.sqrt(n)))
    rows = -(-n // width)
    factor, value = np.ones((width, rows)), np.zeros((width, rows))
    for to, x in ((factor, a), (value, b)):
        padded = np.full(rows * width, 1.0 if to is factor else 0.0)
        padded[:n] = x
        to[:] = padded.reshape(rows, width).T
    for k in range(1, width):
        value[k] += factor[k] * value[k - 1]
        factor[k] *= factor[k - 1]
    before = np.empty(rows)
    for k, (f, v) in enumerate(zip(factor[-1].tolist(), value[-1].tolist(), strict=True)):
        before[k] = start
        start = f * start + v
    return (value + factor * before).T.ravel()[:n]


def _steps(x: np.ndarray, alpha: float, state: Average) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the values, and the factor and offset by which each of them moves the level before it."""
    known = np.flatnonzero(~np.isnan(x))
    weight = (1.0 - alpha) ** np.diff(known, prepend=-1 - state[1])
    a, b = weight / (weight + alpha), alpha * x[known] / (weight + alpha)
    if len(known) and not state[2]:
        a[0], b[0] = 0.0, x[known[0]]
    return known, a, b


def ewm(x: np.ndarray, alpha: float, least: int = 0, state: Average = NEW) -> np.ndarray:
    """Recursive exponential average: NaN until `least` values are seen, carried over gaps.

    The first value starts it. Across a gap the old average's weight goes on fading, so the next value counts for more.
    """
    known, a, b = _steps(x, alpha, state)
    levels = np.concatenate(([state[0]], scan(a, b, state[0] if state[2] else 0.0) if len(known) else []))
    upto = np.cumsum(~np.isnan(x))
    return np.where(state[2] + upto >= max(least, 1), levels[upto], np.nan)


def ewm_map(x: np.ndarray, alpha: float) -> tuple:
    """What a stretch does to an average: (alpha, bars, bars up to its first value, that value, factor and offset from there on, bars after its last value, values)."""
    known, a, b = _steps(x, alpha, NEW)
    if not len(known):
        return alpha, len(x), 0, 0.0, 1.0, 0.0, 0, 0
    rest = scan(a[1:], b[1:], 0.0)[-1] if len(known) > 1 else 0.0
    return alpha, len(x), int(known[0]) + 1, float(x[known[0]]), float(np.prod(a[1:])), float(rest), int(len(x) - 1 - known[-1]), len(known)


def advance(state: Average, made: tuple) -> Average:
    """The average after a stretch, by the stretch's map."""
    alpha, bars, ahead, first, factor, offset, after, values = made
    level, gap, count = state
    if not values:
        return level, gap + bars, count
    weight = (1.0 - alpha) ** (gap + ahead)
    level = (weight * level + alpha * first) / (weight + alpha) if count else first
    return factor * level + offset, after, count + values


def _span(n: float) -> float:
    return 2.0 / (n + 1.0)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=(b != 0) & ~np.isnan(b))


class Unknown(Exception):
    """A recurrence's state at the beginning of a stretch isn't known yet."""


@dataclass
class Before:
    """What a stretch needs from before it: up to two bars, states of averages and stops that are known, and guesses of stops."""

    tail: list[list[float]] = field(default_factory=list)
    known: dict[tuple, tuple] = field(default_factory=dict)
    guess: dict[tuple, tuple] = field(default_factory=dict)


class Bars:
    """A stretch of a series' bars as arrays, with what several recurrences share. Without `before` the series begins here."""

    def __init__(self, prices: np.ndarray, before: Before | None = None, noting: bool = False):
        tail = np.array(before.tail, float).reshape(-1, len(PRICES)).T if before else np.zeros((len(PRICES), 0))
        self.o, self.h, self.l, self.c, self.v = np.concatenate([tail, prices], 1)
        self.before, self.begin, self.noting = before, tail.shape[1], noting
        self.memo: dict[tuple, np.ndarray] = {}
        self.maps: dict[tuple, tuple] = {}
        self.ends: dict[tuple, tuple] = {}

    def average(self, key: tuple, x: np.ndarray, alpha: float, least: int = 0) -> np.ndarray:
        """The average of x on the stretch's bars, made once; noting, with its map."""
        if key not in self.memo:
            if self.noting:
                self.maps[key] = ewm_map(x, alpha)
            if self.before is not None and key not in self.before.known:
                raise Unknown
            self.memo[key] = ewm(x, alpha, least, self.before.known[key] if self.before else NEW)
        return self.memo[key]

    def here(self, x: np.ndarray) -> np.ndarray:
        return x[self.begin :]

    def change(self) -> np.ndarray:
        return self.here(np.diff(self.c, prepend=np.nan))

    def true_range(self) -> np.ndarray:
        last = np.concatenate(([np.nan], self.c[:-1]))[: len(self.c)]
        return self.here(np.fmax(np.fmax(self.h - self.l, np.abs(self.h - last)), np.abs(self.l - last)))

    def ema(self, n: float) -> np.ndarray:
        return self.average(("ema", n), self.here(self.c), _span(n), int(n))

    def atr(self, n: float) -> np.ndarray:
        return self.average(("atr", n), self.true_range(), 1.0 / n, int(n))

    def macd(self, fast: float, slow: float, signal: float) -> tuple[np.ndarray, ...]:
        line = _all(lambda: self.ema(fast), lambda: self.ema(slow))
        line = line[0] - line[1]
        smooth = self.average(("macd", fast, slow, signal), line, _span(signal), int(signal))
        return line, smooth, line - smooth

    def adx(self, n: float) -> tuple[np.ndarray, ...]:
        up, down = (self.here(np.diff(x, prepend=x[:1])) for x in (self.h, -self.l))
        rise, fall = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        a, *moves = _all(lambda: self.atr(n), lambda: self.average(("rise", n), rise, 1.0 / n, int(n)), lambda: self.average(("fall", n), fall, 1.0 / n, int(n)))
        plus, minus = (100.0 * _ratio(m, a) for m in moves)
        return self.average(("adx", n), 100.0 * _ratio(np.abs(plus - minus), plus + minus), 1.0 / n, int(n)), plus, minus

    def rsi(self, n: float) -> np.ndarray:
        d = self.change()
        side = lambda s: np.where(np.isnan(d), np.nan, np.maximum(s * d, 0.0))
        gain, loss = _all(lambda: self.average(("gain", n), side(1.0), 1.0 / n, int(n)), lambda: self.average(("loss", n), side(-1.0), 1.0 / n, int(n)))
        return 100.0 - 100.0 / (1.0 + _ratio(gain, loss))

    def tsi(self, slow: float, fast: float) -> np.ndarray:
        d = self.change()
        inner = lambda name, x: self.average((name, slow), x, _span(slow))
        both = lambda name, x: self.average((name, slow, fast), inner(name, x), _span(fast))
        top, bottom = _all(lambda: both("step", d), lambda: both("size", np.abs(d)))
        return 100.0 * _ratio(top, bottom)

    def force(self, n: float) -> np.ndarray:
        return self.average(("force", n), self.change() * self.here(self.v), _span(n), int(n))

    def _start(self, key: tuple) -> tuple | None:
        return None if self.before is None else self.before.known.get(key, self.before.guess.get(key))

    def psar(self, step: float, most: float) -> np.ndarray:
        """Parabolic stop: it trails the extreme of the trend by a growing factor and flips when a bar crosses it."""
        highs, lows, n = self.h.tolist(), self.l.tolist(), len(self.c)
        out, state, at = [], self._start(("psar", step, most)), self.begin
        if state is None and at < n:  # the beginning of the series, or a guess
            state, at = (True, step, highs[at], lows[at]), at + 1
            out.append(lows[at - 1])
        if state is not None:
            rising, factor, extreme, stop = state
            for i in range(at, n):
                high, low, b = highs[i], lows[i], max(i - 2, 0)
                stop += factor * (extreme - stop)
                stop = min(stop, lows[i - 1], lows[b]) if rising else max(stop, highs[i - 1], highs[b])
                if low < stop if rising else high > stop:
                    stop, rising, factor = extreme, not rising, step
                    extreme = high if rising else low
                elif high > extreme if rising else low < extreme:
                    extreme = high if rising else low
                    factor = min(factor + step, most)
                out.append(stop)
            self.ends["psar", step, most] = (rising, factor, extreme, stop)
        return np.array(out, float)

    def supertrend(self, n: float, width: float) -> tuple[np.ndarray, ...]:
        """Bands of `width` average ranges that only tighten while the close stays inside; the direction is 1 in warm-up."""
        mid, reach = self.here((self.h + self.l) / 2.0), width * self.atr(n)
        highs, lows, closes = (mid + reach).tolist(), (mid - reach).tolist(), self.here(self.c).tolist()
        line, way = np.full(len(mid), np.nan), np.ones(len(mid))
        upper, lower, turn = self._start(("supertrend", n, width)) or (np.nan, np.nan, 1.0)
        last = self.c[self.begin - 1] if self.begin else np.nan
        for i, (high, low, close) in enumerate(zip(highs, lows, closes, strict=True)):
            if upper == upper:
                if close > upper:
                    turn = 1.0
                elif close < lower:
                    turn = -1.0
                high = high if high < upper or last > upper else upper
                low = low if low > lower or last < lower else lower
                line[i] = low if turn > 0 else high
            way[i] = turn
            upper, lower, last = high, low, close
        self.ends["supertrend", n, width] = (upper, lower, turn)
        return line, way


def _all(*makers: Callable[[], np.ndarray]) -> list[np.ndarray]:
    """What all make; if the state of some is unknown, the others have noted theirs nonetheless."""
    made, missing = [], False
    for make in makers:
        try:
            made.append(make())
        except Unknown:
            missing = True
    if missing:
        raise Unknown
    return made


def _names(wanted: dict[str, tuple]) -> list[tuple[tuple, list[str]]]:
    return [(call, [f"{tag}_{p}" if p else tag for p in PARTS[call[0]]]) for tag, call in wanted.items()]


def _columns(bars: Bars, wanted: dict[str, tuple]) -> Iterator[tuple[str, np.ndarray]]:
    for (kind, *params), columns in _names(wanted):
        got = getattr(bars, kind)(*params)
        yield from zip(columns, got if isinstance(got, tuple) else (got,), strict=True)


def _shape(candles: DataFrame, wanted: dict[str, tuple]) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in candles.schema.fields] + [f"`{n}` double" for _, columns in _names(wanted) for n in columns])


def add(candles: DataFrame, wanted: dict[str, tuple], parts: int | None = None) -> DataFrame:
    """Candles with the columns of each wanted recurrence, {name: (kind, *params)}.

    Each series is one group of a task. With `parts`, all bars are cut into so many ranges of series and time, whatever the
    lengths of the series, at the price of a checkpoint and a few short jobs: for series too long for a task.
    """
    if parts is not None:
        return _in_parts(candles, wanted, parts)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable", ignore_index=True)
        bars = Bars(np.stack([pdf[x].to_numpy(float) for x in PRICES]))
        return pd.concat([pdf, pd.DataFrame(dict(_columns(bars, wanted)), index=pdf.index)], axis=1)

    return candles.groupBy(*SERIES).applyInPandas(run, _shape(candles, wanted))


# in parts of time


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of one series in sorted rows."""
    own, held = None, []
    for b in batches:
        names = [b.column(b.schema.get_field_index(k)) for k in SERIES]
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        for x in names:
            code = pc.fill_null(x.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            key = tuple(x[lo].as_py() for x in names)
            if held and key != own:
                yield own, pa.Table.from_batches(held)
                held = []
            own = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield own, pa.Table.from_batches(held)


def _prices(table: pa.Table) -> np.ndarray:
    return np.stack([table[x].cast(pa.float64()).to_numpy().astype(float) for x in PRICES])


@dataclass
class Range:
    """The last stretch of one range, as the driver knows it: its series, whether it is all of the range, and what it does."""

    first: tuple
    last: tuple
    whole: bool
    tail: list[list[float]]
    maps: dict[tuple, tuple] = field(default_factory=dict)
    ends: dict[tuple, tuple] = field(default_factory=dict)


def _noted(wanted: dict[str, tuple], before: dict[int, Before], deep: bool) -> Callable:
    """A row for each range: (part, JSON of its Range); not deep: without maps and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = part = None
        whole, kept_ = True, None
        for key, table in _stretches(batches):
            if part is None:
                part, first = table["_part"][0].as_py(), key
            else:
                whole = False
            last, kept_ = key, table
        if part is None:
            return
        prices = _prices(kept_)
        bars = Bars(prices, before.get(part) if whole else None, noting=True)
        if deep:
            for call in wanted.values():
                try:
                    getattr(bars, call[0])(*call[1:])
                except Unknown:
                    pass
        pairs = lambda d: [[list(k), list(v)] for k, v in d.items()]
        text = json.dumps([first, last, whole, prices[:, -2:].T.tolist(), pairs(bars.maps), pairs(bars.ends)])
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([text])], names=["part", "noted"])

    return run


def befores(ranged: DataFrame, wanted: dict[str, tuple]) -> tuple[dict[int, Before], list[int]]:
    """What each range that goes on with a series needs from before it; and how many ranges were gone through in each round.

    ranged has rows in ranges `_part` of series and time. The driver holds a few numbers a range. A round goes through the
    ranges in which something is open: first their last bars, then averages, averages of averages, and the states of stops
    as long as one that was handed on has changed.
    """

    def note(parts: list[int] | None, before: dict[int, Before], deep: bool) -> dict[int, Range]:
        rows = ranged if parts is None else ranged.where(F.col("_part").isin(parts))
        out = {}
        for r in rows.mapInArrow(_noted(wanted, before, deep), "part int, noted string").collect():
            first, last, whole, tail, maps, ends = json.loads(r["noted"])
            dicts = ({tuple(k): tuple(v) for k, v in pairs} for pairs in (maps, ends))
            out[r["part"]] = Range(tuple(first), tuple(last), whole, tail, *dicts)
        return out

    ranges, rounds = note(None, {}, False), []
    rounds.append(len(ranges))
    order = sorted(ranges)
    before: dict[int, Before] = {}
    for p, q in zip(order, order[1:], strict=False):
        if ranges[p].last == ranges[q].first:
            ahead = before[p].tail if ranges[p].whole and p in before else []
            before[q] = Before([*ahead, *ranges[p].tail][-2:])
    todo = [p for p, q in zip(order, order[1:], strict=False) if q in before]  # their ends are wanted
    while todo:
        rounds.append(len(todo))
        for p, r in note(todo, before, True).items():
            ranges[p].maps.update(r.maps)
            ranges[p].ends.update(r.ends)
        changed = set()
        for p, q in zip(order, order[1:], strict=False):
            if q not in before:
                continue
            start = before.get(p) if ranges[p].whole else None
            for key, made in ranges[p].maps.items():
                if key not in before[q].known and (start is None or key in start.known):
                    before[q].known[key] = advance(start.known[key] if start else NEW, made)
                    changed.add(q)
            for key, end in ranges[p].ends.items():
                if before[q].guess.get(key) != end and repr(before[q].guess.get(key)) != repr(end):  # NaN is NaN
                    before[q].guess[key] = end
                    changed.add(q)
        after = dict(zip(order[1:], order[2:], strict=False))
        todo = sorted(p for p in changed if ranges[p].whole and after.get(p) in before)
    return before, rounds


def _in_parts(candles: DataFrame, wanted: dict[str, tuple], parts: int) -> DataFrame:
    order = [*SERIES, "ts"]
    ranged = kept(candles.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    before, _ = befores(ranged, wanted)
    own = candles.columns
    names = [*own, *(n for _, columns in _names(wanted) for n in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for _, table in _stretches(batches):
            bars = Bars(_prices(table), before.get(table["_part"][0].as_py()) if first else None)
            first = False
            made = [pa.array(x, pa.float64(), mask=np.isnan(x)) for _, x in _columns(bars, wanted)]
            whole = pa.Table.from_arrays([*(table[c] for c in own), *made], names=names)
            yield from whole.to_batches(max_chunksize=10_000)

    return ranged.mapInArrow(run, _shape(candles, wanted))
