"""Indicators as columns of a sheet: every function adds what it needs and returns the names of its columns.

All are causal, and NULL where the bars so far don't define them. Names carry the parameters, so an indicator that
several callers want is computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barwright.functions.sheet import Sheet
from barwright.functions.windows import SERIES, before, held, last_rows, ordered, ratio, rolling, so_far, true

NEW_YORK = "America/New_York"


def _bar() -> list[Column]:
    return [F.col(x) for x in ("high", "low", "close", "volume")]


def _typical() -> Column:
    high, low, close, _ = _bar()
    return (high + low + close) / 3.0


def _n(x: float) -> str:
    return f"{x:g}".replace(".", "p").replace("-", "m")


# moving averages


def sma(s: Sheet, n: int = 20, x: str = "close") -> str:
    return s.make(f"sma_{n}_{x}", rolling(F.avg, x, n), x)


def wma(s: Sheet, n: int = 20, x: str = "close") -> str:
    """Weights 1..n, the newest bar heaviest, from two rolling sums: sum(x * row) - (row - n) * sum(x)."""
    row = s.make("row", F.row_number().over(ordered()).cast("double"))
    at = s.make(f"moment_{x}", F.col(x) * F.col(row), x, row)
    weighted = rolling(F.sum, at, n) - (F.col(row) - n) * rolling(F.sum, x, n)
    return s.make(f"wma_{n}_{x}", weighted / (n * (n + 1) / 2.0), at, row)


def ema(s: Sheet, n: int = 20) -> str:
    return s.recur("ema", n)[0]


# trend


def macd(s: Sheet, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[str, ...]:
    return s.recur("macd", fast, slow, signal)


def true_range(s: Sheet) -> str:
    high, low, _, _ = _bar()
    return s.make("true_range", F.greatest(high - low, F.abs(high - before("close")), F.abs(low - before("close"))))


def atr(s: Sheet, n: int = 14) -> str:
    return s.recur("atr", n)[0]


def adx(s: Sheet, n: int = 14) -> tuple[str, ...]:
    return s.recur("adx", n)


def aroon(s: Sheet, n: int = 25) -> tuple[str, str, str]:
    """How long ago the extreme of the last n + 1 bars was, in per cent; among equal extremes the oldest counts."""
    row = s.make("row", F.row_number().over(ordered()).cast("double"))
    span = last_rows(n + 1)
    full = F.count("high").over(span) == n + 1
    first = F.col(row) - n
    at_high = F.max(F.struct("high", (-F.col(row)).alias("r"))).over(span)["r"]
    at_low = F.min(F.struct("low", F.col(row).alias("r"))).over(span)["r"]
    up = s.make(f"aroon_up_{n}", F.when(full, 100.0 * (-at_high - first) / n), row)
    down = s.make(f"aroon_down_{n}", F.when(full, 100.0 * (at_low - first) / n), row)
    return up, down, s.make(f"aroon_osc_{n}", F.col(up) - F.col(down), up, down)


def parabolic_sar(s: Sheet, step: float = 0.02, most: float = 0.2) -> str:
    return s.recur("psar", step, most)[0]


def _midpoint(n: int):
    return (rolling(F.max, "high", n) + rolling(F.min, "low", n)) / 2.0


def ichimoku(s: Sheet, conversion: int = 9, base: int = 26, span_b: int = 52) -> tuple[str, ...]:
    """Conversion and base lines, and the cloud's two edges as they were computed `base` bars ago."""
    tenkan, kijun, wide = (s.make(f"mid_{n}", _midpoint(n)) for n in (conversion, base, span_b))
    lead = s.make(f"lead_{conversion}_{base}", (F.col(tenkan) + F.col(kijun)) / 2.0, tenkan, kijun)
    a = s.make(f"cloud_a_{conversion}_{base}", before(lead, base), lead)
    return tenkan, kijun, a, s.make(f"cloud_b_{base}_{span_b}", before(wide, base), wide)


def supertrend(s: Sheet, n: int = 10, width: float = 3.0) -> tuple[str, str]:
    return s.recur("supertrend", n, width)


# momentum


def rsi(s: Sheet, n: int = 14) -> str:
    return s.recur("rsi", n)[0]


def _place(s: Sheet, name: str, x: str, bottom: str, top: str, n: int) -> str:
    """Where x stands between the rolling extremes, in per cent."""
    least, most = rolling(F.min, bottom, n), rolling(F.max, top, n)
    return s.make(name, 100.0 * ratio(F.col(x) - least, most - least), x, bottom, top)


def stochastic(s: Sheet, k: int = 14, d: int = 3, smooth: int = 3) -> tuple[str, str]:
    fast = sma(s, smooth, _place(s, f"stoch_{k}", "close", "low", "high", k))
    return fast, sma(s, d, fast)


def stoch_rsi(s: Sheet, n: int = 14, k: int = 3, d: int = 3) -> tuple[str, str]:
    r = rsi(s, n)
    fast = sma(s, k, _place(s, f"stoch_{r}", r, r, r, n))
    return fast, sma(s, d, fast)


def cci(s: Sheet, n: int = 20) -> str:
    """Deviation of the typical price from its mean, by the mean of each bar's own such deviation."""
    tp = s.make("typical", _typical())
    off = s.make(f"cci_off_{n}", F.col(tp) - rolling(F.avg, tp, n), tp)
    size = s.make(f"cci_abs_{n}", F.abs(off), off)
    return s.make(f"cci_{n}", ratio(F.col(off), 0.015 * rolling(F.avg, size, n)), size)


def williams_r(s: Sheet, n: int = 14) -> str:
    _, _, close, _ = _bar()
    least, most = rolling(F.min, "low", n), rolling(F.max, "high", n)
    return s.make(f"williams_{n}", -100.0 * ratio(most - close, most - least))


def roc(s: Sheet, n: int = 12) -> str:
    _, _, close, _ = _bar()
    return s.make(f"roc_{n}", 100.0 * (ratio(close, before("close", n)) - 1.0))


def momentum(s: Sheet, n: int = 10) -> str:
    _, _, close, _ = _bar()
    return s.make(f"momentum_{n}", close - before("close", n))


def tsi(s: Sheet, slow: int = 25, fast: int = 13) -> str:
    return s.recur("tsi", slow, fast)[0]


# volatility and price action


def bollinger(s: Sheet, n: int = 20, width: float = 2.0) -> tuple[str, ...]:
    """Middle, upper and lower band (population deviation), relative width, and the close's place between the bands."""
    _, _, close, _ = _bar()
    mid, off = sma(s, n), s.make(f"std_{n}", rolling(F.stddev_pop, "close", n))
    tag = f"{n}_{_n(width)}"
    upper = s.make(f"boll_upper_{tag}", F.col(mid) + width * F.col(off), mid, off)
    lower = s.make(f"boll_lower_{tag}", F.col(mid) - width * F.col(off), mid, off)
    span = s.make(f"boll_width_{tag}", ratio(F.col(upper) - F.col(lower), mid), upper, lower)
    return mid, upper, lower, span, s.make(f"boll_pct_{tag}", ratio(close - F.col(lower), F.col(upper) - F.col(lower)), upper, lower)


def keltner(s: Sheet, n: int = 20, width: float = 2.0) -> tuple[str, str, str]:
    mid, reach, tag = ema(s, n), atr(s, n), f"{n}_{_n(width)}"
    upper = s.make(f"kelt_upper_{tag}", F.col(mid) + width * F.col(reach))
    return mid, upper, s.make(f"kelt_lower_{tag}", F.col(mid) - width * F.col(reach))


def donchian(s: Sheet, n: int = 20) -> tuple[str, str, str]:
    upper, lower = s.make(f"donch_upper_{n}", rolling(F.max, "high", n)), s.make(f"donch_lower_{n}", rolling(F.min, "low", n))
    return upper, lower, s.make(f"donch_mid_{n}", (F.col(upper) + F.col(lower)) / 2.0, upper, lower)


def fair_value_gap(s: Sheet, least: float = 0.0) -> tuple[str, ...]:
    """Gaps between a bar and the one two before it, at least `least` average ranges wide, and the latest gap's bounds."""
    high, low, _, _ = _bar()
    tag = _n(least)
    need = F.coalesce(least * F.col(atr(s, 14)), F.lit(0.0)) if least else F.lit(0.0)
    up, down = low - before("high", 2), before("low", 2) - high
    bull = s.make(f"gap_bull_{tag}", true((up > 0) & (up >= need)).cast("double"))
    bear = s.make(f"gap_bear_{tag}", true((down > 0) & (down >= need)).cast("double"))
    bounds = []
    for side, flag, top, bottom in (("bull", bull, low, "high_2"), ("bear", bear, "low_2", high)):
        for end, x in (("top", top), ("bot", bottom)):
            x = F.col(s.make(x, before(x[:-2], 2))) if isinstance(x, str) else x
            bounds.append(s.make(f"gap_{side}_{end}_{tag}", held(F.when(F.col(flag) == 1, x)), flag, "high_2", "low_2"))
    return bull, bear, *bounds


# volume


def obv(s: Sheet) -> str:
    _, _, close, volume = _bar()
    return s.make("obv", F.sum(F.signum(F.coalesce(close - F.col(s.make("close_1", before("close"))), F.lit(0.0))) * volume).over(so_far()), "close_1")


def vwap(s: Sheet) -> str:
    """Volume-weighted typical price so far in the New York day."""
    _, _, _, volume = _bar()
    day = s.make("session", F.to_date(F.from_utc_timestamp("ts", NEW_YORK)))
    span = Window.partitionBy(*SERIES, day).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return s.make("vwap", ratio(F.sum(_typical() * volume).over(span), F.sum(volume).over(span)), day)


def _flow(s: Sheet) -> str:
    """Volume weighed by where the close stands in the bar's range; NULL for a bar without range."""
    high, low, close, volume = _bar()
    return s.make("range_flow", ratio((close - low) - (high - close), high - low) * volume)


def cmf(s: Sheet, n: int = 20) -> str:
    flow = _flow(s)
    return s.make(f"cmf_{n}", ratio(rolling(F.sum, flow, n), rolling(F.sum, "volume", n)), flow)


def mfi(s: Sheet, n: int = 14) -> str:
    _, _, _, volume = _bar()
    tp = s.make("typical", _typical())
    step = s.make("typical_step", F.col(tp) - before(tp), tp)
    gain = s.make("flow_in", F.when(F.col(step) > 0, F.col(tp) * volume).otherwise(0.0), step)
    loss = s.make("flow_out", F.when(F.col(step) < 0, F.col(tp) * volume).otherwise(0.0), step)
    return s.make(f"mfi_{n}", 100.0 - 100.0 / (1.0 + ratio(rolling(F.sum, gain, n), rolling(F.sum, loss, n))), gain, loss)


def ad_line(s: Sheet) -> str:
    flow = _flow(s)
    return s.make("ad_line", F.when(F.col(flow).isNotNull(), F.sum(flow).over(so_far())), flow)


def force_index(s: Sheet, n: int = 13) -> str:
    return s.recur("force", n)[0]


def ease_of_movement(s: Sheet, n: int = 14) -> str:
    high, low, _, volume = _bar()
    mid = s.make("mid_price", (high + low) / 2.0)
    ease = s.make("ease", ratio(F.col(mid) - before(mid), ratio(volume / 1e8, high - low)), mid)
    return sma(s, n, ease)


def add(candles, *wanted, parts=None):
    """Candles with the columns of each (indicator, params): e.g. add(df, (sma, {"n": 10}), (macd, {})).

    parts: recurrences go through so many ranges of time, for series too long for a task.
    """
    s = Sheet()
    for indicator, params in wanted:
        indicator(s, **params)
    return s.apply(candles, parts)
