"""Signals: indicators as votes of -1, 0 or 1 per bar, their parameter grids and their instances."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.functions import indicators as ta
from barwright.functions.sheet import Sheet
from barwright.functions.windows import before, held, sign, true

CATEGORIES = ("trend", "momentum", "volatility", "volume")

#: Signal, category, sparse grid, dense grid (empty: the sparse one).
GRIDS = [
    ("ema_cross", "trend", {"fast": [10, 20, 50], "slow": [50, 100, 200]}, {"fast": [5, 10, 15, 20, 30, 50], "slow": [50, 100, 200, 350, 500, 1400]}),
    ("sma_cross", "trend", {"fast": [10, 20, 50], "slow": [50, 100, 200]}, {"fast": [5, 10, 15, 20, 30, 50], "slow": [50, 100, 200, 350, 500, 1400]}),
    ("wma_cross", "trend", {"fast": [10, 20, 50], "slow": [50, 100, 200]}, {"fast": [5, 10, 15, 20, 30, 50], "slow": [50, 100, 200, 350, 500, 1400]}),
    ("macd_cross", "trend", {"fast": [12, 8], "slow": [26, 21], "signal": [9, 5]}, {"fast": [6, 8, 12], "slow": [21, 26, 34], "signal": [5, 9]}),
    ("price_vs_sma", "trend", {"period": [50, 100, 200]}, {"period": [10, 20, 50, 100, 200, 350, 500, 1400]}),
    ("adx_di", "trend", {"period": [14]}, {"period": [7, 10, 14, 20]}),
    ("supertrend_dir", "trend", {"period": [10], "multiplier": [2.0, 3.0]}, {"period": [7, 10, 14], "multiplier": [2.0, 3.0, 4.0]}),
    ("aroon_dir", "trend", {"period": [14, 25]}, {"period": [14, 25, 50]}),
    ("psar_dir", "trend", {"step": [0.02], "max_step": [0.2]}, {"step": [0.01, 0.02, 0.04], "max_step": [0.2]}),
    ("ichimoku_dir", "trend", {"conversion": [9], "base": [26], "span_b": [52]}, {"conversion": [9, 12, 24], "base": [26, 36, 72], "span_b": [52, 72, 144]}),
    ("rsi_meanrev", "momentum", {"period": [14], "lower": [25, 30], "upper": [60, 70]}, {"period": [2, 4, 7, 14, 21], "lower": [10, 20, 25, 30], "upper": [60, 70, 75, 80]}),
    ("rsi_trend", "momentum", {"period": [14], "level": [50]}, {"period": [7, 14, 21], "level": [45, 50, 55]}),
    ("stoch_meanrev", "momentum", {"k": [14], "d": [3], "smooth": [3], "lower": [20], "upper": [80]}, {"k": [2, 4, 7, 9, 14], "d": [3], "smooth": [3], "lower": [15, 20], "upper": [80, 85]}),
    ("cci_sign", "momentum", {"period": [20]}, {"period": [10, 14, 20, 40]}),
    ("williams_meanrev", "momentum", {"period": [14], "lower": [-80], "upper": [-20]}, {"period": [10, 14, 21], "lower": [-90, -80], "upper": [-20, -10]}),
    ("roc_sign", "momentum", {"period": [12]}, {"period": [6, 9, 12, 20]}),
    ("stochrsi_meanrev", "momentum", {"period": [14], "k": [3], "d": [3], "lower": [20], "upper": [80]}, {"period": [14, 21], "k": [3], "d": [3], "lower": [15, 20], "upper": [80, 85]}),
    ("tsi_sign", "momentum", {"long": [25], "short": [13]}, {"long": [25, 30, 40], "short": [13, 15, 20]}),
    ("momentum_sign", "momentum", {"period": [10]}, {"period": [5, 10, 20, 30]}),
    ("bollinger_meanrev", "volatility", {"period": [20], "num_std": [2.0, 2.5]}, {"period": [10, 14, 20, 30], "num_std": [2.0, 2.5, 3.0]}),
    ("bollinger_breakout", "volatility", {"period": [20], "num_std": [2.0]}, {"period": [10, 20, 30, 50], "num_std": [1.5, 2.0, 2.5, 3.0]}),
    ("keltner_breakout", "volatility", {"period": [20], "multiplier": [2.0]}, {"period": [10, 20], "multiplier": [1.5, 2.0, 2.5]}),
    ("donchian_breakout", "volatility", {"period": [20, 55]}, {"period": [10, 20, 40, 55]}),
    ("fvg_dir", "volatility", {"min_gap_atr": [0.0, 0.5]}, {"min_gap_atr": [0.0, 0.25, 0.5, 1.0]}),
    ("fvg_meanrev", "volatility", {"min_gap_atr": [0.0, 0.5]}, {"min_gap_atr": [0.0, 0.25, 0.5, 1.0]}),
    ("obv_trend", "volume", {"period": [20]}, {"period": [20, 50, 100]}),
    ("cmf_sign", "volume", {"period": [20]}, {"period": [20, 50, 100]}),
    ("mfi_meanrev", "volume", {"period": [14], "lower": [20], "upper": [80]}, {"period": [10, 14, 21], "lower": [15, 20], "upper": [80, 85]}),
    ("vwap_trend", "volume", {}, {}),
    ("ad_trend", "volume", {"period": [20]}, {"period": [20, 50, 100]}),
    ("force_index_sign", "volume", {"period": [13]}, {"period": [2, 13, 21]}),
    ("eom_sign", "volume", {"period": [14]}, {"period": [9, 14, 25]}),
]

CATEGORY = {name: category for name, category, *_ in GRIDS}


def held_long(enter: Column, leave: Column) -> Column:
    """1 from an entry to the next exit, else 0; a bar with both is an entry."""
    return F.coalesce(held(F.when(true(enter), 1.0).when(true(leave), 0.0)), F.lit(0.0))


def held_regime(up: Column, down: Column) -> Column:
    """1 or -1 since the last event, 0 before the first; a bar with both is down."""
    return F.coalesce(held(F.when(true(down), -1.0).when(true(up), 1.0)), F.lit(0.0))


_c = F.col


def _cross(average):
    def vote(s: Sheet, fast, slow):
        a, b = average(s, fast), average(s, slow)
        return sign(_c(a) - _c(b)), a, b

    return vote


def _against(level: float, indicator):
    """The side of a level on which an indicator stands."""

    def vote(s: Sheet, **params):
        x = indicator(s, *params.values())
        return sign(_c(x) - level), x

    return vote


def _difference(first: int, second: int, indicator):
    def vote(s: Sheet, **params):
        parts = indicator(s, *params.values())
        return sign(_c(parts[first]) - _c(parts[second])), parts[first], parts[second]

    return vote


def _reverting(indicator):
    """Long from below `lower` until above `upper`."""

    def vote(s: Sheet, lower, upper, **params):
        x = indicator(s, *params.values())
        x = x[0] if isinstance(x, tuple) else x
        return held_long(_c(x) < lower, _c(x) > upper), x

    return vote


def _beyond(bands, inclusive: bool = False):
    """The side on which the close last left the bands of the bar before."""

    def vote(s: Sheet, **params):
        upper, lower = bands(s, **params)
        top, bottom = (s.make(f"{x}_before", before(x), x) for x in (upper, lower))
        up, down = (_c("close") >= _c(top), _c("close") <= _c(bottom)) if inclusive else (_c("close") > _c(top), _c("close") < _c(bottom))
        return held_regime(up, down), top, bottom

    return vote


def _price_vs_sma(s: Sheet, period):
    x = ta.sma(s, period)
    return sign(_c("close") - _c(x)), x


def _ichimoku(s: Sheet, conversion, base, span_b):
    tenkan, kijun, a, b = ta.ichimoku(s, conversion, base, span_b)
    top, bottom = F.greatest(a, b), F.least(a, b)
    up, down = (_c("close") > top) & (_c(tenkan) > _c(kijun)), (_c("close") < bottom) & (_c(tenkan) < _c(kijun))
    return F.when(true(up), 1.0).when(true(down), -1.0).otherwise(0.0), tenkan, kijun, a, b


def _bollinger_meanrev(s: Sheet, period, num_std):
    mid, _, lower, *_ = ta.bollinger(s, period, num_std)
    return held_long(_c("close") < _c(lower), _c("close") > _c(mid)), mid, lower


def _fvg_dir(s: Sheet, min_gap_atr):
    bull, bear, *_ = ta.fair_value_gap(s, min_gap_atr)
    return held_regime(_c(bull) > 0, _c(bear) > 0), bull, bear


def _fvg_meanrev(s: Sheet, min_gap_atr):
    _, _, top, bottom, *_ = ta.fair_value_gap(s, min_gap_atr)
    return held_long((_c("close") >= _c(bottom)) & (_c("close") <= _c(top)), _c("close") > _c(top)), top, bottom


def _over_mean(line):
    def vote(s: Sheet, period):
        x = line(s)
        mean = ta.sma(s, period, x)
        return sign(_c(x) - _c(mean)), x, mean

    return vote


def _vwap(s: Sheet):
    x = ta.vwap(s)
    return sign(_c("close") - _c(x)), x


def _psar(s: Sheet, step, max_step):
    x = ta.parabolic_sar(s, step, max_step)
    return sign(_c("close") - _c(x)), x


def _supertrend(s: Sheet, period, multiplier):
    way = ta.supertrend(s, period, multiplier)[1]
    return F.coalesce(_c(way), F.lit(0.0)), way


def _rsi_trend(s: Sheet, period, level):
    x = ta.rsi(s, period)
    return sign(_c(x) - level), x


#: Each returns the vote and the sheet's columns that it reads.
VOTES: dict[str, Callable] = {
    "ema_cross": _cross(ta.ema),
    "sma_cross": _cross(ta.sma),
    "wma_cross": _cross(ta.wma),
    "macd_cross": lambda s, fast, slow, signal: _difference(0, 1, ta.macd)(s, fast=fast, slow=slow, signal=signal),
    "price_vs_sma": _price_vs_sma,
    "adx_di": _difference(1, 2, ta.adx),
    "supertrend_dir": _supertrend,
    "aroon_dir": _difference(0, 1, ta.aroon),
    "psar_dir": _psar,
    "ichimoku_dir": _ichimoku,
    "rsi_meanrev": _reverting(ta.rsi),
    "rsi_trend": _rsi_trend,
    "stoch_meanrev": lambda s, k, d, smooth, lower, upper: _reverting(ta.stochastic)(s, lower, upper, k=k, d=d, smooth=smooth),
    "cci_sign": _against(0.0, ta.cci),
    "williams_meanrev": _reverting(ta.williams_r),
    "roc_sign": _against(0.0, ta.roc),
    "stochrsi_meanrev": lambda s, period, k, d, lower, upper: _reverting(ta.stoch_rsi)(s, lower, upper, period=period, k=k, d=d),
    "tsi_sign": lambda s, long, short: _against(0.0, ta.tsi)(s, long=long, short=short),
    "momentum_sign": _against(0.0, ta.momentum),
    "bollinger_meanrev": _bollinger_meanrev,
    "bollinger_breakout": _beyond(lambda s, period, num_std: ta.bollinger(s, period, num_std)[1:3]),
    "keltner_breakout": _beyond(lambda s, period, multiplier: ta.keltner(s, period, multiplier)[1:3]),
    "donchian_breakout": _beyond(lambda s, period: ta.donchian(s, period)[:2], inclusive=True),
    "fvg_dir": _fvg_dir,
    "fvg_meanrev": _fvg_meanrev,
    "obv_trend": _over_mean(ta.obv),
    "cmf_sign": _against(0.0, ta.cmf),
    "mfi_meanrev": _reverting(ta.mfi),
    "vwap_trend": _vwap,
    "ad_trend": _over_mean(ta.ad_line),
    "force_index_sign": _against(0.0, ta.force_index),
    "eom_sign": _against(0.0, ta.ease_of_movement),
}


@dataclass(frozen=True)
class Instance:
    """A signal with its parameters, sorted by name."""

    factory: str
    params: tuple[tuple[str, float], ...]

    @property
    def key(self) -> str:
        return f"{self.factory}({','.join(f'{k}={v}' for k, v in self.params)})"

    @property
    def category(self) -> str:
        return CATEGORY[self.factory]


def instance(factory: str, **params) -> Instance:
    return Instance(factory, tuple(sorted(params.items())))


def enumerate_instances(categories: Iterable[str] = CATEGORIES, dense: bool = False) -> list[Instance]:
    """All instances of the signals of some categories, in the order of GRIDS; a fast period must be below the slow one."""
    wanted, out = set(categories), []
    for name, category, sparse, full in GRIDS:
        if category in wanted:
            grid = full if dense and full else sparse
            for values in product(*grid.values()):
                params = dict(zip(grid, values, strict=True))
                if not ("fast" in params and "slow" in params and params["fast"] >= params["slow"]):
                    out.append(instance(name, **params))
    return out


def with_votes(candles: DataFrame, instances: list[Instance], prefix: str = "v", adx: int | None = None, parts: int | None = None) -> DataFrame:
    """Candles with a column v0, v1, ... of votes for each instance, and adx over so many bars if asked for.

    Indicators that several instances share are computed once; recurrences in `parts` of time, if given.
    """
    s, votes = Sheet(), []
    strength = [F.col(ta.adx(s, adx)[0]).alias("adx")] if adx else []
    for i in instances:
        column, *needs = VOTES[i.factory](s, **dict(i.params))
        votes.append(s.make(f"_vote {i.key}", column, *needs))
    return s.apply(candles, parts).select(*candles.columns, *strength, *[F.col(f"`{v}`").alias(f"{prefix}{k}") for k, v in enumerate(votes)])


def votes(candles: DataFrame, instances: list[Instance]) -> DataFrame:
    """(symbol, interval, ts, instance_key, vote) for each bar and instance."""
    wide = with_votes(candles, instances)
    pairs = F.explode(F.array(*[F.struct(F.lit(i.key).alias("instance_key"), F.col(f"v{k}").alias("vote")) for k, i in enumerate(instances)]))
    return wide.select("symbol", "interval", "ts", pairs.alias("x")).select("symbol", "interval", "ts", "x.instance_key", "x.vote")
