"""SQL twins of the candle queries, for DuckDB: the same definitions written down a second time, as common table expressions."""

from __future__ import annotations

SERIES = "PARTITION BY symbol ORDER BY ts"


def hourly() -> str:
    return """bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(1000 + value, ts) AS open, max(1000 + value) AS high, min(1000 + value) AS low,
         arg_max(1000 + value, ts) AS close, CAST(sum(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2
)"""


BY_TYPE = hourly()


def w(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


SO_FAR = f"({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {f}({x}) OVER {w(n)} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SERIES})"


def ratio(a: str, b: str) -> str:
    return f"(({a}) / nullif(CAST({b} AS DOUBLE), 0))"


def hold(expr: str) -> str:
    return f"last_value({expr} IGNORE NULLS) OVER {SO_FAR}"


def held_long(enter: str, leave: str) -> str:
    return f"coalesce({hold(f'CASE WHEN {enter} THEN 1.0 WHEN {leave} THEN 0.0 END')}, 0.0)"


def held_regime(up: str, down: str) -> str:
    return f"coalesce({hold(f'CASE WHEN {down} THEN -1.0 WHEN {up} THEN 1.0 END')}, 0.0)"


def sign(x: str) -> str:
    return f"coalesce(CAST(sign({x}) AS DOUBLE), 0.0)"


class Twin:
    """A chain of common table expressions, each adding columns to the one before."""

    def __init__(self, bars: str = BY_TYPE):
        self.ctes = [bars, f"t0 AS (SELECT *, row_number() OVER ({SERIES}) AS rn FROM bars)"]
        self.n = 0

    @property
    def at(self) -> str:
        return f"t{self.n}"

    def add(self, **columns: str) -> Twin:
        made = ", ".join(f"{e} AS {c}" for c, e in columns.items())
        self.ctes.append(f"t{self.n + 1} AS (SELECT *, {made} FROM {self.at})")
        self.n += 1
        return self

    def fold(self, names: str, first: str, after: str, final: str) -> Twin:
        """A recurrence over the rows of each symbol: columns `names` in brackets, first row, next row from r (before) and s (now), and what to add."""
        k = self.n + 1
        self.ctes.append(f"r{k}{names} AS (SELECT symbol, rn, {first} FROM {self.at} s WHERE rn = 1 UNION ALL SELECT s.symbol, s.rn, {after} FROM r{k} r JOIN {self.at} s ON s.symbol = r.symbol AND s.rn = r.rn + 1)")
        self.ctes.append(f"t{k} AS (SELECT s.*, {final} FROM {self.at} s JOIN r{k} r ON s.symbol = r.symbol AND s.rn = r.rn)")
        self.n = k
        return self

    def ewm(self, name: str, x: str, alpha: str, least: int) -> Twin:
        d = f"(1.0 - {alpha})"
        first = f"CAST(s.{x} AS DOUBLE), CAST(1 AS DOUBLE), CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END"
        after = f"""CASE WHEN r.y IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN r.y ELSE (r.w * {d} * r.y + {alpha} * s.{x}) / (r.w * {d} + {alpha}) END,
          CASE WHEN r.y IS NULL OR s.{x} IS NOT NULL THEN 1.0 ELSE r.w * {d} END, r.c + CASE WHEN s.{x} IS NULL THEN 0 ELSE 1 END"""
        return self.fold("(symbol, rn, y, w, c)", first, after, f"CASE WHEN r.c >= {least} THEN r.y END AS {name}")

    def with_(self, name: str, body: str) -> Twin:
        self.ctes.append(f"{name} AS ({body})")
        return self

    def select(self, *columns: str, digits: int = 6) -> str:
        made = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
        return self.sql(f"SELECT symbol, ts, {made} FROM {self.at}")

    def sql(self, final: str) -> str:
        return f"WITH RECURSIVE {', '.join(self.ctes)} {final}"


def span(n: float) -> str:
    return f"CAST({2.0 / (n + 1.0)!r} AS DOUBLE)"


def wilder(n: float) -> str:
    return f"CAST({1.0 / n!r} AS DOUBLE)"


# indicators; each adds columns to a twin and returns it


def sma(t: Twin, n: int, x: str = "close", name: str = "sma") -> Twin:
    return t.add(**{name: roll("avg", x, n)})


def wma(t: Twin, n: int) -> Twin:
    terms = " + ".join(f"{n - k} * {lag('close', k) if k else 'close'}" for k in range(n))
    return t.add(wma=f"({terms}) / {n * (n + 1) / 2!r}")


def true_range(t: Twin) -> Twin:
    return t.add(true_range=f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))")


def macd(t: Twin) -> Twin:
    t.ewm("fast", "close", span(12), 12).ewm("slow", "close", span(26), 26).add(line="fast - slow")
    return t.ewm("signal", "line", span(9), 9).add(hist="line - signal")


def atr(t: Twin, n: int = 14, name: str = "atr") -> Twin:
    return true_range(t).ewm(name, "true_range", wilder(n), n)


def adx(t: Twin, n: int = 14) -> Twin:
    atr(t, n).add(up=f"high - {lag('high')}", down=f"{lag('low')} - low")
    t.add(pdm="CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END", mdm="CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END")
    t.ewm("ps", "pdm", wilder(n), n).ewm("ms", "mdm", wilder(n), n).add(plus=f"100 * {ratio('ps', 'atr')}", minus=f"100 * {ratio('ms', 'atr')}")
    return t.add(dx=f"100 * {ratio('abs(plus - minus)', 'plus + minus')}").ewm("adx", "dx", wilder(n), n)


def aroon(t: Twin, n: int) -> Twin:
    full = f"count(high) OVER {w(n + 1)} = {n + 1}"
    # The oldest extreme: the smallest row among equal ones.
    up = f"max({{'h': high, 'r': -rn}}) OVER {w(n + 1)}"
    down = f"min({{'l': low, 'r': rn}}) OVER {w(n + 1)}"
    t.add(up=f"CASE WHEN {full} THEN 100.0 * (-(({up}).r) - (rn - {n})) / {n} END", down=f"CASE WHEN {full} THEN 100.0 * ((({down}).r) - (rn - {n})) / {n} END")
    return t.add(osc="up - down")


def psar(t: Twin, step: float = 0.02, most: float = 0.2) -> Twin:
    t.add(l1=lag("low"), h1=lag("high"), l2=f"coalesce({lag('low', 2)}, {lag('low')})", h2=f"coalesce({lag('high', 2)}, {lag('high')})")
    raw = "(r.stop + r.af * (r.ep - r.stop))"
    stop = f"CASE WHEN r.bull THEN least({raw}, s.l1, s.l2) ELSE greatest({raw}, s.h1, s.h2) END"
    flip = f"CASE WHEN r.bull THEN s.low < {stop} ELSE s.high > {stop} END"
    further = "CASE WHEN r.bull THEN s.high > r.ep ELSE s.low < r.ep END"
    bar = "CASE WHEN r.bull THEN s.high ELSE s.low END"
    after = f"""CASE WHEN {flip} THEN NOT r.bull ELSE r.bull END,
      CASE WHEN {flip} THEN CAST({step} AS DOUBLE) WHEN {further} THEN least(r.af + {step}, CAST({most} AS DOUBLE)) ELSE r.af END,
      CASE WHEN {flip} THEN CASE WHEN r.bull THEN s.low ELSE s.high END WHEN {further} THEN {bar} ELSE r.ep END,
      CASE WHEN {flip} THEN r.ep ELSE {stop} END"""
    return t.fold("(symbol, rn, bull, af, ep, stop)", f"true, CAST({step} AS DOUBLE), s.high, s.low", after, "r.stop AS sar")


def ichimoku(t: Twin, a: int = 9, b: int = 26, c: int = 52) -> Twin:
    mid = lambda n: f"({roll('max', 'high', n)} + {roll('min', 'low', n)}) / 2.0"
    t.add(tenkan=mid(a), kijun=mid(b), wide=mid(c)).add(lead="(tenkan + kijun) / 2.0")
    return t.add(cloud_a=lag("lead", b), cloud_b=lag("wide", b))


def supertrend(t: Twin, n: int = 10, width: float = 3.0) -> Twin:
    atr(t, n).add(up=f"(high + low) / 2.0 + {width} * atr", down=f"(high + low) / 2.0 - {width} * atr", c1=lag("close"))
    started = "r.fu IS NOT NULL"
    way = f"CASE WHEN {started} AND s.close > r.fu THEN 1.0 WHEN {started} AND s.close < r.fl THEN -1.0 ELSE r.way END"
    fu = f"CASE WHEN {started} AND NOT (s.up < r.fu OR s.c1 > r.fu) THEN r.fu ELSE s.up END"
    fl = f"CASE WHEN {started} AND NOT (s.down > r.fl OR s.c1 < r.fl) THEN r.fl ELSE s.down END"
    line = f"CASE WHEN {started} THEN CASE WHEN {way} > 0 THEN {fl} ELSE {fu} END END"
    return t.fold("(symbol, rn, fu, fl, way, line)", "s.up, s.down, CAST(1 AS DOUBLE), CAST(NULL AS DOUBLE)", f"{fu}, {fl}, {way}, {line}", "r.line AS line, r.way AS way")


def rsi(t: Twin, n: int = 14) -> Twin:
    t.add(d=f"close - {lag('close')}").add(up="CASE WHEN d IS NOT NULL THEN greatest(d, 0) END", down="CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END")
    return t.ewm("gain", "up", wilder(n), n).ewm("loss", "down", wilder(n), n).add(rsi=f"100 - 100 / (1 + {ratio('gain', 'loss')})")


def place(t: Twin, name: str, x: str, bottom: str, top: str, n: int) -> Twin:
    least = roll("min", bottom, n)
    return t.add(**{name: f"100 * {ratio(f'{x} - ({least})', f'({roll('max', top, n)}) - ({least})')}"})


def stochastic(t: Twin, k: int = 14, d: int = 3, smooth: int = 3) -> Twin:
    return sma(sma(place(t, "fast", "close", "low", "high", k), smooth, "fast", "k"), d, "k", "d")


def stoch_rsi(t: Twin, n: int = 14, k: int = 3, d: int = 3) -> Twin:
    t = place(rsi(t, n), "fast", "rsi", "rsi", "rsi", n)
    return t.add(k=roll("avg", "fast", k)).add(slow=roll("avg", "k", d))


def cci(t: Twin, n: int = 20) -> Twin:
    t.add(tp="(high + low + close) / 3.0").add(off=f"tp - ({roll('avg', 'tp', n)})").add(size="abs(off)")
    return t.add(cci=ratio("off", f"0.015 * ({roll('avg', 'size', n)})"))


def williams(t: Twin, n: int = 14) -> Twin:
    most = roll("max", "high", n)
    return t.add(williams=f"-100 * {ratio(f'({most}) - close', f'({most}) - ({roll('min', 'low', n)})')}")


def tsi(t: Twin, slow: int = 25, fast: int = 13) -> Twin:
    t.add(d=f"close - {lag('close')}").add(size="abs(d)")
    t.ewm("d1", "d", span(slow), 0).ewm("d2", "d1", span(fast), 0).ewm("s1", "size", span(slow), 0).ewm("s2", "s1", span(fast), 0)
    return t.add(tsi=f"100 * {ratio('d2', 's2')}")


def bollinger(t: Twin, n: int = 20, k: float = 2.0) -> Twin:
    t.add(mid=roll("avg", "close", n), off=roll("stddev_pop", "close", n)).add(upper=f"mid + {k} * off", lower=f"mid - {k} * off")
    return t.add(width=ratio("upper - lower", "mid"), pct_b=ratio("close - lower", "upper - lower"))


def keltner(t: Twin, n: int = 20, k: float = 2.0) -> Twin:
    return atr(t, n).ewm("mid", "close", span(n), n).add(upper=f"mid + {k} * atr", lower=f"mid - {k} * atr")


def donchian(t: Twin, n: int = 20) -> Twin:
    return t.add(upper=roll("max", "high", n), lower=roll("min", "low", n)).add(mid="(upper + lower) / 2.0")


def gaps(t: Twin, least: float = 0.0) -> Twin:
    if least:
        atr(t, 14)
    need = f"coalesce({least} * atr, 0)" if least else "0"
    t.add(h2=lag("high", 2), l2=lag("low", 2))
    t.add(bull=f"CASE WHEN low - h2 > 0 AND low - h2 >= {need} THEN 1.0 ELSE 0.0 END", bear=f"CASE WHEN l2 - high > 0 AND l2 - high >= {need} THEN 1.0 ELSE 0.0 END")
    bound = lambda side, x: hold(f"CASE WHEN {side} = 1 THEN {x} END")
    return t.add(bull_top=bound("bull", "low"), bull_bot=bound("bull", "h2"), bear_top=bound("bear", "l2"), bear_bot=bound("bear", "high"))


def obv(t: Twin) -> Twin:
    return t.add(d=f"coalesce(close - {lag('close')}, 0)").add(obv=f"sum(sign(d) * volume) OVER {SO_FAR}")


def vwap(t: Twin) -> Twin:
    t.add(day="CAST(timezone('America/New_York', timezone('UTC', ts)) AS DATE)")
    s = "(PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return t.add(vwap=ratio(f"sum((high + low + close) / 3.0 * volume) OVER {s}", f"sum(volume) OVER {s}"))


def flow(t: Twin) -> Twin:
    return t.add(flow=f"{ratio('(close - low) - (high - close)', 'high - low')} * volume")


def cmf(t: Twin, n: int = 20) -> Twin:
    return flow(t).add(cmf=ratio(roll("sum", "flow", n), roll("sum", "volume", n)))


def mfi(t: Twin, n: int = 14) -> Twin:
    t.add(tp="(high + low + close) / 3.0").add(d=f"tp - {lag('tp')}")
    t.add(up="CASE WHEN d > 0 THEN tp * volume ELSE 0.0 END", down="CASE WHEN d < 0 THEN tp * volume ELSE 0.0 END")
    return t.add(mfi=f"100 - 100 / (1 + {ratio(roll('sum', 'up', n), roll('sum', 'down', n))})")


def ad_line(t: Twin) -> Twin:
    return flow(t).add(ad_line=f"CASE WHEN flow IS NOT NULL THEN sum(flow) OVER {SO_FAR} END")


def force(t: Twin, n: int = 13) -> Twin:
    return t.add(f=f"(close - {lag('close')}) * volume").ewm("force_index", "f", span(n), n)


def ease(t: Twin, n: int = 14) -> Twin:
    t.add(mid="(high + low) / 2.0").add(e=ratio(f"mid - {lag('mid')}", ratio("volume / 1e8", "high - low")))
    return t.add(ease_of_movement=roll("avg", "e", n))


# votes: the twin after its indicator, and the vote


def votes() -> dict[str, tuple[Twin, str]]:
    def cross(make) -> tuple[Twin, str]:
        return make, sign("fast - slow")

    t = Twin
    before = lambda x: x.add(top=lag("upper"), bottom=lag("lower"))
    beyond = held_regime("close > top", "close < bottom")
    return {
        "ema_cross": cross(t().ewm("fast", "close", span(10), 10).ewm("slow", "close", span(50), 50)),
        "sma_cross": cross(sma(sma(t(), 10, name="fast"), 50, name="slow")),
        "wma_cross": (wma(wma(t(), 10).add(fast="wma"), 50).add(slow="wma_1"), sign("fast - slow")),
        "macd_cross": (macd(t()), sign("line - signal")),
        "price_vs_sma": (sma(t(), 50), sign("close - sma")),
        "adx_di": (adx(t()), sign("plus - minus")),
        "supertrend_dir": (supertrend(t(), 10, 2.0), "way"),
        "aroon_dir": (aroon(t(), 14), sign("up - down")),
        "psar_dir": (psar(t()), sign("close - sar")),
        "ichimoku_dir": (
            ichimoku(t()),
            "CASE WHEN close > greatest(cloud_a, cloud_b) AND tenkan > kijun THEN 1.0 WHEN close < least(cloud_a, cloud_b) AND tenkan < kijun THEN -1.0 ELSE 0.0 END",
        ),
        "rsi_meanrev": (rsi(t()), held_long("rsi < 25", "rsi > 60")),
        "rsi_trend": (rsi(t()), sign("rsi - 50")),
        "stoch_meanrev": (stochastic(t()), held_long("k < 20", "k > 80")),
        "cci_sign": (cci(t()), sign("cci")),
        "williams_meanrev": (williams(t()), held_long("williams < -80", "williams > -20")),
        "roc_sign": (t().add(roc=f"100 * ({ratio('close', lag('close', 12))} - 1)"), sign("roc")),
        "stochrsi_meanrev": (stoch_rsi(t()), held_long("k < 20", "k > 80")),
        "tsi_sign": (tsi(t()), sign("tsi")),
        "momentum_sign": (t().add(m=f"close - {lag('close', 10)}"), sign("m")),
        "bollinger_meanrev": (bollinger(t()), held_long("close < lower", "close > mid")),
        "bollinger_breakout": (before(bollinger(t())), beyond),
        "keltner_breakout": (before(keltner(t())), beyond),
        "donchian_breakout": (before(donchian(t())), held_regime("close >= top", "close <= bottom")),
        "fvg_dir": (gaps(t()), held_regime("bull > 0", "bear > 0")),
        "fvg_meanrev": (gaps(t()), held_long("close >= bull_bot AND close <= bull_top", "close > bull_top")),
        "obv_trend": (obv(t()).add(mean=roll("avg", "obv", 20)), sign("obv - mean")),
        "cmf_sign": (cmf(t()), sign("cmf")),
        "mfi_meanrev": (mfi(t()), held_long("mfi < 20", "mfi > 80")),
        "vwap_trend": (vwap(t()), sign("close - vwap")),
        "ad_trend": (ad_line(t()).add(mean=roll("avg", "ad_line", 20)), sign("ad_line - mean")),
        "force_index_sign": (force(t()), sign("force_index")),
        "eom_sign": (ease(t()), sign("ease_of_movement")),
    }


# backtests

ZERO_IF = "CASE WHEN moved = 0 THEN 0 ELSE {} END"


def metrics(t: Twin, source: str, by: str, cost_bps: float = 5.0, digits: int = 6, finish: bool = True) -> str | Twin:
    """From `source`(symbol, …by, ts, close, position, ppy) to the fifteen metrics."""
    p = f"PARTITION BY {by} ORDER BY ts"
    t.with_("m1", f"SELECT *, coalesce({ratio('close', f'lag(close) OVER ({p})')} - 1, 0) AS asset, lag(position, 1, 0.0) OVER ({p}) AS held FROM {source}")
    t.with_("m2", f"SELECT *, held - lag(held, 1, 0.0) OVER ({p}) AS step FROM m1")
    t.with_("m3", f"SELECT *, held * asset - abs(step) * CAST({cost_bps / 1e4!r} AS DOUBLE) AS r, sum(CASE WHEN step <> 0 THEN 1 ELSE 0 END) OVER ({p} ROWS UNBOUNDED PRECEDING) AS seg FROM m2")
    t.with_("m4", f"SELECT *, exp(sum(ln(1 + r)) OVER ({p} ROWS UNBOUNDED PRECEDING)) AS equity FROM m3")
    t.with_("m5", f"SELECT *, equity / max(equity) OVER ({p} ROWS UNBOUNDED PRECEDING) - 1 AS under FROM m4")
    t.with_("tr", f"SELECT {by}, sum(CASE WHEN lr > 1e-12 THEN 1 ELSE 0 END) AS wins, count(*) AS trades FROM (SELECT {by}, seg, sum(ln(1 + greatest(r, -0.999999))) AS lr FROM m5 WHERE held <> 0 GROUP BY {by}, seg) GROUP BY {by}")
    t.with_("ag", f"""SELECT {by}, count(*) AS n_bars, sum(abs(r)) AS moved, arg_max(equity, ts) AS final, any_value(ppy) AS ppy, avg(r) AS mean, stddev_pop(r) AS off,
      stddev_pop(r) FILTER (r < 0) AS off_down, min(under) AS mdd, sum(CASE WHEN step <> 0 THEN 1 ELSE 0 END) AS changes,
      avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (held <> 0) AS hit, sum(r) FILTER (held <> 0 AND r > 0) AS gain, -sum(r) FILTER (held <> 0 AND r < 0) AS loss,
      avg(CASE WHEN held <> 0 THEN 1.0 ELSE 0.0 END) AS exposure FROM m5 GROUP BY {by}""")
    t.with_("jo", f"SELECT ag.*, coalesce(tr.wins, 0) AS wins, coalesce(tr.trades, 0) AS trades, CASE WHEN final > 0 THEN exp(ln(final) * ppy / n_bars) - 1 END AS cagr FROM ag LEFT JOIN tr USING ({by})")
    zero = lambda x: f"coalesce({x}, 0)"
    values = {
        "total_return": "final - 1",
        "cagr": zero("CASE WHEN isfinite(cagr) THEN cagr END"),
        "ann_vol": "off * sqrt(ppy)",
        "sharpe": zero(f"{ratio('mean', 'off')} * sqrt(ppy)"),
        "sortino": zero(f"{ratio('mean', 'off_down')} * sqrt(ppy)"),
        "max_drawdown": "mdd",
        "calmar": zero(ratio("cagr", "abs(mdd)")),
        "win_rate": zero("hit"),
        "trade_win_rate": zero(ratio("wins", "trades")),
        "profit_factor": zero(ratio("gain", "loss")),
        "exposure": "exposure",
    }
    real = [f"round(CAST({ZERO_IF.format(x)} AS DOUBLE), {digits}) + 0.0 AS {k}" for k, x in values.items()]
    whole = [f"CAST({ZERO_IF.format(x)} AS BIGINT) AS {k}" for k, x in (("trade_wins", "wins"), ("trade_count", "trades"), ("num_trades", "changes"))]
    out = f"SELECT {by}, {', '.join(real + whole)}, n_bars FROM jo"
    return t.sql(out) if finish else t.with_("me", out)


def with_ppy(t: Twin, position: str) -> Twin:
    gap = f"epoch_us(ts) - lag(epoch_us(ts)) OVER ({SERIES})"
    t.with_("gp", f"SELECT symbol, ts, {gap} AS gap FROM {t.at}")
    t.with_("pp", "SELECT symbol, CASE WHEN count(*) >= 3 AND median(gap) > 0 THEN 365.25 * 86400 / (median(gap) / 1e6) ELSE 252.0 END AS ppy FROM gp GROUP BY symbol")
    return t.with_("po", f"SELECT b.symbol, b.ts, b.close, {position} AS position, pp.ppy FROM {t.at} b JOIN pp USING (symbol)")


def with_halves(t: Twin) -> Twin:
    row, n = "row_number() OVER (PARTITION BY symbol ORDER BY ts)", "count(*) OVER (PARTITION BY symbol)"
    return t.with_("ha", f"SELECT *, CASE WHEN {row} <= floor({n} * CAST(0.7 AS DOUBLE)) THEN 'is' ELSE 'oos' END AS half FROM po")


# search, reports and selection over a small space of signals that are windows alone


def windowed(instances: list) -> Twin:
    """Base table b of all bars with their votes v0, v1, ... of instances, half and bars a year."""
    t, votes = Twin(), {}
    for k, i in enumerate(instances):
        p = dict(i.params)
        if i.factory == "price_vs_sma":
            sma(t, p["period"], name=f"s{k}")
            votes[f"v{k}"] = sign(f"close - s{k}")
        elif i.factory == "roc_sign":
            votes[f"v{k}"] = sign(f"100 * ({ratio('close', lag('close', p['period']))} - 1)")
        elif i.factory == "momentum_sign":
            votes[f"v{k}"] = sign(f"close - {lag('close', p['period'])}")
        elif i.factory == "donchian_breakout":
            t.add(**{f"hi{k}": roll("max", "high", p["period"]), f"lo{k}": roll("min", "low", p["period"])})
            t.add(**{f"top{k}": lag(f"hi{k}"), f"bot{k}": lag(f"lo{k}")})
            votes[f"v{k}"] = held_regime(f"close >= top{k}", f"close <= bot{k}")
        elif i.factory == "bollinger_meanrev":
            t.add(**{f"mid{k}": roll("avg", "close", p["period"]), f"off{k}": roll("stddev_pop", "close", p["period"])})
            votes[f"v{k}"] = held_long(f"close < mid{k} - {p['num_std']} * off{k}", f"close > mid{k}")
        elif i.factory == "obv_trend":
            obv(t).add(**{f"mean{k}": roll("avg", "obv", p["period"])})
            votes[f"v{k}"] = sign(f"obv - mean{k}")
        elif i.factory == "vwap_trend":
            vwap(t)
            votes[f"v{k}"] = sign("close - vwap")
        else:
            raise ValueError(i.factory)
    t.add(**votes)
    with_halves(with_ppy(t, "0.0"))
    columns = ", ".join(votes)
    return t.with_("b", f"SELECT h.symbol, h.ts, h.close, h.half, h.ppy, {columns} FROM ha h JOIN {t.at} v ON h.symbol = v.symbol AND h.ts = v.ts")


def searched(instances: list, categories: tuple[str, ...], cost_bps: float = 5.0) -> Twin:
    """re: the results of all combinations of up to three instances of different categories, both modes and rules; un: without clones."""
    import json

    t = windowed(instances)
    rows = ", ".join(f"({k}, {categories.index(i.category)}, '{i.category}', '{i.factory}', '{i.key}', '{json.dumps({'factory': i.factory, 'params': dict(i.params)})}')" for k, i in enumerate(instances))
    t.with_("ins(i, c, category, factory, key, js)", f"SELECT * FROM (VALUES {rows}) AS x(i, c, category, factory, key, js)")
    numbers, values = ", ".join(str(k) for k in range(len(instances))), ", ".join(f"v{k}" for k in range(len(instances)))
    t.with_("vo", f"SELECT symbol, ts, unnest([{numbers}]) AS i, unnest([{values}]) AS v FROM b")
    t.with_("co", """SELECT 1 AS k, 0 AS c1, -1 AS c2, -1 AS c3, i AS i1, -1 AS i2, -1 AS i3 FROM ins
      UNION ALL SELECT 2, x.c, y.c, -1, x.i, y.i, -1 FROM ins x JOIN ins y ON x.c < y.c
      UNION ALL SELECT 3, x.c, y.c, z.c, x.i, y.i, z.i FROM ins x JOIN ins y ON x.c < y.c JOIN ins z ON y.c < z.c""")
    t.with_("sp", """SELECT row_number() OVER (ORDER BY k, c1, c2, c3, i1, i2, i3, m, r) - 1 AS ordinal, k, i1, i2, i3, CASE m WHEN 0 THEN 'long_only' ELSE 'long_short' END AS mode, CASE r WHEN 0 THEN 'and' ELSE 'or' END AS rule
      FROM co, (VALUES (0), (1)) AS x(m), (VALUES (0), (1)) AS y(r) WHERE k > 1 OR r = 0""")
    t.with_("named", """SELECT sp.*, array_to_string(list_sort([a.key, e.key, f.key]), '|') || '#mode=' || mode || '#adxNone#' || rule AS signature,
      concat_ws(', ', a.key, e.key, f.key) AS strategy,
      '{"instances": [' || concat_ws(', ', a.js, e.js, f.js) || '], "mode": "' || mode || '", "adx_min": null, "combine": "' || rule || '"}' AS spec_json
      FROM sp JOIN ins a ON sp.i1 = a.i LEFT JOIN ins e ON sp.i2 = e.i LEFT JOIN ins f ON sp.i3 = f.i""")
    t.with_("hl", """SELECT b.symbol, b.ts, b.close, b.half, b.ppy, sp.ordinal, mode, rule, greatest(a.v, e.v, f.v) AS hi, least(a.v, e.v, f.v) AS lo
      FROM sp JOIN vo a ON a.i = sp.i1 JOIN b ON b.symbol = a.symbol AND b.ts = a.ts LEFT JOIN vo e ON e.i = sp.i2 AND e.symbol = a.symbol AND e.ts = a.ts LEFT JOIN vo f ON f.i = sp.i3 AND f.symbol = a.symbol AND f.ts = a.ts""")
    t.with_("bo", "SELECT *, CASE WHEN rule = 'and' THEN CASE WHEN lo = 1 THEN 1.0 WHEN hi = -1 THEN -1.0 ELSE 0.0 END WHEN hi = 1 AND lo > -1 THEN 1.0 WHEN lo = -1 AND hi < 1 THEN -1.0 ELSE 0.0 END AS way FROM hl")
    t.with_("ps", "SELECT symbol, ts, close, half, ppy, ordinal, CASE WHEN mode = 'long_only' THEN greatest(way, 0.0) ELSE way END AS position FROM bo")
    metrics(t, "ps", "symbol, ordinal, half", cost_bps, 12, finish=False)
    t.with_("re", """SELECT i.symbol, i.ordinal, least(i.sharpe, o.sharpe) AS score, i.sharpe AS is_sharpe, o.sharpe AS oos_sharpe, o.total_return AS oos_return, o.max_drawdown AS oos_max_drawdown, i.num_trades + o.num_trades AS num_trades,
      coalesce((i.trade_wins + o.trade_wins) / nullif(CAST(i.trade_count + o.trade_count AS DOUBLE), 0), 0) AS win_rate, i.trade_win_rate AS is_win_rate, o.trade_win_rate AS oos_win_rate, i.trade_count AS is_trades, o.trade_count AS oos_trades,
      o.trade_wins AS oos_wins, o.sortino AS oos_sortino, o.profit_factor AS oos_profit_factor, o.exposure AS oos_exposure, i.total_return AS is_return, i.cagr AS is_cagr
      FROM me i JOIN me o ON i.symbol = o.symbol AND i.ordinal = o.ordinal AND i.half = 'is' AND o.half = 'oos'""")
    same = "symbol, round(is_sharpe, 4) + 0.0, round(oos_sharpe, 4) + 0.0, round(oos_return, 6) + 0.0, round(oos_max_drawdown, 6) + 0.0, num_trades, round(win_rate, 6)"
    t.with_("un", f"SELECT re.*, named.* EXCLUDE (ordinal) FROM re JOIN named USING (ordinal) QUALIFY row_number() OVER (PARTITION BY {same} ORDER BY ordinal) = 1")
    return t


def best(t: Twin, where: str, n: int, by: str = "score") -> Twin:
    """tp: the n best of each symbol."""
    return t.with_("tp", f"SELECT * FROM un WHERE {where} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round({by}, 9) DESC, ordinal) <= {n}")


def shown(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in columns)
