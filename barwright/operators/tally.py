"""Backtests that are added up stretch by stretch of bars: what many positions have come to so far, and the fifteen metrics of it."""

from __future__ import annotations

import numpy as np

from barwright.operators.backtest import COUNTS, LOSS_FLOOR, METRICS, WIN


class Moments:
    """Number, mean and squared deviations of each row's values, merged without loss of digits."""

    def __init__(self, rows: int):
        self.n, self.mean, self.m2 = np.zeros(rows), np.zeros(rows), np.zeros(rows)

    def add(self, rows: np.ndarray, values: np.ndarray, counted: np.ndarray | None = None) -> None:
        """Values of some rows; of those `counted` only."""
        n = np.full(len(rows), float(values.shape[1])) if counted is None else counted.sum(1).astype(float)
        some = np.maximum(n, 1.0)
        mean = values.mean(1) if counted is None else np.where(counted, values, 0.0).sum(1) / some
        off = values - mean[:, None]
        self._merge(rows, n, mean, ((off if counted is None else np.where(counted, off, 0.0)) ** 2).sum(1))

    def add_zeros(self, rows: np.ndarray, n: int) -> None:
        self._merge(rows, np.full(len(rows), float(n)), np.zeros(len(rows)), np.zeros(len(rows)))

    def _merge(self, rows: np.ndarray, n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> None:
        before, both, gap = self.n[rows], np.maximum(self.n[rows] + n, 1.0), mean - self.mean[rows]
        first = before == 0
        self.m2[rows] = np.where(first, m2, self.m2[rows] + m2 + gap * gap * (before * n / both))
        self.mean[rows] = np.where(first, mean, self.mean[rows] + gap * (n / both))
        self.n[rows] = before + n

    def deviation(self) -> np.ndarray:
        return np.sqrt(self.m2 / np.maximum(self.n, 1.0))


class Tally:
    """One half of a backtest of `rows` strategies, bars added in order of time.

    It holds for each strategy sums and moments of the returns so far, equity with its peak and deepest fall, the position
    last decided and the one held, and the log return of a trade that is still open. So a stretch of bars is added
    exactly as it stands in the whole series, also where a trade goes on over its edge or equity falls below zero.
    """

    def __init__(self, rows: int, cost_bps: float):
        self.cost, self.bars, self.close = cost_bps / 1e4, 0, np.nan
        self.returns, self.losses = Moments(rows), Moments(rows)
        self.equity, self.peak, self.under = np.ones(rows), np.full(rows, -np.inf), np.full(rows, np.inf)
        self.decided, self.held = np.zeros(rows, np.int8), np.zeros(rows, np.int8)
        self.open = np.full(rows, np.nan)
        self.sums = {k: np.zeros(rows) for k in ("moved", "gain", "loss")}
        self.counts = {k: np.zeros(rows, np.int64) for k in ("active", "rises", "num_trades", "trade_count", "trade_wins")}

    def add(self, close: np.ndarray, position: np.ndarray) -> None:
        """The next bars: their closes, and the positions decided on them (strategies x bars)."""
        n = len(close)
        if not n:
            return
        asset = np.zeros(n)
        with np.errstate(all="ignore"):
            asset[1:] = close[1:] / close[:-1] - 1
            if self.bars:
                asset[0] = close[0] / self.close - 1
            self._add(n, close, asset, position)

    def _add(self, n: int, close: np.ndarray, asset: np.ndarray, position: np.ndarray) -> None:
        busy = (self.decided != 0) | (self.held != 0) | position[:, :-1].any(1)
        idle, rows = np.flatnonzero(~busy), np.flatnonzero(busy)
        self.close, self.bars = close[-1], self.bars + n
        self.returns.add_zeros(idle, n)
        self._worth(idle, self.equity[idle, None])
        self._held(rows, asset, position[rows])
        self.decided = position[:, -1].copy()

    def _worth(self, rows: np.ndarray, equity: np.ndarray) -> None:
        peak = np.maximum(np.maximum.accumulate(equity, 1), self.peak[rows, None])
        self.under[rows] = np.minimum(self.under[rows], (equity / peak - 1).min(1))
        self.equity[rows], self.peak[rows] = equity[:, -1], peak[:, -1]

    def _held(self, rows: np.ndarray, asset: np.ndarray, position: np.ndarray) -> None:
        """The bars of strategies that hold something on them, or did on the bar before."""
        held = np.empty(position.shape, np.int8)
        held[:, 0], held[:, 1:] = self.decided[rows], position[:, :-1]
        step = held.copy()
        step[:, 1:] -= held[:, :-1]
        step[:, 0] -= self.held[rows]
        self.held[rows] = held[:, -1]
        r = held * asset - np.abs(step) * self.cost
        active, rises, falls = held != 0, r > 0, r < 0
        self.returns.add(rows, r)
        self.losses.add(rows, r, falls)
        equity = 1 + r
        equity[:, 0] *= self.equity[rows]
        self._worth(rows, np.cumprod(equity, 1))
        rises &= active
        for name, x in (("moved", np.abs(r)), ("gain", np.where(rises, r, 0.0)), ("loss", np.where(active & falls, -r, 0.0))):
            self.sums[name][rows] += x.sum(1)
        for name, x in (("active", active), ("rises", rises), ("num_trades", step != 0)):
            self.counts[name][rows] += x.sum(1)
        self._trades(rows, r, step, active)

    def _trades(self, rows: np.ndarray, r: np.ndarray, step: np.ndarray, active: np.ndarray) -> None:
        """Stretches of one exposure, their returns compounded as sums of logarithms; the last one stays open."""
        n, begun = r.shape[1], self.open[rows]
        over = ~np.isnan(begun) & (step[:, 0] != 0)
        self._close(rows[over], begun[over])
        starts = (step != 0) & active
        starts[:, 0] = active[:, 0]  # begun here, or gone on with
        begin = np.flatnonzero(starts)
        last = np.ones_like(active)
        last[:, :-1] = step[:, 1:] != 0
        end = np.flatnonzero(last & active)
        log = np.log1p(np.maximum(r, LOSS_FLOOR))
        log[:, 0] += np.where(active[:, 0] & ~over & ~np.isnan(begun), begun, 0.0)
        upto = np.cumsum(log, 1).ravel()
        made = upto[end] - upto[begin] + log.ravel()[begin]
        still = end % n == n - 1
        self.open[rows] = np.nan
        self.open[rows[end[still] // n]] = made[still]
        self._close(rows[end[~still] // n], made[~still])

    def _close(self, rows: np.ndarray, made: np.ndarray) -> None:
        np.add.at(self.counts["trade_count"], rows, 1)
        np.add.at(self.counts["trade_wins"], rows[made > WIN], 1)

    def metrics(self, ppy: float) -> dict[str, np.ndarray]:
        """The fifteen metrics of each strategy; what never moved has zeros, but for n_bars."""
        rows = np.flatnonzero(~np.isnan(self.open))
        self._close(rows, self.open[rows])  # a trade still open ends with the bars
        self.open[rows] = np.nan
        n, c, s, year = self.bars, self.counts, self.sums, np.sqrt(ppy)
        ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(b)), where=b > 0)
        mean, off, off_down = self.returns.mean, self.returns.deviation(), self.losses.deviation()
        under = np.where(np.isfinite(self.under), self.under, 0.0)
        with np.errstate(all="ignore"):
            cagr = np.expm1(np.log(np.where(self.equity > 0, self.equity, np.nan)) * ppy / max(n, 1))
        cagr = np.where(np.isfinite(cagr), cagr, 0.0)
        values = {
            "total_return": self.equity - 1,
            "cagr": cagr,
            "ann_vol": off * year,
            "sharpe": ratio(mean * year, off),
            "sortino": ratio(mean * year, off_down),
            "max_drawdown": under,
            "calmar": ratio(cagr, -under),
            "win_rate": ratio(c["rises"], c["active"].astype(float)),
            "trade_win_rate": ratio(c["trade_wins"], c["trade_count"].astype(float)),
            "profit_factor": ratio(s["gain"], s["loss"]),
            "exposure": c["active"] / max(n, 1),
        } | {k: c[k] for k in ("trade_wins", "trade_count", "num_trades")}
        live = s["moved"] != 0
        out = {k: np.where(live, values[k], 0).astype(np.int64 if k in COUNTS else float) for k in METRICS if k != "n_bars"}
        return out | {"n_bars": np.full(len(live), n)}
