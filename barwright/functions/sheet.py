"""A sheet of derived candle columns: each is made once, in as few passes as their dependencies allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from barwright.operators import recurrences


class Sheet:
    """Collects wanted columns and adds them to candles all at once.

    Recurrences (exponential averages, trailing stops) come first, in one grouped pass over each series; window
    expressions follow in layers, one select each, since a window can't hold another. A column asked for twice, under
    the same name, is computed once.
    """

    def __init__(self) -> None:
        self.depth: dict[str, int] = {}
        self.layers: dict[int, dict[str, Column]] = {}
        self.wanted: dict[str, tuple] = {}

    def make(self, name: str, column: Column, *needs: str) -> str:
        """Add a column that reads the columns `needs` of the sheet, besides those of the candles."""
        if name not in self.depth:
            level = 1 + max((self.depth.get(n, 0) for n in needs), default=0)
            self.depth[name] = level
            self.layers.setdefault(level, {})[name] = column
        return name

    def recur(self, kind: str, *params: float) -> tuple[str, ...]:
        """Names of the columns of a recurrence of `barwright.operators.recurrences`."""
        tag = "_".join([kind, *(f"{p:g}".replace(".", "p").replace("-", "m") for p in params)])
        self.wanted[tag] = (kind, *params)
        return tuple(f"{tag}_{part}" if part else tag for part in recurrences.PARTS[kind])

    def apply(self, candles: DataFrame, parts: int | None = None) -> DataFrame:
        """parts: recurrences go through so many ranges of time instead of a series at a time."""
        df = recurrences.add(candles, self.wanted, parts) if self.wanted else candles
        for level in sorted(self.layers):
            df = df.select("*", *[c.alias(n) for n, c in self.layers[level].items()])
        return df
