"""Positions from several votes."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("long_only", "long_short")
RULES = ("and", "or")


def combine(votes: list[Column], rule: str = "and", mode: str = "long_only", adx: Column | None = None, adx_min: float | None = None) -> Column:
    """1, -1 or 0 for a bar: and - all votes agree; or - some vote says so and none the opposite.

    long_only turns shorts into 0. With adx_min, positions are held only where the trend is at least so strong; an
    undefined strength is not.
    """
    if rule not in RULES or mode not in MODES:
        raise ValueError(f"unknown rule or mode: {rule}, {mode}")
    up, down = ([v == x for v in votes] for x in (1.0, -1.0))
    if rule == "and":
        go_up, go_down = reduce(and_, up), reduce(and_, down)
    else:
        go_up, go_down = reduce(or_, up) & ~reduce(or_, down), reduce(or_, down) & ~reduce(or_, up)
    position = F.when(go_up, 1.0).when(go_down, -1.0).otherwise(0.0)
    if mode == "long_only":
        position = F.greatest(position, F.lit(0.0))
    return position if adx_min is None else F.when(F.coalesce(adx >= adx_min, F.lit(False)), position).otherwise(0.0)
