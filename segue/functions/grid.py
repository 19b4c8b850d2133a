"""Snapping times to regular and irregular grids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue import refdata as R


def quantize_to_grid(t: Column, grid: Column, anchor: Column | float = 0.0, mode: str = "round") -> Column:
    """Nearest, next or previous point of ``anchor + k * grid``.

    A time within 50 ms of a point counts as on it, so rounding noise never
    moves a point by a whole phrase.  A grid of 0 leaves the time unchanged.
    """
    anchor = F.lit(anchor) if isinstance(anchor, float) else anchor
    safe = F.when(grid > 0, grid)
    steps = (t - anchor) / safe
    slack = F.lit(R.QUANTIZE_TOLERANCE_SEC) / safe
    index = {"ceil": lambda: F.ceil(steps - slack), "floor": lambda: F.floor(steps + slack),
             "round": lambda: F.rint(steps)}[mode]()
    return F.when(grid > 0, index.cast("double") * grid + anchor).otherwise(t)


def quantize_to_points(t: Column, points: Column, mode: str) -> Column:
    """Next (ceil) or previous (floor) entry of an array of points, NULL if none."""
    tol = R.QUANTIZE_TOLERANCE_SEC
    if mode == "ceil":
        return F.array_min(F.filter(points, lambda p: p >= t - tol))
    return F.array_max(F.filter(points, lambda p: p <= t + tol))


def phrase_anchor(t_first_phrase: Column, downbeat_conf: Column, phrase_conf: Column,
                  first_downbeat: Column) -> Column:
    """First phrase if it was estimated reliably, else the first downbeat."""
    usable = ((t_first_phrase >= 0) & (downbeat_conf > 0)
              & (phrase_conf >= R.PHRASE_CONFIDENCE_MIN))
    return F.when(usable, t_first_phrase).otherwise(first_downbeat)
