"""Tempo arithmetic: octave-aware differences, repairs and bar conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segue import refdata as R


def _images(bpm_a: Column, bpm_b: Column) -> tuple[Column, Column, Column]:
    return (F.abs(bpm_a - bpm_b), F.abs(bpm_a - bpm_b * 2.0), F.abs(bpm_a - bpm_b / 2.0))


def effective_bpm_diff(bpm_a: Column, bpm_b: Column) -> Column:
    """Least tempo gap in A's tempo space, B taken as is, doubled or halved."""
    direct, half, double = _images(bpm_a, bpm_b)
    return F.when((bpm_a <= 0) | (bpm_b <= 0), direct).otherwise(F.least(direct, half, double))


def bpm_relation(bpm_a: Column, bpm_b: Column) -> Column:
    """Which image of B is nearest; direct, then half, wins a tie."""
    direct, half, double = _images(bpm_a, bpm_b)
    return (F.when((bpm_a <= 0) | (bpm_b <= 0) | ((direct <= half) & (direct <= double)), "direct")
            .when(half <= double, "half").otherwise("double"))


def octave_bpm_error(pred: Column, true: Column) -> Column:
    return F.least(F.abs(pred - true), F.abs(pred * 2.0 - true), F.abs(pred / 2.0 - true))


def bpm_ok(detected: Column, expected: Column, tol: float = 3.0) -> Column:
    return F.least(F.abs(detected - expected), F.abs(detected - expected * 2.0),
                   F.abs(detected * 2.0 - expected)) <= tol


def safe_bpm(raw: Column) -> Column:
    """Catalogue tempo stored times 100; a value already in BPM is kept; else NULL."""
    value = raw.cast("double")
    return (F.when((value / 100.0).between(40.0, 250.0), value / 100.0)
            .when(value.between(40.0, 250.0), value))


def repair_half_time(bpm: Column) -> Column:
    doubled = F.bround(bpm * 2.0, 2)
    return (F.when((bpm > 40) & (bpm < 95) & (doubled <= R.BPM_HALFTIME_MAX_RESULT), doubled)
            .when(bpm > 200, F.bround(bpm / 2.0, 2))
            .otherwise(bpm))


def repair_tag_bpm(tag: Column, measured: Column, range_lo: Column, range_hi: Column) -> Column:
    """Tagged tempo, multiplied by a simple factor only if the audio and the genre agree."""
    factors = (0.5, 2.0 / 3.0, 1.0, 1.5, 2.0)
    best = F.least(*[
        F.struct((F.abs(tag * f - measured) / measured).alias("gap"), F.lit(f).alias("factor"))
        for f in factors])
    corrected = tag * best["factor"]
    accept = ((measured > 0) & (best["factor"] != 1.0)
              & (F.abs(tag - measured) / measured > 0.08) & (best["gap"] <= 0.06)
              & ~tag.between(range_lo, range_hi) & corrected.between(range_lo, range_hi))
    return F.when(accept, F.bround(corrected, 2)).otherwise(tag)


def seconds_per_bar(bpm: Column) -> Column:
    return F.when(bpm > 0, F.lit(60.0) / bpm * float(R.METER)).otherwise(0.0)


def seconds_to_bars(seconds: Column, bpm: Column, rounding: str = "round") -> Column:
    ratio = seconds / seconds_per_bar(bpm)
    rounded = {"round": F.rint, "floor": F.floor, "ceil": F.ceil}[rounding](ratio)
    return F.when(bpm > 0, rounded.cast("long")).otherwise(0)


def bars_to_seconds(bars: Column, bpm: Column) -> Column:
    return bars.cast("double") * seconds_per_bar(bpm)
