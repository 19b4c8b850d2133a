"""Expressions over the labelled sections of one track."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _end(section: Column) -> Column:
    return F.coalesce(section["end_time"], section["start_time"], F.lit(0.0))


def intro_end(sections: Column) -> Column:
    """End of the leading run of 'intro' sections, 0 if there is none."""
    step = F.aggregate(
        sections,
        F.struct(F.lit(True).alias("open"), F.lit(0.0).alias("t")),
        lambda acc, s: F.struct(
            (acc["open"] & (s["label"] == "intro")).alias("open"),
            F.when(acc["open"] & (s["label"] == "intro"), _end(s)).otherwise(acc["t"]).alias("t")))
    return F.coalesce(step["t"], F.lit(0.0))


def outro_start(sections: Column, duration: Column) -> Column:
    """Start of the trailing run of 'outro' sections, the duration if there is none."""
    step = F.aggregate(
        F.reverse(sections),
        F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("t")),
        lambda acc, s: F.struct(
            (acc["open"] & (s["label"] == "outro")).alias("open"),
            F.when(acc["open"] & (s["label"] == "outro"), s["start_time"]).otherwise(acc["t"]).alias("t")))
    return F.coalesce(step["t"], duration)


def section_at(sections: Column, t: Column) -> Column:
    """First section with start <= t < end; the last section also holds its end."""
    last_end = F.element_at(sections, -1)["end_time"]
    last_start = F.element_at(sections, -1)["start_time"]
    inside = F.filter(sections, lambda s: (s["start_time"] <= t) & (
        (t < s["end_time"]) | ((t == s["end_time"]) & (s["end_time"] == last_end)
                               & (s["start_time"] == last_start))))
    return F.when((F.size(sections) > 0) & (t >= 0), F.get(inside, F.lit(0)))


def section_covering(sections: Column, t: Column) -> Column:
    """First section with start <= t <= end (the closed reading used for bass risks)."""
    return F.get(F.filter(sections, lambda s: (s["start_time"] <= t) & (t <= s["end_time"])), F.lit(0))


def label_at(sections: Column, t: Column, fallback_edge: str) -> Column:
    """Section label at a mix time; outside all sections the first or last label."""
    edge = F.get(sections, F.lit(0)) if fallback_edge == "in" else F.get(F.reverse(sections), F.lit(0))
    return F.when((F.coalesce(F.size(sections), F.lit(0)) <= 0) | (t < 0), "unknown").otherwise(
        F.coalesce(section_at(sections, t)["label"], edge["label"], F.lit("unknown")))


def resolve_mix_points(mix_in: Column, mix_out: Column, duration: Column,
                       overlap: Column | float) -> tuple[Column, Column]:
    """Usable mix points: the stored ones, else fallbacks, clamped into the track."""
    overlap = F.lit(float(overlap)) if not isinstance(overlap, Column) else overlap
    dur = F.greatest(duration, F.lit(0.0))
    half = overlap / 2.0
    raw_in = (F.when(mix_in >= 0, mix_in)
              .when(dur > 0, F.least(dur * 0.1, F.greatest(F.lit(4.0), half)))
              .otherwise(F.greatest(F.lit(0.0), half)))
    raw_out = (F.when(mix_out >= 0, mix_out)
               .when(dur > 0, F.greatest(raw_in + 4.0, dur - F.least(dur * 0.05, overlap)))
               .otherwise(raw_in + F.greatest(F.lit(4.0), half)))
    clamped_in = F.greatest(F.lit(0.0), F.least(raw_in, dur))
    clamped_out = F.least(dur, F.greatest(clamped_in + 1.0, F.least(raw_out, dur)))
    final_in = F.when(clamped_in >= clamped_out,
                      F.greatest(F.lit(0.0), clamped_out - 1.0)).otherwise(clamped_in)
    return (F.when(dur > 0, final_in).otherwise(raw_in),
            F.when(dur > 0, clamped_out).otherwise(raw_out))
