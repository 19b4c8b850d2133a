"""Laying ordered playlists on a time axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import sections, text

PHASES = ("intro", "warmup", "build", "peak", "sustain", "cooldown")


def timeline(ordered: DataFrame, plans: DataFrame | None = None, peak_share: float = 0.65,
             default_overlap: float = 16.0) -> DataFrame:
    """Start, end, playing time, overlap, peak and phase of every track of every set.

    A track adds the stretch between its mix-in and mix-out to the set; its
    start is the running sum of the stretches before it.  ``plans`` holds
    (playlist_id, idx, mix_out_a, mix_in_b, overlap), ``idx`` being the position
    of the outgoing track.
    """
    c = F.col
    peak_share = max(0.1, min(0.9, peak_share))
    base = ordered.select("playlist_id", "pos", "track_id", "title", c("energy").cast("double").alias("energy"),
                          "duration", "mix_in_point", "mix_out_point")
    if plans is None:
        base = base.withColumns({n: F.lit(None).cast("double") for n in ("plan_out", "plan_overlap", "plan_in")})
    else:
        own = plans.select("playlist_id", c("idx").alias("pos"), c("mix_out_a").alias("plan_out"),
                           c("overlap").alias("plan_overlap"))
        into = plans.select("playlist_id", (c("idx") + 1).alias("pos"), c("mix_in_b").alias("plan_in"))
        base = base.join(own, ["playlist_id", "pos"], "left").join(into, ["playlist_id", "pos"], "left")
    w = Window.partitionBy("playlist_id").orderBy("pos")
    whole = Window.partitionBy("playlist_id")
    fall_in, fall_out = sections.resolve_mix_points(c("mix_in_point"), c("mix_out_point"), c("duration"), default_overlap)
    rows = base.withColumns({"dur": F.greatest(c("duration"), F.lit(30.0)), "fall_in": fall_in, "fall_out": fall_out,
                             "place": F.row_number().over(w) - 1, "n": F.count("*").over(whole)})
    mix_in = F.least(F.greatest(F.when(c("place") == 0, 0.0).otherwise(F.coalesce("plan_in", "fall_in")), F.lit(0.0)),
                     c("dur"))
    rows = rows.withColumn("mix_in", mix_in)

    def fits(t):
        return (c("mix_in") < t) & (t <= c("dur"))

    first_choice = F.coalesce("plan_out", "fall_out")
    rows = rows.withColumn("mix_out", F.when(fits(first_choice), first_choice)
                           .when(fits(c("fall_out")), c("fall_out")).otherwise(c("dur")))
    last = c("place") == c("n") - 1
    tail = c("dur") - c("mix_out")
    unplanned = F.greatest(F.lit(4.0), F.least(tail, F.lit(default_overlap), c("dur") * 0.3))
    overlap = F.greatest(F.lit(0.0), F.least(
        F.when(c("plan_out").isNotNull(), c("plan_overlap")).otherwise(unplanned), c("dur") * 0.5, tail))
    rows = rows.withColumn("overlap", F.when(last, 0.0).otherwise(overlap))
    rows = rows.withColumns({
        "playing": F.when(last, c("dur") - c("mix_in")).otherwise(c("mix_out") - c("mix_in") + c("overlap")),
        "stretch": c("mix_out") - c("mix_in")})
    rows = rows.withColumn("start", F.coalesce(
        F.sum("stretch").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.select("playlist_id", "pos", "place", "n", "track_id", "title", "energy",
                       F.bround("start", 2).alias("start_time"),
                       F.bround(c("start") + c("playing"), 2).alias("end_time"),
                       F.bround("playing", 2).alias("playing_duration"), F.bround("overlap", 2).alias("overlap_with_next"))
    rows = rows.withColumn("total", F.max_by("end_time", "place").over(whole))
    centre = (c("start_time") + c("end_time")) / 2.0
    nearness = 1.0 - F.least(F.abs(centre - c("total") * peak_share) / F.greatest(c("total"), F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumn("peak_score", c("energy") / 100.0 * 0.6 + nearness * 0.4)
    # highest score, first position on a tie
    rows = rows.withColumn("peak_place", F.max(F.struct(c("peak_score"), (-c("place")).alias("back"))).over(whole)["back"] * -1)
    span = F.greatest(c("n") - 1, F.lit(1))
    at, peak_at = c("place") / span, c("peak_place") / span
    phase = (F.when(c("place") == c("peak_place"), "peak").when(c("place") == 0, "intro")
             .when(c("place") == c("n") - 1, "cooldown").when(at < peak_at * 0.5, "warmup")
             .when(at <= peak_at, "build").when(at <= peak_at + 0.15, "sustain").otherwise("cooldown"))
    return rows.select("playlist_id", "pos", "track_id", "title", "start_time", "end_time", "playing_duration",
                       "overlap_with_next", (c("place") == c("peak_place")).alias("is_peak"), phase.alias("energy_phase"))


def timing_summary(lines: DataFrame, target_minutes: float = 60.0) -> DataFrame:
    """Totals, target, overflow, peak and phase counts per set."""
    c = F.col
    out = lines.groupBy("playlist_id").agg(
        F.count("*").alias("track_count"), F.max_by("end_time", "pos").alias("total"),
        F.max(F.when(c("is_peak"), c("title"))).alias("peak_track"),
        F.max(F.when(c("is_peak"), c("start_time"))).alias("peak_start"),
        F.bround(F.avg("playing_duration"), 1).alias("avg_track_duration"),
        *[F.count(F.when(c("energy_phase") == p, 1)).alias(f"n_{p}") for p in PHASES])
    minutes = F.bround(c("total") / 60.0, 2)
    over = F.bround(c("total") / 60.0 - target_minutes, 2) * 60.0
    return out.select(
        "playlist_id", "track_count", text.minutes_seconds(minutes * 60.0).alias("total_time"),
        text.minutes_seconds(F.lit(target_minutes * 60.0)).alias("target_time"),
        text.minutes_seconds(over).alias("overflow"), over.alias("overflow_seconds"), "peak_track",
        text.minutes_seconds(c("peak_start")).alias("peak_time"), "avg_track_duration", *[f"n_{p}" for p in PHASES])
