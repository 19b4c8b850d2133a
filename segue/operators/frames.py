"""Track features from per-frame measurements.

``frames`` is the long table of the library (one row per track and frame):
track_id, frame_idx, t_sec, onset, bass_env, rms, centroid, flatness, contrast,
chroma[12], mfcc[13], power columns.  Per-track values reach the frames by a
salted join; sums are partial before they are shuffled, so a very long track
is never one task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import lineage
from segue import refdata as R
from segue.functions import keys, tempo, vectors
from segue.operators import ordered

SLOTS = 16
# fixed values
MIN_PEAK_RATIO = 1.10
MIN_FOLD_BARS = 8
DOWNBEAT_RELIABLE_MIN = 0.30
BEAT_LABELS = ("main", "drop")
MAJOR_PROFILE = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR_PROFILE = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
AUTOCORRELATION_LAGS = 200

c = F.col


def bar_slot(t: Column, bpm: Column, first_downbeat: Column) -> Column:
    """Sixteenth of the bar, each slot centred on its grid point."""
    bar = tempo.seconds_per_bar(bpm)
    return F.pmod(F.floor(F.pmod(t - first_downbeat, bar) / (bar / SLOTS) + 0.5), F.lit(SLOTS))


def _pattern(sums: list[Column]) -> Column:
    """Shares of 16 slot sums; empty if there is nothing or no concentration."""
    values = F.array(*sums)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    shares = F.transform(values, lambda v: v / total)
    usable = (total > 0) & (F.array_max(values) / total >= MIN_PEAK_RATIO / SLOTS)
    return F.when(usable, shares).otherwise(F.array().cast("array<double>"))


def groove(frames: DataFrame, tracks: DataFrame, sections: DataFrame | None = None,
           frame_seconds: float = 512 / 22050) -> DataFrame:
    """Rhythm patterns, syncopation and bass character of every track.

    ``tracks``: track_id, bpm, first_downbeat, downbeat_confidence.  Only frames
    inside main and drop ``sections`` (track_id, label, start_time, end_time)
    are folded if they cover eight bars, else all frames.  Without a reliable
    downbeat there is no pattern.
    """
    params = tracks.select("track_id", "bpm", "first_downbeat", "downbeat_confidence")
    if sections is None:
        params = params.withColumn("beats", F.array().cast("array<struct<s:double,e:double>>"))
    else:
        spans = (sections.where(c("label").isin(*BEAT_LABELS) & (c("end_time") > c("start_time")))
                 .groupBy("track_id").agg(F.collect_list(F.struct(c("start_time").alias("s"),
                                                                  c("end_time").alias("e"))).alias("beats")))
        params = params.join(spans, "track_id", "left")
    rows = ordered.attach(frames.select("track_id", "frame_idx", "t_sec", "onset", "bass_env", "sub_power", "total_power"),
                          params, "track_id", "frame_idx")
    inside = F.coalesce(F.exists("beats", lambda b: (b["s"] <= c("t_sec")) & (c("t_sec") < b["e"])), F.lit(False))
    rows = rows.withColumns({"slot": bar_slot(c("t_sec"), c("bpm"), c("first_downbeat")), "inside": inside})
    sums = [F.sum(F.when((c("slot") == k) & mask, c(v)).otherwise(0.0)).alias(f"{v}_{m}_{k}")
            for v in ("onset", "bass_env") for m, mask in (("in", c("inside")), ("all", F.lit(True)))
            for k in range(SLOTS)]
    folded = rows.groupBy("track_id").agg(
        F.first("bpm").alias("bpm"), F.first("downbeat_confidence").alias("downbeat_confidence"),
        F.sum(c("inside").cast("long")).alias("n_inside"), F.sum("sub_power").alias("sub"),
        F.sum("total_power").alias("power"), F.avg(F.abs(c("bass_env"))).alias("bass_mean"), *sums)
    loudness = frames.select("track_id", "frame_idx", F.abs(c("bass_env")).alias("bass"))
    folded = folded.join(ordered.group_quantiles(loudness, "track_id", {"bass": {"bass_peak": 0.95}}, "frame_idx"), "track_id", "left")
    enough = c("n_inside") >= F.floor(tempo.seconds_per_bar(c("bpm")) * float(MIN_FOLD_BARS) / frame_seconds)
    reliable = (c("downbeat_confidence") >= DOWNBEAT_RELIABLE_MIN) & (c("bpm") > 0)
    empty = F.array().cast("array<double>")

    def pattern(value: str) -> Column:
        chosen = [F.when(enough & (c("n_inside") > 0), c(f"{value}_in_{k}")).otherwise(c(f"{value}_all_{k}"))
                  for k in range(SLOTS)]
        return F.when(reliable, _pattern(chosen)).otherwise(empty)

    return (folded.select("track_id", pattern("onset").alias("groove_pattern"), pattern("bass_env").alias("bass_pattern"),
                          F.when(reliable & (c("power") > 0), c("sub") / c("power")).otherwise(0.0).alias("sub_energy"),
                          F.when(reliable & (c("bass_mean") > 0), c("bass_peak") / c("bass_mean")).otherwise(0.0)
                          .alias("bass_punch"))
            .withColumn("syncopation", vectors.syncopation(
                F.when(F.size("bass_pattern") > 0, c("bass_pattern")).otherwise(c("groove_pattern")))))


def mean_vectors(frames: DataFrame, key: tuple[str, ...] = ("track_id",)) -> DataFrame:
    """Mean chroma and MFCC per track: one partial aggregate of 25 averages."""
    means = [F.avg(F.get(c(v), F.lit(i))).alias(f"{v}_{i}") for v, n in (("chroma", 12), ("mfcc", 13)) for i in range(n)]
    agg = frames.groupBy(*key).agg(*means)
    return agg.select(*key, F.array(*[c(f"chroma_{i}") for i in range(12)]).alias("chroma"),
                      F.array(*[F.bround(c(f"mfcc_{i}"), 4) for i in range(13)]).alias("mfcc_fingerprint"),
                      F.array(*[F.bround(c(f"mfcc_{i}"), 3) for i in range(13)]).alias("timbre_fingerprint"))


def _key_profiles() -> Column:
    """24 rotated key profiles in candidate order: C major, C minor, C# major, ..."""
    rows = []
    for i, note in enumerate(R.NOTES):
        for mode, profile in (("Major", MAJOR_PROFILE), ("Minor", MINOR_PROFILE)):
            turned = [profile[(k - i) % 12] for k in range(12)]
            rows.append(f"struct({2 * i + (mode == 'Minor')} AS ord, '{note}' AS note, '{mode}' AS mode, "
                        f"{R.literal(sum(v * v for v in profile) ** 0.5)} AS len, "
                        f"array({', '.join(R.literal(v) for v in turned)}) AS profile)")
    return F.expr(f"array({', '.join(rows)})")


def detect_key(means: DataFrame) -> DataFrame:
    """Best and second key of a mean chroma with contrast, margin and confidence."""
    length = F.sqrt(vectors.dot(c("chroma"), c("chroma")))
    scored = means.withColumn("chroma_len", length).withColumn("fits", F.transform(_key_profiles(), lambda p: F.struct(
        F.when(c("chroma_len") > 1e-9, vectors.dot(c("chroma"), p["profile"]) / (c("chroma_len") * p["len"]))
        .otherwise(0.0).alias("fit"), (-p["ord"]).alias("first"), p["note"].alias("note"), p["mode"].alias("mode"))))
    ranked = scored.withColumn("fits", F.sort_array("fits", asc=False))
    best, second = F.get(c("fits"), F.lit(0)), F.get(c("fits"), F.lit(1))
    mean = F.aggregate(c("fits"), F.lit(0.0), lambda acc, x: acc + x["fit"]) / 24.0
    ranked = ranked.withColumn("mean_fit", mean)
    spread = F.sqrt(F.aggregate(c("fits"), F.lit(0.0), lambda acc, x: acc + (x["fit"] - c("mean_fit")) * (
        x["fit"] - c("mean_fit"))) / 24.0)
    ranked = ranked.withColumn("spread_fit", spread)
    contrast = F.when(c("spread_fit") > 1e-9, (best["fit"] - c("mean_fit")) / c("spread_fit")).otherwise(0.0)
    margin = F.when(F.abs(best["fit"]) > 1e-9, (best["fit"] - second["fit"]) / F.abs(best["fit"])).otherwise(0.0)
    keep = [name for name in means.columns if name != "chroma"]
    return ranked.select(
        *keep, best["note"].alias("key_note"), best["mode"].alias("key_mode"), second["note"].alias("second_note"),
        second["mode"].alias("second_mode"), F.bround(F.greatest(F.lit(0.0), contrast), 4).alias("contrast"),
        F.bround(F.greatest(F.lit(0.0), margin), 4).alias("margin"))


def key_confidence(found: DataFrame) -> DataFrame:
    """0..1 confidence and wheel code; a flat chroma gets no code and confidence 0."""
    strength, margin = c("contrast"), c("margin")
    level = F.least(F.lit(1.0), F.greatest(F.lit(0.0), strength / 2.5))
    one, two = keys.key_to_camelot(c("key_note"), c("key_mode")), keys.key_to_camelot(c("second_note"), c("second_mode"))
    steps = keys.wheel_distance(keys.camelot_number(one), keys.camelot_number(two))
    same = keys.camelot_letter(one) == keys.camelot_letter(two)
    near = ((steps == 0) & ~same) | ((steps == 1) & same)
    score = (F.when((strength >= 2.0) & (margin >= 0.02), F.greatest(F.lit(0.8), level))
             .when(near & (strength >= 1.0), F.greatest(F.lit(0.5), level * 0.8))
             .when((strength >= 1.0) & (margin >= 0.01), F.least(F.lit(0.6), F.greatest(F.lit(0.45), level)))
             .otherwise(F.least(level, F.lit(0.4))))
    flat = (strength <= 0.05) & (margin <= 1e-4)
    return found.withColumns({"key_confidence": F.when(flat, 0.0).otherwise(F.bround(score, 3)),
                              "camelot": F.when(flat, "").otherwise(one)})


def _scale(value: Column, low: float, high: float) -> Column:
    """Linear to 0..100 between two values, clamped and cut to an integer."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (value - low) / (high - low) * 100.0)).cast("int")


def track_levels(frames: DataFrame) -> DataFrame:
    """Energy, bass share, brightness and band shares of every track."""
    agg = frames.groupBy("track_id").agg(
        F.sqrt(F.avg(c("rms") * c("rms"))).alias("rms"), F.avg("centroid").alias("centroid"),
        (F.sum("sub_power") / F.sum("total_power")).alias("bass_share"),
        *[F.sqrt(F.avg(f"{b}_ms")).alias(b) for b in ("bass", "mids", "highs")])
    whole = c("bass") + c("mids") + c("highs") + 1e-6
    return agg.select("track_id", _scale(c("rms"), 0.0, 0.4).alias("energy"),
                      F.coalesce(_scale(c("bass_share"), 0.0, 1.0), F.lit(0)).alias("bass_intensity"),
                      _scale(c("centroid"), 500.0, 8000.0).alias("brightness"),
                      *[F.bround(c(b) / whole * 100.0, 1).alias(f"avg_{b}") for b in ("bass", "mids", "highs")])


def vocal_class(frames: DataFrame) -> DataFrame:
    """vocal / instrumental / unknown by points for flatness, MFCC variance and contrast."""
    agg = frames.groupBy("track_id").agg(
        F.avg("flatness").alias("flatness"), F.avg("contrast").alias("contrast"),
        *[F.var_pop(F.get(c("mfcc"), F.lit(i))).alias(f"v{i}") for i in range(1, 13)])
    variance = sum((c(f"v{i}") for i in range(2, 13)), c("v1")) / 12.0
    points = (F.when(c("flatness") < 0.03, 2).when(c("flatness") < 0.08, 1).otherwise(0)
              + F.when(variance > 80, 2).when(variance > 40, 1).otherwise(0)
              + F.when(c("contrast") > 30, 2).when(c("contrast") > 20, 1).otherwise(0))
    return agg.select("track_id", points.alias("points"),
                      F.when(points >= 5, "vocal").when(points <= 2, "instrumental").otherwise("unknown").alias("vocal"))


def autocorrelation(frames: DataFrame, value: str, lags: int = AUTOCORRELATION_LAGS, block: int = 4096) -> DataFrame:
    """Sum of x[i] * x[i + lag] per track for lag 0 .. lags-1: (track_id, lag, ac).

    Blocks of frames with a tail of ``lags`` frames are correlated in Arrow
    batches; only one partial sum per block and lag is shuffled.
    """
    cut = ordered.blockwise(frames.select("track_id", "frame_idx", c(value).cast("double").alias("x")),
                            "frame_idx", block, after=lags - 1)
    packed = cut.groupBy("track_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("frame_idx", "x", "own"))).alias("run"))
    packed = packed.select("track_id", F.transform("run", lambda r: r["x"]).alias("xs"),
                           F.size(F.filter("run", lambda r: r["own"])).alias("n_own"))

    @F.pandas_udf("array<double>")
    def partial(xs: pd.Series, n_own: pd.Series) -> pd.Series:
        import numpy as np
        out = []
        for x, n in zip(xs, n_own):
            head = np.asarray(x[:n])
            full = np.concatenate([np.asarray(x), np.zeros(lags)])
            out.append([float(head @ full[k:k + n]) for k in range(lags)])
        return pd.Series(out)

    return (packed.select("track_id", F.posexplode(partial("xs", "n_own")).alias("lag", "part"))
            .groupBy("track_id", "lag").agg(F.sum("part").alias("ac")))


def strongest_period(frames: DataFrame, value: str) -> DataFrame:
    """Largest local maximum of the normalised autocorrelation: (track_id, period_strength)."""
    sizes = frames.groupBy("track_id").agg(F.floor(F.count("*") / 2).alias("n_lags"))
    ac = autocorrelation(frames, value).join(sizes, "track_id").where(c("lag") < c("n_lags"))
    w = Window.partitionBy("track_id").orderBy("lag")
    near = ac.select("track_id", "lag", "ac", F.lag("ac").over(w).alias("prev"), F.lead("ac").over(w).alias("next"),
                     F.first("ac").over(w).alias("ac0"))
    peak = (c("lag") >= 1) & (c("ac") > c("prev")) & (c("ac") > c("next")) & (c("ac0") > 0)
    return near.groupBy("track_id").agg(F.coalesce(F.max(F.when(peak, c("ac") / c("ac0"))), F.lit(0.0))
                                        .alias("period_strength"))


def beat_intervals(beats: DataFrame) -> DataFrame:
    """Time to the next beat, by an equi-join on the beat number (no per-track window)."""
    following = beats.select("track_id", (c("beat_idx") - 1).alias("beat_idx"), c("beat_time").alias("next_time"))
    return beats.select("track_id", "beat_idx", "beat_time").join(following, ["track_id", "beat_idx"]).select(
        "track_id", "beat_idx", (c("next_time") - c("beat_time")).alias("gap"))


def bar_length(beats: DataFrame, tracks: DataFrame) -> DataFrame:
    """Seconds per bar from the median beat interval, octave errors repaired; NULL below 8 beats."""
    counts = beats.groupBy("track_id").agg(F.count("*").alias("n_beats"))
    median = lineage.stored(beat_intervals(beats).where(c("gap") > 0))
    median = ordered.group_quantiles(median, "track_id", {"gap": {"ibi": 0.5}}, "beat_idx")
    rows = tracks.select("track_id", "bpm").join(counts, "track_id").join(median, "track_id", "left")
    expected = F.lit(60.0) / c("bpm")
    ibi = (F.when(c("ibi") > expected * 1.5, c("ibi") / 2.0).when(c("ibi") < expected * 0.75, c("ibi") * 2.0)
           .otherwise(c("ibi")))
    return rows.select("track_id", F.when((c("n_beats") >= 8) & (c("bpm") > 0), ibi * 4.0).alias("seconds_per_bar"))


def danceability(beats: DataFrame, frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """0..100 from beat regularity, onset and bass periodicity and a tempo bonus."""
    gaps = beat_intervals(beats).groupBy("track_id").agg(
        F.count("*").alias("n_gaps"), F.avg("gap").alias("gap"), F.stddev_pop("gap").alias("spread"))
    onset = strongest_period(frames, "onset").withColumnRenamed("period_strength", "onset_period")
    bass = strongest_period(frames, "bass_env").withColumnRenamed("period_strength", "bass_period")
    rows = (tracks.select("track_id", "bpm").join(gaps, "track_id", "left").join(onset, "track_id", "left")
            .join(bass, "track_id", "left"))
    regular = F.when((c("n_gaps") >= 2) & (c("gap") > 0), 1.0 - F.least(c("spread") / c("gap"), F.lit(1.0))).otherwise(0.0)
    bonus = F.when(c("bpm").between(118, 152), 1.0).when(c("bpm").between(100, 170), 0.08 / 0.15).otherwise(0.0)
    raw = (F.coalesce(regular, F.lit(0.0)) * 0.40 + F.least(F.coalesce("onset_period", F.lit(0.0)), F.lit(1.0)) * 0.30
           + F.coalesce("bass_period", F.lit(0.0)) * 0.20 + bonus * 0.10) * 100.0
    return rows.select("track_id", F.greatest(F.lit(0.0), F.least(raw, F.lit(100.0))).cast("int").alias("danceability"),
                       regular.alias("beat_regularity"), F.least(c("onset_period"), F.lit(1.0)).alias("onset_period"),
                       "bass_period")
