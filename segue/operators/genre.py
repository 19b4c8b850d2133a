"""Genre of a track from its tag or from spectral and rhythmic features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import text

c = F.col
# fixed values: weights of the five scores
WEIGHTS = {"bpm": 0.35, "centroid": 0.20, "rhythm": 0.20, "dynamics": 0.15, "bass": 0.10}


def genre_features(frames: DataFrame) -> DataFrame:
    """Centroid, flatness and relative RMS variance per track (one partial aggregate).

    The small flatness values are added up exactly, so the mean does not depend on the order of tasks.
    """
    return frames.groupBy("track_id").agg(
        F.avg("centroid").alias("centroid"), F.avg(c("flatness").cast("decimal(20,12)")).cast("double").alias("flatness"),
        F.coalesce(F.var_pop("rms") / (F.avg("rms") * F.avg("rms")), F.lit(0.0)).alias("rms_variance"))


def range_score(value: Column, low: float, high: float, centre: float | None = None) -> Column:
    """1 at the centre, 0.8 at the edge, falling outside, 0 beyond two widths."""
    middle = (low + high) / 2.0 if centre is None else float(centre)
    d = F.abs(value - middle) / float(high - low)
    return (F.when(d <= 0.5, 1.0 - d * 0.4).when(d <= 1.0, 0.8 - (d - 0.5) * 1.2)
            .when(d <= 2.0, F.exp(-(d - 1.0)) * 0.2).otherwise(0.0))


def genre_scores(rows: DataFrame) -> DataFrame:
    """Array of (score, order, genre) over all genre profiles.

    ``rows``: bpm, centroid, onset_rate, flatness, rms_variance, bass_intensity.
    """
    scored = []
    for i, (name, (bpm, centre, centroid, onset, flat, var, bass)) in enumerate(R.GENRE_PROFILES.items()):
        total = (range_score(c("bpm"), *bpm, centre) * WEIGHTS["bpm"] + range_score(c("centroid"), *centroid) * WEIGHTS["centroid"]
                 + (range_score(c("onset_rate"), *onset) + range_score(c("flatness"), *flat)) / 2.0 * WEIGHTS["rhythm"]
                 + range_score(c("rms_variance"), *var) * WEIGHTS["dynamics"]
                 + range_score(c("bass_intensity").cast("double"), *bass) * WEIGHTS["bass"])
        total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
        if name == "Drum & Bass":
            total = F.when(c("bpm") < R.DNB_MINIMUM_BPM, total * R.DNB_LOW_BPM_PENALTY).otherwise(total)
        scored.append(F.struct(total.alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("genre")))
    return rows.withColumn("scores", F.sort_array(F.array(*scored), asc=False))


def classify_genre(rows: DataFrame, tag: str = "genre") -> DataFrame:
    """Genre, confidence and source.  Tagged tracks skip the scoring entirely."""
    tagged = rows.withColumn("tag_genre", text.match_genre_tag(c(tag)))
    known = tagged.where(c("tag_genre").isNotNull()).select(
        "track_id", c("tag_genre").alias("detected_genre"), F.lit(1.0).alias("genre_confidence"),
        F.lit("id3_tag").alias("genre_source"))
    rest = genre_scores(tagged.where(c("tag_genre").isNull()))
    best, second = F.get(c("scores"), F.lit(0)), F.get(c("scores"), F.lit(1))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), best["score"] * 0.6 + (best["score"] - second["score"]) * 2.0 * 0.4))
    heard = rest.withColumn("sure", sure).select(
        "track_id", F.when(c("sure") < R.GENRE_CONFIDENCE_MIN, "Unknown").otherwise(best["genre"]).alias("detected_genre"),
        F.when(c("sure") < R.GENRE_CONFIDENCE_MIN, c("sure")).otherwise(F.bround("sure", 3)).alias("genre_confidence"),
        F.lit("audio_analysis").alias("genre_source"))
    return known.unionByName(heard)
