"""Where bars and phrases begin: votes of beats and bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import vectors
from segue.operators import ordered

c = F.col
# fixed values
TRIM_RATIO = 0.3
WEIGHTS = {"bass": 1.0, "novelty": 1.0, "accent": 0.5}
PHRASE_WEIGHTS = {"bass": 1.0, "novelty": 1.0, "rise": 0.75}
MIN_BEATS = 16
MARGIN_CAP = 2.0 / 3.0
FOLD_BINS = 1024
ATTACK_FRACTION = 0.15
GRID_TEMPO_TOLERANCE = 0.10
SELF_ESTIMATE_MAX = 0.99
REFERENCE_PHRASE = 8
SUBPERIOD_MIN_CORRELATION = 0.70


def commensurate(grid_ibi: Column, expected: Column) -> Column:
    """Does a tracked beat grid sit on the expected one, multiples and divisors included."""
    ratio = grid_ibi / expected
    k = F.when(ratio >= 1.0, F.rint(ratio)).otherwise(F.rint(1.0 / ratio))
    fitted = F.when(ratio >= 1.0, ratio / k).otherwise(ratio * k)
    return F.coalesce((grid_ibi > 0) & (expected > 0) & (k >= 1) & (F.abs(fitted - 1.0) <= GRID_TEMPO_TOLERANCE),
                      F.lit(False))


def chroma_change(beats: DataFrame, key: str = "beat_idx") -> DataFrame:
    """Cosine distance of the mean chroma before and after each beat (or bar).

    ``chroma`` is the mean between this beat and the next; the previous one
    comes by an equi-join.
    """
    before = beats.select("track_id", (c(key) + 1).alias(key), c("chroma").alias("chroma_before"))
    rows = beats.join(before, ["track_id", key], "left")
    na, nb = F.sqrt(vectors.dot(c("chroma"), c("chroma"))), F.sqrt(vectors.dot(c("chroma_before"), c("chroma_before")))
    change = 1.0 - vectors.dot(c("chroma"), c("chroma_before")) / (na * nb)
    return rows.withColumn("novelty", F.coalesce(F.when((na > 1e-9) & (nb > 1e-9), change), F.lit(0.0))) \
        .drop("chroma_before")


def _z(name: str, stats: str) -> Column:
    return F.when(c(f"{stats}_std") < 1e-9, 0.0).otherwise((c(name) - c(f"{stats}_avg")) / c(f"{stats}_std"))


def _moments(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.groupBy("track_id").agg(*[x for n in names for x in (
        F.avg(n).alias(f"{n}_avg"), F.stddev_pop(n).alias(f"{n}_std"))])


def vote_downbeat(beats: DataFrame, tracks: DataFrame, block: int = 4096) -> DataFrame:
    """Bar phase of every track by a vote of its beats over four bins.

    ``beats``: track_id, beat_idx, beat_time, bass, loudness, chroma.  Quiet
    beats do not vote.  Result: first_downbeat within the first bar and the
    scaled margin of the vote; no row where the material is too thin or the
    beat grid does not fit the tempo.
    """
    span = beats.groupBy("track_id").agg(
        F.count("*").alias("n_beats"), F.min("beat_time").alias("t0"), F.max("beat_time").alias("t1"),
        F.max("loudness").alias("loudest"))
    info = tracks.select("track_id", "bpm").join(span, "track_id")
    fits = commensurate((c("t1") - c("t0")) / (c("n_beats") - 1), F.lit(60.0) / c("bpm"))
    info = info.where((c("bpm") > 0) & (c("n_beats") >= MIN_BEATS) & (c("loudest") >= 1e-9)).where(fits)
    cut = ordered.blockwise(chroma_change(beats), "beat_idx", block, 2, 2)
    around = Window.partitionBy("track_id", "block").orderBy("beat_idx").rowsBetween(-2, 2)
    rows = cut.withColumn("accent", c("loudness") - F.avg("loudness").over(around)).where(c("own")).drop("block", "own")
    rows = ordered.attach(rows, info.select("track_id", "bpm", "loudest"), "track_id", "beat_idx")
    rows = rows.where(c("loudness") >= c("loudest") * TRIM_RATIO)
    stats = _moments(rows, list(WEIGHTS))
    enough = rows.groupBy("track_id").agg(F.count("*").alias("n_valid")).where(c("n_valid") >= MIN_BEATS)
    rows = ordered.attach(rows, stats.join(enough, "track_id"), "track_id", "beat_idx")
    vote = reduce(lambda x, y: x + y, [_z(n, n) * w for n, w in WEIGHTS.items()])
    bar = F.lit(60.0) / c("bpm") * float(R.METER)
    angle = F.pmod(c("beat_time"), bar) / bar * (2.0 * 3.141592653589793)
    bins = rows.withColumns({"vote": vote, "phase": F.pmod("beat_idx", F.lit(4)), "angle": angle}) \
        .groupBy("track_id", "phase").agg(
        F.sum("vote").alias("votes"), F.count("*").alias("n"), F.first("bpm").alias("bpm"),
        F.avg(F.sin("angle")).alias("s"), F.avg(F.cos("angle")).alias("k"))
    seeds = beats.where(c("beat_idx") < 4).select("track_id", c("beat_idx").alias("phase"), c("beat_time").alias("seed"))
    bins = bins.join(seeds, ["track_id", "phase"], "left")
    voted = bins.groupBy("track_id").agg(
        F.first("bpm").alias("bpm"), F.sum(F.abs("votes")).alias("spread"), F.count("*").alias("n_bins"),
        F.sort_array(F.collect_list(F.struct("votes", (-c("phase")).alias("back"), "n", "s", "k", "seed")), asc=False)
        .alias("ranked"))
    best, second = F.get(c("ranked"), F.lit(0)), F.get(c("ranked"), F.lit(1))
    circle = 2.0 * 3.141592653589793
    mean = F.pmod(F.atan2(best["s"], best["k"]), F.lit(circle)) * bar / circle
    start = F.when(best["n"] >= 2, mean).otherwise(F.pmod(best["seed"], bar))
    # bins without a beat hold 0 votes and may be second
    runner_up = F.when(c("n_bins") < 4, F.greatest(second["votes"], F.lit(0.0))).otherwise(second["votes"])
    margin = F.when(c("spread") < 1e-9, 0.0).otherwise((best["votes"] - runner_up) / c("spread"))
    return voted.select("track_id", (-best["back"]).alias("phase"), start.alias("bar_start"),
                        F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin / MARGIN_CAP)).alias("bar_confidence"))


def fold_beat_phase(envelope: DataFrame, tracks: DataFrame, bins: int = FOLD_BINS) -> DataFrame:
    """Position of the attack inside a beat: envelope folded on one beat.

    ``envelope``: track_id, frame_idx, t_sec, level.  The attack is the last bin
    before the peak at or under 15 % of the rise.
    """
    rows = ordered.attach(envelope.select("track_id", "frame_idx", "t_sec", "level"),
                          tracks.where(c("bpm") > 0).select("track_id", "bpm"), "track_id", "frame_idx")
    ibi = F.lit(60.0) / c("bpm")
    slot = F.least(F.floor(F.pmod(c("t_sec"), ibi) / ibi * bins), F.lit(bins - 1)).cast("int")
    folded = rows.withColumn("slot", slot).groupBy("track_id", "slot").agg(
        F.avg("level").alias("level"), F.first("bpm").alias("bpm"))
    packed = folded.groupBy("track_id").agg(F.first("bpm").alias("bpm"), F.map_from_entries(
        F.collect_list(F.struct("slot", "level"))).alias("levels"))
    every = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                        lambda i: F.coalesce(F.try_element_at("levels", i), F.lit(0.0)))
    packed = packed.select("track_id", "bpm", every.alias("profile"))
    packed = packed.withColumns({"top": F.array_max("profile"), "floor": F.array_min("profile")})
    packed = packed.withColumn("peak", F.array_position("profile", c("top")) - 1)
    limit = c("floor") + (c("top") - c("floor")) * ATTACK_FRACTION
    back = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda s: F.get(
        c("profile"), F.pmod(c("peak") - s, F.lit(bins)).cast("int")) <= limit))
    attack = F.pmod(c("peak") - F.coalesce(back, F.lit(0)), F.lit(bins))
    return packed.where(c("top") > 1e-12).select(
        "track_id", (attack / float(bins) * (F.lit(60.0) / c("bpm"))).alias("beat_phase"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c("top") - c("floor")) / c("top"))).alias("lock"))


def first_downbeat(votes: DataFrame, folds: DataFrame, tracks: DataFrame) -> DataFrame:
    """Voted bar start, moved to the folded beat phase; confidence is the weaker of the two."""
    rows = votes.join(folds, "track_id").join(tracks.select("track_id", "bpm"), "track_id")
    ibi = F.lit(60.0) / c("bpm")
    t = F.pmod(c("beat_phase") + F.rint((c("bar_start") - c("beat_phase")) / ibi) * ibi, ibi * float(R.METER))
    sure = F.least(F.least("bar_confidence", "lock"), F.lit(SELF_ESTIMATE_MAX))
    return rows.select("track_id", F.bround(t, 4).alias("first_downbeat"), F.bround(sure, 3).alias("downbeat_confidence"))


def vote_phrase(bars: DataFrame, tracks: DataFrame) -> DataFrame:
    """Phrase phase of every track by a vote of its bars over phrase_unit bins.

    ``bars``: track_id, bar, bass, novelty, rise (loudness gained, never
    negative).  ``tracks``: track_id, bpm, phrase_unit, anchor.  A phrase that
    repeats at half its length is folded.
    """
    n = bars.groupBy("track_id").agg(F.count("*").alias("n_bars"))
    info = tracks.select("track_id", "bpm", "phrase_unit", "anchor").join(n, "track_id") \
        .where((c("bpm") > 0) & (c("phrase_unit") > 1) & (c("n_bars") >= c("phrase_unit") * 2))
    rows = bars.join(_moments(bars, list(PHRASE_WEIGHTS)), "track_id").join(info, "track_id")
    vote = reduce(lambda x, y: x + y, [_z(k, k) * w for k, w in PHRASE_WEIGHTS.items()])
    bins = rows.withColumns({"vote": vote, "bin": F.pmod("bar", c("phrase_unit"))}).groupBy("track_id", "bin").agg(
        F.sum("vote").alias("v"), F.first("phrase_unit").alias("phrase_unit"), F.first("bpm").alias("bpm"),
        F.first("anchor").alias("anchor"))
    packed = bins.groupBy("track_id").agg(
        F.first("phrase_unit").alias("phrase_unit"), F.first("bpm").alias("bpm"), F.first("anchor").alias("anchor"),
        F.map_from_entries(F.collect_list(F.struct(c("bin").cast("int"), "v"))).alias("by_bin"))
    packed = packed.withColumn("votes", F.transform(F.sequence(F.lit(0), c("phrase_unit") - 1),
                                                    lambda i: F.coalesce(F.try_element_at("by_bin", i.cast("int")), F.lit(0.0))))
    for _ in range(2):
        half = (F.size("votes") / 2).cast("int")
        turned = F.concat(F.slice("votes", half + 1, half), F.slice("votes", F.lit(1), half))
        energy = vectors.dot(c("votes"), c("votes"))
        folds = (F.size("votes") >= 2 * REFERENCE_PHRASE) & (energy >= 1e-12) & (
            vectors.dot(c("votes"), turned) / energy >= SUBPERIOD_MIN_CORRELATION)
        packed = packed.withColumn("votes", F.when(folds, F.zip_with(
            F.slice("votes", F.lit(1), half), F.slice("votes", half + 1, half), lambda x, y: x + y)).otherwise(c("votes")))
    ranked = F.sort_array("votes", asc=False)
    spread = F.aggregate("votes", F.lit(0.0), lambda acc, v: acc + F.abs(v))
    margin = (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))) / spread * F.size("votes") / float(REFERENCE_PHRASE)
    best = F.array_position("votes", F.array_max("votes")) - 1
    bar = F.lit(60.0) / c("bpm") * float(R.METER)
    return packed.select(
        "track_id", F.size("votes").alias("n_bins"), F.bround(F.pmod(c("anchor"), bar) + best * bar, 4).alias("first_phrase"),
        F.when(spread < 1e-9, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), margin)), 3))
        .alias("phrase_confidence"))
