"""Sections of a track: novelty, phrase length, boundaries, energies and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import lineage
from segue.functions import tempo
from segue.operators import ordered, pairs, suppress

c = F.col

# fixed values
NOVELTY_WEIGHTS = {"novelty": 0.65, "bass_novelty": 0.20, "percussion_novelty": 0.15}
THRESHOLDS = (0.30, 0.25, 0.20, 0.15, 0.10)
MIN_SECTIONS = 3
MOST_BOUNDARIES = 11   # where the usual limit of twelve sections is wanted
MIN_SECTION_SECONDS = 8.0
PHRASE_LAGS = (8, 16, 32)
PHRASE_MIN_SCORE = 0.18
PHRASE_MIN_MARGIN = 0.08
PHRASE_PRIOR_BONUS = 0.03
HEAD_SECONDS = 360.0
TAIL_SECONDS = 180.0


def normalize_novelty(rows: DataFrame, curves: Sequence[str], spread: str, key: str = "track_id") -> DataFrame:
    """Shift every curve by its 10th percentile, scale by the 95th, clip to 0..1 (per track).

    One aggregate and one join for all curves: clipping at the 10th percentile keeps the
    order, so percentile and maximum of the shifted curve follow from those of the raw
    one (with two values only, the lower one is clipped and the percentile lies on the
    way from 0 to the upper one).
    """
    stats = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.max(v).alias(f"{v}_top") for v in curves])
    cuts = ordered.group_quantiles(rows, key, {v: {f"{v}_low": 0.10, f"{v}_high": 0.95} for v in curves}, spread)
    ends = stats.join(cuts, key).select(key, *[x for v in curves for x in (
        c(f"{v}_low"),
        F.when(c("n") == 2, (c(f"{v}_top") - c(f"{v}_low")) * 0.95).otherwise(c(f"{v}_high") - c(f"{v}_low")).alias(f"{v}_p95"),
        (c(f"{v}_top") - c(f"{v}_low")).alias(f"{v}_max"))])
    tiny = 2.220446049250313e-16

    def scaled(v: str) -> Column:
        scale = F.when(c(f"{v}_p95") > tiny, c(f"{v}_p95")).otherwise(c(f"{v}_max"))
        return F.when(scale > tiny, F.least(F.lit(1.0), F.greatest(c(v) - c(f"{v}_low"), F.lit(0.0)) / scale)).otherwise(0.0)

    return ordered.attach(rows, ends, key, spread).select(*[(scaled(n).alias(n) if n in curves else c(n)) for n in rows.columns])


def blend_novelty(frames: DataFrame) -> DataFrame:
    """Weighted mean of the three normalised novelty curves as ``novelty``."""
    rows = normalize_novelty(frames.select("track_id", "frame_idx", "t_sec", *NOVELTY_WEIGHTS), list(NOVELTY_WEIGHTS), "frame_idx")
    total = sum((c(n) * w for n, w in list(NOVELTY_WEIGHTS.items())[1:]), c("novelty") * NOVELTY_WEIGHTS["novelty"])
    return rows.select("track_id", "frame_idx", "t_sec", total.alias("novelty"))


def bar_novelty(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """Mean novelty per bar; bars without a frame inside the track count 0."""
    rows = ordered.attach(frames.select("track_id", "frame_idx", "t_sec", "novelty"),
                          tracks.select("track_id", "bpm", "anchor"), "track_id", "frame_idx")
    bar = F.floor((c("t_sec") - c("anchor")) / tempo.seconds_per_bar(c("bpm")))
    means = (rows.where(c("bpm") > 0).withColumn("bar", bar).where(c("bar") >= 0)
             .groupBy("track_id", "bar").agg(F.avg("novelty").alias("novelty")))
    spans = means.groupBy("track_id").agg(F.max("bar").alias("last"))
    every = spans.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), c("last"))).alias("bar"))
    return every.join(means, ["track_id", "bar"], "left").fillna(0.0, ["novelty"])


def phrase_unit(bars: DataFrame, tracks: DataFrame, genre: str = "genre") -> DataFrame:
    """Phrase length 8, 16 or 32 bars measured by self-similarity, NULL if unsure.

    Bars of a track are few; the lagged products come from one window over them.
    """
    curve = normalize_novelty(lineage.stored(bars), ["novelty"], "bar")
    mean = F.avg("novelty").over(Window.partitionBy("track_id"))   # bars of one track
    w = Window.partitionBy("track_id").orderBy("bar")
    centred = curve.select("track_id", "bar", (c("novelty") - mean).alias("x"))
    lagged = centred.select("track_id", "bar", "x", *[x for u in PHRASE_LAGS for x in (
        F.lead("x", u).over(w).alias(f"y{u}"), F.lead("bar", u).over(w).alias(f"b{u}"))])
    dots = lagged.groupBy("track_id").agg(F.sum(c("x") * c("x")).alias("variance"), F.count("*").alias("n_bars"), *[
        F.sum(F.when(c(f"b{u}") == c("bar") + u, c("x") * c(f"y{u}")).otherwise(0.0)).alias(f"d{u}") for u in PHRASE_LAGS])
    rows = tracks.select("track_id", pairs.mix_profile(c(genre))["phrase_unit"].alias("prior")).join(dots, "track_id")
    rows = rows.where((c("n_bars") >= 16) & (c("variance") > 2.220446049250313e-16))

    def usable(u):
        return c("n_bars") >= 2 * u + 8

    s8 = F.when(usable(8), c("d8") / c("variance"))
    rows = rows.withColumn("s8", s8)
    rows = rows.withColumn("s16", F.when(usable(16), c("d16") / c("variance") - F.greatest(F.lit(0.0), c("s8")) * 0.5))
    # the half-lag score of 32 is the discounted score of 16
    rows = rows.withColumn("s32", F.when(usable(32), c("d32") / c("variance") - F.greatest(F.lit(0.0), c("s16")) * 0.5))
    ranked = F.sort_array(F.array_compact(F.array(*[
        F.when(c(f"s{u}").isNotNull(), F.struct(
            (c(f"s{u}") + F.when(c("prior") == u, PHRASE_PRIOR_BONUS).otherwise(0.0)).alias("post"),
            F.lit(-u).alias("first"), c(f"s{u}").alias("score"))) for u in PHRASE_LAGS])), asc=False)
    rows = rows.withColumn("ranked", ranked)
    best, second = F.get(c("ranked"), F.lit(0)), F.get(c("ranked"), F.lit(1))
    sure = (F.size("ranked") >= 2) & (best["score"] >= PHRASE_MIN_SCORE) & (
        best["post"] - second["post"] >= PHRASE_MIN_MARGIN)
    return rows.select("track_id", "n_bars", "s8", "s16", "s32", F.when(sure, -best["first"]).alias("phrase_unit"))


def novelty_peaks(frames: DataFrame, block: int = 4096) -> DataFrame:
    """Frames higher than both neighbours, with their height relative to the track maximum."""
    top = frames.groupBy("track_id").agg(F.max("novelty").alias("top"), F.count("*").alias("n_frames"))
    cut = ordered.blockwise(frames.select("track_id", "frame_idx", "t_sec", "novelty"), "frame_idx", block, 1, 1)
    w = Window.partitionBy("track_id", "block").orderBy("frame_idx")
    near = cut.select("*", F.lag("novelty").over(w).alias("prev"), F.lead("novelty").over(w).alias("next"))
    peaks = near.where(c("own") & (c("novelty") > c("prev")) & (c("novelty") > c("next")))
    rows = ordered.attach(peaks.drop("block", "own", "prev", "next"), top, "track_id", "frame_idx")
    return rows.where((c("top") > 0) & (c("n_frames") >= 4)).select(
        "track_id", "frame_idx", "t_sec", (c("novelty") / c("top")).alias("height"))


def pick_boundaries(frames: DataFrame, tracks: DataFrame, most: int | None = None) -> DataFrame:
    """Section starts of every track as a sorted array, 0 first.

    Peaks are taken strongest first, each at least the minimum distance from
    those taken, at most ``most`` if given.  The selection at a lower threshold extends the
    one at a higher threshold, so one greedy pass serves all thresholds: the
    first threshold that leaves two boundaries decides.  Peaks are never gathered by track,
    only the boundaries that are taken.
    """
    first_two = frames.where(c("frame_idx") <= 1).groupBy("track_id").agg(
        (F.max("t_sec") - F.min("t_sec")).alias("dt"))
    distance = F.greatest(F.lit(MIN_SECTION_SECONDS), tempo.seconds_per_bar(c("bpm")) * c("phrase_unit"))
    limits = tracks.join(first_two, "track_id").select(
        "track_id", F.greatest(F.lit(1), F.floor(distance / c("dt"))).alias("apart"))
    peaks = ordered.attach(novelty_peaks(frames).where(c("height") >= THRESHOLDS[-1]), limits, "track_id", "frame_idx")
    taken = suppress.strongest_apart(peaks.withColumn("back", -c("frame_idx")), "track_id", "frame_idx", "apart", ["height", "back"], ["t_sec"])
    if most is not None:
        strongest = Window.partitionBy("track_id").orderBy(F.desc("height"), F.desc("back"))
        taken = taken.withColumn("place", F.row_number().over(strongest)).where(c("place") <= most)
    choice = F.lit(THRESHOLDS[-1])
    for threshold in reversed(THRESHOLDS):
        choice = F.when(c(f"over_{THRESHOLDS.index(threshold)}") >= MIN_SECTIONS - 1, F.lit(threshold)).otherwise(choice)
    counts = taken.groupBy("track_id").agg(*[F.count_if(c("height") >= t).alias(f"over_{i}") for i, t in enumerate(THRESHOLDS)])
    chosen = counts.select("track_id", choice.alias("threshold"))
    times = (taken.join(chosen, "track_id").where(c("height") >= c("threshold")).groupBy("track_id")
             .agg(F.sort_array(F.collect_list("t_sec")).alias("times")))
    rows = limits.select("track_id").join(times, "track_id", "left").withColumn("times", F.coalesce("times", F.array().cast("array<double>")))
    early = F.get(c("times"), F.lit(0)) <= 1.0
    return rows.select("track_id", F.when(F.coalesce(early, F.lit(False)), F.concat(
        F.array(F.lit(0.0)), F.slice("times", F.lit(2), F.greatest(F.size("times") - 1, F.lit(0)))))
        .otherwise(F.concat(F.array(F.lit(0.0)), c("times"))).alias("boundaries"))


def quantize_boundaries(rows: DataFrame) -> DataFrame:
    """Snap boundaries to the phrase grid, at least two bars apart.

    ``rows``: track_id, boundaries, bpm, duration, phrase_unit, anchor.
    """
    bar = tempo.seconds_per_bar(c("bpm"))
    width = bar * c("phrase_unit")
    snapped = F.array_sort(F.array_distinct(F.transform("boundaries", lambda t: F.greatest(F.lit(0.0), F.least(
        F.rint((t - c("anchor")) / width) * width + c("anchor"), c("duration"))))))
    spaced = F.aggregate(
        c("snapped"), F.array().cast("array<double>"),
        lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= c("bar_s") * 2.0),
                              F.concat(acc, F.array(t))).otherwise(acc))
    return (rows.withColumns({"bar_s": bar, "snapped": snapped})
            .withColumn("boundaries", F.when(c("bpm") > 0, spaced).otherwise(c("boundaries")))
            .drop("bar_s", "snapped"))


def rms_boundaries(frames: DataFrame, tracks: DataFrame) -> DataFrame:
    """Fallback boundaries: start, first and last loud frame, on the phrase grid."""
    mean = frames.groupBy("track_id").agg(F.avg("rms").alias("mean_rms"))
    loud = ordered.attach(frames.select("track_id", "frame_idx", "t_sec", "rms"), mean, "track_id", "frame_idx") \
        .where(c("rms") > c("mean_rms") * 0.40).groupBy("track_id").agg(
        F.min("t_sec").alias("first_loud"), F.max("t_sec").alias("last_loud"))
    rows = tracks.join(loud, "track_id", "left")
    edge = tempo.seconds_per_bar(c("bpm")) * c("phrase_unit") * 2.0
    start = F.when(c("first_loud") <= c("duration") * 0.35, c("first_loud")).otherwise(edge)
    stop = F.when(c("last_loud") >= c("duration") * 0.65, c("last_loud")).otherwise(c("duration") - edge)
    rows = rows.withColumn("boundaries", F.array(F.lit(0.0), start, stop))
    return quantize_boundaries(rows).select("track_id", "boundaries")


def section_spans(rows: DataFrame) -> DataFrame:
    """Long form of boundaries: (track_id, section_idx, start_time, end_time, duration, n_sections)."""
    kept = F.filter("boundaries", lambda b: b < c("duration") - 0.001)
    clean = F.when(F.size(kept) > 0, F.concat(F.array(F.lit(0.0)), F.slice(kept, F.lit(2), F.greatest(
        F.size(kept) - 1, F.lit(0))))).otherwise(F.array(F.lit(0.0)))
    flat = rows.withColumn("starts", clean).select(
        "track_id", "duration", "starts", F.size("starts").alias("n_sections"),
        F.posexplode("starts").alias("section_idx", "start_time"))
    return flat.select("track_id", "section_idx", "start_time", F.coalesce(
        F.get(c("starts"), c("section_idx") + 1), c("duration")).alias("end_time"), "duration", "n_sections")


def section_stats(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Energy 0..100 and trend of every section from its frames.

    Sections partition the track, so the section of a frame is the number of
    section starts before it: each frame stays one row.
    """
    starts = spans.groupBy("track_id").agg(F.sort_array(F.collect_list("start_time")).alias("starts"))
    rows = ordered.attach(frames.select("track_id", "frame_idx", "t_sec", "rms"), starts, "track_id", "frame_idx")
    at = F.size(F.filter("starts", lambda s: s <= c("t_sec"))) - 1
    rows = rows.select("track_id", "t_sec", (c("rms") * c("rms")).alias("power"), "starts", at.alias("section_idx")) \
        .where(c("section_idx") >= 0)
    # halves are cut at the middle of the section, so partial sums per (section, half) suffice
    nxt = F.get(c("starts"), c("section_idx") + 1)
    rows = rows.withColumn("start_time", F.get(c("starts"), c("section_idx"))).withColumn("next_start", nxt)
    last = spans.groupBy("track_id").agg(F.first("duration").alias("duration"))
    rows = ordered.attach(rows.withColumn("spread", F.floor(c("t_sec")).cast("long")), last, "track_id", "spread")
    middle = (c("start_time") + F.coalesce("next_start", "duration")) / 2.0
    parts = rows.groupBy("track_id", "section_idx").agg(
        F.sum("power").alias("power"), F.count("*").alias("n"),
        F.avg(F.when(c("t_sec") < middle, c("power"))).alias("first_half"),
        F.avg(F.when(c("t_sec") >= middle, c("power"))).alias("second_half"))
    whole = parts.groupBy("track_id").agg((F.sum("power") / F.sum("n")).alias("track_power"))
    out = spans.join(parts, ["track_id", "section_idx"], "left").join(whole, "track_id", "left")
    scale = F.greatest(F.lit(0.4), F.sqrt("track_power") * 1.6)
    energy = F.coalesce(F.least(F.lit(100.0), F.sqrt(c("power") / c("n")) / scale * 100.0), F.lit(0.0))
    ratio = F.sqrt(c("second_half")) / F.sqrt(c("first_half"))
    trend = (F.when(c("end_time") - c("start_time") < 1.0, "stable")
             .when(c("first_half") == 0, F.when(c("second_half") > 0, "rising").otherwise("stable"))
             .when(ratio > 1.3, "rising").when(ratio < 0.7, "falling").otherwise("stable"))
    return out.select("track_id", "section_idx", "n_sections", "start_time", "end_time", "duration",
                      energy.alias("avg_energy"), trend.alias("trend"))


def label_sections(stats: DataFrame) -> DataFrame:
    """intro / outro / drop / build / breakdown / main for every section."""
    whole = Window.partitionBy("track_id")
    w = whole.orderBy("section_idx")
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e, n, i = c("avg_energy"), c("n_sections"), c("section_idx")
    rows = stats.withColumns({"mean": F.avg("avg_energy").over(whole), "top": F.max("avg_energy").over(whole)})
    soft = c("top") * 0.85
    low = e < c("mean") * 0.6
    opening = low | ((c("trend") == "rising") & (e < soft)) | (
        (n >= 3) & (e < soft) & (c("start_time") < c("duration") * 0.15))
    closing = (n > 1) & (low | (c("trend") == "falling") | ((e < soft) & (c("start_time") > c("duration") * 0.8)))
    rows = rows.withColumns({"has_intro": F.first(opening).over(full), "has_outro": F.last(closing).over(full)})
    intro = c("has_intro") & ((i == 0) | ((i == 1) & (n > 2) & (c("start_time") < c("duration") * 0.25) & (
        (e < c("mean")) | (c("trend") == "rising") | (e < soft))))
    outro = c("has_outro") & ((i == n - 1) | ((i == n - 2) & (n > 2) & (c("start_time") > c("duration") * 0.75) & (
        (e < c("mean")) | (c("trend") == "falling") | (e < soft))))
    rows = rows.withColumn("base", F.when(outro, "outro").when(intro, "intro")
                           .when((e >= c("mean") * 1.2) & (e > 0), "drop").otherwise("main"))
    # a build needs a following drop, a breakdown a preceding one; builds are named first
    rows = rows.withColumns({"next_base": F.lead("base").over(w), "prev_base": F.lag("base").over(w)})
    label = (F.when((c("base") == "main") & (c("next_base") == "drop") & (c("trend") == "rising"), "build")
             .when((c("base") == "main") & (c("prev_base") == "drop") & (e < c("mean") * 0.8), "breakdown")
             .otherwise(c("base")))
    return rows.select("track_id", "section_idx", "n_sections", "start_time", "end_time", "duration", "avg_energy",
                       "trend", label.alias("label"))


def assemble_sections(labelled: DataFrame, tracks: DataFrame) -> DataFrame:
    """One row per track with its ordered sections, bars and total bars."""
    rows = labelled.join(tracks.select("track_id", "bpm"), "track_id")
    bar = tempo.seconds_per_bar(c("bpm"))
    entry = F.struct(
        "section_idx", "label", F.bround("start_time", 2).alias("start_time"), F.bround("end_time", 2).alias("end_time"),
        F.rint(c("start_time") / bar).cast("int").alias("start_bar"), F.rint(c("end_time") / bar).cast("int").alias("end_bar"),
        F.bround("avg_energy", 1).alias("avg_energy"))
    return rows.groupBy("track_id").agg(
        F.sort_array(F.collect_list(entry)).alias("sections"),
        F.floor(F.first("duration") / F.first(bar)).cast("int").alias("total_bars"))


def merge_windows(head: DataFrame, tail: DataFrame, tracks: DataFrame) -> DataFrame:
    """Join sections of the first and the last stretch of a long track on one time axis.

    ``head`` and ``tail``: track_id, section_idx, label, start_time, end_time,
    avg_energy, times relative to their stretch.  ``tracks``: track_id, bpm,
    duration, head_duration, tail_duration (NULL or 0 if the end could not be
    read).  The stretch in between becomes an ``unanalysed`` section.
    """
    info = tracks.select("track_id", "bpm", "duration", F.least("head_duration", "duration").alias("head_end"),
                         F.coalesce("tail_duration", F.lit(0.0)).alias("tail_s"))
    info = info.withColumns({"short": c("duration") <= c("head_end") + 1.0,
                             "tail_start": F.greatest(c("head_end"), c("duration") - TAIL_SECONDS)})
    h = head.join(info, "track_id").where(c("short") | (c("tail_s") <= 0) | (c("start_time") < c("tail_start")))
    h = h.select("track_id", F.lit(0).alias("part"), "section_idx",
                 F.when(~c("short") & (c("label") == "outro"), "main").otherwise(c("label")).alias("label"),
                 "start_time", F.least("end_time", "head_end").alias("end_time"), "avg_energy")
    gap_end = F.when(c("tail_s") > 0, c("tail_start")).otherwise(c("duration"))
    gap = info.where(~c("short") & ((c("tail_s") <= 0) | (c("tail_start") > c("head_end") + 1.0))).select(
        "track_id", F.lit(1).alias("part"), F.lit(0).alias("section_idx"), F.lit("unanalysed").alias("label"),
        F.bround("head_end", 2).alias("start_time"), F.bround(gap_end, 2).alias("end_time"), F.lit(0.0).alias("avg_energy"))
    t = tail.join(info, "track_id").where(~c("short") & (c("tail_s") > 0)).select(
        "track_id", F.lit(2).alias("part"), "section_idx",
        F.when(c("label") == "intro", "main").otherwise(c("label")).alias("label"),
        F.bround(c("start_time") + c("tail_start"), 2).alias("start_time"),
        F.bround(c("end_time") + c("tail_start"), 2).alias("end_time"), "avg_energy")
    rows = h.unionByName(gap).unionByName(t)
    order = Window.partitionBy("track_id").orderBy("part", "section_idx")
    merged = rows.withColumn("section_idx", (F.row_number().over(order) - 1).cast("long")).drop("part")
    covered = info.select("track_id", (c("short") | ((c("tail_s") > 0) & (
        F.least(c("duration"), c("tail_start") + c("tail_s")) >= c("duration") - 1.0))).alias("outro_covered"))
    return merged.join(covered, "track_id")
