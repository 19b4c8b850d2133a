"""Mix-in and mix-out points: per track, from energy, from cues, and per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue import lineage
from segue import refdata as R
from segue.functions import grid, sections, tempo
from segue.operators import ordered
from segue.operators.pairs import mix_profile

EPS = 1e-9
NO_MIX_LABELS = ("intro", "outro", "unanalysed")
# fixed values: preferred labels, first is best
MIX_IN_ORDER = {"build": 0, "main": 1, "breakdown": 2, "drop": 3}
MIX_OUT_ORDER = {"main": 0, "breakdown": 1, "build": 2, "drop": 3}
CUE_IN = r"\b(MIX[- ]?IN|IN|START)\b"
CUE_OUT = r"\b(MIX[- ]?OUT|OUT|OUTRO|END)\b"


def clamp_low(value: Column, low: Column | float) -> Column:
    return F.greatest(value, F.lit(low) if isinstance(low, float) else low)


def snap_pair(t_in: Column, t_out: Column, bpm: Column, duration: Column, unit: Column, anchor: Column,
              eps: float = 1e-6) -> tuple[Column, Column]:
    """Snap a pair of points to the phrase grid, else the bar grid, else keep it."""
    bar = tempo.seconds_per_bar(bpm)
    phrase = bar * F.when(unit > 0, unit).otherwise(8)
    snapped = [(grid.quantize_to_grid(t_in - eps, g, anchor, "ceil"),
                grid.quantize_to_grid(t_out + eps, g, anchor, "floor")) for g in (phrase, bar)]
    usable = [(i >= 0) & (i < o) & (o <= duration) for i, o in snapped]
    return (F.when(usable[0], snapped[0][0]).when(usable[1], snapped[1][0]).otherwise(t_in),
            F.when(usable[0], snapped[0][1]).when(usable[1], snapped[1][1]).otherwise(t_out))


def align_points(tracks: DataFrame, t_in: str = "mix_in_point", t_out: str = "mix_out_point") -> DataFrame:
    """Snap externally given points; impossible input stays as it is."""
    i, o = F.col(t_in), F.col(t_out)
    a_in, a_out = snap_pair(i, o, F.col("bpm"), F.col("duration"), F.col("phrase_unit"), F.col("anchor"))
    valid = (F.col("bpm") > 0) & (F.col("duration") > 0) & (i >= 0) & (i < o) & (o <= F.col("duration"))
    return tracks.withColumns({"aligned_in": F.when(valid, a_in).otherwise(i),
                               "aligned_out": F.when(valid, a_out).otherwise(o)})


def _best_start(secs: Column, intro: Column) -> Column:
    """Start of the best section to mix into: early, by label, then earliest."""
    track_end = F.array_max(F.transform(secs, lambda s: s["end_time"]))
    limit = F.greatest(intro, track_end * 0.40)
    mean = F.aggregate(secs, F.lit(0.0), lambda acc, s: acc + s["avg_energy"]) / F.size(secs)
    usable = F.filter(secs, lambda s: (s["start_time"] >= intro) & ~s["label"].isin(*NO_MIX_LABELS))
    early = F.filter(usable, lambda s: s["start_time"] <= limit)
    chosen = F.when(F.size(early) > 0, early).otherwise(usable)
    ranked = F.array_min(F.transform(chosen, lambda s: F.struct(
        F.coalesce(R.lookup(MIX_IN_ORDER, s["label"]), F.lit(99)).alias("rank"), s["start_time"].alias("t"),
        F.abs(s["avg_energy"] - mean * 0.75).alias("gap"))))
    return ranked["t"]


def _best_end(secs: Column, outro: Column) -> Column:
    usable = F.filter(secs, lambda s: (s["end_time"] <= outro) & ~s["label"].isin(*NO_MIX_LABELS))
    return F.array_max(F.transform(usable, lambda s: s["end_time"]))


def track_mix_points(tracks: DataFrame, genre: str = "detected_genre") -> DataFrame:
    """Genre-aware mix points of every track from its sections.

    Needs bpm, duration, sections, anchor, first_downbeat and a genre; adds
    ``mix_in``, ``mix_out``, ``mix_in_bars`` and ``mix_out_bars``.  Every guard
    is a column of its own step.
    """
    c = F.col
    dur, bar, phrase, anchor = c("duration"), c("bar_s"), c("phrase_s"), c("anchor")
    q = grid.quantize_to_grid
    steps = (
        tracks
        .withColumn("bar_s", tempo.seconds_per_bar(c("bpm")))
        .withColumn("phrase_s", c("bar_s") * mix_profile(c(genre))["phrase_unit"])
        .withColumns({"intro_end": sections.intro_end(c("sections")),
                      "outro_start": sections.outro_start(c("sections"), dur)})
        .withColumns({"best_start": _best_start(c("sections"), c("intro_end")),
                      "best_end": _best_end(c("sections"), c("outro_start"))}))
    intro, outro = c("intro_end"), c("outro_start")
    raw_in = F.when(c("best_start").isNull(), F.greatest(intro, q(intro, phrase, anchor))).otherwise(
        F.greatest(q(c("best_start"), phrase, anchor, "ceil"), intro))
    floor_end = q(c("best_end"), phrase, anchor, "floor")
    before_outro = F.when((outro < dur) & (floor_end >= outro), q(outro - phrase, phrase, anchor, "floor")) \
        .otherwise(floor_end)
    raw_out = F.greatest(F.lit(0.0), F.least(
        F.when(c("best_end").isNull(), q(outro, phrase, anchor, "floor")).otherwise(before_outro), outro))
    steps = (steps.withColumns({"in0": raw_in, "out0": raw_out})
             .withColumns({"in1": q(c("in0"), phrase, anchor, "ceil"), "out1": q(c("out0"), phrase, anchor, "floor"),
                           "low": F.greatest(intro, c("first_downbeat") + phrase),
                           "high": F.least(outro, dur - phrase), "window": phrase * 2.0})
             .withColumn("roomy", (c("high") - c("low")) >= c("window"))
             .withColumn("in2", F.greatest(c("low"), F.least(c("in1"), c("high") - c("window"))))
             .withColumn("out2", F.greatest(c("in2") + c("window"), F.least(c("out1"), c("high"))))
             .withColumn("grid_out", q(c("out2") + EPS, phrase, anchor, "floor"))
             .withColumn("out3", F.when(c("grid_out") - c("in2") >= c("window"), c("grid_out")).otherwise(c("out2")))
             .withColumn("grid_in", q(c("in2") - EPS, phrase, anchor, "ceil"))
             .withColumn("in3", F.when(c("out3") - c("grid_in") >= c("window"), c("grid_in")).otherwise(c("in2")))
             .withColumns({
                 "in4": F.when(c("roomy"), c("in3")).otherwise(F.greatest(intro, dur * 0.15)),
                 "out4": F.when(c("roomy"), c("out3")).otherwise(F.least(outro - bar, dur * 0.85))})
             .withColumns({
                 "alt_in": F.greatest(intro, dur * 0.15),
                 "alt_out": F.least(F.greatest(outro - bar, F.lit(0.0)), dur * 0.85)})
             .withColumns({
                 "in5": F.when(c("out4") > c("in4"), c("in4"))
                 .when(c("alt_out") > c("alt_in"), c("alt_in")).otherwise(dur * 0.15),
                 "out5": F.when(c("out4") > c("in4"), c("out4"))
                 .when(c("alt_out") > c("alt_in"), c("alt_out")).otherwise(dur * 0.85)}))
    final_in, final_out = snap_pair(c("in5"), c("out5"), c("bpm"), dur, mix_profile(c(genre))["phrase_unit"], anchor, EPS)
    usable = (F.size("sections") > 0) & (c("bpm") > 0) & (dur > 0) & (dur < float("inf")) & (c("bpm") < float("inf"))
    keep = [c(name) for name in tracks.columns]
    return (steps.select(*keep,
                         F.when(usable, final_in).otherwise(0.0).alias("mix_in"),
                         F.when(usable, final_out).when(dur > 0, dur).otherwise(0.0).alias("mix_out"),
                         usable.alias("usable"))
            .withColumns({
                "mix_in_bars": F.when(c("usable"), tempo.seconds_to_bars(c("mix_in"), c("bpm"))).otherwise(0),
                "mix_out_bars": F.when(c("usable"), tempo.seconds_to_bars(c("mix_out"), c("bpm"))).otherwise(0)})
            .drop("usable"))


def fallback_sections(frames: DataFrame, tracks: DataFrame, frame_seconds: float) -> DataFrame:
    """Intro, main and outro of a track without sections, from its loudness curve.

    A frame is active if the RMS averaged over four bars reaches 0.4 of its
    maximum.  The moving average is a difference of running sums, built in
    blocks, so a long track is spread over tasks; the level curve is stored once.
    """
    c = F.col
    span = F.greatest(F.lit(1), F.least(
        F.floor(tempo.seconds_per_bar(c("bpm")) * 4.0 / frame_seconds), c("n_frames")).cast("long"))
    sizes = frames.groupBy("track_id").agg(F.count("*").alias("n_frames"))
    info = tracks.select("track_id", "bpm", "duration").join(sizes, "track_id").withColumn("span", span)
    totals = ordered.running_sum(frames.select("track_id", "frame_idx", "t_sec", "rms"), ["track_id"], "frame_idx", "rms", "total")
    base = ordered.attach(totals, info, "track_id", "frame_idx")
    # frame i averages frames i - span//2 .. i + (span - 1)//2, cut at the ends: each running total is added to
    # the frame that its window ends with (the last total to all frames whose window is cut) and taken from the
    # frame whose window starts after it, so one sum per frame replaces two joins of all frames
    ahead, behind = F.floor((c("span") - 1) / 2), F.floor(c("span") / 2)
    last = c("frame_idx") == c("n_frames") - 1
    plus = F.sequence(F.greatest(c("frame_idx") - ahead, F.lit(0)), F.when(last, c("frame_idx")).otherwise(c("frame_idx") - ahead))
    own = F.array(F.struct(c("frame_idx").alias("at"), F.lit(0.0).alias("v"), c("t_sec").alias("t_sec")))
    no_time = F.lit(None).cast("double")
    added = F.when(last | (c("frame_idx") >= ahead), F.transform(plus, lambda i: F.struct(i.alias("at"), c("total").alias("v"), no_time.alias("t_sec"))))
    taken = F.when(c("frame_idx") + behind + 1 < c("n_frames"), F.array(F.struct(
        (c("frame_idx") + behind + 1).alias("at"), (-c("total")).alias("v"), no_time.alias("t_sec"))))
    own_type = "array<struct<at:bigint,v:double,t_sec:double>>"
    parts = F.concat(own, F.coalesce(added, F.array().cast(own_type)), F.coalesce(taken, F.array().cast(own_type)))
    levels = (base.select("track_id", "bpm", "duration", "span", F.explode(parts).alias("x"))
              .groupBy("track_id", "x.at").agg(F.max("x.t_sec").alias("t_sec"), F.first("bpm").alias("bpm"), F.first("duration").alias("duration"),
                                               (F.sum("x.v") / F.first("span")).alias("level")).drop("at"))
    curve = lineage.stored(levels)   # read for the peak, the edges and the energies
    peaks = curve.groupBy("track_id").agg(F.max("level").alias("peak"))
    curve = ordered.attach(curve.withColumn("spread", F.hash("t_sec")), peaks, "track_id", "spread").drop("spread")
    active = (c("peak") > 1e-6) & (c("level") >= c("peak") * R.RMS_THRESHOLD)
    edges = curve.groupBy("track_id").agg(
        F.first("bpm").alias("bpm"), F.first("duration").alias("duration"), F.first("peak").alias("peak"),
        F.min(F.when(active, c("t_sec"))).alias("first_active"), F.max(F.when(active, c("t_sec"))).alias("last_active"))
    fade = tempo.seconds_per_bar(c("bpm")) * 16.0
    early, late = F.least(fade, c("duration") * 0.20), F.greatest(c("duration") - fade, c("duration") * 0.75)
    edges = (edges
             .withColumns({"i0": F.when(c("first_active") <= c("duration") * 0.20, c("first_active")).otherwise(early),
                           "o0": F.when(c("last_active") >= c("duration") * 0.75, c("last_active")).otherwise(late)})
             .select("track_id", "bpm", "duration", "peak",
                     F.when(c("i0") >= c("o0"), early).otherwise(c("i0")).alias("intro_t"),
                     F.when(c("i0") >= c("o0"), late).otherwise(c("o0")).alias("outro_t")))
    zone = F.when(c("t_sec") < c("intro_t"), 0).when(c("t_sec") < c("outro_t"), 1).otherwise(2)
    energy = (ordered.attach(curve.select("track_id", "t_sec", "level").withColumn("spread", F.hash("t_sec")), edges, "track_id", "spread")
              .where(c("t_sec") < c("duration"))
              .groupBy("track_id").agg(*[
                  F.coalesce(F.avg(F.when(zone == k, c("level"))) / F.first("peak") * 100.0, F.lit(0.0)).alias(f"e{k}")
                  for k in (0, 1, 2)]))
    out = edges.join(energy, "track_id")

    def section(label, start, end, level):
        return F.struct(F.lit(label).alias("label"), start.alias("start_time"), end.alias("end_time"),
                        level.alias("avg_energy"))

    return out.select("track_id", "intro_t", "outro_t", F.array(
        section("intro", F.lit(0.0), c("intro_t"), c("e0")), section("main", c("intro_t"), c("outro_t"), c("e1")),
        section("outro", c("outro_t"), c("duration"), c("e2"))).alias("sections"))


def heuristic_cue_rejected(cue_in: Column, named: Column, intro: Column) -> Column:
    """A guessed mix-in inside the intro is dropped, a named one never."""
    return F.coalesce(~named & (intro > 0) & (cue_in < intro - R.QUANTIZE_TOLERANCE_SEC), F.lit(False))


def apply_cues(tracks: DataFrame) -> DataFrame:
    """Named IN and OUT cues replace the computed points; adds ``cue_mix_in``/``cue_mix_out``.

    ``cues`` is an ordered array of (t, name, provenance).
    """
    c = F.col

    def named(pattern, other=None):
        def keep(cue):
            hit = (cue["provenance"] == "manual") & F.upper(cue["name"]).rlike(pattern)
            return hit if other is None else hit & ((cue["t"] != other) | other.isNull())
        return F.get(F.filter(c("cues"), keep), F.lit(0))["t"]

    t_in = F.coalesce(named(CUE_IN), c("mix_in_point"))
    t_out = F.coalesce(named(CUE_OUT, named(CUE_IN)), c("mix_out_point"))
    given = tracks.withColumns({"want_in": t_in, "want_out": t_out})
    a_in, a_out = snap_pair(c("want_in"), c("want_out"), c("bpm"), c("duration"), c("phrase_unit"), c("anchor"))
    valid = (F.size("cues") > 0) & (c("want_in") >= 0) & (c("want_in") < c("want_out")) & (c("want_out") <= c("duration"))
    return given.withColumns({"cue_mix_in": F.when(valid, a_in).otherwise(c("mix_in_point")),
                              "cue_mix_out": F.when(valid, a_out).otherwise(c("mix_out_point"))}
                             ).drop("want_in", "want_out")


def paired_mix_points(pairs: DataFrame) -> DataFrame:
    """Mix-out of A and mix-in of B tuned to each other: adds ``mix_out_a`` and ``mix_in_b``.

    A leaves early enough for B's intro but before its own outro; B starts on
    the first phrase after its intro.
    """
    c, q = F.col, grid.quantize_to_grid
    dur_a, dur_b = c("a_duration"), c("b_duration")

    def bar(side):
        bpm = c(f"{side}_bpm")
        return tempo.seconds_per_bar(F.when(bpm > 0, bpm).otherwise(R.DEFAULT_BPM))

    df = pairs.withColumns({
        "bar_a": bar("a"), "bar_b": bar("b"),
        "phrase_a": bar("a") * c("a_phrase_bars"), "phrase_b": bar("b") * c("b_phrase_bars"),
        "own_out": F.when(c("a_mix_out_point") > 0, c("a_mix_out_point")).otherwise(dur_a * 0.8),
        "intro_b": F.when(c("b_intro_end") > 0, c("b_intro_end")).otherwise(
            F.greatest(c("b_mix_in_point"), F.lit(0.0)))})
    overlap = F.least(
        F.greatest(c("bar_b") * F.greatest(F.lit(8.0), c("b_trans_min")),
                   F.least(c("intro_b"), F.greatest(F.lit(0.0), dur_a - c("own_out")))),
        dur_a * 0.5, dur_b * 0.5)
    df = df.withColumns({
        "out0": F.greatest(c("own_out"), dur_a - overlap),
        "in0": F.when(c("b_intro_end") > 0, q(c("b_intro_end"), c("phrase_b"), c("b_anchor"), "ceil"))
        .otherwise(F.greatest(F.lit(0.0), c("b_mix_in_point"))),
        "outro_floor": q(c("a_outro_start"), c("phrase_a"), c("a_anchor"), "floor")})
    guarded = F.when(c("out0") >= c("a_outro_start"),
                     F.when(c("outro_floor") >= c("a_outro_start"), c("outro_floor") - c("phrase_a"))
                     .otherwise(c("outro_floor"))).otherwise(c("out0"))
    df = df.withColumn("out1", F.greatest(F.least(guarded, dur_a - c("bar_a")), c("bar_a")))
    df = df.withColumns({"q_out": q(c("out1") + EPS, c("phrase_a"), c("a_anchor"), "floor"),
                         "q_in": q(c("in0") - EPS, c("phrase_b"), c("b_anchor"), "ceil")})
    last_bar = F.least(F.greatest(F.greatest(F.lit(0.0), dur_b - c("bar_b")), F.least(c("b_intro_end"), dur_b)),
                       dur_b - 1e-6)
    mix_out = F.when(c("q_out").between(c("bar_a"), dur_a - c("bar_a")), c("q_out")).otherwise(c("out1"))
    mix_in = F.when((c("q_in") >= 0) & (c("q_in") < dur_b), c("q_in")).when(c("q_in") >= dur_b, last_bar).otherwise(c("in0"))
    sound = (dur_a > 0) & (dur_b > 0)
    return df.withColumns({
        "mix_out_a": F.when(sound, mix_out).otherwise(F.bround(F.greatest(c("a_mix_out_point"), F.lit(0.0)), 2)),
        "mix_in_b": F.when(sound, mix_in).otherwise(F.bround(F.greatest(c("b_mix_in_point"), F.lit(0.0)), 2)),
    }).drop("bar_a", "bar_b", "phrase_a", "phrase_b", "own_out", "intro_b", "out0", "in0", "outro_floor", "out1",
            "q_out", "q_in")
