"""Cues, phrases and mix-point candidates of a track."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import grid, sections, tempo, vectors
from segue.operators import frames as frame_ops
from segue.operators.mixpoints import CUE_IN, CUE_OUT

c = F.col

# fixed values: candidate sources in order of priority, with their provenance
SCHEMES = {"benannter_cue": "rekordbox_manual", "pssi_phrase": "rekordbox_pssi", "auto_cue": "rekordbox_auto",
           "analyzer": "analyzer", "sektion": "analyzer", "energie_neuheit": "analyzer"}
# fixed values: phrase labels by mood (1 high; 2 and 3 mid, low)
PHRASES_HIGH = {1: "Intro", 2: "Up", 3: "Down", 5: "Chorus", 6: "Outro"}
PHRASES_MID_LOW = {1: "Intro", 2: "Verse 1", 3: "Verse 2", 4: "Verse 3", 5: "Verse 4",
                   6: "Verse 5", 7: "Verse 6", 8: "Bridge", 9: "Chorus", 10: "Outro"}
KICK_MIN_DBFS = -35.0
KICK_ON_BEAT_MIN = 0.40
FULL_LOUDNESS_JUMP_DB = 20.0
BUCKET_SECONDS = 30.0


def normalize_cues(cues: DataFrame) -> DataFrame:
    """Ordered cues per track without twins closer than two seconds.

    ``cues``: track_id, cue_no, position, name, type, hot_cue.  A named cue
    replaces the unnamed twin before it.
    """
    usable = cues.where((c("position") >= 0) & (c("position") < float("inf")) & ~F.isnan("position"))
    name = F.trim(F.coalesce("name", F.lit("")))
    source = F.when(name == "", "leer").when(F.upper(name).startswith("CUE(AUTO)"), "auto").otherwise("manual")
    fields = F.struct(F.bround("position", 3).alias("t"), "cue_no", name.alias("name"), c("type").alias("typ"), "hot_cue", source.alias("provenance"))
    in_order = Window.partitionBy("track_id").orderBy("cue.t", "cue.cue_no")
    # two cues that follow each other two seconds apart do not touch: what lies between such steps is folded alone
    step = F.when(c("cue.t") - F.lag("cue.t").over(in_order) < R.CUE_DEDUPE_SEC, 0).otherwise(1)
    islands = usable.select("track_id", fields.alias("cue")).withColumn("step", step).withColumn("island", F.sum("step").over(in_order))
    packed = islands.groupBy("track_id", "island").agg(F.sort_array(F.collect_list("cue")).alias("all"))
    kind = packed.schema["all"].dataType

    def keep(acc: Column, cue: Column) -> Column:
        last = F.element_at(acc, -1)
        twin = (F.size(acc) > 0) & (cue["t"] - last["t"] < R.CUE_DEDUPE_SEC)
        better = (last["provenance"] != "manual") & (cue["provenance"] == "manual")
        return (F.when(~twin, F.concat(acc, F.array(cue)))
                .when(better, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(cue))).otherwise(acc))

    # element_at(-1) of an empty array is an error under ANSI, so the first cue seeds the fold
    folded = F.aggregate(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))),
                         F.slice("all", 1, 1).cast(kind), keep)
    kept = packed.select("track_id", F.explode(folded).alias("cue"))
    return kept.groupBy("track_id").agg(F.sort_array(F.collect_list("cue")).alias("cues"))


def phrase_label(mood: Column, kind: Column) -> Column:
    other = F.format_string("Unbekannt(%d)", kind)
    return F.coalesce(F.when(mood == 1, R.lookup(PHRASES_HIGH, kind)).otherwise(R.lookup(PHRASES_MID_LOW, kind)), other)


def phrases(entries: DataFrame, headers: DataFrame, beats: DataFrame) -> DataFrame:
    """Phrases with seconds from beat numbers (1-based, clamped to the beat table).

    ``entries``: track_id, entry_no, beat, kind, fill.  ``headers``: track_id,
    mood, end_beat, duration.  ``beats``: track_id, beat_idx (0-based), beat_time.
    """
    counts = beats.groupBy("track_id").agg(F.count("*").alias("n_beats"))
    last = F.greatest(F.least(c("beat") - 1, c("n_beats") - 1), F.lit(0))
    times = beats.select("track_id", c("beat_idx").cast("long").alias("at"), c("beat_time").alias("start_s"))
    starts = (entries.join(counts, "track_id").withColumn("at", last.cast("long"))
              .join(times, ["track_id", "at"]).drop("at", "n_beats"))
    ends = (headers.join(counts, "track_id")
            .withColumn("at", F.greatest(F.least(c("end_beat") - 1, c("n_beats") - 1), F.lit(0)).cast("long"))
            .join(times.withColumnRenamed("start_s", "end_beat_s"), ["track_id", "at"], "left")
            .select("track_id", "mood", "duration", "end_beat_s"))
    w = Window.partitionBy("track_id").orderBy("start_s", "entry_no")
    rows = starts.join(ends, "track_id").withColumns({
        "next_s": F.lead("start_s").over(w), "phrase_idx": F.row_number().over(w) - 1})
    tail = F.when(c("end_beat_s") > c("start_s"), c("end_beat_s")).otherwise(c("duration"))
    tail = F.when(c("duration") > 0, F.least(tail, c("duration"))).otherwise(tail)
    return rows.select("track_id", "phrase_idx", "start_s",
                       F.greatest(F.coalesce("next_s", tail), c("start_s")).alias("end_s"),
                       phrase_label(c("mood"), c("kind")).alias("label"), "mood", "kind", "fill")


def phrase_grid(rows: DataFrame) -> DataFrame:
    """Grid points per track: all phrase starts and the last end, without near repeats."""
    packed = rows.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("phrase_idx", "start_s", "end_s"))).alias("p"))
    points = F.concat(F.transform("p", lambda x: x["start_s"]), F.array(F.element_at("p", -1)["end_s"]))
    packed = packed.withColumn("points", points)
    kept = F.aggregate(F.slice("points", F.lit(2), F.size("points") - 1), F.slice("points", 1, 1),
                       lambda acc, p: F.when(p - F.element_at(acc, -1) > 1e-6, F.concat(acc, F.array(p))).otherwise(acc))
    return packed.select("track_id", kept.alias("grid_points"))


def first_downbeat(ticks: DataFrame) -> DataFrame:
    """Time of the first tick numbered 1: ticks are track_id, beat_number, time_ms."""
    return ticks.groupBy("track_id").agg(
        F.min(F.when(c("beat_number") == 1, c("time_ms") / 1000.0)).alias("first_downbeat"))


def raw_candidates(tracks: DataFrame, cues: DataFrame, phrase_rows: DataFrame, section_rows: DataFrame) -> DataFrame:
    """Candidate times of all sources: (track_id, side, t_raw, scheme, exempt).

    ``tracks``: track_id, mix_in_point, mix_out_point.  ``cues``: one row per
    cue.  ``section_rows``: long form with section_idx, label, start_time,
    avg_energy.
    """
    both = F.explode(F.array(F.lit("in"), F.lit("out")))
    name = F.upper("name")
    manual = c("provenance") == "manual"
    role = (F.when(manual & name.rlike(CUE_IN), "in").when(manual & name.rlike(CUE_OUT), "out").otherwise("both"))
    cue_rows = cues.select("track_id", c("t").alias("t_raw"), role.alias("role"),
                           F.when(manual, "benannter_cue").otherwise("auto_cue").alias("scheme"))
    cue_rows = cue_rows.select(
        "track_id", F.explode(F.when(c("role") == "both", F.array(F.lit("in"), F.lit("out"))).otherwise(F.array("role"))).alias("side"),
        "t_raw", "scheme", (c("role") != "both").alias("exempt"))

    def on_both(df: DataFrame, t: str, scheme: str) -> DataFrame:
        return df.select("track_id", both.alias("side"), c(t).alias("t_raw"), F.lit(scheme).alias("scheme"),
                         F.lit(False).alias("exempt"))

    w = Window.partitionBy("track_id").orderBy("section_idx")
    stepped = section_rows.select("track_id", "section_idx", "label", "start_time", "avg_energy",
                                  F.lag("avg_energy").over(w).alias("before"))
    body = stepped.where(~c("label").isin("intro", "outro", "unanalysed"))
    jumps = body.where(F.abs(c("avg_energy") - c("before")) >= R.ENERGY_JUMP_MIN)
    analyzer = tracks.select("track_id", F.explode(F.array(
        F.struct(F.lit("in").alias("side"), c("mix_in_point").alias("t_raw")),
        F.struct(F.lit("out").alias("side"), c("mix_out_point").alias("t_raw")))).alias("a")).select(
        "track_id", "a.side", "a.t_raw", F.lit("analyzer").alias("scheme"), F.lit(False).alias("exempt")).where(c("t_raw") >= 0)
    parts = [cue_rows, on_both(phrase_rows, "start_s", "pssi_phrase"), on_both(body, "start_time", "sektion"),
             on_both(jumps, "start_time", "energie_neuheit"), analyzer]
    return reduce(DataFrame.unionByName, parts)


def collect_candidates(raw: DataFrame, info: DataFrame, limit: int | None = None) -> DataFrame:
    """Quantised, gated and merged candidates; with ``limit`` the first of each side by priority.

    ``info``, one row per track: bpm, duration, phrase_unit, anchor,
    outro_covered, sections (array), phrases (array of start_s, end_s, label),
    grid_points (array or NULL).
    """
    guards = info.withColumns({
        "grid_s": tempo.seconds_per_bar(c("bpm")) * F.when(c("phrase_unit") > 0, c("phrase_unit")).otherwise(8),
        "intro_end": sections.intro_end(c("sections")), "outro_start": sections.outro_start(c("sections"), c("duration"))})
    rows = raw.join(guards, "track_id").where((c("bpm") > 0) & (c("duration") > 0)
                                              & ((c("side") == "in") | c("outro_covered")))
    listed = F.coalesce(F.size("grid_points"), F.lit(0)) > 0

    def snap(mode: str) -> Column:
        return F.when(listed, grid.quantize_to_points(c("t_raw"), c("grid_points"), mode)).otherwise(
            grid.quantize_to_grid(c("t_raw"), c("grid_s"), c("anchor"), mode))

    rows = rows.withColumn("t", F.bround(F.when(c("side") == "in", snap("ceil")).otherwise(snap("floor")), 3))
    eps, t = R.QUANTIZE_TOLERANCE_SEC, c("t")
    inside = t.between(0.0, c("duration"))
    fits_in = (t + eps >= c("intro_end")) & (t <= c("duration") - c("grid_s") * 2.0 + eps)
    fits_out = (t - eps <= c("outro_start")) & (t >= c("grid_s") * 2.0 - eps)
    rows = rows.where(inside & (c("exempt") | F.when(c("side") == "in", fits_in).otherwise(fits_out)))
    section = sections.section_at(c("sections"), t)
    rows = rows.withColumn("section_label", F.coalesce(section["label"], F.lit(""))).where(c("section_label") != "unanalysed")
    last = F.element_at("phrases", -1)["start_s"]
    phrase = F.get(F.filter("phrases", lambda p: (p["start_s"] <= t) & (
        (t < p["end_s"]) | ((p["start_s"] == last) & (t == p["end_s"])))), F.lit(0))["label"]
    rows = rows.withColumn("phrase_label", F.coalesce(F.when(F.size("phrases") > 0, phrase), F.lit("")))
    order = {s: i for i, s in enumerate(SCHEMES)}
    merged = rows.withColumn("rank", R.lookup(order, c("scheme"))).groupBy("track_id", "side", "t").agg(
        F.array_sort(F.collect_set("rank")).alias("ranks"), F.first("section_label").alias("section_label"),
        F.first("phrase_label").alias("phrase_label"))
    first = F.get(c("ranks"), F.lit(0))
    early = F.when(c("side") == "in", c("t")).otherwise(-c("t"))
    w = Window.partitionBy("track_id", "side").orderBy(first, -F.size("ranks"), early)
    names = R.array_column(list(SCHEMES))
    kept = merged if limit is None else merged.withColumn("place", F.row_number().over(w)).where(c("place") <= limit)
    return kept.select("track_id", "side", "t", F.transform("ranks", lambda r: F.get(names, r)).alias("schemes"),
                       R.lookup({i: SCHEMES[s] for s, i in order.items()}, first).alias("provenance"),
                       "section_label", "phrase_label")


def measure_candidates(candidates: DataFrame, frames: DataFrame, info: DataFrame) -> DataFrame:
    """Local measurements in a window of one phrase before and after each candidate.

    An interval join on time buckets: a candidate visits the buckets its window
    touches, a frame sits in one.  All sums are partial before the shuffle.
    """
    width = tempo.seconds_per_bar(c("bpm")) * F.when(c("phrase_unit") > 0, c("phrase_unit")).otherwise(8)
    spans = candidates.select("track_id", "side", "t").join(
        info.select("track_id", "bpm", "duration", "phrase_unit", "first_downbeat", "downbeat_confidence"), "track_id")
    spans = spans.withColumns({"lo": F.greatest(F.lit(0.0), c("t") - width), "hi": F.least(c("duration"), c("t") + width)})
    spans = spans.withColumn("bucket", F.explode(F.sequence(
        F.floor(c("lo") / BUCKET_SECONDS), F.floor(c("hi") / BUCKET_SECONDS))))
    rows = frames.withColumn("bucket", F.floor(c("t_sec") / BUCKET_SECONDS)).join(spans, ["track_id", "bucket"]) \
        .where((c("lo") <= c("t_sec")) & (c("t_sec") < c("hi")))
    after = c("t_sec") >= c("t")
    rows = rows.withColumns({"after": after, "slot": frame_ops.bar_slot(c("t_sec"), c("bpm"), c("first_downbeat"))})

    def level(mask: Column | None = None) -> Column:
        power = c("rms") * c("rms")
        return F.sqrt(F.avg(power if mask is None else F.when(mask, power)))

    def mean(column: str, n: int, mask: Column | None = None) -> Column:
        item = [F.get(c(column), F.lit(i)) for i in range(n)]
        return F.array(*[F.avg(x if mask is None else F.when(mask, x)) for x in item])

    agg = rows.groupBy("track_id", "side", "t").agg(
        F.count("*").alias("n_frames"), level().alias("rms"), level(~c("after")).alias("rms_before"),
        level(c("after")).alias("rms_after"), F.avg("centroid").alias("centroid"), F.avg("flatness").alias("flatness_local"),
        *[F.sqrt(F.avg(f"{b}_ms")).alias(b) for b in ("bass", "mids", "highs")],
        F.avg(F.when(~c("after"), c("onset"))).alias("onset_before"), F.avg(F.when(c("after"), c("onset"))).alias("onset_after"),
        mean("chroma", 12).alias("chroma"), mean("chroma", 12, ~c("after")).alias("chroma_before"),
        mean("chroma", 12, c("after")).alias("chroma_after"), mean("mfcc", 13).alias("mfcc_local"),
        mean("mfcc", 13, ~c("after")).alias("mfcc_before"), mean("mfcc", 13, c("after")).alias("mfcc_after"),
        F.first("downbeat_confidence").alias("downbeat_confidence"),
        *[F.sum(F.when(c("slot") == k, c("bass_env")).otherwise(0.0)).alias(f"bass_{k}") for k in range(16)])
    keyed = frame_ops.key_confidence(frame_ops.detect_key(agg))

    def energy(value: Column) -> Column:
        return F.least(F.lit(100.0), value / 0.4 * 100.0).cast("int")

    def apart(x: Column, y: Column) -> Column:
        return 1.0 - F.coalesce(vectors.cosine(x, y), F.lit(1.0))

    def decibel(value: Column) -> Column:
        return F.log10(F.greatest(value, F.lit(1e-9))) * 20.0

    e_before = F.coalesce(energy(c("rms_before")), energy(c("rms")))
    e_after = F.coalesce(energy(c("rms_after")), energy(c("rms")))
    step = e_after - e_before
    trend = F.when(step >= R.ENERGY_TREND_STEP, "rising").when(step <= -R.ENERGY_TREND_STEP, "falling").otherwise("stable")
    whole = c("bass") + c("mids") + c("highs") + 1e-6
    rhythm = F.abs(c("onset_after") - c("onset_before")) / F.greatest(c("onset_after"), c("onset_before"), F.lit(1e-9))
    loud = F.least(F.lit(1.0), F.abs(decibel(c("rms_after")) - decibel(c("rms_before"))) / FULL_LOUDNESS_JUMP_DB)
    timbre = apart(F.slice("mfcc_before", 2, 12), F.slice("mfcc_after", 2, 12))
    harmony = apart(c("chroma_before"), c("chroma_after"))
    total = reduce(lambda x, y: x + y, [c(f"bass_{k}") for k in range(16)])
    on_beat = c("bass_0") + c("bass_4") + c("bass_8") + c("bass_12")
    bass_db = decibel(c("bass"))
    kick = F.when((c("downbeat_confidence") >= frame_ops.DOWNBEAT_RELIABLE_MIN) & (total > 0),
                  (bass_db >= KICK_MIN_DBFS) & (on_beat / total >= KICK_ON_BEAT_MIN))
    both = c("rms_before").isNotNull() & c("rms_after").isNotNull()
    return keyed.select(
        "track_id", "side", "t", "n_frames", energy(c("rms")).alias("energy_local"), trend.alias("energy_trend"),
        F.bround(c("mids") / whole * 100.0, 1).alias("mids_local"), F.bround(c("highs") / whole * 100.0, 1).alias("highs_local"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), (c("centroid") - 500.0) / 7500.0 * 100.0)).cast("int").alias("brightness_local"),
        F.bround("flatness_local", 4).alias("flatness_local"), c("camelot").alias("camelot_local"),
        c("key_confidence").alias("key_confidence_local"), F.bround(bass_db, 2).alias("bass_db"), kick.alias("kick_active"),
        "mfcc_local", F.when(both, F.bround((rhythm + loud + timbre + harmony) / 4.0, 3)).alias("novelty_local"))


def candidate_confidence(downbeat: Column, has_phrase_grid: Column, phrase: Column, key: Column, covered: Column) -> Column:
    """Mean of the available partial confidences."""
    parts = downbeat + F.when(has_phrase_grid, 1.0).otherwise(phrase) + F.when(covered, 1.0).otherwise(0.0)
    mean = F.when(key.isNull(), parts / 3.0).otherwise((parts + key) / 4.0)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean)), 3)


def candidate_summary(candidates: DataFrame, info: DataFrame) -> DataFrame:
    """Counts per side: tracks without candidates, median, guard violations, use of every source."""
    per_track = candidates.groupBy("track_id", "side").agg(F.count("*").alias("n"))
    every = info.select("track_id", F.explode(F.array(F.lit("in"), F.lit("out"))).alias("side"))
    counts = every.join(per_track, ["track_id", "side"], "left").fillna(0, ["n"])
    # counts are at most the limit per side, so the histogram behind the median has a handful of rows
    medians = counts.groupBy("side").agg(F.count("*").alias("tracks"), F.sum((c("n") == 0).cast("int")).alias("without"),
                                         F.median("n").alias("median_n"))
    guards = info.select("track_id", sections.intro_end(c("sections")).alias("intro_end"),
                         sections.outro_start(c("sections"), c("duration")).alias("outro_start"))
    eps = R.QUANTIZE_TOLERANCE_SEC
    bad = F.when(c("side") == "in", c("t") < c("intro_end") - eps).otherwise(c("t") > c("outro_start") + eps)
    broken = candidates.join(guards, "track_id").groupBy("side").agg(
        F.sum(bad.cast("int")).alias("violations"),
        *[F.sum(F.array_contains("schemes", s).cast("int")).alias(f"n_{s}") for s in SCHEMES])
    return medians.join(broken, "side", "left")
