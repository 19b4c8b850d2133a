"""Measures of ordered playlists: quality, context, wheel usage, texture, display rows.

All take rows of ordered playlists (track columns plus ``pos``).  Windows are
per playlist, which the size limit keeps small; sums over playlists are plain
aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segue.functions import bands, keys, tempo, text, vectors
from segue.operators import pairs, scoring, sequence, transitions


def adjacent_scores(ordered: DataFrame, tol: float, keys_: Sequence[str] = ("playlist_id",), order: str = "pos",
                    keep: Sequence[str] = (), **options) -> DataFrame:
    """Neighbour pairs of every playlist with all pair scores."""
    extra = [k for k in keys_ if k != "playlist_id"]
    rows = pairs.pair_features(ordered, keep=(*extra, order, *keep))
    return scoring.score_pairs(transitions.with_tempo(transitions.adjacent(rows, keys_, order)), tol, **options)


def playlist_quality(ordered: DataFrame, tol: float, keys_: Sequence[str] = ("playlist_id",), **options) -> DataFrame:
    """Overall score, harmonic flow, energy consistency and tempo smoothness per playlist.

    Playlists of fewer than two tracks get 1.0 and no averages.
    """
    c = F.col
    steps = adjacent_scores(ordered, tol, keys_, **options).groupBy(*keys_).agg(
        (F.avg("harmonic") / 100.0).alias("harmonic_flow"),
        F.avg(F.abs(c("a_energy") - c("b_energy"))).alias("avg_energy_jump"),
        F.avg("bpm_diff").alias("avg_bpm_jump"), (F.avg("objective") / 100.0).alias("overall_score"))
    smooth = (F.when(c("avg_bpm_jump") == 0, 1.0).otherwise(0.0) if tol <= 0
              else F.greatest(F.lit(0.0), 1.0 - c("avg_bpm_jump") / tol))
    lists = ordered.select(*keys_).distinct()
    return lists.join(steps, list(keys_), "left").select(
        *keys_, F.coalesce("overall_score", F.lit(1.0)).alias("overall_score"),
        F.coalesce("harmonic_flow", F.lit(1.0)).alias("harmonic_flow"),
        F.coalesce(F.when(c("avg_energy_jump").isNotNull(), F.greatest(F.lit(0.0), 1.0 - c("avg_energy_jump") / 50.0)),
                   F.lit(1.0)).alias("energy_consistency"),
        F.coalesce(F.when(c("avg_bpm_jump").isNotNull(), smooth), F.lit(1.0)).alias("bpm_smoothness"),
        (c("harmonic_flow") * 100.0).alias("avg_harmonic_score"),
        (c("overall_score") * 100.0).alias("avg_transition_score"), "avg_energy_jump", "avg_bpm_jump")


def quality_verdict(quality: DataFrame) -> DataFrame:
    """Verdict and up to three hints per playlist."""
    c = F.col
    return quality.withColumns({
        "verdict": F.when(c("overall_score") >= 0.8, "Excellent playlist!").when(
            c("overall_score") >= 0.6, "Good playlist.").otherwise("Consider adjustments."),
        "hints": F.concat_ws(
            " | ",
            F.when(c("harmonic_flow") < 0.6, "Try increasing harmonic strictness or using 'Harmonic Flow'.."),
            F.when(c("energy_consistency") < 0.6,
                   "Consider 'Context Flow' or 'Energy Wave' for better energy flow."),
            F.when(c("bpm_smoothness") < 0.6, "Try increasing BPM tolerance or using 'Consistent' algorithm."))})


def compare_strategies(tracks: DataFrame, tol: float = 3.0, names: Sequence[str] | None = None) -> DataFrame:
    """Quality of every strategy on every playlist, all ordered in one pass."""
    order = sequence.sequence(tracks, list(names or sequence.SUPPORTED), tol).drop("track_id")
    # features once per track, before the rows multiply by the number of strategies
    rows = order.join(tracks, ["playlist_id", "input_pos"])
    return playlist_quality(rows, tol, ("strategy", "playlist_id"))


def reordered(tracks: DataFrame, positions: DataFrame) -> DataFrame:
    """Tracks with new positions (playlist_id, track_id, pos): input for every re-score."""
    return tracks.drop("pos").join(positions.select("playlist_id", "track_id", "pos"), ["playlist_id", "track_id"])


def set_context(ordered: DataFrame) -> DataFrame:
    """Genre streak length and three-track energy trend at every position."""
    w = Window.partitionBy("playlist_id").orderBy("pos")
    genre = text.resolved_genre(F.col("detected_genre"), F.col("genre"))
    rows = ordered.select("playlist_id", "pos", "track_id", "energy", genre.alias("resolved"))
    rows = rows.withColumn("starts", F.coalesce((F.lag("resolved").over(w) != F.col("resolved")).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("playlist_id", "run").orderBy("pos")
    trend = F.col("energy") - F.coalesce(F.lag("energy", 2).over(w), F.lag("energy", 1).over(w), F.col("energy"))
    return rows.select("playlist_id", "pos", "track_id", "resolved",
                       F.row_number().over(inside).alias("streak"), trend.alias("energy_trend"))


def wave_diagnostics(ordered: DataFrame, tol: float) -> DataFrame:
    """Share of unmixable neighbours and how the energy swing grows along the list."""
    w = Window.partitionBy("playlist_id").orderBy("pos")
    swing = ordered.select("playlist_id", "pos", F.abs(F.col("energy") - F.first("energy").over(w)).alias("swing")) \
        .groupBy("playlist_id").agg(F.corr("pos", "swing").alias("swing_growth"))
    steps = adjacent_scores(ordered, tol).groupBy("playlist_id").agg(
        F.avg(F.when(F.col("overall_score") == 0, 1.0).otherwise(0.0)).alias("unmixable_share"))
    return steps.join(swing, "playlist_id")


def key_usage(ordered: DataFrame) -> DataFrame:
    """How often each wheel code occurs in a playlist."""
    code = keys.key_to_camelot(F.col("key_note"), F.col("key_mode"))
    return (ordered.select("playlist_id", code.alias("code")).where(F.col("code") != "")
            .groupBy("playlist_id", "code").agg(F.count("*").alias("n")))


def wheel_edges(ordered: DataFrame, tol: float) -> DataFrame:
    """Moves on the wheel between neighbours with their quality class."""
    edges = adjacent_scores(ordered, tol)
    return edges.where((F.col("a_num") > 0) & (F.col("b_num") > 0)).select(
        "playlist_id", "a_pos", F.concat("a_num", "a_letter").alias("from_code"),
        F.concat("b_num", "b_letter").alias("to_code"), bands.edge_class(F.col("overall_score")).alias("edge"))


def texture(ordered: DataFrame) -> DataFrame:
    """Timbre similarity of neighbours with its label and colour step."""
    rows = transitions.adjacent(ordered.select("playlist_id", "pos", "track_id", "timbre"))
    rows = rows.withColumn("texture", vectors.texture_similarity(F.col("a_timbre"), F.col("b_timbre")))
    return rows.select("playlist_id", "a_pos", "texture", bands.texture_label(F.col("texture")).alias("label"),
                       bands.seven_step(F.col("texture")).alias("colour"))


def playlist_view(ordered: DataFrame, tol: float, **options) -> DataFrame:
    """Display row per track with the score of the step into it, factor by factor."""
    c = F.col
    scored = adjacent_scores(ordered, tol, keep=("timbre",), **options)

    def percent(value, scale=100.0):
        return F.when(value.isNull(), "nicht bestimmbar").otherwise(F.format_string("%.0f %%", value * scale))

    factors = F.concat_ws(
        "\n", F.concat(F.lit("Harmonik: "), percent(c("harmonic").cast("double"), 1.0)),
        *[F.concat(F.lit(f"{label}: "), percent(c(name))) for label, name in (
            ("BPM", "bpm_smoothness"), ("Energie", "energy_flow"), ("Genre", "genre_compatibility"),
            ("Groove", "groove_match"), ("Bassdruck", "bass_continuity"), ("Klangfarbe", "timbre_match"),
            ("Stimmung", "mood_match"))])
    into = scored.select(
        "playlist_id", c("b_pos").alias("pos"), F.floor(c("overall_score") * 100.0).cast("int").alias("score"),
        bands.transition_label(c("overall_score")).alias("score_label"), factors.alias("factors"),
        F.col("a_timbre").alias("previous_timbre"))
    moods = F.concat_ws(", ", c("ai")["moods"])
    ai_text = F.when(F.length(F.trim(c("ai")["sub_genre"])) > 0,
                     F.trim(F.concat(F.lit("["), F.trim(c("ai")["sub_genre"]), F.lit("] "), moods))).otherwise(moods)
    return ordered.join(into, ["playlist_id", "pos"], "left").select(
        "playlist_id", (c("pos") + 1).alias("number"), "title", "artist",
        text.minutes_seconds(c("duration")).alias("length"), F.format_string("%.1f", c("bpm")).alias("bpm"),
        F.concat_ws(" ", "key_note", "key_mode").alias("key"),
        keys.key_to_camelot(c("key_note"), c("key_mode")).alias("code"), "energy", "detected_genre",
        text.mix_point_text(c("mix_in_point"), tempo.seconds_to_bars(c("mix_in_point"), c("bpm"))).alias("mix_in"),
        text.mix_point_text(c("mix_out_point"), tempo.seconds_to_bars(c("mix_out_point"), c("bpm"))).alias("mix_out"),
        F.format_string("%.0f%%", c("avg_bass")).alias("bass"),
        F.when(c("score").isNull(), "-").otherwise(bands.texture_label(
            vectors.texture_similarity(c("previous_timbre"), c("timbre")))).alias("texture"),
        "score", "score_label", "factors", F.coalesce(F.nullif(ai_text, F.lit("")), F.lit("-")).alias("ai"))


def mixpoint_qa(tracks: DataFrame) -> DataFrame:
    """Where the mix points sit on the phrase and bar grids, and how much room they leave."""
    c = F.col
    bar = tempo.seconds_per_bar(c("bpm"))
    phrase = bar * c("phrase_unit")

    def off_grid(t, width):
        gap = F.pmod(t - c("anchor"), width)
        return F.least(gap, width - gap)

    def band(gap):
        return F.when(gap < 0.5, "ok").when(gap < 2.0, "warn").otherwise("fail")

    def bar_band(bars):
        return F.when(bars >= 8, "ok").when(bars >= 4, "warn").otherwise("fail")

    rows = tracks.where((c("bpm") > 0) & (c("mix_in_point") >= 0) & (c("mix_out_point") >= 0)).withColumns({
        "in_off_phrase": off_grid(c("mix_in_point"), phrase), "out_off_phrase": off_grid(c("mix_out_point"), phrase),
        "in_off_bar": off_grid(c("mix_in_point"), bar), "out_off_bar": off_grid(c("mix_out_point"), bar),
        "outro_bars": (c("duration") - c("mix_out_point")) / bar, "entry_bars": c("mix_in_point") / bar})
    gap = F.pmod(c("first_phrase") - c("first_downbeat"), bar)
    rows = rows.select(
        "track_id", "in_off_phrase", "out_off_phrase", "in_off_bar", "out_off_bar", "outro_bars", "entry_bars",
        band(c("in_off_phrase")).alias("in_band"), bar_band(c("outro_bars")).alias("outro_band"),
        bar_band(c("entry_bars")).alias("entry_band"), (c("in_off_phrase") < 0.001).alias("in_exact"),
        (c("out_off_phrase") < 0.001).alias("out_exact"),
        F.when(c("first_phrase") > 0, F.least(gap, bar - gap) < 0.001).alias("first_phrase_on_bar"),
        (c("mix_out_point") - c("mix_in_point") < 30).alias("narrow"))
    checks = [c(n) for n in ("in_band", "outro_band", "entry_band")]
    failed = (checks[0] == "fail") | (checks[1] == "fail") | (checks[2] == "fail") | c("narrow")
    warned = (checks[1] == "warn") | (checks[2] == "warn")
    return rows.withColumn("status", F.when(failed, "fail").when(warned, "warn").otherwise("ok"))
