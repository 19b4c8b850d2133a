"""Evaluation against labelled truth: fields, keys, boundaries, folders, factor spread."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segue.functions import keys, tempo
from segue.operators import ordered

c = F.col
KEY_CLASSES = ("exact", "relative", "fifth", "wrong", "invalid")
FACTORS = ("groove", "bass", "timbre", "mood", "harmonic", "bpm", "energy", "genre")
NEW_FACTORS = FACTORS[:4]
CLASSIC_FACTORS = FACTORS[4:]
MIN_CONTROL_SPREAD = 0.05


def join_truth(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adjudicated truth with its prediction (NULL ``p`` if missing).

    A track whose audio hash disagrees fails the job: numbers of different
    files must never be compared.
    """
    wanted = truth.where(keys.normalize_text(c("label_status")) == "adjudicated")
    other = predictions.select("track_id", F.struct(*[n for n in predictions.columns if n != "track_id"]).alias("p"))
    rows = wanted.join(other, "track_id", "left")
    mine = F.lower(F.trim(F.coalesce("audio_sha256", F.lit(""))))
    theirs = F.lower(F.trim(F.coalesce(c("p")["audio_sha256"], F.lit(""))))
    clash = c("p").isNotNull() & (mine != "") & (mine != theirs)
    return rows.where(F.when(clash, F.raise_error(F.concat(F.lit("audio hash differs: "), c("track_id").cast("string")))
                             .cast("boolean")).otherwise(True))


def _starts(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(values, lambda v: v > 0)))


def matched_count(predicted: Column, true: Column, tolerance: float = 2.0) -> Column:
    """Size of the largest one-to-one matching of two sorted time lists within a tolerance.

    On a line, giving every truth the first free prediction in reach is optimal.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        at = F.greatest(acc["at"], F.size(F.filter(predicted, lambda p: p < t - tolerance)))
        hit = F.coalesce(F.get(predicted, at) <= t + tolerance, F.lit(False))
        return F.struct((at + hit.cast("int")).alias("at"), (acc["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(true, start, step)["n"]


def match_boundaries(rows: DataFrame, predicted: str = "pred_starts", true: str = "true_starts",
                     tolerance: float = 2.0) -> DataFrame:
    """Matched, predicted and true boundaries of every track (starts after 0, without repeats)."""
    clean = rows.withColumns({"p_sorted": F.coalesce(_starts(c(predicted)), F.array().cast("array<double>")),
                              "t_sorted": F.coalesce(_starts(c(true)), F.array().cast("array<double>"))})
    return clean.withColumns({"n_matched": matched_count(c("p_sorted"), c("t_sorted"), tolerance),
                              "n_predicted": F.size("p_sorted"), "n_true": F.size("t_sorted")}).drop("p_sorted", "t_sorted")


def evaluate(truth: DataFrame, predictions: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """One row of metrics over all adjudicated tracks.

    ``truth``: track_id, label_status, audio_sha256, truth_bpm, truth_key_note,
    truth_key_mode, truth_genre, truth_mix_in, truth_mix_out, true_starts.
    ``predictions``: track_id, audio_sha256, bpm, key_note, key_mode, genre,
    mix_in, mix_out, pred_starts.
    """
    rows = join_truth(truth, predictions)
    p = c("p")
    found = p.isNotNull()

    def given(value: Column) -> Column:
        return F.length(F.coalesce(value, F.lit(""))) > 0

    has_key = given(c("truth_key_note")) & given(c("truth_key_mode"))
    key = F.when(found & has_key & given(p["key_note"]) & given(p["key_mode"]),
                 keys.key_class(p["key_note"], p["key_mode"], c("truth_key_note"), c("truth_key_mode")))
    genre = F.when(found & given(c("truth_genre")) & given(p["genre"]),
                   keys.normalize_text(c("truth_genre")) == keys.normalize_text(p["genre"]))
    labelled = F.size(c("true_starts")) > 0
    rows = rows.withColumns({
        "bpm_error": tempo.octave_bpm_error(p["bpm"], c("truth_bpm")), "key_result": key, "genre_hit": genre,
        "in_error": F.abs(p["mix_in"] - c("truth_mix_in")), "out_error": F.abs(p["mix_out"] - c("truth_mix_out")),
        "has_key": has_key, "has_genre": given(c("truth_genre")), "has_sections": F.coalesce(labelled, F.lit(False)),
        "p_starts": F.when(labelled, p["pred_starts"])})
    rows = match_boundaries(rows, "p_starts", "true_starts", tolerance)
    counted = F.when(c("has_sections"), c("n_predicted")).otherwise(0)

    def total(rule: Column) -> Column:
        return F.sum(rule.cast("int"))

    out = rows.agg(
        F.count("*").alias("adjudicated_tracks"), F.count("p").alias("matched_tracks"),
        F.count("truth_bpm").alias("bpm_truth"), F.count("bpm_error").alias("bpm_labeled"), F.avg("bpm_error").alias("bpm_mae"),
        F.avg(F.when(c("bpm_error").isNotNull(), (c("bpm_error") <= 0.5).cast("double"))).alias("bpm_within_0_5"),
        total(c("has_key")).alias("key_truth"), F.count("key_result").alias("key_labeled"),
        *[F.count(F.when(c("key_result") == k, 1)).alias(f"key_{k}") for k in KEY_CLASSES],
        total(c("has_genre")).alias("genre_truth"), F.count("genre_hit").alias("genre_labeled"),
        F.avg(c("genre_hit").cast("double")).alias("genre_accuracy"),
        *[x for side, truth_col in (("in", "truth_mix_in"), ("out", "truth_mix_out")) for x in (
            F.count(truth_col).alias(f"mix_{side}_truth"), F.count(f"{side}_error").alias(f"mix_{side}_labeled"),
            F.avg(f"{side}_error").alias(f"mix_{side}_mae"))],
        total(c("has_sections")).alias("sections_truth"),
        F.count(F.when(c("has_sections") & c("p_starts").isNotNull(), 1)).alias("sections_labeled"),
        F.sum(F.when(c("has_sections"), c("n_matched")).otherwise(0)).alias("boundaries_matched"),
        F.sum(counted).alias("boundaries_predicted"),
        F.sum(F.when(c("has_sections"), c("n_true")).otherwise(0)).alias("boundaries_true"))
    precision = c("boundaries_matched") / F.nullif("boundaries_predicted", F.lit(0))
    recall = c("boundaries_matched") / F.nullif("boundaries_true", F.lit(0))
    f1 = F.when((c("boundaries_true") > 0) & (c("boundaries_matched") == 0), 0.0).when(
        precision + recall > 0, precision * recall * 2.0 / (precision + recall))
    return out.withColumns({
        "track_coverage": c("matched_tracks") / F.nullif("adjudicated_tracks", F.lit(0)),
        **{f"{n}_coverage": c(f"{n}_labeled") / F.nullif(f"{n}_truth", F.lit(0))
           for n in ("bpm", "key", "genre", "mix_in", "mix_out", "sections")},
        "precision": precision, "recall": recall, "f1": f1})


def field_metrics(report: DataFrame) -> DataFrame:
    """The field metrics of :func:`evaluate` in long form: field, truth, labelled, coverage, value."""
    value = {"bpm": "bpm_mae", "genre": "genre_accuracy", "mix_in": "mix_in_mae", "mix_out": "mix_out_mae"}
    entries = [F.struct(F.lit(f).alias("field"), c(f"{f}_truth").alias("truth"), c(f"{f}_labeled").alias("labeled"),
                        c(f"{f}_coverage").alias("coverage"),
                        (c(value[f]) if f in value else F.lit(None).cast("double")).alias("value"))
               for f in ("bpm", "key", "genre", "mix_in", "mix_out", "sections")]
    return report.select(F.explode(F.array(*entries)).alias("m")).select("m.*")


def validation_report(tracks: DataFrame, folder: str = "folder") -> DataFrame:
    """Per folder and in total: label coverage, tempo and key results, averages.

    ``tracks``: bpm, camelot, key_confidence, first_downbeat, lufs, label_bpm,
    label_camelot (NULL without label).
    """
    error = tempo.octave_bpm_error(c("bpm"), c("label_bpm"))
    labelled = c("label_bpm").isNotNull()
    steps = keys.camelot_distance(c("camelot"), c("label_camelot"))
    same = keys.camelot_letter(c("camelot")) == keys.camelot_letter(c("label_camelot"))
    result = (F.when(~labelled, F.lit(None)).when(steps.isNull(), "invalid").when((steps == 0) & same, "exact")
              .when(steps == 0, "relative").when((steps == 1) & same, "fifth").otherwise("wrong"))
    rows = tracks.withColumns({"bpm_hit": labelled & (error <= 0.5), "key_result": result})
    return rows.rollup(folder).agg(
        F.count("*").alias("analyzed"), F.sum(labelled.cast("int")).alias("labelled"),
        F.sum(F.coalesce(c("bpm_hit"), F.lit(False)).cast("int")).alias("bpm_correct"),
        *[F.count(F.when(c("key_result") == k, 1)).alias(f"key_{k}") for k in KEY_CLASSES],
        F.avg("key_confidence").alias("avg_key_confidence"),
        F.sum((c("first_downbeat") > 0).cast("int")).alias("downbeat_detected"),
        F.avg(F.when(c("lufs") < 0, c("lufs"))).alias("avg_lufs")).withColumn(folder, F.coalesce(folder, F.lit("(all)")))


def long_factors(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), c(f).alias("value")) for f in FACTORS]))
                       .alias("x")).select("x.*")


def factor_spread(rows: DataFrame) -> DataFrame:
    """Smallest, median, largest value and spread per factor; which enter the fit.

    The medians come from running counts, so no factor is held in one task.
    """
    values = long_factors(rows)
    simple = values.groupBy("factor").agg(F.min("value").alias("low"), F.max("value").alias("high"),
                                          F.stddev_pop("value").alias("spread"))
    middle = ordered.quantiles(values, ["factor"], "value", {"median": 0.5})
    return simple.join(middle, "factor").withColumn(
        "active", c("factor").isin(*NEW_FACTORS) | (c("spread") >= MIN_CONTROL_SPREAD))
