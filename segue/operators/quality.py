"""Contracts of track, description, truth and listening-test records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segue import refdata as R

c = F.col

# fixed values: contract of a stored track record
REQUIRED_TEXT = ("filePath", "fileName")
LIST_FIELDS = ("sections", "mfcc_fingerprint", "timbre_fingerprint", "analysis_coverage", "groove_pattern",
               "bass_pattern", "phrases", "cue_points", "phrase_grid", "mix_in_candidates", "mix_out_candidates")
DICT_FIELDS = ("ai_metadata",)
CONFIDENCES = ("downbeat_confidence", "key_confidence", "genre_confidence")
NUMERIC_FIELDS = (
    "duration", "bpm", "energy", "bass_intensity", "avg_bass", "avg_mids", "avg_highs", "mix_in_point", "mix_out_point",
    "first_downbeat", "downbeat_confidence", "first_phrase", "phrase_confidence", "key_confidence", "lufs",
    "mix_in_bars", "mix_out_bars", "genre_confidence", "phrase_unit", "brightness", "danceability",
    "spectral_flatness", "percussive_ratio", "syncopation", "sub_energy", "bass_punch", "lufs_coverage_seconds",
    "lufs_channels", "lufs_sample_rate")
AI_KEYS = ("sub_genre", "moods", "description", "mix_in_time", "mix_out_time")


def _type(value: str, path: str) -> str:
    return f"schema_of_variant(try_variant_get({value}, '$.{path}', 'variant'))"


def _number(value: str, path: str) -> Column:
    return F.expr(f"try_variant_get({value}, '$.{path}', 'double')")


def _is_number(value: str, path: str) -> Column:
    kind = F.expr(_type(value, path))
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def _track_values(doc: Column) -> Column:
    """Of one parsed record: the type of every field, and the values that checks compare."""
    fields = F.try_variant_get(doc, "$", "map<string,variant>")

    def value(name: str, kind: str = "double") -> Column:
        return F.try_variant_get(doc, f"$.{name}", kind).alias(name)

    return F.struct(F.transform_values(fields, lambda _, v: F.schema_of_variant(v)).alias("kinds"),
                    *[value(n, "string") for n in REQUIRED_TEXT], *[value(n) for n in CONFIDENCES],
                    *[F.coalesce(value(n), F.lit(unset)).alias(n) for n, unset in (
                        ("duration", 0.0), ("mix_in_point", R.MIX_POINT_UNSET), ("mix_out_point", R.MIX_POINT_UNSET))])


def _track_problems(values: Column) -> Column:
    """Reasons against one record of :func:`_track_values`, in the order of the contract."""
    kinds = values["kinds"]

    def has(name: str) -> Column:
        return kinds[name].isNotNull()

    def numeric(name: str) -> Column:
        return kinds[name].isin("BIGINT", "DOUBLE") | kinds[name].startswith("DECIMAL")

    checks = [F.when(kinds.isNull(), "Track-Record ist kein Dictionary")]
    checks += [F.when(~has(n) | (kinds[n] != "STRING") | (values[n] == ""), f"Pflichtfeld {n} fehlt oder ist ungueltig") for n in REQUIRED_TEXT]
    checks += [F.when(~kinds[n].startswith("ARRAY"), f"{n} muss eine Liste sein") for n in LIST_FIELDS]
    checks += [F.when(~kinds[n].startswith("OBJECT"), f"{n} muss ein Dictionary sein") for n in DICT_FIELDS]
    checks += [F.when(~numeric(n), f"{n} muss numerisch sein") for n in NUMERIC_FIELDS]
    checks += [F.when(~values[n].between(0.0, 1.0), f"{n} liegt ausserhalb 0..1") for n in CONFIDENCES]
    duration, mix_in, mix_out = (values[n] for n in ("duration", "mix_in_point", "mix_out_point"))
    checks += [
        F.when((duration < 0) | (mix_in < R.MIX_POINT_UNSET) | (mix_out < R.MIX_POINT_UNSET),
               "Dauer oder Mixpoint ist ungueltig negativ"),
        F.when((mix_in >= 0) & (mix_out >= 0) & (mix_in >= mix_out), "Mix-In muss vor Mix-Out liegen"),
        F.when((duration > 0) & (mix_out >= 0) & (mix_out > duration + 1e-6), "Mix-Out liegt hinter dem Trackende")]
    return F.array_compact(F.array(*checks))


def validate_tracks(records: DataFrame, data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Split JSON track records into valid ones and rejects with a reason.

    Types are checked on the JSON value itself, before it is cast.  The checks are a
    function of the parsed value, and their result is generated: a filter that moved
    below would parse the record again for every check.
    """
    found = F.transform(F.transform(F.array(F.try_parse_json(c(data))), _track_values), _track_problems)
    judged = records.select("*", F.explode_outer(found).alias("reasons"))
    valid = judged.where(F.size("reasons") == 0).drop("reasons")
    rejects = judged.where(F.size("reasons") > 0).withColumn("reason", F.get("reasons", F.lit(0)))
    return valid, rejects


def safe_tracks(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks with a file of allowed size and a duration up to two hours."""
    sizes = files.select(F.lower("path").alias("key"), "length").groupBy("key").agg(F.max("length").alias("length"))
    return tracks.withColumn("key", F.lower("file_path")).join(sizes, "key").drop("key").where(
        (c("length") <= R.MAX_FILE_SIZE) & (c("duration") > 0) & (c("duration") <= R.MAX_TRACK_SECONDS)
        & ~F.isnan("duration"))


def apply_limits(tracks: DataFrame, files: DataFrame, max_tracks: int) -> DataFrame:
    """The first ``max_tracks`` safe tracks of every playlist.

    The rank limit is applied before the shuffle as well, so an oversized playlist
    never reaches one task whole.
    """
    order = Window.partitionBy("playlist_id").orderBy("input_pos")
    ranked = safe_tracks(tracks, files).withColumn("rank", F.row_number().over(order))
    return ranked.where(c("rank") <= max_tracks).drop("rank")


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become 0.0 in every double, also inside arrays and structs."""
    def clean(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            bad = F.isnan(value) | (F.abs(value) == float("inf"))
            return F.when(bad, F.lit(0.0)).otherwise(value)
        if isinstance(kind, T.ArrayType) and _holds_double(kind):
            return F.transform(value, lambda v: clean(v, kind.elementType))
        if isinstance(kind, T.StructType) and _holds_double(kind):
            inner = F.struct(*[clean(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(value.isNotNull(), inner)
        return value

    return df.select(*[clean(c(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _holds_double(kind: T.DataType) -> bool:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_double(kind.elementType)
    return isinstance(kind, T.StructType) and any(_holds_double(f.dataType) for f in kind.fields)


def validate_ai(rows: DataFrame, data: str = "ai_json", provider: str = "", model: str = "") -> DataFrame:
    """Check JSON descriptions against their contract.

    ``rows`` also has duration and outro_covered.  Adds ``ai_reason`` (NULL if
    valid) and the cleaned record ``ai``; mix points survive only where the end
    of the track was analysed.
    """
    rows = rows.withColumn("doc", F.expr(f"try_parse_json({data})"))
    names = F.json_object_keys(c(data))
    sub = F.trim(F.expr("try_variant_get(doc, '$.sub_genre', 'string')"))
    text = F.trim(F.expr("try_variant_get(doc, '$.description', 'string')"))
    moods = F.expr("try_variant_get(doc, '$.moods', 'array<string>')")
    mood_types = F.expr(_type("doc", "moods"))
    t_in, t_out = _number("doc", "mix_in_time"), _number("doc", "mix_out_time")

    def is_text(name: str, value: Column, longest: int) -> Column:
        return (F.expr(_type("doc", name)) == "STRING") & F.length(value).between(1, longest)

    def no(rule: Column) -> Column:
        return ~F.coalesce(rule, F.lit(False))

    reason = (
        F.when(c("doc").isNull() | no(F.array_sort(names) == F.array(*[F.lit(k) for k in sorted(AI_KEYS)])),
               "KI-Ergebnis muss exakt das definierte Fuenf-Key-Schema besitzen")
        .when(no(is_text("sub_genre", sub, 100)), "sub_genre muss ein nichtleerer String sein")
        .when(no(mood_types.startswith("ARRAY") & F.size(moods).between(2, 3)), "moods muss zwei bis drei Eintraege besitzen")
        .when(no((mood_types == "ARRAY<STRING>") & F.forall(moods, lambda m: F.length(F.trim(m)).between(1, 40))),
              "Jeder Mood muss ein nichtleerer String sein")
        .when(no(is_text("description", text, 1000)), "description muss ein nichtleerer String sein")
        .when(no(_is_number("doc", "mix_in_time")), "mix_in_time muss eine JSON-Zahl sein")
        .when(no(_is_number("doc", "mix_out_time")), "mix_out_time muss eine JSON-Zahl sein")
        .when(no((t_in >= 0) & (t_in < t_out) & (t_out <= c("duration"))), "KI-Mixpoints verletzen die Track-Grenzen"))
    covered = F.coalesce(c("outro_covered"), F.lit(False))
    record = F.struct(
        F.lit(True).alias("current"), F.transform(moods, lambda m: F.trim(m)).alias("moods"), sub.alias("sub_genre"),
        text.alias("description"), F.when(covered, t_in).alias("mix_in_time"), F.when(covered, t_out).alias("mix_out_time"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.lit(R.AI_PROMPT_VERSION).alias("prompt_version"), F.lit(R.AI_METADATA_VERSION).alias("schema_version"))
    judged = rows.withColumn("ai_reason", reason)
    return judged.withColumn("ai", F.when(c("ai_reason").isNull(), record)).drop("doc")


def provenance_matches(ai: Column, provider: str | None = None, model: str | None = None) -> Column:
    """Was the description made under the current contract (and by the given model)."""
    rule = ((F.length(ai["provider"]) > 0) & (F.length(ai["model"]) > 0)
            & (ai["prompt_version"] == R.AI_PROMPT_VERSION) & (ai["schema_version"] == R.AI_METADATA_VERSION))
    if provider is not None:
        rule = rule & (ai["provider"] == provider)
    if model is not None:
        rule = rule & (ai["model"] == model)
    return F.coalesce(rule, F.lit(False))


def cue_export_ok(outro_covered: Column, mix_in: Column, mix_out: Column, duration: Column) -> Column:
    """Cues may be exported: track end analysed and points finite, ordered, inside the track."""
    return F.coalesce(outro_covered & (duration > 0) & ~F.isnan(mix_in) & ~F.isnan(mix_out)
                      & (mix_in >= 0) & (mix_in < mix_out) & (mix_out <= duration), F.lit(False))


def check_provenance(truth: DataFrame) -> DataFrame:
    """Adjudicated truth rows that lack provenance: (track_id, problem)."""
    needed = ("audio_sha256", "label_source", "annotator_1", "annotator_2", "adjudicator")

    def blank(name: str) -> Column:
        return F.trim(F.coalesce(c(name), F.lit(""))) == ""

    missing = F.concat_ws(",", *[F.when(blank(n), n) for n in needed])
    rows = truth.where(F.lower(F.trim("label_status")) == "adjudicated").withColumn("missing", missing)
    problem = (F.when(c("missing") != "", F.concat(F.lit("missing: "), c("missing")))
               .when(~F.trim("audio_sha256").rlike("^[0-9a-fA-F]{64}$"), "invalid audio_sha256"))
    return rows.select("track_id", problem.alias("problem")).where(c("problem").isNotNull())


def check_ab_manifest(manifest: DataFrame, clips: DataFrame) -> DataFrame:
    """Violations of a paired listening manifest: (pair_id, problem).

    ``manifest``: pair_id, clip_a, clip_b.  ``clips``: clip, sha256,
    sample_rate, channels, duration.
    """
    def side(s: str) -> DataFrame:
        return clips.select(c("clip").alias(f"clip_{s}"), *[c(n).alias(f"{n}_{s}") for n in (
            "sha256", "sample_rate", "channels", "duration")])

    rows = manifest.join(side("a"), "clip_a", "left").join(side("b"), "clip_b", "left")
    hashes = F.concat_ws("|", F.least("sha256_a", "sha256_b"), F.greatest("sha256_a", "sha256_b"))
    rows = rows.withColumn("hashes", hashes)
    # counts by partial aggregates, so a repeated id or clip pair costs nothing
    ids = manifest.groupBy("pair_id").agg(F.count("*").alias("same_id"))
    twins = rows.groupBy("hashes").agg(F.count("*").alias("same_clips"))
    rows = rows.join(ids, "pair_id").join(twins, "hashes")
    problem = F.concat_ws(
        "; ",
        F.when((F.trim("pair_id") == "") | (c("same_id") > 1), "pair_id missing or repeated"),
        F.when(c("sha256_a").isNull() | c("sha256_b").isNull(), "clip missing"),
        F.when(c("sha256_a") == c("sha256_b"), "identical clips"),
        F.when(c("same_clips") > 1, "clip pair repeated"),
        F.when((c("sample_rate_a") != c("sample_rate_b")) | (c("channels_a") != c("channels_b")), "format differs"),
        F.when(F.abs(c("duration_a") - c("duration_b")) > 0.010, "duration differs"))
    return rows.select("pair_id", problem.alias("problem")).where(c("problem") != "").distinct()
