"""Reading and writing libraries: files, track store, catalogue, truth, sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import keys, tempo, text

c = F.col

AUDIO_EXTENSIONS = ("mp3", "wav", "flac", "aiff", "aif", "m4a", "ogg")
TRACK_SCHEMA = (
    "filePath string, fileName string, artist string, title string, genre string, duration double, bpm double, "
    "keyNote string, keyMode string, camelotCode string, energy int, bass_intensity int, mix_in_point double, "
    "mix_out_point double, first_downbeat double, downbeat_confidence double, first_phrase double, "
    "phrase_confidence double, key_confidence double, lufs double, detected_genre string, genre_confidence double, "
    "phrase_unit int, brightness int, vocal_instrumental string, danceability int, spectral_flatness double, "
    "percussive_ratio double, groove_pattern array<double>, bass_pattern array<double>, timbre_fingerprint array<double>, "
    "sub_energy double, bass_punch double, outro_covered boolean, "
    "sections array<struct<label string, start_time double, end_time double, start_bar int, end_bar int, "
    "avg_energy double, avg_bass double, sub_energy double, bass_punch double>>, "
    "avg_bass double, avg_mids double, avg_highs double, mix_in_bars int, mix_out_bars int, genre_source string, "
    "mfcc_fingerprint array<double>, syncopation double, analysis_mode string, lufs_status string, "
    "lufs_coverage_seconds double, lufs_channels int, lufs_sample_rate int, rekordbox_signature string, "
    "phrase_grid array<double>, "
    # of open shape: kept as their JSON text
    "ai_metadata string, analysis_coverage string, phrases string, cue_points string, "
    "mix_in_candidates string, mix_out_candidates string")
# local values of a mix-point candidate; names are fixed values
_CANDIDATE = (
    "t double, schema array<string>, provenance string, confidence double, section_label string, phrase_label string, "
    "neuheit double, traegt_allein boolean, groove_pattern_lokal array<double>, bass_pattern_lokal array<double>, "
    "syncopation_lokal double, percussive_ratio_lokal double, sub_energy double, bass_punch double, bass_rms_dbfs double, "
    "kick_aktiv boolean, camelot_lokal string, key_confidence_lokal double, timbre_fingerprint_lokal array<double>, "
    "brightness_lokal int, flatness_lokal double, avg_mids_lokal double, avg_highs_lokal double, energy_lokal int, "
    "energy_trend string, lufs_lokal double, vocal_aktiv_lokal boolean, mood string")
CATALOG_FIELDS = ("bpm", "camelot", "duration", "title", "artist", "genre", "content_id", "cues")
TRUTH_SCHEMA = (
    "track_id string, audio_path string, audio_sha256 string, label_status string, label_source string, "
    "annotator_1 string, annotator_2 string, adjudicator string, truth_bpm string, truth_key_note string, "
    "truth_key_mode string, truth_genre string, truth_mix_in_seconds string, truth_mix_out_seconds string, "
    "truth_sections_json string, notes string")
PREDICTION_SCHEMA = (
    "metadata struct<app_version string, source_commit string, config_sha256 string, created_at string>, "
    "predictions array<struct<track_id string, audio_sha256 string, bpm double, key_note string, key_mode string, "
    "genre string, mix_in_seconds double, mix_out_seconds double, "
    "sections array<struct<start_time double, end_time double, label string>>>>")


# ---------------------------------------------------------------- files, store
def scan_library(spark: SparkSession, root: str, extensions: Sequence[str] = AUDIO_EXTENSIONS) -> DataFrame:
    """Audio files below a folder: path, length, modificationTime (contents are never read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./\\]+)\z", 1))
    return files.where(suffix.isin(*[e.lower() for e in extensions]))


def read_tracks(store: DataFrame, data: str = "data", newest: str = "ingest_ts") -> DataFrame:
    """Parsed track records, one per path: unknown keys are dropped, the newest record wins."""
    parsed = store.select(newest, F.from_json(data, TRACK_SCHEMA).alias("t")).where(c("t.filePath").isNotNull())
    best = parsed.groupBy(F.lower("t.filePath").alias("identity")).agg(F.max_by("t", newest).alias("t"))
    return best.select("t.*")


#: Element types of the open fields, and the numbers an element cannot do without.  A JSON null or a missing value is NULL: not measured.
OPEN_FIELDS = {
    "phrases": ("start_s double, end_s double, label string, mood int, kind int, fill int", ("start_s", "end_s")),
    "cue_points": ("t double, name string, typ string, hot_cue int, provenance string", ("t",)),
    "mix_in_candidates": (_CANDIDATE, ("t",)), "mix_out_candidates": (_CANDIDATE, ("t",))}
AI_RECORD = "struct<sub_genre string, moods array<string>, description string, mix_in_time double, mix_out_time double, _provider string, _model string>"


def _colons(spec: str) -> str:
    """A column list as the inside of a struct type."""
    return ",".join(part.strip().replace(" ", ":", 1) for part in spec.split(","))


def _elements(field: str) -> Column:
    """The elements of a JSON list, each as its JSON text; NULL if the text is no list."""
    return F.when(F.ltrim(c(field)).startswith("["), F.from_json(field, "array<string>"))


def _typed(element: Column, spec: str) -> Column:
    return F.from_json(element, f"{spec}, broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})


def _fault(element: Column, value: Column, numbers: Sequence[str]) -> Column:
    """Why an element cannot be used, NULL if it can."""
    def usable(n: str) -> Column:
        return value[n].isNotNull() & ~F.isnan(value[n]) & (value[n] >= 0) & (value[n] < float("inf"))

    missing = F.coalesce(*[F.when(~F.coalesce(usable(n), F.lit(False)), F.lit(n)) for n in numbers])
    return (F.when(element.isNull() | ~F.ltrim(element).startswith("{"), F.lit("no record"))
            .when(value["broken"].isNotNull(), F.lit("value of another type"))
            .when(missing.isNotNull(), F.concat(missing, F.lit(" is no time"))))


def typed_fields(tracks: DataFrame) -> DataFrame:
    """Track records with their open fields as arrays of structs and the AI record as a struct.

    Phrases, cues and candidates become arrays without the elements that
    :func:`rejected_elements` lists; ``analysis_coverage`` becomes pairs of seconds.  A
    field that is no list, is null or missing is an empty array; an AI record that is no
    object is NULL.  Order is kept.  All of it is one projection, without a shuffle.
    """
    def typed(field: str) -> Column:
        spec, numbers = OPEN_FIELDS[field]
        good = F.filter(F.transform(_elements(field), lambda e: F.struct(e.alias("e"), _typed(e, spec).alias("v"))),
                        lambda x: _fault(x["e"], x["v"], numbers).isNull())
        whole = F.transform(good, lambda x: x["v"].dropFields("broken"))
        return F.coalesce(whole, F.array().cast(f"array<struct<{_colons(spec)}>>"))

    span = F.from_json("analysis_coverage", "array<array<double>>")
    coverage = F.transform(F.filter(span, lambda x: (F.size(x) == 2) & (F.get(x, F.lit(0)) <= F.get(x, F.lit(1)))),
                           lambda x: F.struct(F.get(x, F.lit(0)).alias("start_s"), F.get(x, F.lit(1)).alias("end_s")))
    ai = F.when(F.ltrim("ai_metadata").startswith("{"), F.from_json("ai_metadata", AI_RECORD))
    return tracks.withColumns({
        **{f: typed(f) for f in OPEN_FIELDS}, "ai_metadata": ai,
        "analysis_coverage": F.coalesce(coverage, F.array().cast("array<struct<start_s:double,end_s:double>>"))})


def rejected_elements(tracks: DataFrame) -> DataFrame:
    """Elements of the open fields that cannot be used: filePath, field, position, element, reason.

    A field whose text is no list is one row with position -1; an empty or missing field is none.
    """
    def faults(field: str) -> Column:
        spec, numbers = OPEN_FIELDS[field]

        def row(at: Column, element: Column, reason: Column) -> Column:
            return F.struct(F.lit(field).alias("field"), at.alias("position"), element.alias("element"), reason.alias("reason"))

        found = F.transform(_elements(field), lambda e, i: row(i, e, _fault(e, _typed(e, spec), numbers)))
        whole = F.array(row(F.lit(-1), c(field), F.lit("no list")))
        none = F.array().cast("array<struct<field:string,position:int,element:string,reason:string>>")
        listless = c(field).isNotNull() & (F.trim(field) != "") & (F.trim(field) != "null") & _elements(field).isNull()
        return F.when(listless, whole).otherwise(F.coalesce(F.filter(found, lambda x: x["reason"].isNotNull()), none))

    return (tracks.select("filePath", F.explode(F.concat(*[faults(f) for f in OPEN_FIELDS])).alias("x"))
            .select("filePath", "x.*"))


def upsert_tracks(base: DataFrame, updates: DataFrame, version: int, key: str = "key", newest: str = "ingest_ts") -> DataFrame:
    """Newest record per key; records of another schema version are dropped.

    A partial aggregate, not a window: many versions of one key collapse before
    the shuffle.
    """
    both = base.unionByName(updates).where(c("version") == version)
    others = [n for n in both.columns if n != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(c(newest), c("data"))).alias("r"))
    return best.select(key, *[c(f"r.{n}").alias(n) for n in others])


def normalized_path(path: Column) -> Column:
    return F.lower(F.replace(path, F.lit("\\"), F.lit("/")))


def with_change_key(files: DataFrame, catalog: DataFrame | None = None,
                    fields: Sequence[str] = ("content_id", "title", "camelot")) -> DataFrame:
    """Key that changes with path, size, time or catalogue metadata of a file."""
    key = F.concat_ws("-", normalized_path(c("path")), c("length").cast("string"), c("modified").cast("string"))
    if catalog is None:
        return files.withColumn("change_key", key)
    marks = catalog.select(c("path").alias("catalog_path"), F.sha2(F.to_json(F.struct(*fields)), 256).alias("signature"))
    joined = files.join(marks, normalized_path(c("path")) == c("catalog_path"), "left").drop("catalog_path")
    return joined.withColumn("change_key", F.concat(key, F.coalesce(
        F.concat(F.lit("-source-"), c("signature")), F.lit(""))))


def changed_files(files: DataFrame, store: DataFrame, key: str = "change_key") -> DataFrame:
    """Files whose change key is not in the store."""
    return files.join(store.select(key).distinct(), key, "left_anti")


# ------------------------------------------------------------------- catalogue
def read_catalog(raw: DataFrame) -> DataFrame:
    """Typed catalogue records per path with conflict flag, plus basename use.

    ``raw``: content_id, path, raw_bpm (times 100), key_text, length, title,
    artist, genre, cues.  A path whose records disagree in any known field is
    ambiguous; else the best-analysed record wins.
    """
    typed = raw.select(
        normalized_path(c("path")).alias("path"), tempo.safe_bpm(c("raw_bpm")).alias("bpm"),
        keys.text_key_to_camelot(c("key_text")).alias("camelot"), c("length").cast("double").alias("duration"),
        "title", "artist", "genre", "content_id", F.when(F.size("cues") > 0, F.array_sort("cues")).alias("cues"))
    quality = sum((c(n).isNotNull().cast("int") for n in ("camelot", "duration", "title")),
                  c("bpm").isNotNull().cast("int")) + F.coalesce(F.size("cues"), F.lit(0))
    record = F.struct(*CATALOG_FIELDS)
    differs = [(F.min(n) != F.max(n)) for n in CATALOG_FIELDS]
    conflict = differs[0]
    for d in differs[1:]:
        conflict = F.coalesce(conflict, F.lit(False)) | F.coalesce(d, F.lit(False))
    best = typed.groupBy("path").agg(
        F.max_by(record, F.struct(quality.alias("q"), c("content_id"))).alias("r"), conflict.alias("ambiguous"),
        F.count("*").alias("n_records"))
    return best.select("path", text.basename(c("path")).alias("basename"), "ambiguous", "n_records", "r.*")


def basenames(catalog: DataFrame) -> DataFrame:
    """Records per basename with the record of the unique ones."""
    return catalog.groupBy("basename").agg(
        F.sum("n_records").alias("n_named"), F.max_by(F.struct(*CATALOG_FIELDS), c("path")).alias("named"))


def match_catalog(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalogue record of a file by exact path, else by unique basename.

    Adds ``match`` (path, basename, ambiguous, missing) and the record columns
    prefixed ``cat_``.
    """
    left = files.withColumns({"match_path": normalized_path(c("file_path")),
                              "match_name": text.basename(normalized_path(c("file_path")))})
    by_path = catalog.select(c("path").alias("match_path"), "ambiguous", F.struct(*CATALOG_FIELDS).alias("exact"))
    by_name = basenames(catalog).withColumnRenamed("basename", "match_name")
    rows = left.join(by_path, "match_path", "left").join(by_name, "match_name", "left")
    status = (F.when(c("ambiguous"), "ambiguous").when(c("exact").isNotNull(), "path")
              .when(c("n_named") == 1, "basename").when(c("n_named") > 1, "ambiguous").otherwise("missing"))
    found = F.when(c("match") == "path", c("exact")).when(c("match") == "basename", c("named"))
    rows = rows.withColumn("match", status).withColumn("found", found)
    return rows.select(*[c(n) for n in files.columns], "match",
                       *[c("found")[n].alias(f"cat_{n}") for n in CATALOG_FIELDS])


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """Totals over the unambiguous paths."""
    return catalog.where(~c("ambiguous")).agg(
        F.count("*").alias("total_tracks"), F.count("bpm").alias("tracks_with_bpm"),
        F.count("camelot").alias("tracks_with_key"), F.count("cues").alias("tracks_with_cues"),
        F.avg("bpm").alias("average_bpm"))


def catalog_coverage(matched: DataFrame, examples: int = 3) -> DataFrame:
    """Files per coverage class with the first few names of each."""
    status = (F.when(c("match").isin("path", "basename") & c("cat_bpm").isNotNull(), "with_analysis")
              .when(c("match").isin("path", "basename"), "without_analysis")
              .when(c("match") == "ambiguous", "ambiguous").otherwise("not_in_collection"))
    rows = matched.select(status.alias("status"), "file_path")
    totals = rows.groupBy("status").agg(F.count("*").alias("n"))
    first = (rows.withColumn("rank", F.row_number().over(Window.partitionBy("status").orderBy("file_path")))
             .where(c("rank") <= examples).groupBy("status")
             .agg(F.array_join(F.array_sort(F.collect_list(text.basename(c("file_path")))), ",").alias("examples")))
    return totals.join(F.broadcast(first), "status")


# ------------------------------------------------------- truth, sheets, reports
def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled truth from CSV with typed numbers."""
    raw = spark.read.schema(TRUTH_SCHEMA).option("header", "true").option("escape", '"').option("multiLine", "true").csv(path)
    numbers = ("truth_bpm", "truth_mix_in_seconds", "truth_mix_out_seconds")
    return raw.withColumns({n: F.nullif(F.trim(n), F.lit("")).cast("double") for n in numbers}).withColumn(
        "truth_sections", F.from_json("truth_sections_json", "array<struct<start_time double, end_time double, label string>>"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """One row per prediction; metadata without its four fields or a sha256 fails the job."""
    raw = spark.read.schema(PREDICTION_SCHEMA).option("multiLine", "true").json(path)
    m = c("metadata")
    complete = F.coalesce((F.trim(m["app_version"]) != "") & (F.trim(m["source_commit"]) != "") & (F.trim(m["created_at"]) != "")
                          & F.trim(m["config_sha256"]).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    checked = raw.where(F.when(complete, True).otherwise(F.raise_error(F.lit("prediction metadata incomplete")).cast("boolean")))
    return checked.select("metadata", F.explode("predictions").alias("p")).select("p.*", "metadata.app_version")


def predictions_from_tracks(tracks: DataFrame) -> DataFrame:
    """Track records as evaluation records."""
    unset = R.MIX_POINT_UNSET
    return tracks.select(
        c("track_id").cast("string").alias("track_id"), F.when(c("bpm") > 0, c("bpm")).alias("bpm"),
        F.nullif("key_note", F.lit("")).alias("key_note"), F.nullif("key_mode", F.lit("")).alias("key_mode"),
        text.resolved_genre(c("detected_genre"), c("genre")).alias("genre"),
        F.nullif("mix_in_point", F.lit(unset)).alias("mix_in_seconds"),
        F.nullif("mix_out_point", F.lit(unset)).alias("mix_out_seconds"),
        F.transform("sections", lambda s: F.struct(s["start_time"].alias("start_time"), s["end_time"].alias("end_time"),
                                                   s["label"].alias("label"))).alias("sections"))


def write_sheet(sheet: DataFrame, path: str) -> None:
    """CSV with header (rating and feature sheets)."""
    sheet.write.mode("overwrite").option("header", "true").csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines (weights, evaluations, fit reports)."""
    rows.write.mode("overwrite").json(path)
