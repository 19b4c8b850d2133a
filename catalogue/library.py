"""Queries on scalar functions, contracts, the track store, the catalogue and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from catalogue.pairs import resolved
from catalogue.plans import q
from catalogue.sets import ordered
from segue import lineage
from segue.functions import bands, grid, keys, tempo, text, vectors
from segue.operators import quality
from segue.sources import collection, exports, library

C = rel.CTES
duck = rel.duck

# ------------------------------------------------------------ derived relations
# track records as JSON text, some broken, several versions per key
PATH = "concat('C:/m/', CAST(user_id AS STRING), '-', CAST(e % 7 AS STRING), '.mp3')"
RECORD = {
    "key": "concat('K', CAST(user_id AS STRING), '-', CAST(e % 5 AS STRING))",
    "version": "e % 3",
    "ingest_ts": "e",
    "data": ("CASE WHEN e % 31 = 0 THEN 'no json' ELSE concat('{\"filePath\":\"', " + PATH + ", '\",\"fileName\":\"', "
             "CASE WHEN e % 37 = 0 THEN '' ELSE 'f.mp3' END, '\",\"duration\":', CASE WHEN e % 29 = 0 THEN '-5' ELSE CAST(e % 400 AS STRING) END, "
             "',\"bpm\":', CASE WHEN e % 23 = 0 THEN '\"fast\"' ELSE CAST(90 + e % 60 AS STRING) END, "
             "',\"key_confidence\":', CAST((e % 13) / 10e0 AS STRING), ',\"sections\":', CASE WHEN e % 19 = 0 THEN '\"x\"' ELSE '[]' END, "
             "',\"mix_in_point\":', CAST(e % 300 AS STRING), ',\"mix_out_point\":', CAST(e * 3 % 420 AS STRING), ',\"extra\":1}') END"),
}
# open fields of records, some elements broken
OPEN = {
    "phrases": ("concat('[{\"start_s\":', CAST(e % 90 AS STRING), ',\"end_s\":', CASE WHEN e % 11 = 0 THEN '\"x\"' ELSE CAST(e % 90 + 16 AS STRING) END, "
                "',\"label\":\"P', CAST(e % 3 AS STRING), '\",\"mood\":1,\"kind\":', CAST(e % 4 AS STRING), ',\"fill\":0}', CASE WHEN e % 7 = 0 THEN ',null]' ELSE ']' END)"),
    "cue_points": ("CASE WHEN e % 13 = 0 THEN '{\"t\":1}' ELSE concat('[{\"t\":', CAST(e % 50 - 5 AS STRING), ',\"name\":\"c\",\"typ\":\"cue\",\"hot_cue\":', "
                   "CASE WHEN e % 2 = 0 THEN 'null' ELSE '3' END, ',\"provenance\":\"manual\"}]') END"),
    "mix_in_candidates": ("concat('[{\"t\":', CAST(e % 200 AS STRING), ',\"schema\":[\"phrase\",\"cue\"],\"kick_aktiv\":', CASE WHEN e % 2 = 0 THEN 'true' ELSE 'false' END, "
                          "',\"energy_lokal\":', CASE WHEN e % 17 = 0 THEN '\"loud\"' ELSE CAST(e % 100 AS STRING) END, '}]')"),
    "ai_metadata": ("CASE WHEN e % 5 = 0 THEN '[]' ELSE concat('{\"sub_genre\":\"g', CAST(e % 6 AS STRING), '\",\"moods\":[\"a\",\"b\"],\"mix_in_time\":', "
                    "CAST(e % 40 AS STRING), '}') END"),
    "analysis_coverage": "concat('[[0,', CAST(e % 300 AS STRING), CASE WHEN e % 9 = 0 THEN '],[5]]' ELSE ']]' END)",
}
NAME = ("concat('0', CAST(k % 10 AS STRING), CASE WHEN k % 3 = 0 THEN ' - ' ELSE '_' END, p_name, CASE WHEN k % 4 = 0 THEN ' - ' ELSE '_' END, "
        "'Song ', CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN concat('_', CAST(100 + k % 60 AS STRING), '__(', "
        + rel.pick(["Tech_House", "Psy-Trance", "Melodic House & Techno", "Original Mix", "House", "Ambient"], "k % 6")
        + ", ')_', " + rel.pick(["A", "Bb", "F#", "Db", "G"], "k % 5") + ", '_', " + rel.pick(["Minor", "Major"], "(k * 3) % 2")
        + ", '_17') WHEN k % 7 = 0 THEN ' (Extended Mix) (Dub)' ELSE '' END, '.mp3')")


def records(spark, sf):
    e = rel.read(spark, sf, "events").withColumn("e", F.col("event_id"))
    return e.select(*[F.expr(x).alias(n) for n, x in RECORD.items()])


def catalog_raw(spark, sf):
    """Catalogue rows from ``part``: paths repeat, some disagree, some have no tempo."""
    part = rel.read(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    return part.select(
        F.expr("CAST(CASE WHEN k % 3 = 0 THEN k % 40 ELSE k END AS STRING)").alias("content_id"),
        F.expr("concat('C:/Cat/', CAST(k % 700 AS STRING), '/', CASE WHEN k % 700 < 300 THEN p_name ELSE CAST(k % 700 AS STRING) END, '.mp3')").alias("path"),
        F.expr("CASE WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN 100 + k % 700 % 60 ELSE (100 + k % 700 % 60) * 100 END").alias("raw_bpm"),
        F.expr(rel.pick(["Am", "Bb", "F#m", "8A", "Dbm", "x"], "k % 700 % 6")).alias("key_text"),
        F.expr("180 + k % 700 % 200").alias("length"), F.col("p_name").alias("title"),
        F.expr("CASE WHEN k % 5 = 0 THEN NULL ELSE p_name END").alias("artist"), F.lit("House").alias("genre"),
        F.expr("CASE WHEN k % 4 = 0 THEN array(CAST(k % 700 AS DOUBLE)) ELSE CAST(array() AS array<double>) END").alias("cues"))


def catalog_files(spark, sf):
    part = rel.read(spark, sf, "part").withColumnRenamed("p_partkey", "k")
    return part.select(F.col("k").alias("file_id"), F.expr(
        "concat('c:/cat/', CAST(k % 900 AS STRING), '/', CASE WHEN k % 900 < 300 THEN p_name ELSE CAST(k % 900 AS STRING) END, '.mp3')").alias("file_path"))


# -------------------------------------------------------------------- queries
def key_functions(spark, sf):
    t = rel.tracks(spark, sf)
    code = keys.key_to_camelot(F.col("key_note"), F.col("key_mode"))
    other = F.concat((F.col("track_id") % 13).cast("string"), F.when(F.col("track_id") % 2 == 0, "A").otherwise("B"))
    label = F.expr(rel.pick(["Am", "Bb", "F#m", "8A", "Dbm", "x", " G ", "C#"], "track_id % 8"))
    return canon(t.select("track_id", code.alias("code"), keys.camelot_number(other).alias("num"), keys.camelot_letter(other).alias("letter"),
                          keys.camelot_distance(code, other).alias("distance"), keys.text_key_to_camelot(label).alias("from_text"),
                          keys.camelot_to_text(code).alias("to_text"), keys.normalize_note(F.lower(label)).alias("note"),
                          keys.normalize_mode(F.upper("key_mode")).alias("mode"),
                          keys.normalize_text(F.concat(F.lit("  A_b "), F.col("title"))).alias("plain")))


def tempo_functions(spark, sf):
    t = rel.tracks(spark, sf)
    k, bpm = F.col("track_id"), F.col("bpm")
    other = F.expr("45e0 + track_id * 11 % 180")
    return canon(t.select(
        "track_id", tempo.effective_bpm_diff(bpm, other).alias("diff"), tempo.bpm_relation(bpm, other).alias("relation"),
        tempo.octave_bpm_error(other, bpm).alias("octave_error"), tempo.bpm_ok(bpm, other).alias("ok"),
        tempo.safe_bpm(k * 13).alias("safe"), tempo.repair_half_time(other).alias("repaired"),
        tempo.seconds_to_bars(F.col("duration"), bpm, "floor").alias("bars_floor"),
        tempo.seconds_to_bars(F.col("duration"), bpm).alias("bars_round"), tempo.bars_to_seconds(F.lit(16), bpm).alias("bar16"),
        tempo.repair_tag_bpm(other, bpm, F.lit(118.0), F.lit(150.0)).alias("tag_repaired")))


def grid_functions(spark, sf):
    t = rel.tracks(spark, sf)
    anchor, width = F.col("first_downbeat"), F.col("bass_punch") * 7.0
    points = F.array(*[F.lit(p) for p in (0.0, 31.5, 60.02, 118.0, 240.0)])
    at = F.col("duration") / 3.0
    return canon(t.select("track_id", *[grid.quantize_to_grid(at, width, anchor, m).alias(m) for m in ("ceil", "floor", "round")],
                          grid.quantize_to_points(at, points, "ceil").alias("next_point"),
                          grid.quantize_to_points(at, points, "floor").alias("last_point")))


def vector_functions(spark, sf):
    v = rel.vectors(spark, sf)
    return canon(v.select("vec_id", vectors.cosine("groove_pattern", "bass_pattern").alias("cosine"),
                          vectors.cyclic_cosine(F.col("groove_pattern"), F.col("bass_pattern")).alias("cyclic"),
                          vectors.texture_similarity(F.slice("raw", 1, 13), F.slice("raw", 14, 13)).alias("texture"),
                          vectors.syncopation(F.col("groove_pattern")).alias("syncopation")))


def names(spark, sf):
    p = rel.read(spark, sf, "part").withColumnRenamed("p_partkey", "k").select("k", F.expr(NAME).alias("file"))
    path = F.concat(F.lit("C:/in/"), F.col("file"))
    artist, title, genre = text.artist_title_genre(path, F.when(F.col("k") % 5 == 0, "Tagged").otherwise("Unknown"), F.lit(None).cast("string"),
                                                   F.lit(""))
    bpm, label_genre, note, mode = text.shop_labels(path)
    return canon(p.select("k", artist.alias("artist"), title.alias("title"), genre.alias("genre"), bpm.alias("label_bpm"), label_genre.alias("label_genre"),
                          note.alias("label_note"), mode.alias("label_mode"), text.bpm_from_name(path).alias("name_bpm"),
                          text.genre_from_name(path).alias("name_genre")))


def tags(spark, sf):
    t = rel.tracks(spark, sf)
    tag = F.concat(F.lit("x "), F.col("genre"))
    return canon(t.select("track_id", text.match_genre_tag(F.col("genre")).alias("exact"), text.match_genre_tag(tag).alias("contained"),
                          text.resolved_genre(F.col("detected_genre"), F.col("genre")).alias("resolved")))


def label_accuracy(spark, sf):
    """Detected genre and tempo against the labels in file names."""
    p = rel.read(spark, sf, "part").withColumnRenamed("p_partkey", "track_id").select("track_id", F.expr(NAME.replace("k ", "track_id ").replace("k,", "track_id,").replace("(k AS", "(track_id AS")).alias("file"))
    t = rel.tracks(spark, sf).select("track_id", "detected_genre", "bpm").join(p, "track_id")
    named = text.genre_from_name(F.col("file"))
    status = F.when(text.genre_label_matches(named, F.col("detected_genre")), "ok").when(named == "?", "unknown").otherwise("wrong")
    label = text.bpm_from_name(F.col("file"))
    rows = t.select(status.alias("status"), F.when(label.isNotNull(), tempo.bpm_ok(F.col("bpm"), label.cast("double"))).alias("bpm_fits"))
    return canon(rows.groupBy("status").agg(F.count("*").alias("n"), F.count("bpm_fits").alias("n_bpm"),
                                            F.sum(F.col("bpm_fits").cast("int")).alias("n_bpm_ok")))


def band_functions(spark, sf):
    t = rel.tracks(spark, sf)
    s = F.col("brightness") / 100.0
    return canon(t.select("track_id", bands.transition_label(s).alias("label"), bands.lamp(s).alias("lamp"), bands.seven_step(s).alias("step7"),
                          bands.texture_label(s).alias("texture"), bands.edge_class(s).alias("edge"),
                          text.minutes_seconds(F.col("duration") - 240.0).alias("mmss")))


def validated(spark, sf):
    valid, rejects = quality.validate_tracks(records(spark, sf))
    return canon(valid.select(F.lit("valid").alias("reason")).unionByName(rejects.select("reason"))
                 .groupBy("reason").agg(F.count("*").alias("n")))


def _limit_input(spark, sf):
    t = rel.tracks(spark, sf)
    files = t.where("track_id % 13 <> 0").select(F.upper("file_path").alias("path"), F.expr("(track_id * 7919 % 600) * 1048576").alias("length"))
    return t.select("playlist_id", "input_pos", "track_id", "file_path", "duration"), files


def limits(spark, sf):
    return canon(quality.safe_tracks(*_limit_input(spark, sf)).select("playlist_id", "track_id"))


def first_tracks(spark, sf):
    return canon(quality.apply_limits(*_limit_input(spark, sf), 20).select("playlist_id", "track_id"))


def sanitized(spark, sf):
    t = rel.tracks(spark, sf).select(
        "track_id", F.when(F.col("track_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("bpm")).alias("bpm"),
        F.transform("timbre", lambda v: F.when(F.col("track_id") % 7 == 0, F.lit(float("inf"))).otherwise(v)).alias("timbre"),
        F.struct(F.when(F.col("track_id") % 3 == 0, F.lit(float("-inf"))).otherwise(F.col("lufs")).alias("lufs")).alias("levels"))
    out = quality.sanitize(t)
    return canon(out.select("track_id", "bpm", F.aggregate("timbre", F.lit(0.0), lambda a, v: a + v).alias("timbre_sum"),
                            F.col("levels.lufs").alias("lufs")))


AI_JSON = ("concat('{\"sub_genre\":\"', CASE WHEN k % 9 = 0 THEN ' ' ELSE ' Deep ' END, '\",\"moods\":', CASE WHEN k % 11 = 0 THEN '[\"a\"]' WHEN k % 13 = 0 THEN "
           "'[1,2]' ELSE '[\"dark\",\" raw\"]' END, ',\"description\":\"d\",\"mix_in_time\":', CASE WHEN k % 17 = 0 THEN '\"1\"' ELSE CAST(k % 250 AS STRING) END, "
           "',\"mix_out_time\":', CAST(k * 3 % 400 AS STRING), CASE WHEN k % 19 = 0 THEN ',\"x\":1}' ELSE '}' END)")


def ai_contract(spark, sf):
    part = rel.read(spark, sf, "part").select(F.col("p_partkey").alias("track_id"), F.expr(AI_JSON.replace("k ", "p_partkey ").replace("(k ", "(p_partkey ")).alias("ai_json"))
    rows = rel.tracks(spark, sf).select("track_id", "duration", "outro_covered").join(part, "track_id")
    out = quality.validate_ai(rows, provider="P", model="M")
    return canon(out.select("track_id", "ai_reason", F.col("ai.sub_genre").alias("sub_genre"), F.array_join("ai.moods", ",").alias("moods"),
                            F.col("ai.mix_in_time").alias("mix_in_time"), quality.provenance_matches(F.col("ai"), "P", "M").alias("current")))


def cue_gate(spark, sf):
    return canon(rel.tracks(spark, sf).select("track_id", quality.cue_export_ok(
        F.col("outro_covered"), F.col("mix_in_point"), F.col("mix_out_point"), F.col("duration")).alias("ok")))


def provenance(spark, sf):
    rows = rel.read(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("track_id"), F.when(F.col("quality") == 1, " Adjudicated").otherwise("draft").alias("label_status"),
        F.when(F.col("doc_id") % 3 == 0, F.lit("zz")).otherwise(F.repeat(F.lit("a1"), 32)).alias("audio_sha256"),
        F.lit("shop").alias("label_source"), F.lit("x").alias("annotator_1"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("y").alias("annotator_2"),
        F.when(F.col("doc_id") % 7 == 0, F.lit(None)).otherwise("z").alias("adjudicator"))
    return canon(quality.check_provenance(rows))


def manifest(spark, sf):
    d = rel.read(spark, sf, "labels").select("doc_id")
    rows = d.select(F.concat(F.lit("p"), (F.col("doc_id") % 350).cast("string")).alias("pair_id"), F.col("doc_id").alias("clip_a"),
                    (F.col("doc_id") * 7 % 390).alias("clip_b"))
    clips = d.select(F.col("doc_id").alias("clip"), F.concat(F.lit("h"), (F.col("doc_id") % 300).cast("string")).alias("sha256"),
                     F.when(F.col("doc_id") % 50 == 0, 48000).otherwise(44100).alias("sample_rate"), F.lit(2).alias("channels"),
                     (F.lit(30.0) + (F.col("doc_id") % 3) * 0.008).alias("duration"))
    return canon(quality.check_ab_manifest(rows, clips))


def store(spark, sf):
    r = records(spark, sf)
    return canon(library.upsert_tracks(r.where("ingest_ts % 2 = 0"), r.where("ingest_ts % 2 = 1"), 2).select("key", "ingest_ts", "version"))


def parsed(spark, sf):
    return canon(library.read_tracks(records(spark, sf)).select("filePath", "bpm", "duration", "mix_in_point"))


def _open_records(spark, sf):
    """Parsed records of one file an event, with open fields."""
    e = rel.read(spark, sf, "events").withColumn("e", F.col("event_id"))
    fields = F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.expr(x)) for n, x in OPEN.items()])
    data = F.concat(F.lit('{"filePath":"C:/o/'), F.col("e").cast("string"), F.lit('.mp3",'), fields, F.lit("}"))
    return library.read_tracks(e.select(F.col("e").alias("ingest_ts"), data.alias("data")))


def typed(spark, sf):
    """Phrases, cues, candidates, AI record and coverage as arrays and structs."""
    t = library.typed_fields(_open_records(spark, sf))

    def first(field: str, name: str):
        return F.get(field, F.lit(0))[name]

    return canon(t.select(
        "filePath", F.size("phrases").alias("n_phrases"), first("phrases", "end_s").alias("phrase_end"), first("phrases", "label").alias("phrase_label"),
        first("phrases", "kind").alias("phrase_kind"), F.size("cue_points").alias("n_cues"), first("cue_points", "t").alias("cue_t"),
        first("cue_points", "hot_cue").alias("hot_cue"), F.size("mix_in_candidates").alias("n_in"), first("mix_in_candidates", "kick_aktiv").alias("kick"),
        first("mix_in_candidates", "energy_lokal").alias("energy"), F.array_join(first("mix_in_candidates", "schema"), ",").alias("schemes"),
        F.size("mix_out_candidates").alias("n_out"), F.col("ai_metadata.sub_genre").alias("sub_genre"), F.array_join("ai_metadata.moods", ",").alias("moods"),
        F.size("analysis_coverage").alias("n_spans"), first("analysis_coverage", "end_s").alias("covered_to")))


def rejected(spark, sf):
    return canon(library.rejected_elements(_open_records(spark, sf)))


def changes(spark, sf):
    t = rel.tracks(spark, sf)
    files = t.select(F.col("file_path").alias("path"), F.expr("track_id * 31 % 1000").alias("length"), F.expr("track_id % 77").alias("modified"))
    older = files.where("modified % 3 <> 0")
    return canon(library.changed_files(library.with_change_key(files), library.with_change_key(older)).select("path", "change_key"))


def signed(spark, sf):
    """Change keys that also cover the catalogue metadata."""
    cat = library.read_catalog(catalog_raw(spark, sf))
    files = cat.select("path", F.lit(7).alias("length"), F.lit(1).alias("modified"))
    out = library.with_change_key(files, cat.select("path", "content_id", "title", "camelot"))
    return canon(out.select("path", F.length("change_key").alias("n_chars"), F.length("signature").alias("n_signature")))


def catalog(spark, sf):
    return canon(library.read_catalog(catalog_raw(spark, sf)).select("path", "basename", "ambiguous", "n_records", "bpm", "camelot", "title"))


def matched(spark, sf):
    return canon(library.match_catalog(catalog_files(spark, sf), library.read_catalog(catalog_raw(spark, sf))).select(
        "file_id", "match", "cat_bpm", "cat_camelot"))


def catalog_statistics(spark, sf):
    return canon(library.catalog_stats(library.read_catalog(catalog_raw(spark, sf))))


def coverage(spark, sf):
    return canon(library.catalog_coverage(library.match_catalog(catalog_files(spark, sf), library.read_catalog(catalog_raw(spark, sf)))))


def predictions(spark, sf):
    return canon(library.predictions_from_tracks(rel.tracks(spark, sf)).select(
        "track_id", "bpm", "key_note", "key_mode", "genre", "mix_in_seconds", "mix_out_seconds", F.size("sections").alias("n_sections")))


def _exported(spark, sf):
    """Playlists with repeated locations and missing paths."""
    t = ordered(spark, sf)
    path = F.when(F.col("track_id") % 23 == 0, F.lit("")).when(F.col("track_id") % 10 == 9, F.lit("C:/music/same.mp3")).otherwise(F.col("file_path"))
    return t.withColumn("file_path", path).withColumn("downbeat_confidence", F.when(F.col("track_id") % 4 == 3, 1.0).otherwise(0.5))


def m3u8(spark, sf):
    return canon(exports.m3u8_lines(_exported(spark, sf), "Set"))


def m3u8_relative(spark, sf):
    return canon(exports.m3u8_lines(_exported(spark, sf), "Set", "C:/music/sets"))


def xml_document(spark, sf):
    return canon(exports.xml_document(exports.deduplicated(_exported(spark, sf)), "Set"))


def export_errors(spark, sf):
    return canon(exports.export_errors(exports.deduplicated(_exported(spark, sf))))


def deduplicated(spark, sf):
    return canon(exports.deduplicated(_exported(spark, sf)).select("playlist_id", "pos", "export_error", "xml_id"))


def xml_rows(spark, sf):
    x = exports.xml_collection(exports.deduplicated(_exported(spark, sf)))
    return canon(x.select("playlist_id", F.col("_TrackID").alias("xml_id"), F.col("_Name").alias("name"), F.col("_Artist").alias("artist"),
                          F.col("_Genre").alias("genre"), F.col("_AverageBpm").alias("bpm"), F.col("_Tonality").alias("tonality"),
                          F.col("_TotalTime").alias("seconds"), F.col("TEMPO._Inizio").alias("anchor")))


def xml_marks(spark, sf):
    return canon(exports.xml_marks(exports.deduplicated(_exported(spark, sf))))


def _collection_file(spark, sf):
    """The exported playlists as XML files in the shared folder."""
    path = f"{lineage.shared_folder(spark)}/collection-{uuid.uuid4().hex}"
    exports.write_xml(exports.xml_document(exports.deduplicated(_exported(spark, sf)), "Set"), path)
    return path


def xml_tracks_read(spark, sf):
    """Collection entries of written files, read back."""
    t = collection.tracks(collection.read_entries(spark, _collection_file(spark, sf)))
    m = F.col("marks")
    return canon(t.select("playlist_id", F.col("track_key").cast("long").alias("xml_id"), "name", "artist", "genre", "duration", "bpm", "key_text", "path",
                          F.get("tempo.start", F.lit(0)).alias("anchor"), F.size(m).alias("n_marks"), F.size(F.filter(m, lambda x: x["hot"])).alias("n_hot"),
                          F.array_join(F.transform(m, lambda x: x["name"]), ",").alias("mark_names"),
                          F.aggregate(m, F.lit(0.0), lambda a, x: a + x["start"]).alias("mark_seconds")))


def xml_members_read(spark, sf):
    """Playlists of written files, read back."""
    t = collection.read_playlists(spark, _collection_file(spark, sf))
    return canon(t.select("playlist_id", "playlist", "position", F.col("track_key").cast("long").alias("xml_id")))


def xml_catalog(spark, sf):
    """Catalogue made of written collection files: the export of all playlists as an import."""
    rows = collection.catalog_rows(collection.tracks(collection.read_entries(spark, _collection_file(spark, sf))))
    return canon(library.read_catalog(rows).select("path", "basename", "ambiguous", "n_records"))


def report(spark, sf):
    return canon(exports.export_report(exports.deduplicated(_exported(spark, sf))))


QUERIES = {
    "f1_f5_keys": key_functions, "f6_f11_tempo": tempo_functions, "f12_f13_grid": grid_functions, "f23_f24_vectors": vector_functions,
    "f14_f15_names": names, "f16_f17_genre_tags": tags, "f25_f26_bands": band_functions, "a10_label_accuracy": label_accuracy,
    "v1_validated_records": validated, "v2_limits": limits, "v2_first_tracks": first_tracks, "v3_sanitized": sanitized, "v5_ai_contract": ai_contract, "v6_cue_gate": cue_gate,
    "v7_provenance": provenance, "v8_ab_manifest": manifest, "s2_parsed_tracks": parsed, "s2_typed_fields": typed, "s2_rejected_elements": rejected, "s3_upserted_store": store, "s4_j6_changed_files": changes,
    "s4_signed_keys": signed, "s5_catalog": catalog, "j5_catalog_match": matched, "a7_catalog_stats": catalog_statistics, "a8_coverage": coverage,
    "s7_predictions": predictions, "s8_m3u8": m3u8, "u2_deduplicated": deduplicated, "s9_xml_collection": xml_rows, "s9_xml_marks": xml_marks,
    "s10_export_report": report, "s10_export_errors": export_errors, "s8_m3u8_relative": m3u8_relative, "s9_xml_document": xml_document,
    "s9_xml_tracks_read": xml_tracks_read, "s9_xml_members_read": xml_members_read, "s9_xml_catalog": xml_catalog,
}

# ------------------------------------------------------------------- SQL twins
C["records"] = duck(f"SELECT *, {', '.join(f'{x} AS {n}' for n, x in RECORD.items())}, {PATH} AS path FROM (SELECT *, event_id AS e FROM events)")
_REASON = """CASE WHEN e % 31 = 0 THEN 'Track-Record ist kein Dictionary' WHEN e % 37 = 0 THEN 'Pflichtfeld fileName fehlt oder ist ungueltig'
  WHEN e % 19 = 0 THEN 'sections muss eine Liste sein' WHEN e % 23 = 0 THEN 'bpm muss numerisch sein' WHEN e % 13 > 10 THEN 'key_confidence liegt ausserhalb 0..1'
  WHEN e % 29 = 0 THEN 'Dauer oder Mixpoint ist ungueltig negativ' WHEN e % 300 >= e * 3 % 420 THEN 'Mix-In muss vor Mix-Out liegen'
  WHEN e % 400 > 0 AND e * 3 % 420 > e % 400 THEN 'Mix-Out liegt hinter dem Trackende' ELSE 'valid' END"""
_KEYTEXT = rel.pick(["Am", "Bb", "F#m", "8A", "Dbm", "x", " G ", "C#"], "track_id % 8")
_TO_TEXT = "CASE code " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in keys.EXPORT_KEYS.items()) + " END"
_OTHER = "(45e0 + track_id * 11 % 180)"
_RATIO = {f: f"abs({_OTHER} * {f} - bpm) / bpm" for f in ("0.5e0", "(2e0 / 3e0)", "1e0", "1.5e0", "2e0")}
_BESTGAP = "least(" + ", ".join(_RATIO.values()) + ")"
_FACTOR = "CASE " + " ".join(f"WHEN {e} = {_BESTGAP} THEN {f}" for f, e in _RATIO.items()) + " END"
C["names"] = duck(f"SELECT p_partkey AS k, {NAME.replace('k ', 'p_partkey ').replace('(k AS', '(p_partkey AS')} AS file FROM part")
_STEM = "regexp_replace(file, '\\.[^.]*$', '')"
_D, _U = r"^(?:\d+[\s.-]*)?([^-]+?)\s*-\s*(.+)$", r"^(?:\d+[\s._-]*)?([^_]+?)_(.+)$"
_SHOP = r"_(\d{2,3})__\(([^)]+)\)_([A-G][#b]?)_(Minor|Major)_"


def _part(group: int) -> str:
    d, u = f"trim(regexp_extract({_STEM}, '{_D}', {group}))", f"trim(regexp_extract({_STEM}, '{_U}', {group}))"
    ok_d = f"length(trim(regexp_extract({_STEM}, '{_D}', 1))) BETWEEN 1 AND 100 AND length(trim(regexp_extract({_STEM}, '{_D}', 2))) BETWEEN 1 AND 200"
    ok_u = f"length(trim(regexp_extract({_STEM}, '{_U}', 1))) BETWEEN 1 AND 100 AND length(trim(regexp_extract({_STEM}, '{_U}', 2))) BETWEEN 1 AND 200"
    return f"CASE WHEN {ok_d} THEN {d} WHEN {ok_u} THEN {u} END"


_ALIAS = "coalesce(" + ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(lower(file), '{o}{a.lower()}{c}')" for o in "(_" for c in ")_") + f" THEN '{a}' END" for a in text.GENRE_ALIASES) + ")"
_NAMEGENRE = (f"coalesce({_ALIAS}, nullif(regexp_extract(file, '__\\(([^)]+)\\)__', 1), ''), list_filter(regexp_extract_all(file, '\\(([^)]+)\\)', 1), "
              "lambda g: NOT (" + " OR ".join(f"contains(lower(g), '{w}')" for w in text.VERSION_WORDS) + "))[1], '?')")
_F = "translate(lower(ng), '_-', '  ')"
_MATCH = "(" + " OR ".join(
    f"(detected_genre = '{g}' AND (" + " OR ".join(f"contains({_F}, '{a.lower().replace('-', ' ')}') OR contains('{a.lower().replace('-', ' ')}', {_F})" for a in al) + "))"
    for g, al in text.ALIASES_OF.items()) + f" OR contains({_F}, lower(detected_genre)) OR contains(lower(detected_genre), {_F}) OR (contains({_F}, 'psy') AND contains(lower(detected_genre), 'psy')))"
C["cat_raw"] = f"""SELECT CAST(CASE WHEN k % 3 = 0 THEN k % 40 ELSE k END AS VARCHAR) AS content_id,
  lower('c:/cat/' || (k % 700) || '/' || CASE WHEN k % 700 < 300 THEN p_name ELSE CAST(k % 700 AS VARCHAR) END || '.mp3') AS path,
  lower(CASE WHEN k % 700 < 300 THEN p_name ELSE CAST(k % 700 AS VARCHAR) END || '.mp3') AS basename,
  CASE WHEN k % 11 = 0 THEN NULL ELSE 100e0 + k % 700 % 60 END AS bpm,
  CASE k % 700 % 6 WHEN 0 THEN '8A' WHEN 1 THEN '6B' WHEN 2 THEN '11A' WHEN 3 THEN '8A' WHEN 4 THEN '12A' END AS camelot, 180 + k % 700 % 200 AS duration,
  p_name AS title, CASE WHEN k % 5 = 0 THEN NULL ELSE p_name END AS artist, CASE WHEN k % 4 = 0 THEN k % 700 END AS cue
 FROM (SELECT *, p_partkey AS k FROM part)"""
C["cat"] = """SELECT path, any_value(basename) AS basename, count(*) AS n_records, arg_max(r, {'q': q, 'c': content_id}) AS r,
  coalesce(min(bpm) <> max(bpm), false) OR coalesce(min(camelot) <> max(camelot), false) OR min(duration) <> max(duration) OR min(title) <> max(title)
   OR coalesce(min(artist) <> max(artist), false) OR min(content_id) <> max(content_id) OR coalesce(min(cue) <> max(cue), false) AS ambiguous
 FROM (SELECT *, {'bpm': bpm, 'camelot': camelot, 'title': title, 'cue': cue} AS r, (bpm IS NOT NULL)::INT + (camelot IS NOT NULL)::INT + 2 + (cue IS NOT NULL)::INT AS q FROM cat_raw) GROUP BY 1"""
C["cat_names"] = "SELECT basename, sum(n_records) AS n_named, arg_max(r, path) AS named FROM cat GROUP BY 1"
C["cat_match"] = """SELECT file_id, file_name, CASE WHEN ambiguous THEN 'ambiguous' WHEN c.path IS NOT NULL THEN 'path' WHEN n_named = 1 THEN 'basename' WHEN n_named > 1 THEN 'ambiguous' ELSE 'missing' END AS match,
  c.r AS exact, named, file_path FROM (SELECT p_partkey AS file_id, 'c:/cat/' || (p_partkey % 900) || '/' || CASE WHEN p_partkey % 900 < 300 THEN p_name ELSE CAST(p_partkey % 900 AS VARCHAR) END || '.mp3' AS file_path,
   CASE WHEN p_partkey % 900 < 300 THEN p_name ELSE CAST(p_partkey % 900 AS VARCHAR) END || '.mp3' AS file_name FROM part)
  LEFT JOIN cat c ON c.path = lower(file_path) LEFT JOIN cat_names n ON n.basename = lower(file_name)"""
_REC = "CASE match WHEN 'path' THEN exact WHEN 'basename' THEN named END"
_XPATH = "CASE WHEN track_id % 23 = 0 THEN '' WHEN track_id % 10 = 9 THEN 'C:/music/same.mp3' ELSE file_path END"
C["exported"] = f"""SELECT *, CASE WHEN export_error IS NULL THEN sum(CASE WHEN export_error IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY playlist_id ORDER BY pos) END AS xml_id FROM (
  SELECT *, CASE WHEN xpath = '' THEN 'Track uebersprungen (kein Dateipfad): ' || title
    WHEN row_number() OVER (PARTITION BY playlist_id, lower(xpath) ORDER BY pos) > 1 THEN 'Track uebersprungen (Duplikat): ' || xpath END AS export_error
  FROM (SELECT * REPLACE (CASE WHEN track_id % 4 = 3 THEN 1e0 ELSE 0.5e0 END AS downbeat_confidence), input_pos AS pos, {_XPATH} AS xpath FROM tracks))"""
_CUEOK = "outro_covered AND mix_in_point >= 0 AND mix_in_point < mix_out_point AND mix_out_point <= duration"
_GRIDOK = "downbeat_confidence = 1 AND first_downbeat < duration"
_AIK = "track_id"
_AI_REASON = """CASE WHEN k % 19 = 0 THEN 'KI-Ergebnis muss exakt das definierte Fuenf-Key-Schema besitzen' WHEN k % 9 = 0 THEN 'sub_genre muss ein nichtleerer String sein'
  WHEN k % 11 = 0 THEN 'moods muss zwei bis drei Eintraege besitzen' WHEN k % 13 = 0 THEN 'Jeder Mood muss ein nichtleerer String sein'
  WHEN k % 17 = 0 THEN 'mix_in_time muss eine JSON-Zahl sein' WHEN NOT (k % 250 < k * 3 % 400 AND k * 3 % 400 <= duration) THEN 'KI-Mixpoints verletzen die Track-Grenzen' END"""


def _band(value: str, rows, low: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {b}e0 THEN '{n}'" for b, n in rows) + f" ELSE '{low}' END"


_DIFFS = ("abs(bpm - {o})", "abs(bpm - {o} * 2e0)", "abs(bpm - {o} / 2e0)")
_DIFFS = tuple(d.format(o=_OTHER) for d in _DIFFS)
_PTS = "[0e0, 31.5e0, 60.02e0, 118e0, 240e0]"

SQL = {
    "f1_f5_keys": sql(with_ctes(C, ["tracks", "wheel"], f"""
        SELECT *, CASE WHEN code <> '' AND num > 0 THEN least(abs(cn - num), 12 - abs(cn - num)) END AS distance, {_TO_TEXT} AS to_text FROM (
         SELECT track_id, coalesce(code, '') AS code, CAST(regexp_extract(code, '^[0-9]+') AS INT) AS cn, CASE WHEN track_id % 13 = 0 THEN 0 ELSE track_id % 13 END AS num,
           CASE WHEN track_id % 13 = 0 THEN '' WHEN track_id % 2 = 0 THEN 'A' ELSE 'B' END AS letter,
           CASE track_id % 8 WHEN 0 THEN '8A' WHEN 1 THEN '6B' WHEN 2 THEN '11A' WHEN 3 THEN '8A' WHEN 4 THEN '12A' WHEN 6 THEN '9B' WHEN 7 THEN '3B' END AS from_text,
           CASE track_id % 8 WHEN 0 THEN 'AM' WHEN 1 THEN 'A#' WHEN 2 THEN 'F#M' WHEN 3 THEN '8A' WHEN 4 THEN 'DBM' WHEN 5 THEN 'X' WHEN 6 THEN 'G' ELSE 'C#' END AS note,
           key_mode AS mode, 'a b ' || lower(title) AS plain
         FROM tracks LEFT JOIN wheel w ON w.note = key_note AND w.mode = key_mode)"""), "track_id num distance",
        texts="code letter from_text to_text note mode plain"),
    "f6_f11_tempo": sql(with_ctes(C, ["tracks"], f"""
        SELECT track_id, least({', '.join(_DIFFS)}) AS diff, CASE WHEN {_DIFFS[0]} <= {_DIFFS[1]} AND {_DIFFS[0]} <= {_DIFFS[2]} THEN 'direct' WHEN {_DIFFS[1]} <= {_DIFFS[2]} THEN 'half' ELSE 'double' END AS relation,
          least({', '.join(_DIFFS)}) AS octave_error, least(abs(bpm - {_OTHER}), abs(bpm - {_OTHER} * 2e0), abs(bpm * 2e0 - {_OTHER})) <= 3 AS ok,
          CASE WHEN track_id * 13 / 100e0 BETWEEN 40 AND 250 THEN track_id * 13 / 100e0 WHEN track_id * 13 BETWEEN 40 AND 250 THEN track_id * 13e0 END AS safe,
          CASE WHEN {_OTHER} > 40 AND {_OTHER} < 95 AND {_OTHER} * 2 <= 185 THEN {_OTHER} * 2 WHEN {_OTHER} > 200 THEN {_OTHER} / 2 ELSE {_OTHER} END AS repaired,
          floor(duration / (60e0 / bpm * 4e0)) AS bars_floor, round_even(duration / (60e0 / bpm * 4e0), 0) AS bars_round, 16e0 * (60e0 / bpm * 4e0) AS bar16,
          CASE WHEN {_FACTOR} <> 1 AND abs({_OTHER} - bpm) / bpm > 0.08e0 AND {_BESTGAP} <= 0.06e0 AND NOT ({_OTHER} BETWEEN 118 AND 150)
            AND {_OTHER} * {_FACTOR} BETWEEN 118 AND 150 THEN round_even({_OTHER} * {_FACTOR}, 2) ELSE {_OTHER} END AS tag_repaired FROM tracks"""),
        "track_id bars_floor bars_round", "diff octave_error safe repaired bar16 tag_repaired", "relation", "ok"),
    "f12_f13_grid": sql(with_ctes(C, ["tracks"], f"""
        SELECT track_id, {', '.join(f"{q('duration / 3e0', 'bass_punch * 7e0', 'first_downbeat', m)} AS {m}" for m in ('ceil', 'floor', 'round'))},
          list_min(list_filter({_PTS}, lambda p: p >= duration / 3e0 - 0.05e0)) AS next_point, list_max(list_filter({_PTS}, lambda p: p <= duration / 3e0 + 0.05e0)) AS last_point FROM tracks"""),
        "track_id", "ceil floor round next_point last_point"),
    "f23_f24_vectors": sql(with_ctes(C, ["vectors"], """
        SELECT vec_id, c0 AS cosine, greatest(c0, c4, c8, c12) AS cyclic, texture, syncopation FROM (
          SELECT vec_id, list_cosine_similarity(a, b) AS c0, list_cosine_similarity(a, list_concat(b[13:16], b[1:12])) AS c4,
            list_cosine_similarity(a, list_concat(b[9:16], b[1:8])) AS c8, list_cosine_similarity(a, list_concat(b[5:16], b[1:4])) AS c12,
            list_cosine_similarity(raw[2:13], raw[15:26]) AS texture, (a[3] + a[7] + a[11] + a[15]) / (a[1] + a[5] + a[9] + a[13] + a[3] + a[7] + a[11] + a[15]) AS syncopation
          FROM (SELECT *, groove_pattern AS a, bass_pattern AS b FROM vectors))"""), "vec_id", "cosine cyclic texture syncopation"),
    "f14_f15_names": sql(with_ctes(C, ["names"], f"""
        SELECT k, CASE WHEN k % 5 = 0 THEN 'Tagged' ELSE coalesce({_part(1)}, 'Unknown') END AS artist, coalesce({_part(2)}, file) AS title, 'Unknown' AS genre,
          TRY_CAST(nullif(regexp_extract(file, '{_SHOP}', 1), '') AS DOUBLE) AS label_bpm, nullif(replace(regexp_extract(file, '{_SHOP}', 2), '_', ' '), '') AS label_genre,
          CASE nullif(regexp_extract(file, '{_SHOP}', 3), '') WHEN 'Bb' THEN 'A#' WHEN 'Db' THEN 'C#' ELSE nullif(regexp_extract(file, '{_SHOP}', 3), '') END AS label_note,
          nullif(regexp_extract(file, '{_SHOP}', 4), '') AS label_mode, TRY_CAST(nullif(regexp_extract(file, '_(\\d{{2,3}})__', 1), '') AS INT) AS name_bpm, {_NAMEGENRE} AS name_genre FROM names"""),
        "k name_bpm", "label_bpm", "artist title genre label_genre label_note label_mode name_genre"),
    "f16_f17_genre_tags": sql(with_ctes(C, ["tracks", "genre_tags"], f"""
        SELECT track_id, coalesce(g.canonical, c.canonical) AS exact, c.canonical AS contained, {resolved('detected_genre', 't.genre')} AS resolved FROM tracks t
          LEFT JOIN genre_tags g ON g.tag = lower(t.genre)
          LEFT JOIN (SELECT genre, first(canonical ORDER BY length(tag) DESC) AS canonical FROM (SELECT DISTINCT genre FROM tracks) JOIN genre_tags ON contains(lower(genre), tag) GROUP BY 1) c
            ON c.genre = t.genre"""), "track_id", texts="exact contained resolved"),
    "f25_f26_bands": sql(with_ctes(C, ["tracks"], f"""
        SELECT track_id, {_band('s', bands.TRANSITION_BANDS, 'Riskant')} AS label, {_band('s', bands.LAMP_BANDS, 'danger')} AS lamp,
          {_band('s', bands.SEVEN_STEPS, '#ff3b30')} AS step7, {_band('s', bands.TEXTURE_BANDS, 'Klang: Discord')} AS texture,
          CASE WHEN s <= 0.001e0 THEN 'danger' WHEN s >= 0.6e0 THEN 'success' ELSE 'warning' END AS edge,
          CASE WHEN d < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs(d) / 60) AS BIGINT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(abs(d) % 60) AS BIGINT) AS VARCHAR), 2, '0') AS mmss
        FROM (SELECT track_id, brightness / 100e0 AS s, duration - 240e0 AS d FROM tracks)"""), "track_id", texts="label lamp step7 texture edge mmss"),
    "a10_label_accuracy": sql(with_ctes(C, ["tracks", "names"], f"""
        SELECT status, count(*) AS n, count(fits) AS n_bpm, sum(CASE WHEN fits THEN 1 WHEN fits IS NOT NULL THEN 0 END) AS n_bpm_ok FROM (
          SELECT CASE WHEN ng <> '?' AND {_MATCH} THEN 'ok' WHEN ng = '?' THEN 'unknown' ELSE 'wrong' END AS status,
            least(abs(bpm - nb), abs(bpm - nb * 2e0), abs(bpm * 2e0 - nb)) <= 3 AS fits FROM (
            SELECT detected_genre, bpm, {_NAMEGENRE} AS ng, TRY_CAST(nullif(regexp_extract(file, '_(\\d{{2,3}})__', 1), '') AS INT) AS nb
            FROM tracks JOIN names ON k = track_id)) GROUP BY 1"""), "n n_bpm n_bpm_ok", texts="status"),
    "v1_validated_records": sql(with_ctes(C, ["records"], f"SELECT {_REASON} AS reason, count(*) AS n FROM records GROUP BY 1"), "n", texts="reason"),
    "v2_limits": sql(with_ctes(C, ["tracks"], "SELECT playlist_id, track_id FROM tracks WHERE track_id % 13 <> 0 AND track_id * 7919 % 600 <= 500"),
        "playlist_id track_id"),
    "v2_first_tracks": sql(with_ctes(C, ["tracks"], """SELECT playlist_id, track_id FROM tracks WHERE track_id % 13 <> 0 AND track_id * 7919 % 600 <= 500
        QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY input_pos) <= 20"""), "playlist_id track_id"),
    "v3_sanitized": sql(with_ctes(C, ["tracks"], """SELECT track_id, CASE WHEN track_id % 5 = 0 THEN 0e0 ELSE bpm END AS bpm,
        CASE WHEN track_id % 7 = 0 THEN 0e0 ELSE coalesce(list_sum(timbre), 0e0) END AS timbre_sum, CASE WHEN track_id % 3 = 0 THEN 0e0 ELSE lufs END AS lufs FROM tracks"""),
        "track_id", "bpm timbre_sum lufs"),
    "v5_ai_contract": sql(with_ctes(C, ["tracks"], f"""
        SELECT track_id, ai_reason, CASE WHEN ai_reason IS NULL THEN 'Deep' END AS sub_genre, CASE WHEN ai_reason IS NULL THEN 'dark,raw' END AS moods,
          CASE WHEN ai_reason IS NULL AND outro_covered THEN k % 250 END AS mix_in_time, ai_reason IS NULL AS current
        FROM (SELECT *, {_AI_REASON} AS ai_reason FROM (SELECT *, track_id AS k FROM tracks))"""), "track_id", "mix_in_time", "ai_reason sub_genre moods", "current"),
    "v6_cue_gate": sql(with_ctes(C, ["tracks"], f"SELECT track_id, {_CUEOK} AS ok FROM tracks"), "track_id", bools="ok"),
    "v7_provenance": sql("""SELECT CAST(doc_id AS VARCHAR) AS track_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 = 0 THEN 'missing: annotator_2,adjudicator'
        WHEN doc_id % 5 = 0 THEN 'missing: annotator_2' WHEN doc_id % 7 = 0 THEN 'missing: adjudicator' ELSE 'invalid audio_sha256' END AS problem
        FROM labels WHERE quality = 1 AND (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0)""", texts="track_id problem"),
    "v8_ab_manifest": sql("""SELECT DISTINCT pair_id, problem FROM (SELECT pair_id, concat_ws('; ', CASE WHEN same_id > 1 THEN 'pair_id missing or repeated' END,
          CASE WHEN hb IS NULL THEN 'clip missing' END, CASE WHEN ha = hb THEN 'identical clips' END,
          CASE WHEN count(*) OVER (PARTITION BY concat_ws('|', least(ha, hb), greatest(ha, hb))) > 1 THEN 'clip pair repeated' END,
          CASE WHEN ra <> rb THEN 'format differs' END, CASE WHEN abs(da - db) > 0.01e0 THEN 'duration differs' END) AS problem
        FROM (SELECT 'p' || (l.doc_id % 350) AS pair_id, count(*) OVER (PARTITION BY l.doc_id % 350) AS same_id, 'h' || (l.doc_id % 300) AS ha, CASE WHEN b.doc_id IS NOT NULL THEN 'h' || (b.doc_id % 300) END AS hb,
            CASE WHEN l.doc_id % 50 = 0 THEN 48000 ELSE 44100 END AS ra, CASE WHEN b.doc_id % 50 = 0 THEN 48000 WHEN b.doc_id IS NOT NULL THEN 44100 END AS rb,
            30e0 + (l.doc_id % 3) * 0.008e0 AS da, 30e0 + (b.doc_id % 3) * 0.008e0 AS db
          FROM labels l LEFT JOIN labels b ON b.doc_id = l.doc_id * 7 % 390)) WHERE problem <> ''""", texts="pair_id problem"),
    "s2_parsed_tracks": sql(with_ctes(C, ["records"], """SELECT arg_max(path, e) AS "filePath", max(CASE WHEN e = m AND e % 23 <> 0 THEN 90e0 + e % 60 END) AS bpm,
        max(CASE WHEN e = m THEN CASE WHEN e % 29 = 0 THEN -5e0 ELSE e % 400 END END) AS duration, max(CASE WHEN e = m THEN e % 300 END) AS mix_in_point
        FROM (SELECT *, max(e) OVER (PARTITION BY path) AS m FROM records WHERE e % 31 <> 0) GROUP BY path"""), "", "bpm duration mix_in_point", '"filePath"'),
    "s3_upserted_store": sql(with_ctes(C, ["records"], "SELECT key, max(ingest_ts) AS ingest_ts, 2 AS version FROM records WHERE version = 2 GROUP BY 1"),
                             "ingest_ts version", texts="key"),
    "s4_j6_changed_files": sql(with_ctes(C, ["tracks"], """SELECT path, change_key FROM (SELECT file_path AS path, lower(file_path) || '-' || (track_id * 31 % 1000) || '-' || (track_id % 77) AS change_key,
        track_id % 77 % 3 AS m FROM tracks) WHERE m = 0"""), texts="path change_key"),
    "s4_signed_keys": sql(with_ctes(C, ["cat"], "SELECT path, length(path) + length('-7-1-source-') + 64 AS n_chars, 64 AS n_signature FROM cat"), "n_chars n_signature", texts="path"),
    "s5_catalog": sql(with_ctes(C, ["cat"], "SELECT path, basename, ambiguous, n_records, r.bpm AS bpm, r.camelot AS camelot, r.title AS title FROM cat"),
                      "n_records", "bpm", "path basename camelot title", "ambiguous"),
    "j5_catalog_match": sql(with_ctes(C, ["cat_match"], f"SELECT file_id, match, ({_REC}).bpm AS cat_bpm, ({_REC}).camelot AS cat_camelot FROM cat_match"),
                            "file_id", "cat_bpm", "match cat_camelot"),
    "a7_catalog_stats": sql(with_ctes(C, ["cat"], """SELECT count(*) AS total_tracks, count(r.bpm) AS tracks_with_bpm, count(r.camelot) AS tracks_with_key, count(r.cue) AS tracks_with_cues,
        avg(r.bpm) AS average_bpm FROM cat WHERE NOT ambiguous"""), "total_tracks tracks_with_bpm tracks_with_key tracks_with_cues", "average_bpm"),
    "a8_coverage": sql(with_ctes(C, ["cat_match"], f"""SELECT status, any_value(n) AS n, string_agg(file_name, ',' ORDER BY file_name) AS examples FROM (
          SELECT *, row_number() OVER (PARTITION BY status ORDER BY file_path) AS rk, count(*) OVER (PARTITION BY status) AS n FROM (
           SELECT *, CASE WHEN match IN ('path', 'basename') AND ({_REC}).bpm IS NOT NULL THEN 'with_analysis' WHEN match IN ('path', 'basename') THEN 'without_analysis'
             WHEN match = 'ambiguous' THEN 'ambiguous' ELSE 'not_in_collection' END AS status FROM cat_match)) WHERE rk <= 3 GROUP BY 1"""), "n", texts="status examples"),
    "s7_predictions": sql(with_ctes(C, ["tracks", "track_sections"], f"""SELECT CAST(t.track_id AS VARCHAR) AS track_id, bpm, nullif(key_note, '') AS key_note, nullif(key_mode, '') AS key_mode, {resolved()} AS genre,
        nullif(mix_in_point, -1) AS mix_in_seconds, nullif(mix_out_point, -1) AS mix_out_seconds, (SELECT count(*) FROM track_sections s WHERE s.track_id = t.track_id) AS n_sections FROM tracks t"""),
        "n_sections", "bpm mix_in_seconds mix_out_seconds", "track_id key_note key_mode genre"),
    "s8_m3u8": sql(with_ctes(C, ["exported"], """SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos, ln) - 1 AS line_no, line FROM (
        SELECT playlist_id, -1 AS pos, unnest([0, 1, 2, 3]) AS ln, unnest(['#EXTM3U', '#EXTENC:UTF-8', '#PLAYLIST:Set', '']) AS line FROM (SELECT DISTINCT playlist_id FROM exported)
        UNION ALL SELECT playlist_id, pos, unnest([0, 1, 2]), unnest(['#EXTINF:' || CAST(duration AS BIGINT) || ',' || artist || ' - ' || title, xpath, '']) FROM exported WHERE xpath <> '')"""),
        "playlist_id line_no", texts="line"),
    "s8_m3u8_relative": sql(with_ctes(C, ["exported"], """SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id ORDER BY pos, ln) - 1 AS line_no, line FROM (
        SELECT playlist_id, -1 AS pos, unnest([0, 1, 2, 3]) AS ln, unnest(['#EXTM3U', '#EXTENC:UTF-8', '#PLAYLIST:Set', '']) AS line FROM (SELECT DISTINCT playlist_id FROM exported)
        UNION ALL SELECT playlist_id, pos, unnest([0, 1, 2]), unnest(['#EXTINF:' || CAST(duration AS BIGINT) || ',' || artist || ' - ' || title, regexp_replace(xpath, '^C:/music/', '../'), '']) FROM exported WHERE xpath <> '')"""),
        "playlist_id line_no", texts="line"),
    "s9_xml_document": sql(with_ctes(C, ["exported", "wheel", "track_sections"], f"""
        SELECT * FROM (WITH kept AS (SELECT * FROM exported LEFT JOIN wheel ON note = key_note AND mode = key_mode WHERE export_error IS NULL),
        lists AS (SELECT playlist_id, count(*) FILTER (WHERE export_error IS NULL) AS n FROM exported GROUP BY 1),
        marks AS (SELECT playlist_id, xml_id, row_number() OVER (PARTITION BY playlist_id, xml_id ORDER BY grp, ord) - 1 AS seq, name, start, num FROM (
          SELECT playlist_id, xml_id, 0 AS grp, unnest([1, 2, 3, 4]) AS ord, unnest(['MIX IN', 'MIX IN', 'MIX OUT', 'MIX OUT']) AS name,
            unnest([mix_in_point, mix_in_point, mix_out_point, mix_out_point]) AS start, unnest([0, -1, 1, -1]) AS num FROM kept WHERE {_CUEOK}
          UNION ALL SELECT playlist_id, xml_id, 1, section_idx, upper(label), start_time, -1 FROM kept e JOIN track_sections s ON s.track_id = e.track_id
            WHERE {_CUEOK} AND label IN ('drop', 'breakdown') AND start_time > 0))
        SELECT playlist_id, unnest([0, 0, 0, 2, 2, 2, 2, 4, 4]) AS part, 0 AS xml_id, unnest([0, 1, 2, 0, 1, 2, 3, 0, 1]) AS seq, unnest(['<?xml version="1.0" encoding="UTF-8"?>',
          '<DJ_PLAYLISTS Version="1.0.0">', '<COLLECTION Entries="' || n || '">', '</COLLECTION>', '<PLAYLISTS><NODE Type="0" Name="ROOT" Count="1">', '<NODE Type="0" Count="1" Name="Playlists">',
          '<NODE Type="1" KeyType="0" Name="Set" Entries="' || n || '">', '</NODE></NODE></NODE></PLAYLISTS>', '</DJ_PLAYLISTS>']) AS line FROM lists
        UNION ALL SELECT playlist_id, 1, xml_id, -2, '<TRACK TrackID="' || CAST(xml_id AS BIGINT) || '" Name="' || replace(replace(title, '&', '&amp;'), '"', '&quot;') || '" Artist="' || replace(artist, '&', '&amp;') || '" Genre="'
           || replace(CASE WHEN detected_genre <> 'Unknown' THEN detected_genre ELSE genre END, '&', '&amp;') || '" TotalTime="' || CAST(duration AS BIGINT) || '" AverageBpm="' || format('{{:.2f}}', bpm) || '"'
           || coalesce(' Tonality="' || ({_TO_TEXT}) || '"', '') || ' Location="file://localhost/' || replace(replace(xpath, ' ', '%20'), '#', '%23') || '">' FROM kept
        UNION ALL SELECT playlist_id, 1, xml_id, -1, '<TEMPO Inizio="' || format('{{:.3f}}', round_even(first_downbeat * 1000e0, 0) / 1000e0) || '" Bpm="' || format('{{:.2f}}', bpm) || '" Metro="4/4" Battito="1"/>' FROM kept WHERE {_GRIDOK}
        UNION ALL SELECT playlist_id, 1, xml_id, 1073741824, '</TRACK>' FROM kept
        UNION ALL SELECT playlist_id, 1, xml_id, seq, '<POSITION_MARK Name="' || name || '" Type="0" Start="' || format('{{:.3f}}', round_even(start * 1000e0, 0) / 1000e0) || '" Num="' || num || '"/>' FROM marks
        UNION ALL SELECT playlist_id, 3, xml_id, 0, '<TRACK Key="' || CAST(xml_id AS BIGINT) || '"/>' FROM kept)"""), "playlist_id part xml_id seq", texts="line"),
    "s2_typed_fields": sql("""SELECT *, CASE WHEN n_phrases = 1 THEN e % 90 + 16 END AS phrase_end, CASE WHEN n_phrases = 1 THEN 'P' || (e % 3) END AS phrase_label,
          CASE WHEN n_phrases = 1 THEN e % 4 END AS phrase_kind, CASE WHEN n_cues = 1 THEN e % 50 - 5 END AS cue_t, CASE WHEN n_cues = 1 AND e % 2 = 1 THEN 3 END AS hot_cue,
          CASE WHEN n_in = 1 THEN e % 2 = 0 END AS kick, CASE WHEN n_in = 1 THEN e % 100 END AS energy, CASE WHEN n_in = 1 THEN 'phrase,cue' END AS schemes
        FROM (SELECT event_id AS e, 'C:/o/' || event_id || '.mp3' AS "filePath", CASE WHEN event_id % 11 = 0 THEN 0 ELSE 1 END AS n_phrases,
          CASE WHEN event_id % 13 = 0 OR event_id % 50 < 5 THEN 0 ELSE 1 END AS n_cues, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS n_in, 0 AS n_out,
          CASE WHEN event_id % 5 <> 0 THEN 'g' || (event_id % 6) END AS sub_genre, CASE WHEN event_id % 5 <> 0 THEN 'a,b' END AS moods, 1 AS n_spans, event_id % 300 AS covered_to FROM events)""",
        "n_phrases phrase_kind n_cues hot_cue n_in energy n_out n_spans", "phrase_end cue_t covered_to", '"filePath" phrase_label schemes sub_genre moods', "kick"),
    "s2_rejected_elements": sql(with_ctes({**C, "open_records": duck("SELECT event_id, " + ", ".join(f"{x} AS {n}" for n, x in OPEN.items())
                                                                     + " FROM (SELECT *, event_id AS e FROM events)")}, ["open_records"], """
        SELECT 'C:/o/' || event_id || '.mp3' AS "filePath", * FROM (
          SELECT event_id, 'phrases' AS field, 0 AS position, rtrim(substr(phrases, 2), ',nul]') AS element, 'value of another type' AS reason FROM open_records WHERE event_id % 11 = 0
          UNION ALL SELECT event_id, 'phrases', 1, NULL, 'no record' FROM open_records WHERE event_id % 7 = 0
          UNION ALL SELECT event_id, 'cue_points', -1, cue_points, 'no list' FROM open_records WHERE event_id % 13 = 0
          UNION ALL SELECT event_id, 'cue_points', 0, substr(cue_points, 2, length(cue_points) - 2), 't is no time' FROM open_records WHERE event_id % 13 <> 0 AND event_id % 50 < 5
          UNION ALL SELECT event_id, 'mix_in_candidates', 0, substr(mix_in_candidates, 2, length(mix_in_candidates) - 2), 'value of another type' FROM open_records WHERE event_id % 17 = 0)"""),
        "position", texts='"filePath" field element reason'),
    "s9_xml_tracks_read": sql(with_ctes(C, ["exported", "wheel", "track_sections"], f"""
        SELECT * FROM (WITH kept AS (SELECT *, {_CUEOK} AS cues, {_TO_TEXT} AS key_text FROM exported LEFT JOIN wheel ON note = key_note AND mode = key_mode WHERE export_error IS NULL),
        parts AS (SELECT playlist_id, xml_id, count(*) AS n, string_agg(upper(label), ',' ORDER BY section_idx) AS names, sum(round_even(start_time * 1000e0, 0) / 1000e0) AS secs
          FROM kept e JOIN track_sections s ON s.track_id = e.track_id WHERE cues AND label IN ('drop', 'breakdown') AND start_time > 0 GROUP BY 1, 2)
        SELECT k.playlist_id, CAST(k.xml_id AS BIGINT) AS xml_id, title AS name, artist, CASE WHEN detected_genre <> 'Unknown' THEN detected_genre ELSE genre END AS genre,
          CAST(CAST(duration AS BIGINT) AS DOUBLE) AS duration, CAST(format('{{:.2f}}', bpm) AS DOUBLE) AS bpm, key_text, xpath AS path,
          CASE WHEN {_GRIDOK} THEN round_even(first_downbeat * 1000e0, 0) / 1000e0 END AS anchor,
          CASE WHEN cues THEN 4 + coalesce(n, 0) ELSE 0 END AS n_marks, CASE WHEN cues THEN 2 ELSE 0 END AS n_hot,
          CASE WHEN cues THEN 'MIX IN,MIX IN,MIX OUT,MIX OUT' || coalesce(',' || names, '') ELSE '' END AS mark_names,
          CASE WHEN cues THEN 2 * (round_even(mix_in_point * 1000e0, 0) + round_even(mix_out_point * 1000e0, 0)) / 1000e0 + coalesce(secs, 0) ELSE 0 END AS mark_seconds
        FROM kept k LEFT JOIN parts p ON p.playlist_id = k.playlist_id AND p.xml_id = k.xml_id)"""), "playlist_id xml_id n_marks n_hot", "duration bpm anchor mark_seconds", "name artist genre key_text path mark_names"),
    "s9_xml_members_read": sql(with_ctes(C, ["exported"], """SELECT playlist_id, 'ROOT/Playlists/Set' AS playlist, xml_id - 1 AS position, xml_id FROM exported WHERE export_error IS NULL"""),
                               "playlist_id position xml_id", texts="playlist"),
    "s9_xml_catalog": sql(with_ctes(C, ["exported", "wheel", "track_sections"], f"""
        SELECT * FROM (WITH kept AS (SELECT *, lower(xpath) AS place, {_CUEOK} AS cues, {_TO_TEXT} AS key_text FROM exported LEFT JOIN wheel ON note = key_note AND mode = key_mode WHERE export_error IS NULL),
        marks AS (SELECT playlist_id, xml_id, start FROM (SELECT playlist_id, xml_id, unnest([mix_in_point, mix_out_point]) AS start FROM kept WHERE cues
            UNION ALL SELECT playlist_id, xml_id, start_time FROM kept e JOIN track_sections s ON s.track_id = e.track_id WHERE cues AND label IN ('drop', 'breakdown') AND start_time > 0)),
        lists AS (SELECT playlist_id, xml_id, list_sort(list_distinct(list(round_even(start * 1000e0, 0) / 1000e0)))::VARCHAR AS cue FROM marks GROUP BY 1, 2),
        raw AS (SELECT k.*, cue FROM kept k LEFT JOIN lists l ON l.playlist_id = k.playlist_id AND l.xml_id = k.xml_id)
        SELECT place AS path, regexp_extract(place, '[^/]*$') AS basename, count(*) AS n_records,
          count(DISTINCT format('{{:.2f}}', bpm)) > 1 OR count(DISTINCT key_text) > 1 OR count(DISTINCT CAST(duration AS BIGINT)) > 1 OR count(DISTINCT title) > 1 OR count(DISTINCT artist) > 1
          OR count(DISTINCT CASE WHEN detected_genre <> 'Unknown' THEN detected_genre ELSE genre END) > 1 OR count(DISTINCT xml_id) > 1 OR count(DISTINCT cue) > 1 AS ambiguous
        FROM raw GROUP BY place)"""), "n_records", texts="path basename", bools="ambiguous"),
    "s10_export_errors": sql(with_ctes(C, ["exported"], f"""SELECT playlist_id, pos, export_error AS error FROM exported WHERE export_error IS NOT NULL
        UNION ALL SELECT playlist_id, pos, xpath || ': Beatgrid ausgelassen (kein verlaesslicher Downbeat)' FROM exported WHERE export_error IS NULL AND ({_GRIDOK}) IS NOT TRUE
        UNION ALL SELECT playlist_id, pos, xpath || ': Cues ausgelassen (Coverage/Schema/Provenienz unzureichend)' FROM exported WHERE export_error IS NULL AND ({_CUEOK}) IS NOT TRUE"""),
        "playlist_id pos", texts="error"),
    "u2_deduplicated": sql(with_ctes(C, ["exported"], "SELECT * FROM exported"), "playlist_id pos xml_id", texts="export_error"),
    "s9_xml_collection": sql(with_ctes(C, ["exported", "wheel"], f"""SELECT playlist_id, CAST(CAST(xml_id AS BIGINT) AS VARCHAR) AS xml_id, title AS name, artist, CASE WHEN detected_genre <> 'Unknown' THEN detected_genre ELSE genre END AS genre,
        format('{{:.2f}}', bpm) AS bpm, {_TO_TEXT} AS tonality, CAST(CAST(duration AS BIGINT) AS VARCHAR) AS seconds, CASE WHEN {_GRIDOK} THEN first_downbeat END AS anchor
        FROM exported LEFT JOIN wheel ON note = key_note AND mode = key_mode WHERE export_error IS NULL"""), "playlist_id", "anchor", "xml_id name artist genre bpm tonality seconds"),
    "s9_xml_marks": sql(with_ctes(C, ["exported", "track_sections"], f"""SELECT playlist_id, xml_id, row_number() OVER (PARTITION BY playlist_id, xml_id ORDER BY grp, ord) - 1 AS mark_no, name, start, num FROM (
        SELECT playlist_id, xml_id, 0 AS grp, unnest([1, 2, 3, 4]) AS ord, unnest(['MIX IN', 'MIX IN', 'MIX OUT', 'MIX OUT']) AS name, unnest([mix_in_point, mix_in_point, mix_out_point, mix_out_point]) AS start,
          unnest([0, -1, 1, -1]) AS num FROM exported WHERE export_error IS NULL AND {_CUEOK}
        UNION ALL SELECT playlist_id, xml_id, 1, section_idx, upper(label), start_time, -1 FROM exported e JOIN track_sections s ON s.track_id = e.track_id
          WHERE export_error IS NULL AND {_CUEOK} AND label IN ('drop', 'breakdown') AND start_time > 0)"""), "playlist_id xml_id mark_no num", "start", "name"),
    "s10_export_report": sql(with_ctes(C, ["exported", "track_sections"], f"""SELECT playlist_id, sum(kept) AS tracks_written, sum(CASE WHEN kept = 1 AND cues THEN 4 + parts ELSE 0 END) AS cues_written,
        sum(CASE WHEN kept = 1 AND grid THEN 1 ELSE 0 END) AS beatgrids_written, sum(CASE WHEN kept = 0 THEN 1 ELSE (NOT cues)::INT + (NOT grid)::INT END) AS n_errors,
        CASE WHEN sum(CASE WHEN kept = 0 THEN 1 ELSE (NOT cues)::INT + (NOT grid)::INT END) > 0 THEN 'partial' ELSE 'success' END AS status FROM (
        SELECT playlist_id, (export_error IS NULL)::INT AS kept, {_CUEOK} AS cues, {_GRIDOK} AS grid,
          (SELECT count(*) FROM track_sections s WHERE s.track_id = e.track_id AND label IN ('drop', 'breakdown') AND start_time > 0) AS parts FROM exported e) GROUP BY 1"""),
        "playlist_id tracks_written cues_written beatgrids_written n_errors", texts="status"),
}
