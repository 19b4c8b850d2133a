"""Queries on frame features, structure, genre and downbeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from segue import refdata as R
from segue import lineage
from segue.operators import downbeat, frames, genre, ordered, structure

C = rel.CTES
LENGTH = 300.0

FRAME_COLUMNS = {
    "onset": "value",
    "bass_env": "(e * 17 % 100) / 10e0",
    "rms": "value / 500e0",
    "centroid": "500e0 + (e * 37 % 7500)",
    "flatness": "(e * 7 % 30) / 400e0",
    "contrast": "(e * 7 % 45) * 1e0",
    "sub_power": "(e * 3 % 20) / 10e0",
    "total_power": "2e0 + (e % 50) / 10e0",
    "bass_ms": "(e * 11 % 100) / 10e0",
    "mids_ms": "(e * 13 % 100) / 10e0",
    "highs_ms": "(e * 19 % 100) / 10e0",
    "novelty": "(e * 29 % 101) / 101e0",
    "bass_novelty": "(e * 31 % 97) / 97e0",
    "percussion_novelty": "(e * 43 % 89) / 89e0",
}
TRACK_COLUMNS = {
    "bpm": "100e0 + track_id % 60",
    "first_downbeat": "(track_id % 8) / 16e0",
    "downbeat_confidence": "(track_id % 5) / 4e0",
    "anchor": "(track_id % 8) / 16e0",
    "duration": "300e0",
    "phrase_unit": "CASE WHEN track_id % 2 = 0 THEN 8 ELSE 16 END",
    "genre": rel.pick(rel.TAG_LIST, "track_id % 12"),
}


def frame_rows(spark, sf):
    """Frames from the event stream: a month of events becomes five minutes of frames."""
    e = rel.read(spark, sf, "events").withColumn("e", F.col("event_id")).select(
        "e", F.col("user_id").alias("track_id"), "value", (F.expr(
            "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))") / 8640000000.0).alias("t_sec"))
    indexed = ordered.dense_index(e, ["track_id"], ["t_sec", "e"], F.floor(F.col("t_sec") / 30.0), "frame_idx")
    v = rel.vectors(spark, sf).select("vec_id", F.transform(F.slice("raw", 1, 12), F.abs).alias("chroma"),
                                      F.transform(F.slice("raw", 13, 13), lambda x: x * 100.0).alias("mfcc"))
    return lineage.stored(indexed.withColumn("vec_id", rel.vector_number(spark, sf, "e")).join(v, "vec_id").select(
        "track_id", "frame_idx", "t_sec", *[F.expr(x).alias(n) for n, x in FRAME_COLUMNS.items()], "chroma", "mfcc"))


def frame_tracks(spark, sf):
    ids = rel.read(spark, sf, "events").select(F.col("user_id").alias("track_id")).distinct()
    return ids.select("track_id", *[F.expr(x).alias(n) for n, x in TRACK_COLUMNS.items()])


def frame_sections(spark, sf):
    """Sections of the frame tracks, stretched to their length."""
    ids = rel.read(spark, sf, "events").select(F.col("user_id").alias("l_orderkey")).distinct()
    s = rel.sections(spark, sf, ids)
    return s.select("track_id", "section_idx", "label", (F.col("start_time") / F.col("duration") * LENGTH).alias("start_time"),
                    (F.col("end_time") / F.col("duration") * LENGTH).alias("end_time"), "avg_energy")


def beat_rows(spark, sf):
    """Every frame as a beat: (track_id, beat_idx, beat_time, bass, loudness, chroma)."""
    return frame_rows(spark, sf).select("track_id", F.col("frame_idx").alias("beat_idx"), F.col("t_sec").alias("beat_time"),
                                        F.col("bass_env").alias("bass"), F.col("rms").alias("loudness"), "chroma")


def _joined(name):
    return F.array_join(F.transform(name, lambda v: F.format_string("%.4f", v)), " ").alias(name)


def groove(spark, sf):
    out = frames.groove(frame_rows(spark, sf), frame_tracks(spark, sf), frame_sections(spark, sf), frame_seconds=4.0)
    return canon(out.select("track_id", F.get("groove_pattern", F.lit(0)).alias("groove_0"),
                            F.get("groove_pattern", F.lit(7)).alias("groove_7"), F.get("bass_pattern", F.lit(3)).alias("bass_3"),
                            F.size("groove_pattern").alias("n_groove"), F.size("bass_pattern").alias("n_bass"),
                            "sub_energy", "bass_punch", "syncopation"))


def groove_unmasked(spark, sf):
    out = frames.groove(frame_rows(spark, sf), frame_tracks(spark, sf))
    return canon(out.select("track_id", F.get("groove_pattern", F.lit(0)).alias("groove_0"),
                            F.get("bass_pattern", F.lit(15)).alias("bass_15"), "syncopation"))


def key(spark, sf):
    return canon(frames.key_confidence(frames.detect_key(frames.mean_vectors(frame_rows(spark, sf)))).drop(
        "mfcc_fingerprint", "timbre_fingerprint"))


def fingerprints(spark, sf):
    m = frames.mean_vectors(frame_rows(spark, sf))
    return canon(m.select("track_id", F.get("mfcc_fingerprint", F.lit(0)).alias("mfcc_0"),
                          F.get("mfcc_fingerprint", F.lit(12)).alias("mfcc_12"), F.get("chroma", F.lit(5)).alias("chroma_5")))


def levels(spark, sf):
    return canon(frames.track_levels(frame_rows(spark, sf)))


def vocals(spark, sf):
    return canon(frames.vocal_class(frame_rows(spark, sf)))


def dance(spark, sf):
    return canon(frames.danceability(beat_rows(spark, sf), frame_rows(spark, sf), frame_tracks(spark, sf)))


def bars(spark, sf):
    return canon(frames.bar_length(beat_rows(spark, sf), frame_tracks(spark, sf)))


def commensurate(spark, sf):
    t = frame_tracks(spark, sf)
    return canon(t.select("track_id", downbeat.commensurate(F.lit(60.0) / (F.col("track_id") % 90 + 40.0), F.lit(60.0) / F.col("bpm"))
                          .alias("fits")))


def downbeat_votes(spark, sf):
    # frames are sparse, so the grid check runs against their own mean spacing
    t = frame_tracks(spark, sf)
    span = beat_rows(spark, sf).groupBy("track_id").agg(
        ((F.max("beat_time") - F.min("beat_time")) / (F.count("*") - 1)).alias("ibi"))
    return canon(downbeat.vote_downbeat(beat_rows(spark, sf), t.drop("bpm").join(
        span.select("track_id", (F.lit(60.0) / F.col("ibi")).alias("bpm")), "track_id")))


BINS = 1024


def beat_fold(spark, sf):
    env = frame_rows(spark, sf).select("track_id", "frame_idx", "t_sec", F.col("bass_env").alias("level"))
    return canon(downbeat.fold_beat_phase(env, frame_tracks(spark, sf), BINS))


def phrase_votes(spark, sf):
    b = frame_rows(spark, sf).select("track_id", F.col("frame_idx").alias("bar"), F.col("bass_env").alias("bass"), "novelty",
                                     F.greatest(F.lit(0.0), F.col("rms") - 0.1).alias("rise"))
    return canon(downbeat.vote_phrase(b, frame_tracks(spark, sf)))


def novelty(spark, sf):
    return canon(structure.blend_novelty(frame_rows(spark, sf)).drop("t_sec"))


def bar_curve(spark, sf):
    return canon(structure.bar_novelty(frame_rows(spark, sf), frame_tracks(spark, sf)))


def phrase(spark, sf):
    return canon(structure.phrase_unit(structure.bar_novelty(frame_rows(spark, sf), frame_tracks(spark, sf)), frame_tracks(spark, sf)))


def _picked(spark, sf, most=None):
    return structure.pick_boundaries(frame_rows(spark, sf), frame_tracks(spark, sf), most)


def first_boundaries(spark, sf):
    return canon(_picked(spark, sf, structure.MOST_BOUNDARIES).select("track_id", F.posexplode("boundaries").alias("idx", "t")))


def boundaries(spark, sf):
    return canon(_picked(spark, sf).select("track_id", F.posexplode("boundaries").alias("idx", "t")))


def snapped(spark, sf):
    q = structure.quantize_boundaries(_picked(spark, sf).join(frame_tracks(spark, sf), "track_id"))
    return canon(q.select("track_id", F.posexplode("boundaries").alias("idx", "t")))


def rms_fallback(spark, sf):
    b = structure.rms_boundaries(frame_rows(spark, sf), frame_tracks(spark, sf))
    return canon(b.select("track_id", F.posexplode("boundaries").alias("idx", "t")))


def _stats(spark, sf):
    t = frame_tracks(spark, sf)
    rows = structure.rms_boundaries(frame_rows(spark, sf), t).join(t.select("track_id", "duration"), "track_id")
    return structure.section_stats(frame_rows(spark, sf), structure.section_spans(rows))


def stats(spark, sf):
    return canon(_stats(spark, sf).select("track_id", "section_idx", "start_time", "end_time", "avg_energy", "trend"))


def _trended(spark, sf):
    """Lineitem sections with a trend, as input of the labeller."""
    return rel.sections(spark, sf).select(
        "track_id", F.col("section_idx").cast("int").alias("section_idx"), F.col("n_sections").cast("int").alias("n_sections"),
        "start_time", "end_time", "duration", "avg_energy",
        F.when(F.col("l_partkey") % 3 == 0, "rising").when(F.col("l_partkey") % 3 == 1, "falling").otherwise("stable").alias("trend"))


def labels(spark, sf):
    return canon(structure.label_sections(_trended(spark, sf)).select("track_id", "section_idx", "label"))


def assembled(spark, sf):
    lab = structure.label_sections(_trended(spark, sf))
    t = rel.sections(spark, sf).select("track_id", F.col("section_bpm").alias("bpm")).distinct()
    out = structure.assemble_sections(lab, t)
    s = F.element_at("sections", -1)
    return canon(out.select("track_id", F.size("sections").alias("n"), "total_bars", s["label"].alias("last_label"),
                            s["start_bar"].alias("start_bar"), s["end_bar"].alias("end_bar"), s["avg_energy"].alias("avg_energy")))


def merged(spark, sf):
    s = rel.sections(spark, sf).select("track_id", "section_idx", "label", "start_time", "end_time", "avg_energy", "section_bpm", "duration")
    t = s.groupBy("track_id").agg(F.first("section_bpm").alias("bpm"), F.max("duration").alias("head_duration"))
    k = F.col("track_id")
    t = t.select("track_id", "bpm", "head_duration", (F.col("head_duration") + (k % 4) * 150.0).alias("duration"),
                 F.when(k % 7 != 0, 180.0).alias("tail_duration"))
    cut = s.select("track_id", "section_idx", "label", "start_time", "end_time", "avg_energy")
    return canon(structure.merge_windows(cut, cut.where("section_idx < 2"), t).select(
        "track_id", "section_idx", "label", "start_time", "end_time", "outro_covered"))


def fallback_points(spark, sf):
    from segue.operators import mixpoints
    out = mixpoints.fallback_sections(frame_rows(spark, sf), frame_tracks(spark, sf), 4.5)
    s = F.get("sections", F.lit(1))
    return canon(out.select("track_id", "intro_t", "outro_t", s["avg_energy"].alias("main_energy")))


def classified(spark, sf):
    feats = genre.genre_features(frame_rows(spark, sf)).join(frame_tracks(spark, sf), "track_id").withColumns({
        "onset_rate": F.expr("(track_id % 90) / 10e0"), "bass_intensity": F.expr("CAST(track_id * 7 % 101 AS INT)"),
        "centroid": F.expr("800e0 + track_id * 31 % 3800"), "flatness": F.expr("(track_id % 18) / 100e0"),
        "rms_variance": F.expr("(track_id % 60) / 100e0"), "bpm": F.expr("118e0 + track_id * 7 % 64")})
    return canon(genre.classify_genre(feats))


def genre_profile_features(spark, sf):
    return canon(genre.genre_features(frame_rows(spark, sf)))


QUERIES = {
    "g1_g2_groove": groove,
    "g4_groove_unmasked": groove_unmasked,
    "g5_fingerprints": fingerprints,
    "g6_g7_key": key,
    "g8_levels": levels,
    "g9_vocal_class": vocals,
    "g10_danceability": dance,
    "g11_bar_length": bars,
    "g12_commensurate": commensurate,
    "g13_downbeat_vote": downbeat_votes,
    "g14_beat_fold": beat_fold,
    "g15_phrase_vote": phrase_votes,
    "g16_blended_novelty": novelty,
    "g17_bar_novelty": bar_curve,
    "g18_phrase_unit": phrase,
    "g19_boundaries": boundaries,
    "g19_first_eleven": first_boundaries,
    "g20_quantized_boundaries": snapped,
    "g21_section_stats": stats,
    "g22_section_labels": labels,
    "g23_rms_boundaries": rms_fallback,
    "g24_merged_windows": merged,
    "g25_assembled_sections": assembled,
    "g26_genre": classified,
    "g26_genre_features": genre_profile_features,
    "p12_fallback_sections": fallback_points,
}

# ------------------------------------------------------------------- SQL twins
C["frames"] = f"""
SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY t_sec, e) - 1 AS frame_idx, t_sec,
  {', '.join(f'{x} AS {n}' for n, x in FRAME_COLUMNS.items())},
  list_transform(CAST(embedding[1:12] AS DOUBLE[]), lambda x: abs(x)) AS chroma,
  list_transform(CAST(embedding[13:25] AS DOUBLE[]), lambda x: x * 100e0) AS mfcc
FROM (SELECT *, event_id AS e, date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 8640000000e0 AS t_sec FROM events)
JOIN embeddings ON vec_id = e % {rel.VECTORS}"""
C["frame_tracks"] = (f"SELECT track_id, {', '.join(f'{x} AS {n}' for n, x in TRACK_COLUMNS.items())} "
                     "FROM (SELECT DISTINCT user_id AS track_id FROM events)")
C["frame_sections"] = """SELECT track_id, section_idx, label, start_time / duration * 300e0 AS start_time,
  end_time / duration * 300e0 AS end_time, avg_energy FROM sections WHERE track_id IN (SELECT user_id FROM events)"""

_BAR = "(60e0 / bpm * 4e0)"
_MOD = "(x - floor(x / w) * w)"


def mod(x: str, w: str) -> str:
    return f"(({x}) - floor(({x}) / ({w})) * ({w}))"


C["fold"] = f"""
SELECT track_id, slot, sum(onset) AS onset_all, sum(bass_env) AS bass_all, sum(CASE WHEN inside THEN onset ELSE 0e0 END) AS onset_in,
  sum(CASE WHEN inside THEN bass_env ELSE 0e0 END) AS bass_in, sum(CASE WHEN inside THEN 1 ELSE 0 END) AS n_in
FROM (SELECT f.*, CAST(floor({mod('t_sec - first_downbeat', _BAR)} / ({_BAR} / 16) + 0.5e0) AS BIGINT) % 16 AS slot,
   EXISTS (SELECT 1 FROM frame_sections s WHERE s.track_id = f.track_id AND s.label IN ('main', 'drop') AND s.start_time <= f.t_sec
           AND f.t_sec < s.end_time) AS inside
  FROM frames f JOIN frame_tracks USING (track_id)) GROUP BY 1, 2"""


def _fold(masked: bool, need: str) -> str:
    pick = (f"CASE WHEN sum(n_in) OVER w >= floor({need}) AND sum(n_in) OVER w > 0 THEN {{v}}_in ELSE {{v}}_all END"
            if masked else "{v}_all")
    return f"""
SELECT track_id, bpm, downbeat_confidence >= 0.3e0 AS ok, {', '.join(
        f"CASE WHEN sum({v}) > 0 AND max({v}) / sum({v}) >= 1.1e0 / 16 THEN coalesce(max(CASE WHEN slot = {k} THEN {v} END), 0e0) / sum({v}) END AS {v}_{k}"
        for v in ('onset', 'bass') for k in range(16))}
FROM (SELECT f.track_id, slot, bpm, downbeat_confidence, {pick.format(v='onset')} AS onset, {pick.format(v='bass')} AS bass
      FROM fold f JOIN frame_tracks USING (track_id) WINDOW w AS (PARTITION BY f.track_id)) GROUP BY 1, 2, 3"""


def _sync(v: str) -> str:
    on = " + ".join(f"{v}_{k}" for k in (0, 4, 8, 12))
    off = " + ".join(f"{v}_{k}" for k in (2, 6, 10, 14))
    return f"({off}) / nullif({on} + {off}, 0e0)"


_MAJ = "[" + ", ".join(f"{v}e0" for v in frames.MAJOR_PROFILE) + "]"
_MIN = "[" + ", ".join(f"{v}e0" for v in frames.MINOR_PROFILE) + "]"
_NOTES = "[" + ", ".join(f"'{n}'" for n in R.NOTES) + "]"
C["mean_chroma"] = "SELECT track_id, list(m ORDER BY i) AS chroma FROM (SELECT track_id, i, avg(chroma[i]) AS m FROM frames, range(1, 13) r(i) GROUP BY 1, 2) GROUP BY 1"
C["key_fits"] = f"""
SELECT track_id, 2 * i + CASE WHEN mode = 'Minor' THEN 1 ELSE 0 END AS ord, {_NOTES}[i + 1] AS note, mode,
  list_inner_product(list_concat(chroma[i + 1:12], chroma[1:i]), prof) / (sqrt(list_inner_product(chroma, chroma)) * sqrt(list_inner_product(prof, prof))) AS fit
FROM mean_chroma, range(12) r(i), (VALUES ('Major', {_MAJ}), ('Minor', {_MIN})) p(mode, prof)"""
C["keys_found"] = """
SELECT track_id, arg_max(note, r) AS key_note, arg_max(mode, r) AS key_mode, max(CASE WHEN rk = 2 THEN note END) AS second_note,
  max(CASE WHEN rk = 2 THEN mode END) AS second_mode,
  round_even(greatest(0e0, (max(fit) - avg(fit)) / stddev_pop(fit)), 4) AS contrast,
  round_even(greatest(0e0, (max(fit) - max(CASE WHEN rk = 2 THEN fit END)) / abs(max(fit))), 4) AS margin
FROM (SELECT *, -rk AS r FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY fit DESC, ord) AS rk FROM key_fits)) GROUP BY 1"""


def _steps(x: str, y: str) -> str:
    nx, ny = f"CAST(regexp_extract({x}, '^[0-9]+') AS INT)", f"CAST(regexp_extract({y}, '^[0-9]+') AS INT)"
    return f"least(abs({nx} - {ny}), 12 - abs({nx} - {ny}))"


_KEY = f"""
SELECT *, CASE WHEN contrast <= 0.05e0 AND margin <= 0.0001e0 THEN 0e0 ELSE round_even(
   CASE WHEN contrast >= 2 AND margin >= 0.02e0 THEN greatest(0.8e0, lv)
   WHEN contrast >= 1 AND (({_steps('camelot', 'code2')} = 0 AND right(camelot, 1) <> right(code2, 1)) OR
        ({_steps('camelot', 'code2')} = 1 AND right(camelot, 1) = right(code2, 1))) THEN greatest(0.5e0, lv * 0.8e0)
   WHEN contrast >= 1 AND margin >= 0.01e0 THEN least(0.6e0, greatest(0.45e0, lv)) ELSE least(lv, 0.4e0) END, 3) END AS key_confidence
FROM (SELECT k.*, a.code AS camelot, b.code AS code2, least(1e0, greatest(0e0, contrast / 2.5e0)) AS lv FROM keys_found k
  JOIN wheel a ON a.note = key_note AND a.mode = key_mode JOIN wheel b ON b.note = second_note AND b.mode = second_mode)"""


def _cut(value: str, low: float, high: float) -> str:
    return f"trunc(greatest(0e0, least(100e0, ({value} - {low}e0) / {high - low}e0 * 100e0)))"


def _ac(value: str) -> str:
    return f"""SELECT track_id, coalesce(max(CASE WHEN lag >= 1 AND ac > prev AND ac > nxt THEN ac / ac0 END), 0e0) AS p FROM (
  SELECT *, lag(ac) OVER w AS prev, lead(ac) OVER w AS nxt, first(ac) OVER w AS ac0 FROM (
   SELECT a.track_id, l.lag, sum(a.{value} * b.{value}) AS ac FROM frames a
    JOIN (SELECT track_id, count(*) // 2 AS nl FROM frames GROUP BY 1) n ON n.track_id = a.track_id
    JOIN range(200) l(lag) ON l.lag < nl JOIN frames b ON b.track_id = a.track_id AND b.frame_idx = a.frame_idx + l.lag GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY track_id ORDER BY lag)) GROUP BY 1"""


C["gaps"] = "SELECT * FROM (SELECT track_id, frame_idx, lead(t_sec) OVER (PARTITION BY track_id ORDER BY frame_idx) - t_sec AS gap FROM frames) WHERE gap IS NOT NULL"
_DANCE = f"""
SELECT track_id, trunc(greatest(0e0, least(100e0, (beat_regularity * 0.4e0 + least(coalesce(o.p, 0e0), 1e0) * 0.3e0 + coalesce(b.p, 0e0) * 0.2e0
   + bonus * 0.1e0) * 100e0))) AS danceability, beat_regularity, least(o.p, 1e0) AS onset_period, b.p AS bass_period
FROM (SELECT track_id, CASE WHEN count(*) >= 2 AND avg(gap) > 0 THEN 1e0 - least(stddev_pop(gap) / avg(gap), 1e0) ELSE 0e0 END AS beat_regularity FROM gaps GROUP BY 1)
 JOIN (SELECT track_id, CASE WHEN bpm BETWEEN 118 AND 152 THEN 1e0 WHEN bpm BETWEEN 100 AND 170 THEN 0.08e0 / 0.15e0 ELSE 0e0 END AS bonus FROM frame_tracks) USING (track_id)
 LEFT JOIN ({_ac('onset')}) o USING (track_id) LEFT JOIN ({_ac('bass_env')}) b USING (track_id)"""


def _norm(rel_name: str, value: str, extra: str = "") -> str:
    return f"""SELECT track_id, {extra} CASE WHEN p95 > 2.3e-16 THEN least(1e0, s / p95) WHEN top > 2.3e-16 THEN least(1e0, s / top) ELSE 0e0 END AS {value}
 FROM (SELECT *, quantile_cont(s, 0.95) OVER w AS p95, max(s) OVER w AS top FROM (
   SELECT *, greatest({value} - quantile_cont({value}, 0.1) OVER w, 0e0) AS s FROM {rel_name} WINDOW w AS (PARTITION BY track_id)) WINDOW w AS (PARTITION BY track_id))"""


C["bar_means"] = f"""SELECT track_id, bar, avg(novelty) AS novelty FROM (
  SELECT f.track_id, novelty, CAST(floor((t_sec - anchor) / {_BAR}) AS BIGINT) AS bar FROM frames f JOIN frame_tracks USING (track_id)) WHERE bar >= 0 GROUP BY 1, 2"""
C["bars"] = """SELECT track_id, bar, coalesce(novelty, 0e0) AS novelty FROM (
  SELECT track_id, unnest(range(0, max(bar) + 1)) AS bar FROM bar_means GROUP BY 1) LEFT JOIN bar_means USING (track_id, bar)"""
C["centred"] = f"""SELECT track_id, bar, n_bars, novelty - avg(novelty) OVER w AS x FROM (
  SELECT *, count(*) OVER (PARTITION BY track_id) AS n_bars FROM ({_norm('bars', 'novelty', 'bar,')})) WINDOW w AS (PARTITION BY track_id)"""
C["lagged"] = """SELECT a.track_id, a.n_bars, sum(a.x * a.x) AS variance, coalesce(sum(a.x * b8.x), 0e0) AS d8, coalesce(sum(a.x * b16.x), 0e0) AS d16,
   coalesce(sum(a.x * b32.x), 0e0) AS d32 FROM centred a
  LEFT JOIN centred b8 ON b8.track_id = a.track_id AND b8.bar = a.bar + 8 LEFT JOIN centred b16 ON b16.track_id = a.track_id AND b16.bar = a.bar + 16
  LEFT JOIN centred b32 ON b32.track_id = a.track_id AND b32.bar = a.bar + 32 GROUP BY 1, 2"""
_PHRASE = """
SELECT track_id, n_bars, s8, s16, s32, CASE WHEN n >= 2 AND sc >= 0.18e0 AND p1 - p2 >= 0.08e0 THEN u END AS phrase_unit FROM (
 SELECT track_id, n_bars, s8, s16, s32, count(post) AS n, max(CASE WHEN rk = 1 THEN u END) AS u, max(CASE WHEN rk = 1 THEN score END) AS sc,
   max(CASE WHEN rk = 1 THEN post END) AS p1, max(CASE WHEN rk = 2 THEN post END) AS p2 FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY post DESC NULLS LAST, u) AS rk FROM (
   SELECT *, score + CASE WHEN u = prior THEN 0.03e0 ELSE 0e0 END AS post FROM (
    SELECT *, unnest([8, 16, 32]) AS u, unnest([s8, s16, s32]) AS score FROM (
     SELECT *, CASE WHEN n_bars >= 72 THEN d32 / variance - 0.5e0 * greatest(0e0, s16) END AS s32 FROM (
      SELECT *, CASE WHEN n_bars >= 40 THEN d16 / variance - 0.5e0 * greatest(0e0, s8) END AS s16 FROM (
       SELECT l.*, coalesce(phrase_bars, 8e0) AS prior, CASE WHEN n_bars >= 24 THEN d8 / variance END AS s8 FROM lagged l
         JOIN frame_tracks USING (track_id) LEFT JOIN mix_profiles ON genre_key = lower(genre)
       WHERE n_bars >= 16 AND variance > 2.3e-16))))))
 GROUP BY 1, 2, 3, 4, 5)"""

C["peaks"] = """SELECT track_id, frame_idx, t_sec, novelty / top AS h FROM (
  SELECT *, lag(novelty) OVER w AS prev, lead(novelty) OVER w AS nxt, max(novelty) OVER (PARTITION BY track_id) AS top
  FROM frames WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) WHERE novelty > prev AND novelty > nxt AND novelty / top >= 0.1e0"""
C["apart"] = f"""SELECT track_id, greatest(1, floor(greatest(8e0, {_BAR} * phrase_unit) / dt)) AS apart FROM frame_tracks JOIN (
  SELECT track_id, max(t_sec) - min(t_sec) AS dt FROM frames WHERE frame_idx <= 1 GROUP BY 1) USING (track_id)"""
# strongest peak first, one per step
C["greedy"] = """
  SELECT track_id, 0 AS step, CAST([] AS STRUCT(h DOUBLE, i BIGINT, t DOUBLE)[]) AS taken FROM apart
  UNION ALL
  SELECT g.track_id, step + 1, list_append(taken, best) FROM (
    SELECT g.track_id, g.step, g.taken, {'h': max({'h': p.h, 'b': -p.frame_idx, 't': p.t_sec}).h, 'i': -max({'h': p.h, 'b': -p.frame_idx, 't': p.t_sec}).b,
           't': max({'h': p.h, 'b': -p.frame_idx, 't': p.t_sec}).t} AS best
    FROM greedy g JOIN apart USING (track_id) JOIN peaks p ON p.track_id = g.track_id
    WHERE len(list_filter(g.taken, lambda q: abs(q.i - p.frame_idx) < apart)) = 0
    GROUP BY 1, 2, 3) g"""
C["picked"] = """
SELECT track_id, CASE WHEN len(ts) = 0 OR ts[1] > 1 THEN list_concat([0e0], ts) ELSE list_concat([0e0], ts[2:]) END AS boundaries FROM (
 SELECT track_id, list_sort(list_transform(list_filter(taken, lambda q: q.h >= thr), lambda q: q.t)) AS ts FROM (
  SELECT track_id, taken, CASE WHEN len(list_filter(taken, lambda q: q.h >= 0.3e0)) >= 2 THEN 0.3e0 WHEN len(list_filter(taken, lambda q: q.h >= 0.25e0)) >= 2 THEN 0.25e0
    WHEN len(list_filter(taken, lambda q: q.h >= 0.2e0)) >= 2 THEN 0.2e0 WHEN len(list_filter(taken, lambda q: q.h >= 0.15e0)) >= 2 THEN 0.15e0 ELSE 0.1e0 END AS thr
  FROM greedy QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY step DESC) = 1))"""


C["greedy_eleven"] = C["greedy"].replace("FROM greedy g", "FROM greedy_eleven g").replace("WHERE len(", "WHERE g.step < 11 AND len(")
C["picked_eleven"] = C["picked"].replace("FROM greedy ", "FROM greedy_eleven ")


def _snapped(source: str) -> str:
    """Snap to the phrase grid, then keep points two bars apart (a reduce over the sorted list)."""
    return f"""
SELECT track_id, duration, list_reduce(list_transform(q, lambda v: [v]), lambda acc, v: CASE WHEN v[1] - acc[-1] >= 2e0 * bar THEN list_append(acc, v[1]) ELSE acc END) AS boundaries FROM (
 SELECT track_id, duration, bar, list_sort(list_distinct(list_transform(boundaries, lambda t: greatest(0e0, least(round_even((t - anchor) / (bar * phrase_unit), 0) * (bar * phrase_unit) + anchor, duration))))) AS q
 FROM (SELECT b.track_id, b.boundaries, f.*, {_BAR} AS bar FROM {source} b JOIN frame_tracks f USING (track_id)))"""


C["loud"] = f"""SELECT track_id, [0e0, CASE WHEN a <= duration * 0.35e0 THEN a ELSE {_BAR} * phrase_unit * 2e0 END,
   CASE WHEN z >= duration * 0.65e0 THEN z ELSE duration - {_BAR} * phrase_unit * 2e0 END] AS boundaries FROM frame_tracks JOIN (
  SELECT track_id, min(t_sec) AS a, max(t_sec) AS z FROM (SELECT *, avg(rms) OVER (PARTITION BY track_id) AS m FROM frames) WHERE rms > m * 0.4e0 GROUP BY 1) USING (track_id)"""
C["loud_snapped"] = _snapped("loud")
C["spans"] = """SELECT track_id, i AS section_idx, s AS start_time, lead(s, 1, duration) OVER (PARTITION BY track_id ORDER BY i) AS end_time FROM (
  SELECT track_id, duration, unnest(starts) AS s, generate_subscripts(starts, 1) - 1 AS i FROM (
   SELECT track_id, duration, list_concat([0e0], list_filter(boundaries, lambda b: b < duration - 0.001e0)[2:]) AS starts FROM loud_snapped))"""
_STATS = """
SELECT *, CASE WHEN end_time - start_time < 1 THEN 'stable' WHEN f = 0 THEN CASE WHEN g > 0 THEN 'rising' ELSE 'stable' END
   WHEN sqrt(g) / sqrt(f) > 1.3e0 THEN 'rising' WHEN sqrt(g) / sqrt(f) < 0.7e0 THEN 'falling' ELSE 'stable' END AS trend,
  coalesce(least(100e0, sqrt(p) / greatest(0.4e0, sqrt(track_p) * 1.6e0) * 100e0), 0e0) AS avg_energy
FROM (SELECT s.track_id, s.section_idx, s.start_time, s.end_time, avg(rms * rms) AS p, avg(CASE WHEN t_sec < (start_time + end_time) / 2 THEN rms * rms END) AS f,
    avg(CASE WHEN t_sec >= (start_time + end_time) / 2 THEN rms * rms END) AS g
  FROM spans s LEFT JOIN frames x ON x.track_id = s.track_id AND s.start_time <= x.t_sec AND (x.t_sec < s.end_time OR s.end_time >= 300) GROUP BY 1, 2, 3, 4)
 JOIN (SELECT track_id, avg(rms * rms) AS track_p FROM frames GROUP BY 1) USING (track_id)"""

C["trended"] = """SELECT *, CASE l_partkey % 3 WHEN 0 THEN 'rising' WHEN 1 THEN 'falling' ELSE 'stable' END AS trend,
   avg(avg_energy) OVER w AS mean, max(avg_energy) OVER w * 0.85e0 AS soft FROM sections WINDOW w AS (PARTITION BY track_id)"""
C["labelled"] = """
SELECT *, CASE WHEN base = 'main' AND lead(base) OVER w = 'drop' AND trend = 'rising' THEN 'build'
   WHEN base = 'main' AND lag(base) OVER w = 'drop' AND avg_energy < mean * 0.8e0 THEN 'breakdown' ELSE base END AS new_label FROM (
 SELECT *, CASE WHEN has_outro AND (section_idx = n_sections - 1 OR (section_idx = n_sections - 2 AND n_sections > 2 AND start_time > duration * 0.75e0
      AND (avg_energy < mean OR trend = 'falling' OR avg_energy < soft))) THEN 'outro'
   WHEN has_intro AND (section_idx = 0 OR (section_idx = 1 AND n_sections > 2 AND start_time < duration * 0.25e0
      AND (avg_energy < mean OR trend = 'rising' OR avg_energy < soft))) THEN 'intro'
   WHEN avg_energy >= mean * 1.2e0 AND avg_energy > 0 THEN 'drop' ELSE 'main' END AS base FROM (
  SELECT *, bool_or(section_idx = 0 AND (avg_energy < mean * 0.6e0 OR (trend = 'rising' AND avg_energy < soft)
       OR (n_sections >= 3 AND avg_energy < soft AND start_time < duration * 0.15e0))) OVER (PARTITION BY track_id) AS has_intro,
    bool_or(section_idx = n_sections - 1 AND n_sections > 1 AND (avg_energy < mean * 0.6e0 OR trend = 'falling'
       OR (avg_energy < soft AND start_time > duration * 0.8e0))) OVER (PARTITION BY track_id) AS has_outro FROM trended))
WINDOW w AS (PARTITION BY track_id ORDER BY section_idx)"""

_MERGED = """
WITH info AS (SELECT *, duration <= head_end + 1 AS short, greatest(head_end, duration - 180e0) AS tail_start FROM (
   SELECT track_id, max(duration) AS head_end, max(duration) + track_id % 4 * 150e0 AS duration, CASE WHEN track_id % 7 <> 0 THEN 180e0 ELSE 0e0 END AS tail_s
   FROM sections GROUP BY 1)),
 parts AS (
  SELECT s.track_id, 0 AS part, section_idx, CASE WHEN NOT short AND label = 'outro' THEN 'main' ELSE label END AS label, start_time, least(end_time, head_end) AS end_time
   FROM sections s JOIN info USING (track_id) WHERE short OR tail_s <= 0 OR start_time < tail_start
  UNION ALL SELECT track_id, 1, 0, 'unanalysed', round_even(head_end, 2), round_even(CASE WHEN tail_s > 0 THEN tail_start ELSE duration END, 2) FROM info
   WHERE NOT short AND (tail_s <= 0 OR tail_start > head_end + 1)
  UNION ALL SELECT s.track_id, 2, section_idx, CASE WHEN label = 'intro' THEN 'main' ELSE label END, round_even(start_time + tail_start, 2), round_even(end_time + tail_start, 2)
   FROM sections s JOIN info USING (track_id) WHERE NOT short AND tail_s > 0 AND section_idx < 2)
SELECT p.track_id, row_number() OVER (PARTITION BY p.track_id ORDER BY part, section_idx) - 1 AS section_idx, label, start_time, end_time,
  short OR (tail_s > 0 AND least(duration, tail_start + tail_s) >= duration - 1) AS outro_covered FROM parts p JOIN info USING (track_id)"""


def _range(value: str, low: float, high: float, centre: float | None = None) -> str:
    mid = (low + high) / 2 if centre is None else centre
    d = f"(abs({value} - {mid}e0) / {float(high - low)}e0)"
    return (f"(CASE WHEN {d} <= 0.5e0 THEN 1e0 - {d} * 0.4e0 WHEN {d} <= 1 THEN 0.8e0 - ({d} - 0.5e0) * 1.2e0 "
            f"WHEN {d} <= 2 THEN 0.2e0 * exp(-({d} - 1e0)) ELSE 0e0 END)")


def _score(name: str) -> str:
    bpm, centre, cent, onset, flat, var, bass = R.GENRE_PROFILES[name]
    total = (f"0.35e0 * {_range('bpm', *bpm, centre)} + 0.2e0 * {_range('centroid', *cent)} + 0.2e0 * ({_range('onset_rate', *onset)} + "
             f"{_range('flatness', *flat)}) / 2e0 + 0.15e0 * {_range('rms_variance', *var)} + 0.1e0 * {_range('bass', *bass)}")
    damp = "* CASE WHEN bpm < 160 THEN 0.5e0 ELSE 1e0 END" if name == "Drum & Bass" else ""
    return f"greatest(0e0, least(1e0, {total})) {damp}"


_GENRE = f"""
SELECT track_id, CASE WHEN tag IS NOT NULL THEN tag WHEN sure < 0.4e0 THEN 'Unknown' ELSE best END AS detected_genre,
  CASE WHEN tag IS NOT NULL THEN 1e0 WHEN sure < 0.4e0 THEN sure ELSE round_even(sure, 3) END AS genre_confidence,
  CASE WHEN tag IS NOT NULL THEN 'id3_tag' ELSE 'audio_analysis' END AS genre_source FROM (
 SELECT track_id, tag, max(CASE WHEN rk = 1 THEN g END) AS best,
   greatest(0e0, least(1e0, max(CASE WHEN rk = 1 THEN s END) * 0.6e0 + (max(CASE WHEN rk = 1 THEN s END) - max(CASE WHEN rk = 2 THEN s END)) * 2e0 * 0.4e0)) AS sure FROM (
  SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s DESC, i) AS rk FROM (
   SELECT track_id, tag, unnest(range(9)) AS i, unnest([{', '.join(f"'{n}'" for n in R.CANONICAL_GENRES)}]) AS g,
     unnest([{', '.join(_score(n) for n in R.CANONICAL_GENRES)}]) AS s FROM (
    SELECT track_id, 118e0 + track_id * 7 % 64 AS bpm, (track_id % 90) / 10e0 AS onset_rate, track_id * 7 % 101 AS bass,
      800e0 + track_id * 31 % 3800 AS centroid, (track_id % 18) / 100e0 AS flatness, (track_id % 60) / 100e0 AS rms_variance,
      coalesce(g.canonical,
        (SELECT first(canonical ORDER BY length(g2.tag) DESC) FROM genre_tags g2 WHERE contains(lower(genre), g2.tag))) AS tag
    FROM frame_tracks LEFT JOIN genre_tags g ON g.tag = lower(genre)))) GROUP BY 1, 2)"""

C["change"] = """SELECT f.*, coalesce(1e0 - list_inner_product(chroma, pc) / (sqrt(list_inner_product(chroma, chroma)) * sqrt(list_inner_product(pc, pc))), 0e0) AS nov,
   rms - avg(rms) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS accent
 FROM (SELECT *, lag(chroma) OVER (PARTITION BY track_id ORDER BY frame_idx) AS pc FROM frames) f"""
C["voters"] = """SELECT *, (bass_env - avg(bass_env) OVER w) / stddev_pop(bass_env) OVER w + (nov - avg(nov) OVER w) / stddev_pop(nov) OVER w
    + 0.5e0 * (accent - avg(accent) OVER w) / stddev_pop(accent) OVER w AS vote, count(*) OVER w AS n_valid FROM (
  SELECT *, max(rms) OVER (PARTITION BY track_id) AS loudest, 4e0 * (max(t_sec) OVER (PARTITION BY track_id) - min(t_sec) OVER (PARTITION BY track_id))
     / (count(*) OVER (PARTITION BY track_id) - 1) AS bar FROM change) WHERE rms >= loudest * 0.3e0 WINDOW w AS (PARTITION BY track_id)"""
_VOTE = f"""
SELECT track_id, p AS phase, CASE WHEN n >= 2 THEN {mod('atan2(s, k)', '2e0 * pi()')} * bar / (2e0 * pi()) ELSE {mod('seed', 'bar')} END AS bar_start,
  least(1e0, greatest(0e0, (v - CASE WHEN nb < 4 THEN greatest(coalesce(v2, 0e0), 0e0) ELSE v2 END) / spread / (2e0 / 3e0))) AS bar_confidence FROM (
 SELECT *, lead(v) OVER w AS v2, count(*) OVER (PARTITION BY track_id) AS nb, sum(abs(v)) OVER (PARTITION BY track_id) AS spread, row_number() OVER w AS rk FROM (
  SELECT track_id, frame_idx % 4 AS p, sum(vote) AS v, count(*) AS n, any_value(bar) AS bar,
    avg(sin({mod('t_sec', 'bar')} / bar * 2e0 * pi())) AS s, avg(cos({mod('t_sec', 'bar')} / bar * 2e0 * pi())) AS k
  FROM voters WHERE n_valid >= 16 GROUP BY 1, 2) JOIN (SELECT track_id, frame_idx AS p, t_sec AS seed FROM frames WHERE frame_idx < 4) USING (track_id, p)
 WINDOW w AS (PARTITION BY track_id ORDER BY v DESC, p)) WHERE rk = 1"""
_FOLD = f"""
SELECT track_id, ((pk - coalesce(b, 0) + {BINS}) % {BINS}) / {BINS}e0 * 60e0 / bpm AS beat_phase, (top - flo) / top AS lock FROM (
 SELECT track_id, bpm, top, flo, pk, min(CASE WHEN lv <= flo + 0.15e0 * (top - flo) THEN (pk - slot + {BINS}) % {BINS} END) AS b FROM (
  SELECT *, max(lv) OVER w AS top, min(lv) OVER w AS flo, first(slot) OVER (PARTITION BY track_id ORDER BY lv DESC, slot) AS pk FROM (
   SELECT t.track_id, t.bpm, r.slot, coalesce(x.lv, 0e0) AS lv FROM frame_tracks t CROSS JOIN range({BINS}) r(slot) LEFT JOIN (
    SELECT track_id, least({BINS} - 1, CAST(floor({mod('t_sec', '60e0 / bpm')} / (60e0 / bpm) * {BINS}) AS BIGINT)) AS slot, avg(bass_env) AS lv
    FROM frames JOIN frame_tracks USING (track_id) GROUP BY 1, 2) x ON x.track_id = t.track_id AND x.slot = r.slot) WINDOW w AS (PARTITION BY track_id))
 GROUP BY 1, 2, 3, 4, 5)"""
_PVOTE = f"""
WITH v AS (SELECT track_id, bpm, anchor, phrase_unit AS pu, frame_idx % phrase_unit AS bin, sum(vote) AS v FROM (
   SELECT f.track_id, frame_idx, bpm, anchor, phrase_unit, count(*) OVER w AS n, (bass_env - avg(bass_env) OVER w) / stddev_pop(bass_env) OVER w
     + (novelty - avg(novelty) OVER w) / stddev_pop(novelty) OVER w
     + 0.75e0 * (greatest(0e0, rms - 0.1e0) - avg(greatest(0e0, rms - 0.1e0)) OVER w) / stddev_pop(greatest(0e0, rms - 0.1e0)) OVER w AS vote
   FROM frames f JOIN frame_tracks USING (track_id) WINDOW w AS (PARTITION BY f.track_id)) WHERE n >= phrase_unit * 2 GROUP BY 1, 2, 3, 4, 5),
 h AS (SELECT a.track_id, a.bpm, a.anchor, a.pu, a.bin, a.v, a.pu = 16 AND sum(a.v * b.v) OVER w / sum(a.v * a.v) OVER w >= 0.7e0 AS folds, b.v AS other
   FROM v a JOIN v b ON b.track_id = a.track_id AND b.bin = (a.bin + a.pu // 2) % a.pu WINDOW w AS (PARTITION BY a.track_id)),
 u AS (SELECT track_id, bpm, anchor, CASE WHEN folds THEN pu // 2 ELSE pu END AS nb, bin, CASE WHEN folds THEN v + other ELSE v END AS v FROM h WHERE NOT folds OR bin < pu // 2)
SELECT track_id, nb AS n_bins, round_even({mod('anchor', _BAR)} + bin * {_BAR}, 4) AS first_phrase,
  round_even(greatest(0e0, least(1e0, (v - v2) / spread * nb / 8e0)), 3) AS phrase_confidence FROM (
 SELECT *, lead(v) OVER w AS v2, sum(abs(v)) OVER (PARTITION BY track_id) AS spread, row_number() OVER w AS rk FROM u WINDOW w AS (PARTITION BY track_id ORDER BY v DESC, bin)) WHERE rk = 1"""

_SMOOTH = f"""
WITH s AS (SELECT *, greatest(1, least(CAST(floor({_BAR} * 4e0 / 4.5e0) AS BIGINT), n)) AS span FROM (
   SELECT f.track_id, frame_idx, t_sec, rms, bpm, duration, count(*) OVER (PARTITION BY f.track_id) AS n FROM frames f JOIN frame_tracks USING (track_id))),
 curve AS (SELECT a.track_id, a.t_sec, a.bpm, a.duration, sum(b.rms) / a.span AS lv FROM s a JOIN s b ON b.track_id = a.track_id
    AND b.frame_idx BETWEEN a.frame_idx - a.span // 2 AND a.frame_idx + (a.span - 1) // 2 GROUP BY a.track_id, a.t_sec, a.bpm, a.duration, a.span, a.frame_idx),
 top AS (SELECT *, max(lv) OVER (PARTITION BY track_id) AS peak FROM curve),
 e AS (SELECT track_id, bpm, duration, peak, min(CASE WHEN lv >= peak * 0.4e0 THEN t_sec END) AS fa, max(CASE WHEN lv >= peak * 0.4e0 THEN t_sec END) AS la FROM top GROUP BY 1, 2, 3, 4),
 o AS (SELECT *, CASE WHEN fa <= duration * 0.2e0 THEN fa ELSE least({_BAR} * 16e0, duration * 0.2e0) END AS i0,
    CASE WHEN la >= duration * 0.75e0 THEN la ELSE greatest(duration - {_BAR} * 16e0, duration * 0.75e0) END AS o0 FROM e),
 z AS (SELECT *, CASE WHEN i0 >= o0 THEN least({_BAR} * 16e0, duration * 0.2e0) ELSE i0 END AS intro_t,
    CASE WHEN i0 >= o0 THEN greatest(duration - {_BAR} * 16e0, duration * 0.75e0) ELSE o0 END AS outro_t FROM o)
SELECT z.track_id, intro_t, outro_t, coalesce(avg(CASE WHEN c.t_sec >= intro_t AND c.t_sec < outro_t THEN c.lv END) / any_value(peak) * 100e0, 0e0) AS main_energy
FROM z JOIN curve c ON c.track_id = z.track_id AND c.t_sec < z.duration GROUP BY 1, 2, 3"""

_F = ["frames", "frame_tracks"]
_EXPLODED = "SELECT track_id, unnest(boundaries) AS t, generate_subscripts(boundaries, 1) - 1 AS idx FROM "
SQL = {
    "g1_g2_groove": sql(with_ctes(C, ["fold", "frames"], f"""
        SELECT p.track_id, CASE WHEN ok THEN onset_0 END AS groove_0, CASE WHEN ok THEN onset_7 END AS groove_7, CASE WHEN ok THEN bass_3 END AS bass_3,
          CASE WHEN ok AND onset_0 IS NOT NULL THEN 16 ELSE 0 END AS n_groove, CASE WHEN ok AND bass_0 IS NOT NULL THEN 16 ELSE 0 END AS n_bass,
          CASE WHEN ok THEN sub ELSE 0e0 END AS sub_energy, CASE WHEN ok THEN punch ELSE 0e0 END AS bass_punch,
          CASE WHEN ok THEN coalesce({_sync('bass')}, {_sync('onset')}, 0e0) ELSE 0e0 END AS syncopation
        FROM ({_fold(True, _BAR + ' * 8e0 / 4e0')}) p JOIN (SELECT track_id, sum(sub_power) / sum(total_power) AS sub,
          quantile_cont(abs(bass_env), 0.95) / avg(abs(bass_env)) AS punch FROM frames GROUP BY 1) USING (track_id)"""),
        "track_id n_groove n_bass", "groove_0 groove_7 bass_3 sub_energy bass_punch syncopation"),
    "g4_groove_unmasked": sql(with_ctes(C, ["fold"], f"""
        SELECT track_id, CASE WHEN ok THEN onset_0 END AS groove_0, CASE WHEN ok THEN bass_15 END AS bass_15,
          CASE WHEN ok THEN coalesce({_sync('bass')}, {_sync('onset')}, 0e0) ELSE 0e0 END AS syncopation FROM ({_fold(False, '')})"""),
        "track_id", "groove_0 bass_15 syncopation"),
    "g5_fingerprints": sql(with_ctes(C, ["frames"], """SELECT track_id, round_even(avg(mfcc[1]), 4) AS mfcc_0, round_even(avg(mfcc[13]), 4) AS mfcc_12,
        avg(chroma[6]) AS chroma_5 FROM frames GROUP BY 1"""), "track_id", "mfcc_0 mfcc_12 chroma_5"),
    "g6_g7_key": sql(with_ctes(C, ["keys_found", "wheel"], _KEY), "track_id", "contrast margin key_confidence",
                     "key_note key_mode second_note second_mode camelot"),
    "g8_levels": sql(with_ctes(C, ["frames"], f"""
        SELECT track_id, {_cut('sqrt(r)', 0, 0.4)} AS energy, {_cut('share', 0, 1)} AS bass_intensity, {_cut('cent', 500, 8000)} AS brightness,
          {', '.join(f'round_even({b} / (b + m + h + 0.000001e0) * 100e0, 1) AS avg_{n}' for b, n in (('b', 'bass'), ('m', 'mids'), ('h', 'highs')))}
        FROM (SELECT track_id, avg(rms * rms) AS r, avg(centroid) AS cent, sum(sub_power) / sum(total_power) AS share, sqrt(avg(bass_ms)) AS b,
          sqrt(avg(mids_ms)) AS m, sqrt(avg(highs_ms)) AS h FROM frames GROUP BY 1)"""),
        "track_id energy bass_intensity brightness", "avg_bass avg_mids avg_highs"),
    "g9_vocal_class": sql(with_ctes(C, ["frames"], f"""
        SELECT *, CASE WHEN points >= 5 THEN 'vocal' WHEN points <= 2 THEN 'instrumental' ELSE 'unknown' END AS vocal FROM (
          SELECT track_id, CASE WHEN fl < 0.03e0 THEN 2 WHEN fl < 0.08e0 THEN 1 ELSE 0 END + CASE WHEN va > 80 THEN 2 WHEN va > 40 THEN 1 ELSE 0 END
            + CASE WHEN co > 30 THEN 2 WHEN co > 20 THEN 1 ELSE 0 END AS points FROM (
            SELECT track_id, avg(flatness) AS fl, avg(contrast) AS co, ({' + '.join(f'var_pop(mfcc[{i}])' for i in range(2, 14))}) / 12e0 AS va FROM frames GROUP BY 1))"""),
        "track_id points", texts="vocal"),
    "g10_danceability": sql(with_ctes(C, [*_F, "gaps"], _DANCE), "track_id danceability", "beat_regularity onset_period bass_period"),
    "g11_bar_length": sql(with_ctes(C, [*_F, "gaps"], """
        SELECT track_id, CASE WHEN n >= 8 THEN 4e0 * CASE WHEN ibi > 90e0 / bpm THEN ibi / 2 WHEN ibi < 45e0 / bpm THEN ibi * 2 ELSE ibi END END AS seconds_per_bar
        FROM frame_tracks JOIN (SELECT track_id, count(*) AS n FROM frames GROUP BY 1) USING (track_id)
          LEFT JOIN (SELECT track_id, median(gap) AS ibi FROM gaps WHERE gap > 0 GROUP BY 1) USING (track_id)"""), "track_id", "seconds_per_bar"),
    "g12_commensurate": sql(with_ctes(C, ["frame_tracks"], """
        SELECT track_id, abs(CASE WHEN r >= 1 THEN r / round_even(r, 0) ELSE r * round_even(1e0 / r, 0) END - 1e0) <= 0.1e0 AS fits
        FROM (SELECT track_id, (60e0 / (track_id % 90 + 40e0)) / (60e0 / bpm) AS r FROM frame_tracks)"""), "track_id", bools="fits"),
    "g13_downbeat_vote": sql(with_ctes(C, ["voters", "frames"], _VOTE), "track_id phase", "bar_start bar_confidence"),
    "g14_beat_fold": sql(with_ctes(C, _F, _FOLD), "track_id", "beat_phase lock"),
    "g15_phrase_vote": sql(with_ctes(C, _F, f"SELECT * FROM ({_PVOTE})"), "track_id n_bins", "first_phrase phrase_confidence"),
    "g16_blended_novelty": sql(with_ctes(C, ["frames"], f"""
        SELECT a.track_id, a.frame_idx, 0.65e0 * a.novelty + 0.2e0 * b.bass_novelty + 0.15e0 * c.percussion_novelty AS novelty
        FROM ({_norm('frames', 'novelty', 'frame_idx,')}) a JOIN ({_norm('frames', 'bass_novelty', 'frame_idx,')}) b USING (track_id, frame_idx)
          JOIN ({_norm('frames', 'percussion_novelty', 'frame_idx,')}) c USING (track_id, frame_idx)"""), "track_id frame_idx", "novelty"),
    "g17_bar_novelty": sql(with_ctes(C, ["bars"], "SELECT * FROM bars"), "track_id bar", "novelty"),
    "g18_phrase_unit": sql(with_ctes(C, ["lagged", "frame_tracks", "mix_profiles"], _PHRASE), "track_id n_bars phrase_unit", "s8 s16 s32"),
    "g19_boundaries": sql(with_ctes(C, ["picked"], _EXPLODED + "picked").replace("WITH ", "WITH RECURSIVE ", 1), "track_id idx", "t"),
    "g19_first_eleven": sql(with_ctes(C, ["picked_eleven"], _EXPLODED + "picked_eleven").replace("WITH ", "WITH RECURSIVE ", 1), "track_id idx", "t"),
    "g20_quantized_boundaries": sql(with_ctes(C, ["picked", "frame_tracks"], f"{_EXPLODED} ({_snapped('picked')})").replace(
        "WITH ", "WITH RECURSIVE ", 1), "track_id idx", "t"),
    "g21_section_stats": sql(with_ctes(C, ["spans", "frames"], _STATS), "track_id section_idx", "start_time end_time avg_energy", "trend"),
    "g22_section_labels": sql(with_ctes(C, ["labelled"], "SELECT track_id, section_idx, new_label AS label FROM labelled"),
                              "track_id section_idx", texts="label"),
    "g23_rms_boundaries": sql(with_ctes(C, ["loud_snapped"], _EXPLODED + "loud_snapped"), "track_id idx", "t"),
    "g24_merged_windows": sql(with_ctes(C, ["sections"], f"SELECT * FROM ({_MERGED})"), "track_id section_idx", "start_time end_time", "label", "outro_covered"),
    "g25_assembled_sections": sql(with_ctes(C, ["labelled"], """
        SELECT track_id, n_sections AS n, floor(duration / (240e0 / section_bpm)) AS total_bars, new_label AS last_label,
          round_even(start_time / (240e0 / section_bpm), 0) AS start_bar, round_even(end_time / (240e0 / section_bpm), 0) AS end_bar,
          round_even(avg_energy, 1) AS avg_energy FROM labelled WHERE section_idx = n_sections - 1"""),
        "track_id n total_bars start_bar end_bar", "avg_energy", "last_label"),
    "g26_genre": sql(with_ctes(C, ["frame_tracks", "genre_tags"], _GENRE), "track_id", "genre_confidence", "detected_genre genre_source"),
    "g26_genre_features": sql(with_ctes(C, ["frames"], """SELECT track_id, avg(centroid) AS centroid, avg(flatness) AS flatness,
        var_pop(rms) / (avg(rms) * avg(rms)) AS rms_variance FROM frames GROUP BY 1"""), "track_id", "centroid flatness rms_variance"),
    "p12_fallback_sections": sql(with_ctes(C, _F, f"SELECT * FROM ({_SMOOTH})"), "track_id", "intro_t outro_t main_energy"),
}
