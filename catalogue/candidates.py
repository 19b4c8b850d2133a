"""Queries on cues, phrases and mix-point candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import frames as fr
from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from catalogue.plans import q
from segue import refdata as R
from segue.operators import candidates as cand

C = rel.CTES
NAMES = rel.pick(["MIX IN", "OUTRO", "Drop 2", "CUE(Auto)", ""], "(e * 7) % 5")


def cue_rows(spark, sf):
    return rel.read(spark, sf, "events").withColumn("e", F.col("event_id")).select(
        F.col("user_id").alias("track_id"), F.col("e").alias("cue_no"), F.expr("(e * 13 % 3600) / 10e0 - 10e0").alias("position"),
        F.expr(NAMES).alias("name"), F.lit(0).alias("type"), F.expr("CAST(e % 4 AS INT)").alias("hot_cue"))


def info(spark, sf):
    t = fr.frame_tracks(spark, sf).withColumns({
        "outro_covered": F.expr("track_id % 6 <> 0"), "mix_in_point": F.expr("CASE WHEN track_id % 4 = 0 THEN -1e0 ELSE 30e0 + track_id % 50 END"),
        "mix_out_point": F.expr("220e0 + track_id % 60")})
    s = fr.frame_sections(spark, sf).groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct(
        "section_idx", "label", "start_time", "end_time", "avg_energy"))).alias("sections"))
    p = phrase_rows(spark, sf)
    arrays = p.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct("phrase_idx", "start_s", "end_s", "label"))).alias("phrases"))
    return t.join(s, "track_id").join(arrays, "track_id", "left").join(cand.phrase_grid(p), "track_id", "left")


def phrase_rows(spark, sf):
    b = fr.beat_rows(spark, sf).select("track_id", "beat_idx", "beat_time")
    entries = b.where("beat_idx % 8 = 0 AND track_id % 3 <> 0").select(
        "track_id", F.col("beat_idx").alias("entry_no"), (F.col("beat_idx") + 1).alias("beat"),
        F.expr("CAST(1 + beat_idx / 8 % 8 AS INT)").alias("kind"), F.lit(0).alias("fill"))
    headers = fr.frame_tracks(spark, sf).select("track_id", F.expr("CAST(1 + track_id % 3 AS INT)").alias("mood"),
                                                F.expr("60 + track_id % 30").alias("end_beat"), "duration")
    return cand.phrases(entries, headers, b)


def _collected(spark, sf, limit=None):
    i = info(spark, sf)
    cues = cand.normalize_cues(cue_rows(spark, sf)).select("track_id", F.explode("cues").alias("q")).select("track_id", "q.*")
    raw = cand.raw_candidates(i, cues, phrase_rows(spark, sf), fr.frame_sections(spark, sf))
    return cand.collect_candidates(raw, i, limit), i


def cues(spark, sf):
    out = cand.normalize_cues(cue_rows(spark, sf)).select("track_id", F.posexplode("cues").alias("idx", "q"))
    return canon(out.select("track_id", "idx", "q.t", "q.name", "q.provenance"))


def phrases(spark, sf):
    return canon(phrase_rows(spark, sf).select("track_id", "phrase_idx", "start_s", "end_s", "label"))


def grid_points(spark, sf):
    return canon(cand.phrase_grid(phrase_rows(spark, sf)).select("track_id", F.posexplode("grid_points").alias("idx", "t")))


def downbeats(spark, sf):
    ticks = fr.beat_rows(spark, sf).select("track_id", F.expr("beat_idx % 4 + 1 - track_id % 3").alias("beat_number"),
                                           (F.col("beat_time") * 1000.0).alias("time_ms"))
    return canon(cand.first_downbeat(ticks))


def first_eight(spark, sf):
    return _shown(_collected(spark, sf, R.CANDIDATES_PER_SIDE)[0])


def collected(spark, sf):
    return _shown(_collected(spark, sf)[0])


def _shown(rows):
    return canon(rows.select("track_id", "side", "t", F.array_join("schemes", ",").alias("schemes"), "provenance", "section_label", "phrase_label"))


def summary(spark, sf):
    return canon(cand.candidate_summary(*_collected(spark, sf)))


def _spots(spark, sf):
    """Two fixed spots per track, for the measurement."""
    return fr.frame_tracks(spark, sf).select("track_id", F.explode(F.expr(
        "array(struct('in' AS side, 60e0 + track_id % 40 AS t), struct('out' AS side, 200e0 + track_id % 30 AS t))")).alias("s")).select("track_id", "s.*")


def measured(spark, sf):
    out = cand.measure_candidates(_spots(spark, sf), fr.frame_rows(spark, sf), fr.frame_tracks(spark, sf))
    return canon(out.drop("mfcc_local", "key_confidence_local", "camelot_local", "flatness_local"))


def confidence(spark, sf):
    t = fr.frame_tracks(spark, sf)
    return canon(t.select("track_id", cand.candidate_confidence(
        F.col("downbeat_confidence"), F.col("track_id") % 3 == 0, F.expr("(track_id % 7) / 7e0"),
        F.when(F.col("track_id") % 4 != 0, F.expr("(track_id % 11) / 10e0")), F.col("track_id") % 5 != 0).alias("confidence")))


QUERIES = {"c1_cues": cues, "c2_phrases": phrases, "c3_phrase_grid": grid_points, "c4_first_downbeat": downbeats,
           "c5_c6_c7_candidates": collected, "c7_first_eight": first_eight, "c8_measured": measured, "c9_confidence": confidence, "c10_summary": summary}

# ------------------------------------------------------------------- SQL twins
C["cue_rows"] = f"""SELECT user_id AS track_id, e AS cue_no, round_even((e * 13 % 3600) / 10e0 - 10e0, 3) AS t, name,
  CASE WHEN name = '' THEN 'leer' WHEN name = 'CUE(Auto)' THEN 'auto' ELSE 'manual' END AS provenance,
  row_number() OVER (PARTITION BY user_id ORDER BY (e * 13 % 3600), e) AS rn
 FROM (SELECT *, event_id AS e, {NAMES.replace('e * 7', 'event_id * 7')} AS name FROM events) WHERE (e * 13 % 3600) / 10e0 - 10e0 >= 0"""
C["cue_fold"] = """
  SELECT track_id, rn, 0 AS idx, t, name, provenance FROM cue_rows WHERE rn = 1
  UNION ALL
  SELECT r.track_id, r.rn, CASE WHEN r.t - f.t < 2 THEN f.idx ELSE f.idx + 1 END,
    CASE WHEN r.t - f.t >= 2 OR (f.provenance <> 'manual' AND r.provenance = 'manual') THEN r.t ELSE f.t END,
    CASE WHEN r.t - f.t >= 2 OR (f.provenance <> 'manual' AND r.provenance = 'manual') THEN r.name ELSE f.name END,
    CASE WHEN r.t - f.t >= 2 OR (f.provenance <> 'manual' AND r.provenance = 'manual') THEN r.provenance ELSE f.provenance END
  FROM cue_fold f JOIN cue_rows r ON r.track_id = f.track_id AND r.rn = f.rn + 1"""
C["clean_cues"] = "SELECT track_id, idx, arg_max(t, rn) AS t, arg_max(name, rn) AS name, arg_max(provenance, rn) AS provenance FROM cue_fold GROUP BY 1, 2"
_HIGH = " ".join(f"WHEN {k} THEN '{v}'" for k, v in cand.PHRASES_HIGH.items())
_LOW = " ".join(f"WHEN {k} THEN '{v}'" for k, v in cand.PHRASES_MID_LOW.items())
C["phrases"] = f"""SELECT track_id, phrase_idx, start_s, greatest(coalesce(nxt, least(CASE WHEN e > start_s THEN e ELSE 300e0 END, 300e0)), start_s) AS end_s,
   CASE WHEN track_id % 3 = 0 THEN CASE kind {_HIGH} ELSE 'Unbekannt(' || kind || ')' END ELSE CASE kind {_LOW} ELSE 'Unbekannt(' || kind || ')' END END AS label FROM (
  SELECT f.track_id, frame_idx, t_sec AS start_s, lead(t_sec) OVER w AS nxt, row_number() OVER w - 1 AS phrase_idx, CAST(1 + frame_idx // 8 % 8 AS INT) AS kind, e
  FROM frames f JOIN (SELECT track_id, t_sec AS e FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM frames) WHERE frame_idx = least(59 + track_id % 30, n - 1)) x ON x.track_id = f.track_id
  WHERE frame_idx % 8 = 0 AND f.track_id % 3 <> 0 WINDOW w AS (PARTITION BY f.track_id ORDER BY t_sec))"""
C["grid_points"] = """SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY t) - 1 AS idx, t FROM (
  SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t) AS p FROM (SELECT track_id, start_s AS t FROM phrases UNION ALL SELECT track_id, arg_max(end_s, phrase_idx) FROM phrases GROUP BY 1))
  WHERE p IS NULL OR t - p > 0.000001e0"""
C["cand_edges"] = """SELECT track_id, coalesce(max(CASE WHEN section_idx < fb THEN end_time END), 0e0) AS intro_end, coalesce(min(CASE WHEN section_idx > lb THEN start_time END), 300e0) AS outro_start, max(section_idx) AS last_idx FROM (
  SELECT *, coalesce(min(CASE WHEN label <> 'intro' THEN section_idx END) OVER (PARTITION BY track_id), 999) AS fb,
    coalesce(max(CASE WHEN label <> 'outro' THEN section_idx END) OVER (PARTITION BY track_id), -1) AS lb FROM frame_sections) GROUP BY 1"""
_INW, _OUTW = r"\b(MIX[- ]?IN|IN|START)\b", r"\b(MIX[- ]?OUT|OUT|OUTRO|END)\b"
C["cand_raw"] = f"""
 SELECT track_id, side, t AS t_raw, CASE WHEN provenance = 'manual' THEN 0 ELSE 2 END AS rk, role <> 'both' AS exempt FROM (
   SELECT *, CASE WHEN provenance = 'manual' AND regexp_matches(upper(name), '{_INW}') THEN 'in' WHEN provenance = 'manual' AND regexp_matches(upper(name), '{_OUTW}') THEN 'out' ELSE 'both' END AS role FROM clean_cues),
   (VALUES ('in'), ('out')) s(side) WHERE role = 'both' OR role = side
 UNION ALL SELECT track_id, side, start_s, 1, false FROM phrases, (VALUES ('in'), ('out')) s(side)
 UNION ALL SELECT track_id, side, start_time, 4, false FROM frame_sections, (VALUES ('in'), ('out')) s(side) WHERE label NOT IN ('intro', 'outro', 'unanalysed')
 UNION ALL SELECT track_id, side, start_time, 5, false FROM (SELECT *, lag(avg_energy) OVER (PARTITION BY track_id ORDER BY section_idx) AS b FROM frame_sections), (VALUES ('in'), ('out')) s(side)
   WHERE label NOT IN ('intro', 'outro', 'unanalysed') AND abs(avg_energy - b) >= 20
 UNION ALL SELECT track_id, 'in', 30e0 + track_id % 50, 3, false FROM frame_tracks WHERE track_id % 4 <> 0
 UNION ALL SELECT track_id, 'out', 220e0 + track_id % 60, 3, false FROM frame_tracks"""
C["cand_snapped"] = f"""SELECT r.*, grid_s, intro_end, outro_start, round_even(CASE WHEN track_id % 3 <> 0 THEN
     CASE WHEN side = 'in' THEN (SELECT min(g.t) FROM grid_points g WHERE g.track_id = r.track_id AND g.t >= r.t_raw - 0.05e0)
       ELSE (SELECT max(g.t) FROM grid_points g WHERE g.track_id = r.track_id AND g.t <= r.t_raw + 0.05e0) END
   WHEN side = 'in' THEN {q('t_raw', 'grid_s', 'anchor', 'ceil')} ELSE {q('t_raw', 'grid_s', 'anchor', 'floor')} END, 3) AS t
 FROM cand_raw r JOIN (SELECT *, 60e0 / bpm * 4e0 * phrase_unit AS grid_s FROM frame_tracks) USING (track_id) JOIN cand_edges USING (track_id) WHERE side = 'in' OR track_id % 6 <> 0"""
_AT = "coalesce((SELECT first(label ORDER BY section_idx) FROM frame_sections s WHERE s.track_id = m.track_id AND s.start_time <= m.t AND (m.t < s.end_time OR (s.section_idx = m.last_idx AND m.t = s.end_time))), '')"
C["cand_gated"] = f"""SELECT *, {_AT} AS section_label FROM (SELECT s.*, last_idx FROM cand_snapped s JOIN cand_edges USING (track_id) WHERE t BETWEEN 0 AND 300 AND (exempt OR
   CASE WHEN side = 'in' THEN t + 0.05e0 >= s.intro_end AND t <= 300 - 2 * grid_s + 0.05e0 ELSE t - 0.05e0 <= s.outro_start AND t >= 2 * grid_s - 0.05e0 END)) m"""
_NM = "[" + ", ".join(f"'{s}'" for s in cand.SCHEMES) + "]"
_PV = "[" + ", ".join(f"'{s}'" for s in cand.SCHEMES.values()) + "]"
C["candidates"] = f"""SELECT track_id, side, t, ranks, section_label, list_reduce(list_transform(ranks, lambda r: {_NM}[r + 1]), lambda x, y: x || ',' || y) AS schemes, {_PV}[ranks[1] + 1] AS provenance,
   coalesce((SELECT first(label ORDER BY phrase_idx) FROM phrases p WHERE p.track_id = m.track_id AND p.start_s <= m.t AND (m.t < p.end_s OR (m.t = p.end_s AND p.phrase_idx = (SELECT max(phrase_idx) FROM phrases z WHERE z.track_id = m.track_id)))), '') AS phrase_label
 FROM (SELECT track_id, side, t, list_sort(list(DISTINCT rk)) AS ranks, any_value(section_label) AS section_label FROM cand_gated WHERE section_label <> 'unanalysed' GROUP BY 1, 2, 3) m"""
C["first_candidates"] = """SELECT * FROM candidates
   QUALIFY row_number() OVER (PARTITION BY track_id, side ORDER BY ranks[1], -len(ranks), CASE WHEN side = 'in' THEN t ELSE -t END) <= 8"""

_E = "trunc(least(100e0, {} / 0.4e0 * 100e0))"


def _rms(cond: str = "true") -> str:
    return f"sqrt(avg(rms * rms) FILTER ({cond}))"


def _mean(v: str, n: int, cond: str, start: int = 1) -> str:
    return "[" + ", ".join(f"coalesce(avg({v}[{i}]) FILTER ({cond}), 0e0)" for i in range(start, n + 1)) + "]"


_MEASURED = f"""
SELECT track_id, side, t, n_frames, {_E.format('r')} AS energy_local,
  CASE WHEN ea - eb >= 10 THEN 'rising' WHEN ea - eb <= -10 THEN 'falling' ELSE 'stable' END AS energy_trend,
  round_even(m / (b + m + h + 0.000001e0) * 100e0, 1) AS mids_local, round_even(h / (b + m + h + 0.000001e0) * 100e0, 1) AS highs_local,
  trunc(greatest(0e0, least(100e0, (cent - 500e0) / 7500e0 * 100e0))) AS brightness_local, round_even(flat, 4) AS flatness_local,
  round_even(20e0 * log10(greatest(b, 1e-9)), 2) AS bass_db, CASE WHEN dc >= 0.3e0 AND tot > 0 THEN 20e0 * log10(greatest(b, 1e-9)) >= -35 AND onb / tot >= 0.4e0 END AS kick_active,
  CASE WHEN rb IS NOT NULL AND ra IS NOT NULL THEN round_even((abs(oa - ob) / greatest(oa, ob, 1e-9) + least(1e0, abs(20e0 * log10(greatest(ra, 1e-9)) - 20e0 * log10(greatest(rb, 1e-9))) / 20e0)
     + 1e0 - greatest(0e0, least(1e0, list_cosine_similarity(mb, ma))) + 1e0 - greatest(0e0, least(1e0, list_cosine_similarity(cb, ca)))) / 4e0, 3) END AS novelty_local
FROM (SELECT *, coalesce({_E.format('ra')}, {_E.format('r')}) AS ea, coalesce({_E.format('rb')}, {_E.format('r')}) AS eb FROM (
 SELECT track_id, side, t, count(*) AS n_frames, {_rms()} AS r, {_rms('t_sec < t')} AS rb, {_rms('t_sec >= t')} AS ra, avg(centroid) AS cent, avg(flatness) AS flat,
   sqrt(avg(bass_ms)) AS b, sqrt(avg(mids_ms)) AS m, sqrt(avg(highs_ms)) AS h, avg(onset) FILTER (t_sec < t) AS ob, avg(onset) FILTER (t_sec >= t) AS oa,
   {_mean('mfcc', 13, 't_sec < t', 2)} AS mb, {_mean('mfcc', 13, 't_sec >= t', 2)} AS ma, {_mean('chroma', 12, 't_sec < t')} AS cb, {_mean('chroma', 12, 't_sec >= t')} AS ca,
   any_value(downbeat_confidence) AS dc, sum(bass_env) AS tot, sum(CASE WHEN slot IN (0, 4, 8, 12) THEN bass_env ELSE 0e0 END) AS onb
 FROM (SELECT s.*, f.* EXCLUDE (track_id), downbeat_confidence, CAST(floor({fr.mod('f.t_sec - first_downbeat', fr._BAR)} / ({fr._BAR} / 16) + 0.5e0) AS BIGINT) % 16 AS slot
  FROM (SELECT track_id, 'in' AS side, 60e0 + track_id % 40 AS t FROM frame_tracks UNION ALL SELECT track_id, 'out', 200e0 + track_id % 30 FROM frame_tracks) s
   JOIN frame_tracks k ON k.track_id = s.track_id JOIN frames f ON f.track_id = s.track_id AND f.t_sec >= greatest(0e0, s.t - {fr._BAR} * phrase_unit) AND f.t_sec < least(300e0, s.t + {fr._BAR} * phrase_unit))
 GROUP BY 1, 2, 3))"""

_REC = ("WITH ", "WITH RECURSIVE ", 1)
SQL = {
    "c1_cues": sql(with_ctes(C, ["clean_cues"], "SELECT * FROM clean_cues").replace(*_REC), "track_id idx", "t", "name provenance"),
    "c2_phrases": sql(with_ctes(C, ["phrases"], "SELECT * FROM phrases"), "track_id phrase_idx", "start_s end_s", "label"),
    "c3_phrase_grid": sql(with_ctes(C, ["grid_points"], "SELECT * FROM grid_points"), "track_id idx", "t"),
    "c4_first_downbeat": sql(with_ctes(C, ["frames"], "SELECT track_id, min(CASE WHEN frame_idx % 4 + 1 - track_id % 3 = 1 THEN t_sec END) AS first_downbeat FROM frames GROUP BY 1"),
                             "track_id", "first_downbeat"),
    "c5_c6_c7_candidates": sql(with_ctes(C, ["candidates"], "SELECT * FROM candidates").replace(*_REC), "track_id", "t", "side schemes provenance section_label phrase_label"),
    "c7_first_eight": sql(with_ctes(C, ["first_candidates"], "SELECT * FROM first_candidates").replace(*_REC), "track_id", "t", "side schemes provenance section_label phrase_label"),
    "c8_measured": sql(with_ctes(C, ["frames", "frame_tracks"], _MEASURED), "track_id n_frames energy_local brightness_local",
                       "t mids_local highs_local bass_db novelty_local", "side energy_trend", "kick_active"),
    "c9_confidence": sql(with_ctes(C, ["frame_tracks"], """SELECT track_id, round_even(greatest(0e0, least(1e0, CASE WHEN track_id % 4 = 0 THEN p / 3e0 ELSE (p + (track_id % 11) / 10e0) / 4e0 END)), 3) AS confidence
        FROM (SELECT track_id, downbeat_confidence + CASE WHEN track_id % 3 = 0 THEN 1e0 ELSE (track_id % 7) / 7e0 END + CASE WHEN track_id % 5 <> 0 THEN 1e0 ELSE 0e0 END AS p FROM frame_tracks)"""),
        "track_id", "confidence"),
    "c10_summary": sql(with_ctes(C, ["candidates", "frame_sections", "cand_edges"], f"""
        SELECT side, tracks, without, median_n, violations, {', '.join(f'n_{s}' for s in cand.SCHEMES)} FROM (
          SELECT side, count(*) AS tracks, sum((n = 0)::INT) AS without, median(n) AS median_n FROM (
            SELECT i.track_id, s.side, count(c.t) AS n FROM (SELECT DISTINCT track_id FROM frame_sections) i CROSS JOIN (VALUES ('in'), ('out')) s(side)
              LEFT JOIN candidates c ON c.track_id = i.track_id AND c.side = s.side GROUP BY 1, 2) GROUP BY 1)
        LEFT JOIN (SELECT side, sum((CASE WHEN side = 'in' THEN t < intro_end - 0.05e0 ELSE t > outro_start + 0.05e0 END)::INT) AS violations,
            {', '.join(f'sum(list_contains(ranks, {i})::INT) AS n_{s}' for i, s in enumerate(cand.SCHEMES))}
          FROM candidates JOIN cand_edges USING (track_id) GROUP BY 1) USING (side)""").replace(*_REC),
        "tracks without violations " + " ".join(f"n_{s}" for s in cand.SCHEMES), "median_n", "side"),
}
