"""Queries on mix points, transition plans and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import pairs as pair_queries
from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from catalogue.sets import ANCHOR, C, ordered
from segue import refdata as R
from segue.functions import grid, sections
from segue.operators import mixpoints, transitions
from segue.plans import timeline as timing

TOL = 3.0


def _anchored(spark, sf):
    return rel.tracks(spark, sf).withColumn("anchor", grid.phrase_anchor(
        F.col("first_phrase"), F.col("downbeat_confidence"), F.col("phrase_confidence"), F.col("first_downbeat")))


def recommendations(spark, sf):
    return transitions.recommend(ordered(spark, sf), TOL)


def plan(spark, sf):
    return canon(recommendations(spark, sf).select(
        "playlist_id", "idx", "from_track", "to_track", "mix_out_a", "mix_in_b", "overlap", "fade_out_end",
        "transition_type", "tempo_ratio", "bpm_delta", "energy_delta", "score", "risk_level", "transition_bars",
        "outgoing_section", "incoming_section"))


def advice(spark, sf):
    return canon(recommendations(spark, sf).select("playlist_id", "idx", *[
        F.col(f"dj.{n}").alias(n) for n in ("genre_pair", "technique", "eq", "structure_note", "tempo", "key", "energy",
                                            "gain", "rhythm")]))


def risks(spark, sf):
    return canon(recommendations(spark, sf).select(
        "playlist_id", "idx", F.array_join("risk_notes", "; ").alias("risk_notes"), "description"))


def note_lines(spark, sf):
    return canon(recommendations(spark, sf).select("playlist_id", "idx", "notes"))


def clips(spark, sf):
    return canon(transitions.clip_requests(recommendations(spark, sf)).drop("path_a", "path_b", "idx").groupBy(
        "playlist_id", "transition_type").agg(
        F.count("*").alias("n"), F.sum(F.col("in_sync").cast("int")).alias("n_in_sync"), F.avg("rate").alias("rate"),
        F.avg("rate_wanted").alias("rate_wanted"), F.sum("crossfade_sec").alias("crossfade_sec"),
        F.sum(F.col("downbeat_reliable_a").cast("int")).alias("reliable_a"),
        F.avg("reserve_a").alias("reserve_a"), F.avg("reserve_b").alias("reserve_b")))


def precedence(spark, sf):
    t = rel.tracks(spark, sf)
    k = F.col("track_id")
    rows = t.select(
        "track_id", F.when(k % 2 == 0, F.col("duration") - 30.0).alias("plan_out"),
        F.when(k % 2 == 0, F.lit(20.0)).alias("plan_in"), F.when(k % 2 == 0, F.lit(24.0)).alias("plan_overlap"),
        F.when(k % 3 == 0, F.lit(-1.0)).otherwise(F.col("duration") - 40.0).alias("pair_out"),
        F.when(k % 5 == 0, F.lit(-1.0)).otherwise(F.lit(30.0)).alias("pair_in"),
        F.when(k % 7 == 0, F.lit(0.0)).otherwise(F.lit(18.0)).alias("pair_overlap"),
        F.col("mix_out_point").alias("track_out"), F.col("mix_in_point").alias("track_in"),
        F.when(k % 14 == 0, F.lit(0.0)).otherwise(F.lit(12.0)).alias("track_overlap"))
    return canon(transitions.effective_mix_points(rows).select("track_id", "mix_out", "mix_in", "crossfade"))


def track_points(spark, sf):
    return canon(mixpoints.track_mix_points(_anchored(spark, sf)).select(
        "track_id", "mix_in", "mix_out", "mix_in_bars", "mix_out_bars"))


def aligned(spark, sf):
    return canon(mixpoints.align_points(_anchored(spark, sf)).select("track_id", "aligned_in", "aligned_out"))


def resolved(spark, sf):
    i, o = sections.resolve_mix_points(F.col("mix_in_point"), F.col("mix_out_point"), F.col("duration"), 16.0)
    return canon(rel.tracks(spark, sf).select("track_id", i.alias("mix_in"), o.alias("mix_out")))


def edges(spark, sf):
    t = _anchored(spark, sf)
    secs = F.col("sections")
    return canon(t.select(
        "track_id", "anchor", sections.intro_end(secs).alias("intro_end"),
        sections.outro_start(secs, F.col("duration")).alias("outro_start"),
        sections.label_at(secs, F.col("mix_out_point"), "out").alias("label_out"),
        sections.label_at(secs, F.col("mix_in_point"), "in").alias("label_in"),
        sections.section_covering(secs, F.col("mix_out_point"))["avg_bass"].alias("bass_out")))


def cue_points(spark, sf):
    """One named cue per side, by track number."""
    k = F.col("track_id")
    name = F.when(k % 4 == 0, "MIX IN").when(k % 4 == 1, "Outro").when(k % 4 == 2, "Drop 2").otherwise("CUE(Auto)")
    cue = F.struct((k % 60).cast("double").alias("t"), name.alias("name"),
                   F.when(k % 4 == 3, "auto").otherwise("manual").alias("provenance"))
    late = F.struct((F.col("duration") - (k % 45)).alias("t"), F.lit("mix-out").alias("name"),
                    F.lit("manual").alias("provenance"))
    t = _anchored(spark, sf).withColumn("cues", F.when(k % 5 == 0, F.array(cue)).otherwise(F.array(cue, late)))
    return canon(mixpoints.apply_cues(t).select("track_id", "cue_mix_in", "cue_mix_out"))


def timeline(spark, sf):
    return canon(timing.timeline(ordered(spark, sf), recommendations(spark, sf)).drop("title"))


def timeline_unplanned(spark, sf):
    return canon(timing.timeline(ordered(spark, sf)).drop("title"))


def summary(spark, sf):
    return canon(timing.timing_summary(timing.timeline(ordered(spark, sf), recommendations(spark, sf))))


QUERIES = {
    "p21_transition_plan": plan,
    "p18_advice": advice,
    "p19_risk_notes": risks,
    "p20_note_lines": note_lines,
    "p22_clip_requests": clips,
    "p23_effective_mix_points": precedence,
    "p11_track_mix_points": track_points,
    "p14_aligned_points": aligned,
    "p15_cue_points": cue_points,
    "f21_resolved_mix_points": resolved,
    "f18_f19_f20_section_edges": edges,
    "a3_timeline": timeline,
    "a3_timeline_unplanned": timeline_unplanned,
    "a6_timing_summary": summary,
}

# ------------------------------------------------------------------- SQL twins


def q(t: str, width: str, anchor: str, mode: str) -> str:
    inner = {"ceil": f"ceil((({t}) - {anchor}) / ({width}) - 0.05e0 / ({width}))",
             "floor": f"floor((({t}) - {anchor}) / ({width}) + 0.05e0 / ({width}))",
             "round": f"round_even((({t}) - {anchor}) / ({width}), 0)"}[mode]
    return f"({inner} * ({width}) + {anchor})"


C["section_edges"] = """
SELECT track_id, coalesce(min(CASE WHEN label <> 'intro' THEN section_idx END), 999) AS first_body,
       coalesce(max(CASE WHEN label <> 'outro' THEN section_idx END), -1) AS last_body
FROM track_sections GROUP BY 1"""
C["edges"] = """
SELECT s.track_id, coalesce(max(CASE WHEN section_idx < first_body THEN end_time END), 0e0) AS intro_end,
       min(CASE WHEN section_idx > last_body THEN start_time END) AS outro_start_or_null, max(n_sections) AS n_secs,
       max(end_time) AS track_end, avg(avg_energy) AS mean_energy
FROM track_sections s JOIN section_edges e ON e.track_id = s.track_id GROUP BY 1"""
C["plan_feat"] = f"""
SELECT f.*, {ANCHOR} AS anchor, coalesce(intro_end, 0e0) AS intro_end, coalesce(outro_start_or_null, duration) AS outro_start,
  coalesce(n_secs, 0) AS n_secs, track_end, mean_energy, coalesce(p.trans_min, 16e0) AS trans_min, coalesce(p.trans_max, 32e0) AS trans_max,
  coalesce(p.phrase_bars, 8e0) AS phrase_bars, coalesce(p.eq, 'Standard Bass Swap') AS eq,
  coalesce(p.technique, 'Standard Intro/Outro-Blend') AS technique, coalesce(w.code, '') AS code
FROM feat f LEFT JOIN edges e ON e.track_id = f.track_id LEFT JOIN mix_profiles p ON p.genre_key = lower(f.detected_genre)
  LEFT JOIN wheel w ON w.note = f.key_note AND w.mode = f.key_mode"""


def _label(track: str, t: str, edge: str) -> str:
    pick = "section_idx" if edge == "in" else "-section_idx"
    return f"""CASE WHEN {track}.n_secs = 0 OR {t} < 0 THEN 'unknown' ELSE coalesce(
      (SELECT first(s.label ORDER BY section_idx) FROM track_sections s WHERE s.track_id = {track}.track_id AND s.start_time <= {t}
        AND ({t} < s.end_time OR (s.section_idx = s.n_sections - 1 AND {t} = s.end_time))),
      (SELECT first(s.label ORDER BY {pick}) FROM track_sections s WHERE s.track_id = {track}.track_id)) END"""


def _bass(track: str, t: str) -> str:
    return f"""coalesce((SELECT first(s.avg_bass ORDER BY section_idx) FROM track_sections s WHERE s.track_id = {track}.track_id
        AND s.start_time <= {t} AND {t} <= s.end_time), {track}.avg_bass)"""


# numeric plan of every neighbour pair; x is A, y is B
C["paired"] = f"""
SELECT *, CASE WHEN q_out >= bar_a AND q_out <= x.duration - bar_a THEN q_out ELSE out1 END AS pair_out,
  CASE WHEN q_in >= 0 AND q_in < y.duration THEN q_in WHEN q_in >= y.duration
       THEN least(greatest(greatest(0e0, y.duration - bar_b), least(y.intro_end, y.duration)), y.duration - 0.000001e0) ELSE in0 END AS pair_in
FROM (SELECT *, {q('out1 + 1e-9', 'phrase_a', 'x.anchor', 'floor')} AS q_out, {q('in0 - 1e-9', 'phrase_b', 'y.anchor', 'ceil')} AS q_in
 FROM (SELECT *, greatest(least(CASE WHEN out0 >= x.outro_start THEN CASE WHEN outro_floor >= x.outro_start THEN outro_floor - phrase_a
          ELSE outro_floor END ELSE out0 END, x.duration - bar_a), bar_a) AS out1
  FROM (SELECT *, greatest(own_out, x.duration - least(greatest(bar_b * greatest(8e0, y.trans_min),
            least(CASE WHEN y.intro_end > 0 THEN y.intro_end ELSE greatest(y.mix_in_point, 0e0) END, greatest(0e0, x.duration - own_out))),
            x.duration * 0.5e0, y.duration * 0.5e0)) AS out0,
      CASE WHEN y.intro_end > 0 THEN {q('y.intro_end', 'phrase_b', 'y.anchor', 'ceil')} ELSE greatest(0e0, y.mix_in_point) END AS in0,
      {q('x.outro_start', 'phrase_a', 'x.anchor', 'floor')} AS outro_floor
   FROM (SELECT x, y, 60e0 / x.bpm * 4e0 AS bar_a, 60e0 / y.bpm * 4e0 AS bar_b, 60e0 / x.bpm * 4e0 * x.phrase_bars AS phrase_a,
       60e0 / y.bpm * 4e0 * y.phrase_bars AS phrase_b,
       CASE WHEN x.mix_out_point > 0 THEN x.mix_out_point ELSE x.duration * 0.8e0 END AS own_out
     FROM plan_feat x JOIN plan_feat y ON y.playlist_id = x.playlist_id AND y.input_pos = x.input_pos + 1))))"""


def _resolve(prefix: str, overlap: str) -> tuple[str, str]:
    dur, i, o = f"{prefix}duration", f"{prefix}mix_in_point", f"{prefix}mix_out_point"
    raw_in = f"CASE WHEN {i} >= 0 THEN {i} ELSE least({dur} * 0.1e0, greatest(4e0, {overlap} / 2e0)) END"
    raw_out = f"CASE WHEN {o} >= 0 THEN {o} ELSE greatest(({raw_in}) + 4e0, {dur} - least({dur} * 0.05e0, {overlap})) END"
    clamped_in = f"greatest(0e0, least({raw_in}, {dur}))"
    out = f"least({dur}, greatest({clamped_in} + 1e0, least({raw_out}, {dur})))"
    return f"(CASE WHEN {clamped_in} >= {out} THEN greatest(0e0, {out} - 1e0) ELSE {clamped_in} END)", f"({out})"


_EFF = "least(12e0, greatest(6e0, least(x.duration, y.duration) * 0.2e0))"
_FREE = pair_queries.harmonic(diff="0e0", tol="1e9")
_IN = {name: "(" + " OR ".join(f"{s}.rgenre IN ({', '.join(repr(g) for g in genres)})" for s in "xy") + ")"
       for name, genres in (("melodic", R.MELODIC_GENRES), ("eq", R.EQ_SWAP_GENRES), ("bass", R.BASS_SWAP_GENRES))}
C["plan"] = f"""
SELECT *, least(x.duration, plan_out + overlap) AS fade_out_end,
  {_label('x', 'plan_out', 'out')} AS outgoing_section, {_label('y', 'plan_in', 'in')} AS incoming_section,
  {_bass('x', 'plan_out')} AS bass_a, {_bass('y', 'plan_in')} AS bass_b,
  CASE WHEN bpm_relation <> 'direct' AND bpm_diff <= 3 THEN 'halftime_switch'
       WHEN bpm_diff > 3 AND free >= 50 THEN 'breakdown_bridge' WHEN bpm_diff > 3 THEN 'cold_cut'
       WHEN step > 25 AND harmonic >= 70 THEN 'drop_cut' WHEN step < -25 AND harmonic >= 60 THEN 'echo_out'
       WHEN step < -25 THEN 'breakdown_bridge'
       WHEN harmonic >= 85 AND abs(step) <= 15 AND bpm_diff <= 2 AND {_IN['melodic']} THEN 'filter_ride'
       WHEN harmonic >= 70 AND {_IN['eq']} THEN 'pro_eq_swap' WHEN harmonic >= 70 AND {_IN['bass']} THEN 'bass_swap'
       WHEN harmonic >= 70 THEN 'smooth_blend' WHEN harmonic >= 50 AND abs(step) > 15 THEN 'breakdown_bridge'
       WHEN harmonic >= 50 THEN 'filter_ride' WHEN harmonic >= 30 THEN 'echo_out' ELSE 'cold_cut' END AS transition_type,
  CASE WHEN bpm_diff > 3 OR objective < 50 THEN 'high' WHEN objective >= 80 AND abs(step) <= 20 THEN 'low'
       WHEN abs(step) > 35 AND objective < 70 THEN 'high' WHEN objective >= 70 THEN 'medium-low' ELSE 'medium' END AS risk_level
FROM (SELECT *, greatest(0e0, least(CASE WHEN planned THEN bar_a * transition_bars ELSE eff END, 64e0, greatest(0e0, x.duration - plan_out),
        greatest(0e0, y.duration - plan_in), CASE WHEN x.n_secs > 0 AND x.outro_start < x.duration AND x.outro_start - plan_out >= 8 * bar_a
        THEN floor((x.outro_start - plan_out) / bar_a) * bar_a ELSE 1e9 END)) AS overlap
  FROM (SELECT *, CASE WHEN planned THEN pair_out ELSE {_resolve('x.', _EFF)[1]} END AS plan_out,
       CASE WHEN planned THEN pair_in ELSE {_resolve('y.', _EFF)[0]} END AS plan_in,
       greatest(8, CAST(round_even((CASE WHEN bpm_relation <> 'direct' THEN least(base_bars, 16) ELSE base_bars END
          - CASE WHEN bpm_diff < 1 AND abs(step) < 10 THEN 4 ELSE 0 END) / 4e0, 0) * 4 AS INTEGER)) AS transition_bars
    FROM (SELECT p.*, a.bpm_diff, a.bpm_relation, a.harmonic, a.objective, {_FREE} AS free, y.energy - x.energy AS step,
         x.detected_genre <> 'Unknown' AND y.detected_genre <> 'Unknown' AS planned, {_EFF} AS eff,
         coalesce(f.affinity, 0.5e0) AS aff,
         floor((x.trans_min + x.trans_max + y.trans_min + y.trans_max) / 4e0)
           + CASE WHEN a.bpm_diff > 8 THEN 8 WHEN a.bpm_diff > 4 THEN 4 ELSE 0 END
           + CASE WHEN abs(x.energy - y.energy) > 25 THEN 4 ELSE 0 END AS base_bars
       FROM paired p JOIN adj a ON a.a_track_id = x.track_id
         LEFT JOIN affinity f ON f.g_lo = least(lower(x.detected_genre), lower(y.detected_genre))
                             AND f.g_hi = greatest(lower(x.detected_genre), lower(y.detected_genre)))))"""

_N1 = "format('{:.1f}', {})"


def f1(value: str) -> str:
    return f"format('{{:.1f}}', {value})"


def sf1(value: str, digits: int = 1) -> str:
    return f"format('{{:+.{digits}f}}', {value})"


_TEMPO_HEAD = f"{f1('x.bpm')} || ' → ' || {f1('y.bpm')}"
_DIFF = f"' (Diff ' || {sf1('y.bpm - x.bpm')} || ')'"
_PCT = f1("abs((y.bpm - x.bpm) / x.bpm) * 100e0")
_WAY = "CASE WHEN y.bpm < x.bpm THEN 'runter' ELSE 'rauf' END"
_TEMPO = f"""CASE WHEN bpm_relation <> 'direct' AND bpm_diff < 0.3e0 THEN {_TEMPO_HEAD} || ' — Half/Double-Time kompatibel, Downbeat exakt auf Phrase setzen'
  WHEN bpm_relation <> 'direct' THEN {_TEMPO_HEAD} || ' — Half/Double-Time (eff. ' || {f1('bpm_diff')} || ' BPM, ~' || {f1('bpm_diff / x.bpm * 100e0')}
     || '% Fein-Pitch), Downbeat auf Phrase setzen'
  WHEN bpm_diff < 0.3e0 THEN {_TEMPO_HEAD} || ' — Match, kein Pitching noetig'
  WHEN bpm_diff <= 2 THEN {_TEMPO_HEAD} || {_DIFF} || ' — Pitch-Fader ' || {_PCT} || '% ' || {_WAY}
  WHEN bpm_diff <= 5 THEN {_TEMPO_HEAD} || {_DIFF} || ' — ' || {_PCT} || '% ' || {_WAY} || ' pitchen, frueh beginnen'
  WHEN bpm_diff <= 10 THEN {_TEMPO_HEAD} || {_DIFF} || ' — Tempo im Intro angleichen'
  ELSE {_TEMPO_HEAD} || {_DIFF} || ' — Breakdown-Bridge oder Cold Cut' END"""
_STEPS = "least(abs(x.num - y.num), 12 - abs(x.num - y.num))"
_KEY = f"""CASE WHEN x.num = 0 OR y.num = 0 THEN '' ELSE x.code || ' → ' || y.code || ' — ' ||
  CASE WHEN x.code = y.code THEN 'Gleiche Tonart, perfekt harmonisch' WHEN {_STEPS} = 0 THEN 'Dur/Moll-Wechsel, smooth energy shift'
   WHEN {_STEPS} = 1 THEN '1 Schritt (' || CASE WHEN (y.num - x.num + 12) % 12 <= 6 THEN '+' ELSE '-' END || ')' ||
      CASE WHEN x.letter = y.letter THEN ', harmonisch blendbar' ELSE ' + Modus-Wechsel, energy mix' END
   WHEN {_STEPS} = 2 THEN 'Distanz 2, Filter-Ride empfohlen' WHEN {_STEPS} = 3 THEN 'Distanz 3, dezenter Clash — kein Melodie-Overlap'
   WHEN {_STEPS} IN (4, 5) AND x.letter = y.letter THEN 'Distanz ' || {_STEPS} || ', experimentelle Technik (+4/+7) — Energie-/Mood-Shift, kurz blenden'
   ELSE 'Distanz ' || {_STEPS} || ', Key-Clash — nur Bass Swap' END END"""
_ENERGY = f"""CASE WHEN x.energy <= 0 AND y.energy <= 0 THEN '' ELSE x.energy || ' → ' || y.energy || ' (Diff ' || {sf1('step * 1e0', 0)} || ') — ' ||
  CASE WHEN abs(step) <= 5 THEN 'stabil, normaler Crossfade' WHEN step > 25 THEN 'Push, Drop-Cut oder Build-Einstieg'
   WHEN step > 10 THEN 'Aufbau, im Build einmixen' WHEN step < -25 THEN 'Drop, Breakdown-Uebergang planen'
   WHEN step < -10 THEN 'Abfall, im Outro ueberblenden' ELSE 'leichter Shift, smooth moeglich' END END"""
_LUFS = f"{f1('x.lufs')} || ' → ' || {f1('y.lufs')} || ' LUFS — '"
_GAIN = f"""CASE WHEN x.lufs >= 0 OR y.lufs >= 0 THEN '' WHEN abs(x.lufs - y.lufs) < 1 THEN {_LUFS} || 'Pegel passt, kein Gain noetig'
  ELSE {_LUFS} || 'Track B Gain ' || {f1('abs(x.lufs - y.lufs)')} || ' dB ' || CASE WHEN x.lufs > y.lufs THEN 'rauf' ELSE 'runter' END
   || CASE WHEN abs(x.lufs - y.lufs) >= 3 THEN ' (deutlich — vor dem Mix angleichen!)' ELSE '' END END"""
_RHYTHM = """CASE WHEN x.percussive_ratio > 0.7e0 AND y.percussive_ratio > 0.7e0
   THEN 'Beide Tracks sehr perkussiv - Vorsicht vor Rhythmus-Salat, kurzen Uebergang waehlen'
   WHEN y.percussive_ratio < 0.3e0 THEN 'Incoming Track sehr tonal - ideal fuer lange Filter-Blends' ELSE '' END"""
_NOTES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in transitions.STRUCTURE_NOTES.items())
_STRUCTURE = f"""CASE WHEN outgoing_section = 'unknown' OR incoming_section = 'unknown' THEN '' ELSE
   CASE outgoing_section || '>' || incoming_section {_NOTES} ELSE 'Struktur: ' || outgoing_section || ' -> ' || incoming_section END END"""


def _cross(what: int) -> str:
    whens = " ".join(f"WHEN '{m}|{n}' THEN '{t[what]}'" for (p, r), t in R.CROSS_GENRE.items() for m, n in ((p, r), (r, p)))
    fallback = ("""CASE WHEN aff < 0.3e0 THEN 'Schwierige Kombination -- Breakdown-Bridge oder Cold Cut, kein langer Blend'
      WHEN aff < 0.6e0 THEN 'Vorsichtiger Uebergang -- kurzer Blend am Phrasen-Ende, Energie angleichen'
      ELSE 'Standard cross-genre blend - match energy levels' END""" if what == 0 else
                """CASE WHEN aff < 0.3e0 THEN 'Bass von Track A komplett cutten BEVOR Track B einsetzt -- keine Ueberlappung'
      ELSE 'Standard bass swap at phrase boundary' END""")
    own = "y.technique" if what == 0 else "y.eq"
    return (f"CASE WHEN x.detected_genre = y.detected_genre THEN {own} ELSE "
            f"CASE x.detected_genre || '|' || y.detected_genre {whens} ELSE {fallback} END END")


def _when_planned(expr: str) -> str:
    return f"CASE WHEN planned THEN {expr} END"


def _unsure(side: str, label: str) -> str:
    return (f"CASE WHEN {side}.key_confidence > 0 AND {side}.key_confidence < 0.5e0 THEN 'Key von Track {label} unsicher erkannt (' || "
            f"format('{{:.0f}}', {side}.key_confidence * 100e0) || '%) -- Harmonik-Empfehlung pruefen, im Zweifel Bass Swap' END")


_RISKS = f"""concat_ws('; ',
  CASE WHEN bpm_relation <> 'direct' THEN 'Half/Double-Time (' || {f1('x.bpm')} || '↔' || {f1('y.bpm')} || ') -- exakt auf Phrase/Downbeat cutten'
     || CASE WHEN bpm_diff <= 2 THEN '' ELSE ', eff. ' || {f1('bpm_diff')} || ' BPM angleichen' END
   WHEN bpm_diff > 8 THEN 'Grosser BPM-Sprung (' || {f1('bpm_diff')} || ') -- Pitch-Anpassung noetig'
   WHEN bpm_diff > 4 THEN 'BPM-Differenz ' || {f1('bpm_diff')} || ' -- langsam angleichen' END,
  CASE WHEN abs(step) > 30 THEN 'Grosser Energie-Sprung (' || abs(step) || ') -- EQ-Uebergang nutzen'
   WHEN abs(step) > 15 THEN 'Deutlicher Energie-Shift (' || abs(step) || ') -- Transition aufbauen' END,
  CASE WHEN aff < 0.4e0 THEN 'Geringe Genre-Kompatibilitaet -- Bridge-Track empfohlen'
   WHEN aff < 0.6e0 THEN 'Maessige Genre-Kompatibilitaet -- im Breakdown/Intro mixen' END,
  CASE WHEN x.num > 0 AND y.num > 0 AND {_STEPS} > 2 THEN 'Tonart-Clash (Camelot-Distanz: ' || {_STEPS} || ') -- EQ/Filter nutzen' END,
  CASE WHEN bass_b > 80 THEN 'Incoming Track hat sehr dominanten Bass -- Bass-Swap am Phrasen-Ende empfohlen' END,
  {_unsure('x', 'A')}, {_unsure('y', 'B')},
  CASE WHEN x.lufs < 0 AND y.lufs < 0 AND abs(x.lufs - y.lufs) >= 3 THEN 'Lautheits-Sprung ' || {f1('abs(x.lufs - y.lufs)')} || ' dB ('
     || {f1('x.lufs')} || ' vs ' || {f1('y.lufs')} || ' LUFS) -- Gain vor dem Mix angleichen' END,
  CASE WHEN x.vocal_instrumental = 'vocal' AND y.vocal_instrumental = 'vocal' THEN
     'Beide Tracks vocal-lastig -- Vocal-Ueberlappung vermeiden (Uebergang ueber instrumentale Passagen legen)' END,
  CASE WHEN bass_a > 60 AND bass_b > 60 THEN 'Bass-Kollision droht! (A:' || format('{{:.0f}}', bass_a) || '%, B:' || format('{{:.0f}}', bass_b)
     || '%) -- Bass von Track A hart cutten' END)"""
_CODES = "CASE WHEN x.code <> '' AND y.code <> '' THEN ' (' || x.code || '->' || y.code || ')' ELSE '' END"
_DESCRIPTION = f"""concat_ws('; ',
  CASE WHEN harmonic >= 90 THEN 'Perfekte Tonart' || {_CODES} WHEN planned AND harmonic >= 70 THEN 'Harmonisch' || {_CODES}
   WHEN planned THEN NULL WHEN harmonic >= 70 THEN 'Harmonisch kompatibel' || {_CODES}
   WHEN harmonic >= 50 THEN 'Tonart geht, kurz mixen' || {_CODES} ELSE 'Tonart-Clash' || {_CODES} || ' -- EQ-Filter nutzen' END,
  CASE WHEN planned OR abs(y.bpm - x.bpm) < 0.5e0 THEN NULL
   WHEN abs(y.bpm - x.bpm) <= 3 THEN 'BPM-Anpassung ' || {sf1('y.bpm - x.bpm')} || ' -- Pitch Fader korrigieren'
   ELSE 'BPM-Sprung ' || {sf1('y.bpm - x.bpm')} || ' -- harter Cut oder Breakdown nutzen' END,
  CASE WHEN planned THEN NULL WHEN step > 25 THEN 'Grosser Energie-Push [++] -- Drop-Einstieg ideal'
   WHEN step > 12 THEN 'Energie steigt [+] -- im Build reinmixen' WHEN step < -25 THEN 'Starker Energie-Drop [--] -- Breakdown-Uebergang planen'
   WHEN step < -12 THEN 'Energie faellt [-] -- im Outro sanft ueberblenden' ELSE 'Energie stabil [=] -- nahtlose Ueberblendung moeglich' END,
  CASE WHEN objective >= 85 THEN 'Sichere Transition -- laeuft fast von allein'
   WHEN objective >= 70 THEN 'Solide Transition -- mit Aufmerksamkeit sauber mixbar'
   WHEN objective >= 55 THEN 'Machbar, aber anspruchsvoll -- Timing und EQ muessen stimmen'
   ELSE 'Riskante Transition -- nur fuer erfahrene DJs oder mit langem Breakdown' END)"""

_WARNINGS = "list_filter([" + _RISKS[len("concat_ws('; ',"):-1] + "], lambda r: r IS NOT NULL)"


def _warned(rule: str) -> str:
    return f"nullif(array_to_string(list_transform(list_filter({_WARNINGS}, lambda r: {rule} starts_with(r, 'Bass-Kollision')), lambda r: '! ' || r), '; '), '')"


def _tag(label: str, expr: str) -> str:
    return f"'{label}: ' || nullif({expr}, '')"


_NOTES_LINE = f"""concat_ws('; ', {', '.join(_when_planned(e) for e in (
    _tag('Mix', _cross(0)), _tag('EQ', _cross(1)), "'Transition: ' || transition_bars || ' bars'", f"nullif({_STRUCTURE}, '')",
    "'[' || x.detected_genre || ' -> ' || y.detected_genre || ']'", _warned('NOT'), _tag('BPM', _TEMPO), _tag('Key', _KEY),
    _tag('Energy', _ENERGY), _tag('Gain', _GAIN), _tag('Rhythmus', _RHYTHM), _warned('')))}, {_DESCRIPTION})"""

_RATE = """CASE WHEN abs(x.bpm - y.bpm) > 0.05e0 THEN x.bpm / (CASE WHEN abs(y.bpm * 2e0 - x.bpm) < x.bpm * 0.04e0 THEN y.bpm * 2e0
   WHEN abs(y.bpm / 2e0 - x.bpm) < x.bpm * 0.04e0 THEN y.bpm / 2e0 ELSE y.bpm END) ELSE 1e0 END"""
_ID = "x.playlist_id AS playlist_id, x.input_pos AS idx"

# mix points of one track, guard by guard
_PRIO_IN = "CASE label WHEN 'build' THEN 0 WHEN 'main' THEN 1 WHEN 'breakdown' THEN 2 WHEN 'drop' THEN 3 ELSE 99 END"


def _snap(i: str, o: str, phrase: str, eps: str, keep_i: str, keep_o: str) -> tuple[str, str]:
    pi, po = q(f"{i} - {eps}", phrase, "anchor", "ceil"), q(f"{o} + {eps}", phrase, "anchor", "floor")
    bi, bo = q(f"{i} - {eps}", "bar", "anchor", "ceil"), q(f"{o} + {eps}", "bar", "anchor", "floor")
    return tuple(f"CASE WHEN {pi} >= 0 AND {pi} < {po} AND {po} <= duration THEN {p} "
                 f"WHEN {bi} >= 0 AND {bi} < {bo} AND {bo} <= duration THEN {b} ELSE {k} END"
                 for p, b, k in ((pi, bi, keep_i), (po, bo, keep_o)))


_FINAL_IN, _FINAL_OUT = _snap("in5", "out5", "phrase", "1e-9", "in5", "out5")
_POINTS = f"""
SELECT track_id, CASE WHEN n_secs > 0 THEN {_FINAL_IN} ELSE 0e0 END AS mix_in, CASE WHEN n_secs > 0 THEN {_FINAL_OUT} ELSE duration END AS mix_out, bar, n_secs FROM (
 SELECT *, CASE WHEN out4 > in4 THEN in4 WHEN alt_out > alt_in THEN alt_in ELSE duration * 0.15e0 END AS in5,
   CASE WHEN out4 > in4 THEN out4 WHEN alt_out > alt_in THEN alt_out ELSE duration * 0.85e0 END AS out5 FROM (
  SELECT *, CASE WHEN roomy THEN in3 ELSE greatest(intro_end, duration * 0.15e0) END AS in4,
    CASE WHEN roomy THEN out3 ELSE least(outro_start - bar, duration * 0.85e0) END AS out4,
    greatest(intro_end, duration * 0.15e0) AS alt_in, least(greatest(outro_start - bar, 0e0), duration * 0.85e0) AS alt_out FROM (
   SELECT *, CASE WHEN out3 - {q('in2 - 1e-9', 'phrase', 'anchor', 'ceil')} >= phrase * 2e0 THEN {q('in2 - 1e-9', 'phrase', 'anchor', 'ceil')} ELSE in2 END AS in3 FROM (
    SELECT *, CASE WHEN {q('out2 + 1e-9', 'phrase', 'anchor', 'floor')} - in2 >= phrase * 2e0 THEN {q('out2 + 1e-9', 'phrase', 'anchor', 'floor')} ELSE out2 END AS out3 FROM (
     SELECT *, greatest(in2 + phrase * 2e0, least(out1, high)) AS out2 FROM (
      SELECT *, greatest(low, least(in1, high - phrase * 2e0)) AS in2, high - low >= phrase * 2e0 AS roomy FROM (
       SELECT *, {q('in0', 'phrase', 'anchor', 'ceil')} AS in1, {q('out0', 'phrase', 'anchor', 'floor')} AS out1,
         greatest(intro_end, first_downbeat + phrase) AS low, least(outro_start, duration - phrase) AS high FROM (
        SELECT *, CASE WHEN best_start IS NULL THEN greatest(intro_end, {q('intro_end', 'phrase', 'anchor', 'round')})
            ELSE greatest({q('best_start', 'phrase', 'anchor', 'ceil')}, intro_end) END AS in0,
          greatest(0e0, least(CASE WHEN best_end IS NULL THEN {q('outro_start', 'phrase', 'anchor', 'floor')}
            WHEN outro_start < duration AND {q('best_end', 'phrase', 'anchor', 'floor')} >= outro_start
            THEN {q('outro_start - phrase', 'phrase', 'anchor', 'floor')} ELSE {q('best_end', 'phrase', 'anchor', 'floor')} END, outro_start)) AS out0 FROM (
         SELECT f.*, 60e0 / bpm * 4e0 AS bar, 60e0 / bpm * 4e0 * phrase_bars AS phrase,
           coalesce((SELECT first(start_time ORDER BY {_PRIO_IN}, start_time) FROM track_sections s WHERE s.track_id = f.track_id
              AND start_time >= f.intro_end AND label NOT IN ('intro', 'outro', 'unanalysed') AND start_time <= greatest(f.intro_end, f.track_end * 0.4e0)),
             (SELECT first(start_time ORDER BY {_PRIO_IN}, start_time) FROM track_sections s WHERE s.track_id = f.track_id
              AND start_time >= f.intro_end AND label NOT IN ('intro', 'outro', 'unanalysed'))) AS best_start,
           (SELECT max(end_time) FROM track_sections s WHERE s.track_id = f.track_id AND end_time <= f.outro_start
              AND label NOT IN ('intro', 'outro', 'unanalysed')) AS best_end
         FROM plan_feat f)))))))))"""

_A_IN, _A_OUT = _snap("mix_in_point", "mix_out_point", "bar * phrase_unit", "1e-6", "mix_in_point", "mix_out_point")
_C_IN, _C_OUT = _snap("want_in", "want_out", "bar * phrase_unit", "1e-6", "want_in", "want_out")
_CUES = """SELECT *, CASE WHEN track_id % 4 = 0 THEN (track_id % 60) * 1e0 ELSE mix_in_point END AS want_in,
   CASE WHEN track_id % 4 = 1 THEN (track_id % 60) * 1e0 WHEN track_id % 5 <> 0 THEN duration - track_id % 45 ELSE mix_out_point END AS want_out
 FROM (SELECT *, 60e0 / bpm * 4e0 AS bar FROM plan_feat)"""


def _timeline(planned: bool) -> str:
    plan_cols = ("o.plan_out, o.overlap AS plan_overlap, i.plan_in" if planned else
                 "CAST(NULL AS DOUBLE) AS plan_out, CAST(NULL AS DOUBLE) AS plan_overlap, CAST(NULL AS DOUBLE) AS plan_in")
    joins = ("LEFT JOIN plan o ON o.x.track_id = t.track_id LEFT JOIN plan i ON i.y.track_id = t.track_id" if planned else "")
    fall_in, fall_out = _resolve("t.", "16e0")
    return f"""
SELECT playlist_id, place AS pos, track_id, title, start_time, end_time, playing_duration, overlap_with_next, place = peak_place AS is_peak,
  CASE WHEN place = peak_place THEN 'peak' WHEN place = 0 THEN 'intro' WHEN place = n - 1 THEN 'cooldown'
   WHEN place / greatest(n - 1, 1) < peak_place / greatest(n - 1, 1) * 0.5e0 THEN 'warmup'
   WHEN place / greatest(n - 1, 1) <= peak_place / greatest(n - 1, 1) THEN 'build'
   WHEN place / greatest(n - 1, 1) <= peak_place / greatest(n - 1, 1) + 0.15e0 THEN 'sustain' ELSE 'cooldown' END AS energy_phase
FROM (SELECT *, first(place) OVER (PARTITION BY playlist_id ORDER BY peak_score DESC, place) AS peak_place
 FROM (SELECT *, energy / 100e0 * 0.6e0 + (1e0 - least(abs((start_time + end_time) / 2e0 - total * 0.65e0) / greatest(total, 1e0), 1e0)) * 0.4e0 AS peak_score
  FROM (SELECT *, last(end_time) OVER (PARTITION BY playlist_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS total
   FROM (SELECT *, round_even(start, 2) AS start_time, round_even(start + playing, 2) AS end_time, round_even(playing, 2) AS playing_duration,
       round_even(overlap, 2) AS overlap_with_next
    FROM (SELECT *, coalesce(sum(mix_out - mix_in) OVER (PARTITION BY playlist_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS start,
       CASE WHEN place = n - 1 THEN dur - mix_in ELSE mix_out - mix_in + overlap END AS playing
     FROM (SELECT *, CASE WHEN place = n - 1 THEN 0e0 ELSE greatest(0e0, least(CASE WHEN plan_out IS NOT NULL THEN plan_overlap
          ELSE greatest(4e0, least(dur - mix_out, 16e0, dur * 0.3e0)) END, dur * 0.5e0, dur - mix_out)) END AS overlap
      FROM (SELECT *, CASE WHEN mix_in < coalesce(plan_out, fall_out) AND coalesce(plan_out, fall_out) <= dur THEN coalesce(plan_out, fall_out)
          WHEN mix_in < fall_out AND fall_out <= dur THEN fall_out ELSE dur END AS mix_out
       FROM (SELECT *, least(greatest(CASE WHEN place = 0 THEN 0e0 ELSE coalesce(plan_in, fall_in) END, 0e0), dur) AS mix_in
        FROM (SELECT t.playlist_id, t.input_pos AS place, t.track_id, t.title, t.energy, greatest(t.duration, 30e0) AS dur, {plan_cols},
            {fall_in} AS fall_in, {fall_out} AS fall_out, count(*) OVER (PARTITION BY t.playlist_id) AS n
          FROM tracks t {joins})))))))))"""


C["timeline"] = _timeline(True)
C["timeline_plain"] = _timeline(False)


def _mmss(v: str) -> str:
    return (f"CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(CAST(floor(abs({v}) / 60e0) AS BIGINT) AS VARCHAR) || ':' || "
            f"lpad(CAST(CAST(floor(abs({v}) % 60e0) AS BIGINT) AS VARCHAR), 2, '0')")


_TIME = dict(ints="playlist_id pos track_id", floats="start_time end_time playing_duration overlap_with_next",
             texts="energy_phase", bools="is_peak")

SQL = {
    "p21_transition_plan": sql(with_ctes(C, ["plan"], f"""
        SELECT {_ID}, x.track_id AS from_track, y.track_id AS to_track, plan_out AS mix_out_a, plan_in AS mix_in_b, overlap, fade_out_end,
          transition_type, y.bpm / x.bpm AS tempo_ratio, round_even(y.bpm - x.bpm, 2) AS bpm_delta, step AS energy_delta,
          objective AS score, risk_level, transition_bars, outgoing_section, incoming_section FROM plan"""),
        "playlist_id idx from_track to_track energy_delta score transition_bars",
        "mix_out_a mix_in_b overlap fade_out_end tempo_ratio bpm_delta",
        "transition_type risk_level outgoing_section incoming_section"),
    "p18_advice": sql(with_ctes(C, ["plan"], f"""
        SELECT {_ID}, {', '.join(f'{_when_planned(e)} AS {n}' for n, e in (
            ('genre_pair', "x.detected_genre || ' -> ' || y.detected_genre"), ('technique', _cross(0)), ('eq', _cross(1)),
            ('structure_note', _STRUCTURE), ('tempo', _TEMPO), ('key', _KEY), ('energy', _ENERGY), ('gain', _GAIN),
            ('rhythm', _RHYTHM)))} FROM plan"""),
        "playlist_id idx", texts="genre_pair technique eq structure_note tempo key energy gain rhythm"),
    "p19_risk_notes": sql(with_ctes(C, ["plan"], f"""
        SELECT {_ID}, {_when_planned(_RISKS)} AS risk_notes, {_DESCRIPTION} AS description FROM plan"""),
        "playlist_id idx", texts="risk_notes description"),
    "p20_note_lines": sql(with_ctes(C, ["plan"], f"SELECT {_ID}, {_NOTES_LINE} AS notes FROM plan"), "playlist_id idx", texts="notes"),
    "p22_clip_requests": sql(with_ctes(C, ["plan"], f"""
        SELECT playlist_id, transition_type, count(*) AS n, sum(CASE WHEN abs(w - r) <= 0.000001e0 THEN 1 ELSE 0 END) AS n_in_sync,
          avg(r) AS rate, avg(w) AS rate_wanted, sum(overlap) AS crossfade_sec, sum(reliable) AS reliable_a,
          avg(ra) AS reserve_a, avg(rb) AS reserve_b FROM (
          SELECT *, least(1.08e0, greatest(0.92e0, w)) AS r FROM (
            SELECT {_ID}, transition_type, overlap, {_RATE} AS w, CASE WHEN x.downbeat_confidence >= 0.3e0 THEN 1 ELSE 0 END AS reliable,
              x.duration - plan_out AS ra, y.duration - plan_in - 8e0 AS rb FROM plan)) GROUP BY 1, 2"""),
        "playlist_id n n_in_sync reliable_a", "rate rate_wanted crossfade_sec reserve_a reserve_b", "transition_type"),
    "p23_effective_mix_points": sql(with_ctes(C, ["tracks"], """
        SELECT track_id, CASE WHEN track_id % 2 = 0 THEN duration - 30 WHEN track_id % 3 <> 0 THEN duration - 40
            ELSE greatest(0e0, mix_out_point) END AS mix_out,
          CASE WHEN track_id % 2 = 0 THEN 20e0 WHEN track_id % 5 <> 0 THEN 30e0 ELSE greatest(0e0, mix_in_point) END AS mix_in,
          CASE WHEN track_id % 2 = 0 THEN 24e0 WHEN track_id % 7 <> 0 THEN 18e0 WHEN track_id % 14 = 0 THEN 16e0 ELSE 12e0 END AS crossfade
        FROM tracks"""), "track_id", "mix_out mix_in crossfade"),
    "p11_track_mix_points": sql(with_ctes(C, ["plan_feat", "track_sections"], f"""
        SELECT *, CASE WHEN n_secs > 0 THEN round_even(mix_in / bar, 0) ELSE 0 END AS mix_in_bars,
          CASE WHEN n_secs > 0 THEN round_even(mix_out / bar, 0) ELSE 0 END AS mix_out_bars FROM ({_POINTS})"""),
        "track_id mix_in_bars mix_out_bars", "mix_in mix_out"),
    "p14_aligned_points": sql(with_ctes(C, ["plan_feat"], f"""
        SELECT track_id, CASE WHEN ok THEN {_A_IN} ELSE mix_in_point END AS aligned_in, CASE WHEN ok THEN {_A_OUT} ELSE mix_out_point END AS aligned_out
        FROM (SELECT *, 60e0 / bpm * 4e0 AS bar, mix_in_point >= 0 AND mix_in_point < mix_out_point AND mix_out_point <= duration AS ok FROM plan_feat)"""),
        "track_id", "aligned_in aligned_out"),
    "p15_cue_points": sql(with_ctes(C, ["plan_feat"], f"""
        SELECT track_id, CASE WHEN ok THEN {_C_IN} ELSE mix_in_point END AS cue_mix_in, CASE WHEN ok THEN {_C_OUT} ELSE mix_out_point END AS cue_mix_out
        FROM (SELECT *, want_in >= 0 AND want_in < want_out AND want_out <= duration AS ok FROM ({_CUES}))"""),
        "track_id", "cue_mix_in cue_mix_out"),
    "f21_resolved_mix_points": sql(with_ctes(C, ["tracks"], f"""
        SELECT track_id, {_resolve('', '16e0')[0]} AS mix_in, {_resolve('', '16e0')[1]} AS mix_out FROM tracks"""),
        "track_id", "mix_in mix_out"),
    "f18_f19_f20_section_edges": sql(with_ctes(C, ["plan_feat", "track_sections"], f"""
        SELECT track_id, anchor, intro_end, outro_start, {_label('f', 'mix_out_point', 'out')} AS label_out, {_label('f', 'mix_in_point', 'in')} AS label_in,
          (SELECT first(s.avg_bass ORDER BY section_idx) FROM track_sections s WHERE s.track_id = f.track_id
            AND s.start_time <= f.mix_out_point AND f.mix_out_point <= s.end_time) AS bass_out FROM plan_feat f"""),
        "track_id", "anchor intro_end outro_start bass_out", "label_out label_in"),
    "a3_timeline": sql(with_ctes(C, ["timeline"], "SELECT * FROM timeline"), **_TIME),
    "a3_timeline_unplanned": sql(with_ctes(C, ["timeline_plain"], "SELECT * FROM timeline_plain"), **_TIME),
    "a6_timing_summary": sql(with_ctes(C, ["timeline"], f"""
        SELECT *, {_mmss('m * 60e0')} AS total_time, '60:00' AS target_time, {_mmss('overflow_seconds')} AS overflow, {_mmss('peak_start')} AS peak_time
        FROM (SELECT *, round_even(total / 60e0, 2) AS m, CAST(format('{{:.2f}}', total / 60e0 - 60e0) AS DOUBLE) * 60e0 AS overflow_seconds
         FROM (SELECT playlist_id, count(*) AS track_count, arg_max(end_time, pos) AS total, max(CASE WHEN is_peak THEN title END) AS peak_track,
            max(CASE WHEN is_peak THEN start_time END) AS peak_start, round_even(avg(playing_duration), 1) AS avg_track_duration,
            {', '.join(f"count(CASE WHEN energy_phase = '{p}' THEN 1 END) AS n_{p}" for p in timing.PHASES)} FROM timeline GROUP BY 1))"""),
        "playlist_id track_count " + " ".join(f"n_{p}" for p in timing.PHASES), "overflow_seconds avg_track_duration",
        "total_time target_time overflow peak_track peak_time"),
}
