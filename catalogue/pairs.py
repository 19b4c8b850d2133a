"""Queries on pair joins and pair scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from segue import refdata as R
from segue.operators import pairs, scoring

TOL = 3.0
CANONICAL = ", ".join(f"'{g.lower()}'" for g in R.CANONICAL_GENRES)


def resolved(detected: str = "detected_genre", tag: str = "genre") -> str:
    return (f"CASE WHEN {detected} NOT IN ('', 'Unknown') THEN {detected} "
            f"WHEN {tag} NOT IN ('', 'Unknown') THEN {tag} ELSE 'Unknown' END")


def eff_diff(a: str, b: str) -> str:
    return f"least(abs({a} - {b}), abs({a} - {b} * 2e0), abs({a} - {b} / 2e0))"


def relation(a: str, b: str) -> str:
    return (f"CASE WHEN abs({a} - {b}) <= abs({a} - {b} * 2e0) AND abs({a} - {b}) <= abs({a} - {b} / 2e0) THEN 'direct' "
            f"WHEN abs({a} - {b} * 2e0) <= abs({a} - {b} / 2e0) THEN 'half' ELSE 'double' END")


def harmonic(diff: str = "bpm_diff", rel_: str = "bpm_relation", tol: str = f"{TOL}e0", strictness: int = 7,
             experimental: bool = True) -> str:
    pen = f"(CASE WHEN {rel_} = 'direct' THEN 1e0 ELSE 0.85e0 END)"
    loose = max(0.4, min(1.0, 1.0 - (strictness - 7) * 0.08))
    up = "((b_num - a_num + 12) % 12)"
    extra = (f"WHEN a_letter = b_letter AND {up} = 4 THEN trunc(70e0 * {pen} * {loose}e0) "
             f"WHEN a_letter = b_letter AND {up} = 7 THEN trunc(65e0 * {pen} * {loose}e0) ") if experimental else ""
    return f"""CASE WHEN {diff} > {tol} THEN 0
      WHEN a_num = 0 OR b_num = 0 THEN trunc(10e0 * {pen})
      WHEN {up} = 0 AND a_letter = b_letter THEN trunc(100e0 * {pen})
      WHEN {up} = 0 AND a_letter = 'A' THEN trunc(90e0 * {pen})
      WHEN {up} = 0 THEN trunc(85e0 * {pen})
      WHEN a_letter = b_letter AND {up} IN (1, 11) THEN trunc(80e0 * {pen})
      WHEN a_letter = b_letter AND {up} = 2 THEN trunc(75e0 * {pen} * {loose}e0)
      {extra}
      WHEN a_letter <> b_letter AND {up} IN (1, 11) THEN trunc(60e0 * {pen} * {loose}e0)
      ELSE greatest(5, trunc({15 - strictness}e0 * {pen})) END"""


SEAM = """(SELECT first(CASE WHEN s.sub_energy IS NOT NULL AND s.bass_punch IS NOT NULL THEN s.{c} END ORDER BY section_idx)
    FROM track_sections s WHERE s.track_id = t.track_id AND t.{p} >= 0 AND s.start_time <= t.{p}
     AND (t.{p} < s.end_time OR (s.section_idx = s.n_sections - 1 AND t.{p} = s.end_time)))"""

rel.CTES["feat"] = f"""
SELECT t.*, {resolved()} AS rgenre,
       coalesce(CAST(regexp_extract(w.code, '^[0-9]+') AS INTEGER), 0) AS num, coalesce(right(w.code, 1), '') AS letter,
       coalesce({SEAM.format(c='sub_energy', p='mix_out_point')}, t.sub_energy) AS out_sub,
       coalesce({SEAM.format(c='bass_punch', p='mix_out_point')}, t.bass_punch) AS out_punch,
       coalesce({SEAM.format(c='sub_energy', p='mix_in_point')}, t.sub_energy) AS in_sub,
       coalesce({SEAM.format(c='bass_punch', p='mix_in_point')}, t.bass_punch) AS in_punch
FROM tracks t LEFT JOIN wheel w ON w.note = t.key_note AND w.mode = t.key_mode"""

_FEATS = ("track_id input_pos bpm num letter key_mode energy rgenre brightness flatness sub_energy out_sub out_punch in_sub "
          "in_punch vocal_instrumental groove_pattern bass_pattern timbre ai_current ai_mood_1 ai_mood_2 "
          "ai_sub_genre").split()

rel.CTES["all_pairs"] = f"""
SELECT a.playlist_id, {', '.join(f'a.{c} AS a_{c}, b.{c} AS b_{c}' for c in _FEATS)},
       {eff_diff('a.bpm', 'b.bpm')} AS bpm_diff, {relation('a.bpm', 'b.bpm')} AS bpm_relation
FROM feat a JOIN feat b ON a.playlist_id = b.playlist_id AND a.input_pos <> b.input_pos"""


def cos(c: str) -> str:
    return (f"CASE WHEN len(a_{c}) > 0 AND len(b_{c}) > 0 THEN greatest(0e0, least(1e0, list_inner_product(a_{c}, b_{c}) "
            f"/ (sqrt(list_inner_product(a_{c}, a_{c})) * sqrt(list_inner_product(b_{c}, b_{c}))))) END")


def factors(tol: float = TOL) -> str:
    """Select list of the eight factors over rows shaped like ``all_pairs``."""
    return f"""
  {harmonic(tol=f'{tol}e0')} AS harmonic,
  CASE WHEN bpm_diff > {tol} THEN 0e0 ELSE exp(-bpm_diff / {tol / 2}e0) END AS bpm_smoothness,
  greatest(0e0, 1e0 - abs(b_energy - a_energy) / 100e0) AS energy_flow,
  coalesce((SELECT affinity FROM affinity WHERE g_lo = least(lower(a_rgenre), lower(b_rgenre))
            AND g_hi = greatest(lower(a_rgenre), lower(b_rgenre))), 0.5e0) AS genre_compatibility,
  {cos('groove_pattern')} AS groove_cos, {cos('bass_pattern')} AS bass_cos, {cos('timbre')} AS timbre_match,
  CASE WHEN a_sub_energy > 0 AND b_sub_energy > 0 THEN
     0.6e0 * greatest(0e0, 1e0 - abs(a_out_sub - b_in_sub) / 0.5e0)
     + 0.4e0 * greatest(0e0, 1e0 - abs(a_out_punch - b_in_punch) / 1.4e0) END AS bass_continuity,
  CASE WHEN a_brightness > 0 AND b_brightness > 0 THEN
     0.7e0 * greatest(0e0, 1e0 - abs(a_brightness - b_brightness) / 60e0)
     + 0.3e0 * greatest(0e0, 1e0 - abs(a_flatness - b_flatness) / 0.15e0) END AS mood_raw,
  a_key_mode <> '' AND b_key_mode <> '' AND a_key_mode <> b_key_mode AS mode_switch,
  CASE WHEN a_ai_current AND b_ai_current THEN least(0.14e0,
     0.08e0 * len(list_intersect(list_distinct([lower(trim(a_ai_mood_1)), lower(trim(a_ai_mood_2))]),
                                 list_distinct([lower(trim(b_ai_mood_1)), lower(trim(b_ai_mood_2))])))
       / greatest(len(list_distinct([lower(trim(a_ai_mood_1)), lower(trim(a_ai_mood_2))])),
                  len(list_distinct([lower(trim(b_ai_mood_1)), lower(trim(b_ai_mood_2))])))
     + CASE WHEN lower(a_ai_sub_genre) = lower(b_ai_sub_genre) THEN 0.06e0
            WHEN contains(lower(a_ai_sub_genre), lower(b_ai_sub_genre))
              OR contains(lower(b_ai_sub_genre), lower(a_ai_sub_genre)) THEN 0.03e0 ELSE 0e0 END) ELSE 0e0 END AS ai_bonus,
  CASE WHEN lower(a_rgenre) IN ({CANONICAL}) AND lower(b_rgenre) IN ({CANONICAL}) THEN 0.12e0 ELSE 0.06e0 END AS genre_w"""


def scored(source: str, tol: float = TOL) -> str:
    """Scored rows over any relation shaped like ``all_pairs``."""
    return f"""
SELECT *, CAST(round_even(overall_score * 100e0, 0) AS INTEGER) AS objective FROM (
 SELECT * EXCLUDE (base), CASE WHEN bpm_diff > {tol} THEN 0e0
     WHEN a_vocal_instrumental = 'vocal' AND b_vocal_instrumental = 'vocal'
     THEN greatest(0e0, least(1e0, base + ai_bonus) - 0.06e0) ELSE least(1e0, base + ai_bonus) END AS overall_score FROM (
  SELECT *, (0.16e0 * (harmonic / 100e0) + 0.12e0 * bpm_smoothness + 0.12e0 * energy_flow + genre_w * genre_compatibility
      + coalesce(0.3e0 * groove_match, 0e0) + coalesce(0.08e0 * bass_continuity, 0e0)
      + coalesce(0.05e0 * timbre_match, 0e0) + coalesce(0.05e0 * mood_match, 0e0))
     / (0.16e0 + 0.12e0 + 0.12e0 + genre_w + CASE WHEN groove_match IS NULL THEN 0e0 ELSE 0.3e0 END
      + CASE WHEN bass_continuity IS NULL THEN 0e0 ELSE 0.08e0 END
      + CASE WHEN timbre_match IS NULL THEN 0e0 ELSE 0.05e0 END
      + CASE WHEN mood_match IS NULL THEN 0e0 ELSE 0.05e0 END) AS base FROM (
   SELECT *, CASE WHEN groove_raw IS NOT NULL THEN greatest(0e0, least(1e0, (groove_raw - 0.65e0) / (1e0 - 0.65e0))) END AS groove_match,
     CASE WHEN mode_switch AND mood_raw IS NOT NULL THEN greatest(0e0, mood_raw - 0.15e0) ELSE mood_raw END AS mood_match FROM (
    SELECT *, coalesce(0.6e0 * bass_cos + 0.4e0 * groove_cos, groove_cos, bass_cos) AS groove_raw
    FROM (SELECT *, {factors(tol)} FROM {source})))))"""


rel.CTES["scored"] = scored("(SELECT * FROM all_pairs WHERE bpm_diff <= 3e0)")

SCORE_SQL = dict(ints="playlist_id a_input_pos b_input_pos a_track_id b_track_id harmonic objective",
                 floats="bpm_diff bpm_smoothness energy_flow genre_compatibility groove_match bass_continuity "
                        "timbre_match mood_match ai_bonus overall_score", texts="bpm_relation")


def candidate_pairs(spark, sf):
    slim = rel.tracks(spark, sf).select("playlist_id", "input_pos", "track_id", "bpm")
    return canon(pairs.candidate_pairs(slim, TOL).select(
        "playlist_id", "a_track_id", "b_track_id", "bpm_diff", "bpm_relation"))


def scored_pairs(spark, sf):
    return canon(scoring.scored_playlist_pairs(rel.tracks(spark, sf), TOL).select(*scoring.PAIR_SCORES))


def top_partners(spark, sf):
    scored_df = scoring.scored_playlist_pairs(rel.tracks(spark, sf), TOL)
    return canon(pairs.top_partners(scored_df, 5).select(
        "playlist_id", "a_track_id", "b_track_id", "objective", "partner_rank"))


def harmonic_partners(spark, sf):
    feats = pairs.pair_features(rel.tracks(spark, sf))
    from segue.functions import keys
    scored_df = pairs.candidate_pairs(feats, TOL).withColumn("harmonic", keys.harmonic_score(
        F.col("a_num"), F.col("a_letter"), F.col("b_num"), F.col("b_letter"), F.col("bpm_diff"),
        F.col("bpm_relation"), TOL, 9, False))
    return canon(pairs.top_partners(scored_df, 5, "harmonic").select(
        "playlist_id", "a_track_id", "b_track_id", "harmonic", "partner_rank"))


def eligible(spark, sf):
    scored_df = scoring.scored_playlist_pairs(rel.tracks(spark, sf), TOL)
    kept = pairs.eligible_pairs(scored_df, min_overall=0.5, min_groove=0.02)
    return canon(kept.select("playlist_id", "a_track_id", "b_track_id", "overall_score", "groove_match"))


def genre_affinity(spark, sf):
    t = rel.tracks(spark, sf).select("playlist_id", "input_pos", "detected_genre", "genre")
    from pyspark.sql import Window
    nxt = t.withColumn("next_genre", F.lead("genre").over(Window.partitionBy("playlist_id").orderBy("input_pos")))
    out = pairs.with_genre_affinity(nxt.where(F.col("next_genre").isNotNull()), "detected_genre", "next_genre")
    return canon(out.groupBy("detected_genre", "next_genre").agg(
        F.count("*").alias("n"), F.first("genre_compatibility").alias("genre_compatibility")))


def _override(spark, sf):
    """A learned override: per detected genre, weights from the tracks' own levels."""
    return rel.tracks(spark, sf).groupBy(F.col("detected_genre").alias("genre")).agg(
        (F.avg("energy") / 1000.0).alias("groove_weight"), (F.avg("brightness") / 2000.0).alias("timbre_weight"))


def weights(spark, sf):
    return canon(pairs.resolve_weights(R.genre_weights(spark), _override(spark, sf)))


def weighted_scores(spark, sf):
    table = pairs.resolve_weights(R.genre_weights(spark), _override(spark, sf))
    df = scoring.scored_playlist_pairs(rel.tracks(spark, sf), TOL, weights=table)
    return canon(df.groupBy("playlist_id").agg(F.count("*").alias("n"), F.avg("overall_score").alias("avg_overall")))


def directed_scores(spark, sf):
    df = scoring.scored_playlist_pairs(rel.tracks(spark, sf), TOL, classic=True, direction="Build Up")
    return canon(df.select("playlist_id", "a_input_pos", "b_input_pos", "energy_flow", "overall_score"))


def mix_profiles(spark, sf):
    t = pairs.with_mix_profile(rel.tracks(spark, sf).select("track_id", "detected_genre"))
    return canon(t.select("track_id", F.col("profile.outro_min").alias("outro_min"),
                          F.col("profile.outro_max").alias("outro_max"), F.col("profile.trans_min").alias("trans_min"),
                          F.col("profile.trans_max").alias("trans_max"), F.col("profile.phrase_unit").alias("phrase_bars"),
                          F.col("profile.eq").alias("eq"), F.col("profile.technique").alias("technique")))


QUERIES = {
    "j1_candidate_pairs": candidate_pairs,
    "p8_scored_pairs": scored_pairs,
    "p8_weighted_scores": weighted_scores,
    "p3_directed_classic_scores": directed_scores,
    "q11_top_partners": top_partners,
    "p1_harmonic_partners": harmonic_partners,
    "j13_eligible_pairs": eligible,
    "j2_genre_affinity": genre_affinity,
    "j3_resolved_weights": weights,
    "j4_mix_profiles": mix_profiles,
}

_KEYS = ", ".join(R.WEIGHT_DEFAULTS)
rel.CTES["defaults"] = (f"SELECT * FROM ({rel._values(R.weight_rows())}) AS t(genre, {_KEYS})")
rel.CTES["resolved_weights"] = """
SELECT d.* REPLACE (coalesce(o.gw, d.groove_weight) AS groove_weight, coalesce(o.tw, d.timbre_weight) AS timbre_weight)
FROM defaults d LEFT JOIN (SELECT detected_genre AS g, avg(energy) / 1000e0 AS gw, avg(brightness) / 2000e0 AS tw
                           FROM tracks GROUP BY 1) o ON o.g = d.genre"""

SQL = {
    "j1_candidate_pairs": sql(with_ctes(rel.CTES, ["all_pairs"],
        "SELECT * FROM all_pairs WHERE bpm_diff <= 3e0"), "playlist_id a_track_id b_track_id", "bpm_diff", "bpm_relation"),
    "p8_scored_pairs": sql(with_ctes(rel.CTES, ["scored"], "SELECT * FROM scored"), **SCORE_SQL),
    "q11_top_partners": sql(with_ctes(rel.CTES, ["scored"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, a_input_pos ORDER BY objective DESC, b_input_pos)
          AS partner_rank FROM scored) WHERE partner_rank <= 5"""),
        "playlist_id a_track_id b_track_id objective partner_rank"),
    "p1_harmonic_partners": sql(with_ctes(rel.CTES, ["all_pairs"], f"""
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id, a_input_pos ORDER BY harmonic DESC, b_input_pos)
          AS partner_rank FROM (SELECT *, {harmonic(strictness=9, experimental=False)} AS harmonic
          FROM all_pairs WHERE bpm_diff <= 3e0)) WHERE partner_rank <= 5"""),
        "playlist_id a_track_id b_track_id harmonic partner_rank"),
    "j13_eligible_pairs": sql(with_ctes(rel.CTES, ["scored"], """
        SELECT * FROM scored WHERE bpm_diff <= 2e0 AND harmonic >= 60 AND overall_score >= 0.5e0 AND groove_match >= 0.02e0
          AND bass_continuity IS NOT NULL AND timbre_match IS NOT NULL AND mood_match IS NOT NULL"""),
        "playlist_id a_track_id b_track_id", "overall_score groove_match"),
    "j2_genre_affinity": sql(with_ctes(rel.CTES, ["tracks", "affinity"], """
        SELECT detected_genre, next_genre, count(*) AS n, coalesce(any_value(affinity), 0.5e0) AS genre_compatibility
        FROM (SELECT *, lead(genre) OVER (PARTITION BY playlist_id ORDER BY input_pos) AS next_genre FROM tracks)
        LEFT JOIN affinity ON g_lo = least(lower(detected_genre), lower(next_genre))
                          AND g_hi = greatest(lower(detected_genre), lower(next_genre))
        WHERE next_genre IS NOT NULL GROUP BY 1, 2"""), "n", "genre_compatibility", "detected_genre next_genre"),
    "j3_resolved_weights": sql(with_ctes(rel.CTES, ["resolved_weights"], "SELECT * FROM resolved_weights"),
                               floats=" ".join(R.WEIGHT_DEFAULTS), texts="genre"),
    "p8_weighted_scores": sql(with_ctes(rel.CTES, ["scored", "resolved_weights"], """
        SELECT playlist_id, count(*) AS n, avg(CASE
            WHEN a_vocal_instrumental = 'vocal' AND b_vocal_instrumental = 'vocal'
            THEN greatest(0e0, least(1e0, base + ai_bonus) - 0.06e0) ELSE least(1e0, base + ai_bonus) END) AS avg_overall
        FROM (SELECT s.*, (harmonic_weight * harmonic / 100e0 + bpm_weight * bpm_smoothness + energy_weight * energy_flow
            + genre_weight * genre_w / 0.12e0 * genre_compatibility + coalesce(groove_weight * groove_match, 0e0)
            + coalesce(bass_weight * bass_continuity, 0e0) + coalesce(timbre_weight * timbre_match, 0e0)
            + coalesce(mood_weight * mood_match, 0e0))
           / (harmonic_weight + bpm_weight + energy_weight + genre_weight * genre_w / 0.12e0
            + CASE WHEN groove_match IS NULL THEN 0e0 ELSE groove_weight END
            + CASE WHEN bass_continuity IS NULL THEN 0e0 ELSE bass_weight END
            + CASE WHEN timbre_match IS NULL THEN 0e0 ELSE timbre_weight END
            + CASE WHEN mood_match IS NULL THEN 0e0 ELSE mood_weight END) AS base
          FROM scored s JOIN resolved_weights w ON w.genre = CASE WHEN s.a_rgenre IN (SELECT genre FROM defaults)
               THEN s.a_rgenre ELSE 'Psytrance' END)
        GROUP BY 1"""), "playlist_id n", "avg_overall"),
    "p3_directed_classic_scores": sql(with_ctes(rel.CTES, ["scored"], """
        SELECT *, CASE WHEN a_vocal_instrumental = 'vocal' AND b_vocal_instrumental = 'vocal'
            THEN greatest(0e0, least(1e0, base + ai_bonus) - 0.06e0) ELSE least(1e0, base + ai_bonus) END AS overall_score
        FROM (SELECT * EXCLUDE (energy_flow, overall_score), up AS energy_flow,
            (1e0 - gs) * (0.44e0 * harmonic / 100e0 + 0.28e0 * bpm_smoothness + 0.28e0 * up) + gs * genre_compatibility AS base
          FROM (SELECT *, least(1e0, greatest(0, b_energy - a_energy) / 50e0) AS up,
                 CASE WHEN a_rgenre <> 'Unknown' AND b_rgenre <> 'Unknown' THEN 0.2e0 ELSE 0.1e0 END AS gs FROM scored))"""),
        "playlist_id a_input_pos b_input_pos", "energy_flow overall_score"),
    "j4_mix_profiles": sql(with_ctes(rel.CTES, ["tracks", "mix_profiles"], """
        SELECT track_id, coalesce(outro_min, 16e0) AS outro_min, coalesce(outro_max, 32e0) AS outro_max,
          coalesce(trans_min, 16e0) AS trans_min, coalesce(trans_max, 32e0) AS trans_max,
          coalesce(phrase_bars, 8e0) AS phrase_bars, coalesce(eq, 'Standard Bass Swap') AS eq,
          coalesce(technique, 'Standard Intro/Outro-Blend') AS technique
        FROM tracks LEFT JOIN mix_profiles ON genre_key = lower(detected_genre)"""),
        "track_id phrase_bars", "outro_min outro_max trans_min trans_max", "eq technique"),
}
