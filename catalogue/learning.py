"""Queries on evaluation, mined mixes, ratings and learned weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import frames as fr
from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from catalogue.pairs import resolved
from segue import lineage
from segue import refdata as R
from segue.functions import keys, text
from segue.operators import evaluate, mining, pairs, ratings

C = rel.CTES
FACTORS = evaluate.FACTORS


# ------------------------------------------------------------ derived relations
def truth(spark, sf):
    t = rel.tracks(spark, sf)
    k = F.col("track_id")
    s = rel.sections(spark, sf, t.select(k.alias("l_orderkey"))).where("start_time > 0").groupBy("track_id").agg(
        F.sort_array(F.collect_list("start_time")).alias("true_starts"))
    return t.join(s, "track_id", "left").select(
        "track_id", F.when(k % 3 == 0, "draft").otherwise("Adjudicated ").alias("label_status"),
        F.concat(F.lit("h"), k.cast("string")).alias("audio_sha256"), F.when(k % 10 != 0, F.col("bpm")).alias("truth_bpm"),
        F.col("key_note").alias("truth_key_note"), F.col("key_mode").alias("truth_key_mode"),
        text.resolved_genre(F.col("detected_genre"), F.col("genre")).alias("truth_genre"),
        F.when(F.col("mix_in_point") >= 0, F.col("mix_in_point")).alias("truth_mix_in"),
        F.when(F.col("mix_out_point") >= 0, F.col("mix_out_point")).alias("truth_mix_out"), "true_starts")


def predictions(spark, sf):
    t = rel.tracks(spark, sf)
    k = F.col("track_id")
    s = rel.sections(spark, sf, t.select(k.alias("l_orderkey"))).groupBy("track_id").agg(F.collect_list(
        F.col("start_time") + ((F.col("l_partkey") % 9) - 4) * 0.75).alias("pred_starts"))
    note = F.expr(rel.pick(list(R.NOTES), "((track_id * 7) % 12 + CASE track_id % 4 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END) % 12"))
    bpm = F.expr("CASE track_id % 5 WHEN 0 THEN bpm WHEN 1 THEN bpm * 2 WHEN 2 THEN bpm / 2 WHEN 3 THEN bpm + 0.4e0 ELSE bpm + 2 END")
    return t.where(k % 11 != 0).join(s, "track_id", "left").select(
        "track_id", F.concat(F.lit("H"), k.cast("string")).alias("audio_sha256"), bpm.alias("bpm"), note.alias("key_note"),
        F.when(k % 17 == 0, "").otherwise(F.when(k % 4 == 3, F.when(F.col("key_mode") == "Minor", "major").otherwise("minor"))
                                          .otherwise(F.col("key_mode"))).alias("key_mode"),
        F.when(k % 13 == 0, "Techno").otherwise(F.lower(text.resolved_genre(F.col("detected_genre"), F.col("genre")))).alias("genre"),
        (F.col("mix_in_point") + k % 5).alias("mix_in"), (F.col("mix_out_point") - k % 7).alias("mix_out"), "pred_starts")


def windows(spark, sf):
    """Stable windows of mined mixes from the vectors."""
    v = rel.vectors(spark, sf)
    k = F.col("vec_id")
    return v.select(F.floor(k / 50).alias("mix_id"), F.floor(k % 50 / 2).alias("transition_idx"), (k % 2).alias("side"), "groove_pattern",
                    F.when(k % 9 == 0, F.array().cast("array<double>")).otherwise(F.col("bass_pattern")).alias("bass_pattern"),
                    ((k * 7 % 50) / 50.0).alias("sub_energy"), (F.lit(1.0) + k * 3 % 20 / 10.0).alias("bass_punch"),
                    (k * 11 % 100).cast("double").alias("brightness"), "timbre")


def scores(spark, sf):
    """Labelled scores per mix: quality labels against embedding values."""
    v = rel.vectors(spark, sf).select(F.col("vec_id"), "raw")
    d = rel.read(spark, sf, "labels").withColumn("vec_id", rel.vector_number(spark, sf, "doc_id"))
    return d.join(v, "vec_id").select(
        (F.col("doc_id") % 20).alias("mix_id"), (F.col("quality") == 1).alias("positive"),
        F.explode(F.array(F.struct(F.lit("first").alias("factor"), F.floor(F.get("raw", F.lit(0)) * 100.0).alias("value")),
                          F.struct(F.lit("second").alias("factor"), F.get("raw", F.lit(7)).alias("value")))).alias("x")
    ).select("mix_id", "positive", "x.factor", F.col("x.value").cast("double").alias("value"))


def features(spark, sf):
    v = rel.vectors(spark, sf).select("vec_id", "raw")
    d = rel.read(spark, sf, "labels").withColumn("vec_id", rel.vector_number(spark, sf, "doc_id"))
    return d.join(v, "vec_id").select(
        F.col("doc_id").cast("string").alias("pair_id"), "doc_id",
        *[F.when((F.col("doc_id") % 41 == i) & (i < 3), F.lit(None)).otherwise((F.get("raw", F.lit(i)) + 1.0) / 2.0).alias(f) for i, f in enumerate(FACTORS)])


def sheet(spark, sf):
    note = F.expr("CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN 'x' WHEN doc_id % 37 = 0 THEN '7' "
                  "WHEN quality = 1 THEN CAST(4 + doc_id % 2 AS STRING) ELSE CAST(1 + doc_id % 3 AS STRING) END")
    return rel.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pair_id"), F.concat(F.lit("clip"), "doc_id").alias("clip"),
                                                note.alias("rating"))


def rated(spark, sf):
    return ratings.join_ratings(features(spark, sf), sheet(spark, sf))


# -------------------------------------------------------------------- queries
def evaluation(spark, sf):
    return canon(evaluate.evaluate(truth(spark, sf), predictions(spark, sf)))


def evaluation_long(spark, sf):
    return canon(evaluate.field_metrics(evaluate.evaluate(truth(spark, sf), predictions(spark, sf))))


def boundaries(spark, sf):
    rows = truth(spark, sf).select("track_id", "true_starts").join(predictions(spark, sf).select("track_id", "pred_starts"), "track_id")
    return canon(evaluate.match_boundaries(rows).select("track_id", "n_matched", "n_predicted", "n_true"))


def validation(spark, sf):
    t = rel.tracks(spark, sf)
    k = F.col("track_id")
    rows = t.select(F.col("artist").alias("folder"), "bpm", keys.key_to_camelot(F.col("key_note"), F.col("key_mode")).alias("camelot"),
                    "key_confidence", "first_downbeat", "lufs", F.when(k % 4 != 0, F.expr("bpm + (track_id % 3) * 0.5e0")).alias("label_bpm"),
                    F.when(k % 4 != 0, F.concat((k % 12 + 1).cast("string"), F.when(k % 2 == 0, "A").otherwise("B"))).alias("label_camelot"))
    return canon(evaluate.validation_report(rows))


def spread(spark, sf):
    return canon(evaluate.factor_spread(features(spark, sf)))


def deltas(spark, sf):
    return canon(mining.true_deltas(windows(spark, sf)))


def gapped(spark, sf):
    """All windows, with gaps in the numbers of their transitions, as cut-off transitions leave them."""
    return windows(spark, sf).withColumn("transition_idx", F.expr("transition_idx + transition_idx div 3"))


def negatives(spark, sf):
    return canon(mining.negative_deltas(gapped(spark, sf)))


def auc(spark, sf):
    return canon(mining.auc(scores(spark, sf), ["factor"]))


def auc_interval(spark, sf):
    return canon(mining.auc_interval(scores(spark, sf)))


def tolerances(spark, sf):
    return canon(mining.tolerances(mining.true_deltas(windows(spark, sf))))


def weights(spark, sf):
    return canon(mining.learn_weights(mining.auc(scores(spark, sf), ["factor"])).select("factor", "weight"))


def bounded(spark, sf):
    found = mining.auc(scores(spark, sf), ["factor"]).withColumn("lower", F.col("auc") - 0.01)
    return canon(mining.learn_weights_bounded(found).select("factor", "weight"))


def holdout(spark, sf):
    """Combined score of true pairs against pairs one window later."""
    w = windows(spark, sf)
    true = mining.true_deltas(w).withColumn("positive", F.lit(True))
    moved = w.withColumn("transition_idx", F.when(F.col("side") == 1, F.pmod(F.col("transition_idx") + 1, F.lit(25))).otherwise(F.col("transition_idx")))
    both = lineage.stored(true.unionByName(mining.true_deltas(moved).withColumn("positive", F.lit(False))))   # read by scales, bounds and ranks
    scored = mining.combined_score(both, {"groove_sim": 0.1, "sub_delta": 0.2, "timbre_sim": 0.0, "brightness_delta": 0.05}, mining.factor_scales(both))
    return canon(mining.holdout_passed(scored))


def report(spark, sf):
    return canon(mining.mining_report(mining.mix_deltas(gapped(spark, sf))).select("factor", "auc", "lower", "upper", "weight", "n_true", "n_random"))


def mined_weights(spark, sf):
    """From mined mixes to the weights that pair scores use, genre by genre."""
    report = mining.mining_report(mining.mix_deltas(gapped(spark, sf)))
    names = list(mining.SCORE_WEIGHTS)
    defaults = spark.createDataFrame([(g, *[float(R.WEIGHT_DEFAULTS[n]) for n in names]) for g in R.CANONICAL_GENRES],
                                     "genre string, " + ", ".join(f"{n} double" for n in names))
    return canon(pairs.resolve_weights(defaults, mining.genre_overrides(report, [R.CANONICAL_GENRES[1], "no such genre"])))


def mined_summary(spark, sf):
    return canon(mining.mining_summary(mining.mix_deltas(gapped(spark, sf)), "Techno", 0).drop("holdout_auc", "holdout"))


def transitions(spark, sf):
    f = fr.frame_rows(spark, sf).withColumnRenamed("track_id", "mix_id")
    return canon(mining.find_transitions(f, 1.0, 1.2))


def bounds(spark, sf):
    t = fr.frame_rows(spark, sf).select(F.col("track_id").alias("mix_id"), F.col("frame_idx").alias("transition_idx"), F.col("t_sec").alias("t"))
    lengths = fr.frame_tracks(spark, sf).select(F.col("track_id").alias("mix_id"), F.col("duration").alias("length"))
    return canon(mining.window_bounds(t, lengths))


def profile(spark, sf):
    return canon(mining.second_profile(fr.frame_rows(spark, sf).withColumnRenamed("track_id", "mix_id")))


def _blends(spark, sf):
    """One row per document: 121 seconds of mids and onsets from its id."""
    d = rel.read(spark, sf, "documents").select("doc_id")
    at = F.sequence(F.lit(0), F.lit(120))
    return d.select("doc_id", F.transform(at, lambda s: 1.0 + F.pmod(F.col("doc_id") * 7 + s * 13, F.lit(50)) / 50.0).alias("mids"),
                    F.transform(at, lambda s: F.when(F.abs(s - 60) <= F.col("doc_id") % 40, 2.0).otherwise(1.0)).alias("onset"))


def bands(spark, sf):
    return canon(_blends(spark, sf).select("doc_id", mining.band_at_centre(F.col("mids")).alias("centre"), mining.blend_width(F.col("onset")).alias("width")))


def blends(spark, sf):
    return canon(mining.blend_report(_blends(spark, sf)))


def blend_ranges(spark, sf):
    return canon(mining.dip_ranges(_blends(spark, sf), "doc_id"))


def rating_status(spark, sf):
    return canon(rated(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.avg("rating").alias("avg_rating")))


def merged(spark, sf):
    new = rel.read(spark, sf, "labels").where("doc_id % 3 = 0").select(
        F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("?"), "doc_id")).otherwise(F.col("doc_id").cast("string")).alias("pair_id"),
        F.when(F.col("doc_id") % 12 != 3, F.col("doc_id") % 5 + 1).cast("int").alias("rating"))
    s = sheet(spark, sf)
    kept = ratings.merge_ratings(s, new).select("pair_id", "rating", F.lit("known").alias("kind"))
    return canon(kept.unionByName(ratings.unknown_ratings(s, new).select("pair_id", F.col("rating").cast("string"), F.lit("unknown").alias("kind"))))


def review(spark, sf):
    t = rel.tracks(spark, sf).select("track_id", "file_path", "bpm", text.resolved_genre(F.col("detected_genre"), F.col("genre")).alias("genre"),
                                     keys.key_to_camelot(F.col("key_note"), F.col("key_mode")).alias("code"))
    f = rel.read(spark, sf, "labels").select("doc_id").join(t.select(F.col("track_id").alias("doc_id"), F.upper("file_path").alias("track_a")), "doc_id").select(
        F.col("doc_id").cast("string").alias("pair_id"), F.lit(20.0).alias("crossfade"), "track_a", F.lit("C:/none.mp3").alias("track_b"))
    return canon(ratings.review_list(sheet(spark, sf), f, t).drop("crossfade", "rating", "bpm_b", "genre_b", "key_b"))


def design(spark, sf):
    return canon(ratings.design(rated(spark, sf)))


def verdict(spark, sf):
    return canon(ratings.data_verdict(ratings.design(rated(spark, sf)), 8))


def logistic(spark, sf):
    return canon(ratings.fit_logistic(ratings.design(rated(spark, sf))))


def gradient(spark, sf):
    rows = ratings.design(rated(spark, sf))
    return canon(ratings.fit_gradient(rows, ratings.fit_logistic(rows)))


def intervals(spark, sf):
    return canon(ratings.bootstrap_ci(ratings.design(rated(spark, sf))))


def _made_up_intervals(spark, sf):
    """Bounds per factor from the spread of the factors, some reaching below 0."""
    s = evaluate.factor_spread(features(spark, sf))
    return s.select("factor", (F.col("median") - 0.499).alias("lower"), (F.col("median") + 0.2).alias("upper"))


def derived(spark, sf):
    return canon(ratings.derive_weights(_made_up_intervals(spark, sf)))


def filled(spark, sf):
    return canon(ratings.full_weights(ratings.derive_weights(_made_up_intervals(spark, sf))))


def fit_report(spark, sf):
    return canon(ratings.fit_report(rated(spark, sf)).select("factor", "coefficient", "n_good", "n_bad", "sufficient"))


def maximin(spark, sf):
    points = features(spark, sf).select(F.concat(F.lit("p"), F.lpad("pair_id", 6, "0")).alias("pair_id"), *FACTORS).dropna()
    return canon(ratings.maximin_sample(points, 12))


def strided(spark, sf):
    files = rel.tracks(spark, sf).select(F.col("artist").alias("folder"), F.col("file_path").alias("path"))
    return canon(ratings.strided_sample(files, 20))


def blind(spark, sf):
    return canon(ratings.blind_assignment(rel.read(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("pair_id"))).drop("session_id"))


QUERIES = {
    "a9_j11_evaluation": evaluation, "a9_field_metrics": evaluation_long, "j12_boundaries": boundaries, "a11_validation_report": validation,
    "a12_factor_spread": spread, "m1_mix_deltas": deltas, "m2_negative_pairs": negatives, "m3_auc": auc, "m4_auc_interval": auc_interval,
    "m5_tolerances": tolerances, "m6_weights": weights, "m6_bounded_weights": bounded, "m7_holdout": holdout, "m8_mining_report": report, "m8_mined_weights": mined_weights, "m8_summary": mined_summary,
    "g27_transitions": transitions, "g28_window_bounds": bounds, "g29_second_profile": profile, "g30_bands": bands, "w8_blend_report": blends,
    "w8_dip_ranges": blend_ranges,
    "j8_rating_status": rating_status, "j9_u3_merged_ratings": merged, "j10_review_list": review, "l1_design": design, "l4_verdict": verdict,
    "l2_logistic": logistic, "l2_gradient": gradient, "l3_intervals": intervals, "l5_derived_weights": derived, "l5_full_weights": filled, "l6_fit_report": fit_report,
    "q12_maximin": maximin, "q13_strided": strided, "q14_blind": blind,
}

# ------------------------------------------------------------------- SQL twins
_SHIFT = "((track_id * 7) % 12 + CASE track_id % 4 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 0 END) % 12"
C["truth"] = f"""SELECT track_id, CASE WHEN track_id % 10 <> 0 THEN bpm END AS truth_bpm, key_note, key_mode, {resolved()} AS g, nullif(mix_in_point, -1) AS tin, nullif(mix_out_point, -1) AS tout, bpm,
  track_id % 11 <> 0 AS found, CASE WHEN track_id % 11 <> 0 THEN CASE track_id % 5 WHEN 0 THEN bpm WHEN 1 THEN bpm * 2 WHEN 2 THEN bpm / 2 WHEN 3 THEN bpm + 0.4e0 ELSE bpm + 2 END END AS pbpm,
  {rel.pick(list(R.NOTES), _SHIFT)} AS pnote, CASE WHEN track_id % 17 = 0 THEN '' WHEN track_id % 4 = 3 THEN CASE WHEN key_mode = 'Minor' THEN 'Major' ELSE 'Minor' END ELSE key_mode END AS pmode,
  mix_in_point + track_id % 5 AS pin, mix_out_point - track_id % 7 AS pout FROM tracks"""
C["t_starts"] = "SELECT DISTINCT track_id, start_time AS t FROM sections WHERE start_time > 0 AND track_id IN (SELECT p_partkey FROM part)"
C["p_starts"] = "SELECT DISTINCT track_id, start_time + ((l_partkey % 9) - 4) * 0.75e0 AS p FROM sections WHERE start_time + ((l_partkey % 9) - 4) * 0.75e0 > 0 AND track_id % 11 <> 0 AND track_id IN (SELECT p_partkey FROM part)"
# truths in order, each takes the first free prediction in reach
C["t_order"] = "SELECT track_id, t, row_number() OVER (PARTITION BY track_id ORDER BY t) AS rn FROM t_starts"
C["matching"] = """
  SELECT DISTINCT track_id, 0 AS rn, -1e9 AS used, 0 AS n FROM t_order
  UNION ALL
  SELECT m.track_id, m.rn + 1, coalesce(x.p, m.used), m.n + (x.p IS NOT NULL)::INT FROM matching m JOIN t_order o ON o.track_id = m.track_id AND o.rn = m.rn + 1
   LEFT JOIN LATERAL (SELECT min(p) AS p FROM p_starts p WHERE p.track_id = m.track_id AND p.p > m.used AND p.p >= o.t - 2 AND p.p <= o.t + 2) x ON true"""
C["matched"] = """SELECT track_id, max(n) AS n_matched FROM matching GROUP BY 1"""
C["starts_count"] = """SELECT t.track_id, n_true, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_matched, 0) AS n_matched FROM (SELECT track_id, count(*) AS n_true FROM t_starts GROUP BY 1) t
  LEFT JOIN (SELECT track_id, count(*) AS n_predicted FROM p_starts GROUP BY 1) p ON p.track_id = t.track_id LEFT JOIN matched m ON m.track_id = t.track_id"""
_ST = "least(abs(cp - ct), 12 - abs(cp - ct))"
_KEYRES = f"""CASE WHEN found AND key_note <> '' AND pmode <> '' THEN CASE WHEN pcode = tcode THEN 'exact' WHEN {_ST} = 0 THEN 'relative'
   WHEN {_ST} = 1 AND right(pcode, 1) = right(tcode, 1) THEN 'fifth' ELSE 'wrong' END END"""
C["judged"] = f"""SELECT *, least(abs(pbpm - truth_bpm), abs(pbpm * 2 - truth_bpm), abs(pbpm / 2 - truth_bpm)) AS err, {_KEYRES} AS kr,
   CASE WHEN found THEN CASE WHEN track_id % 13 = 0 THEN lower(g) = 'techno' ELSE true END END AS gh, CASE WHEN found THEN abs(pin - tin) END AS ie, CASE WHEN found THEN abs(pout - tout) END AS oe
 FROM (SELECT t.*, w.code AS tcode, v.code AS pcode, CAST(regexp_extract(w.code, '^[0-9]+') AS INT) AS ct, CAST(regexp_extract(v.code, '^[0-9]+') AS INT) AS cp
   FROM truth t LEFT JOIN wheel w ON w.note = key_note AND w.mode = key_mode LEFT JOIN wheel v ON v.note = pnote AND v.mode = pmode WHERE track_id % 3 <> 0)"""
C["eval_row"] = f"""SELECT a.*, b.*, boundaries_matched / nullif(boundaries_predicted, 0) AS precision, boundaries_matched / nullif(boundaries_true, 0) AS recall FROM (
 SELECT count(*) AS adjudicated_tracks, sum(found::INT) AS matched_tracks, count(truth_bpm) AS bpm_truth, count(err) AS bpm_labeled, avg(err) AS bpm_mae, avg((err <= 0.5e0)::INT) AS bpm_within_0_5,
   sum((key_note <> '')::INT) AS key_truth, count(kr) AS key_labeled, {', '.join(f"count(CASE WHEN kr = '{k}' THEN 1 END) AS key_{k}" for k in evaluate.KEY_CLASSES)},
   count(*) AS genre_truth, count(gh) AS genre_labeled, avg(gh::INT) AS genre_accuracy, count(tin) AS mix_in_truth, count(ie) AS mix_in_labeled, avg(ie) AS mix_in_mae,
   count(tout) AS mix_out_truth, count(oe) AS mix_out_labeled, avg(oe) AS mix_out_mae FROM judged) a,
 (SELECT count(*) AS sections_truth, count(CASE WHEN track_id % 11 <> 0 THEN 1 END) AS sections_labeled, sum(n_matched) AS boundaries_matched, sum(n_predicted) AS boundaries_predicted, sum(n_true) AS boundaries_true
   FROM starts_count WHERE track_id % 3 <> 0) b"""
_COVER = ("bpm", "key", "genre", "mix_in", "mix_out", "sections")
_EVAL = f"""SELECT *, matched_tracks / adjudicated_tracks AS track_coverage, {', '.join(f'{n}_labeled / {n}_truth AS {n}_coverage' for n in _COVER)},
  2 * precision * recall / (precision + recall) AS f1 FROM eval_row"""
_VALUE = {"bpm": "bpm_mae", "genre": "genre_accuracy", "mix_in": "mix_in_mae", "mix_out": "mix_out_mae"}

C["windows"] = """SELECT vec_id // 50 AS mix_id, vec_id % 50 AS idx, vec_id % 2 AS side, groove_pattern AS gp, bass_pattern AS bp, vec_id % 9 <> 0 AS has_bp,
  (vec_id * 7 % 50) / 50e0 AS sub, 1e0 + vec_id * 3 % 20 / 10e0 AS punch, vec_id * 11 % 100 * 1e0 AS bright, timbre FROM vectors"""


def _cyc(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"list_cosine_similarity({a}, {x})" for x in (
        b, f"list_concat({b}[13:16], {b}[1:12])", f"list_concat({b}[9:16], {b}[1:8])", f"list_concat({b}[5:16], {b}[1:4])")) + ")"


def _delta(join: str) -> str:
    return f"""SELECT x.mix_id, x.idx AS i, y.idx AS j, CASE WHEN x.has_bp AND y.has_bp THEN {_cyc('x.bp', 'y.bp')} ELSE {_cyc('x.gp', 'y.gp')} END AS groove_sim,
  abs(x.sub - y.sub) AS sub_delta, abs(x.punch - y.punch) AS punch_delta, abs(x.bright - y.bright) AS brightness_delta, list_cosine_similarity(x.timbre, y.timbre) AS timbre_sim
 FROM windows x JOIN windows y ON y.mix_id = x.mix_id AND x.side = 0 AND y.side = 1 AND {join}"""


def _number(*parts: str) -> str:
    return f"('0x' || substr(md5({" || '/' || ".join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 15))::BIGINT"


C["gapped"] = "SELECT * REPLACE ((idx // 2 + idx // 2 // 3) * 2 + idx % 2 AS idx), row_number() OVER (PARTITION BY mix_id ORDER BY idx) - 1 AS place FROM windows"
C["neg_mixes"] = f"""SELECT mix_id, count(*) AS n, greatest(30, count(*) FILTER (WHERE side = 0)) AS wanted, count(*) * (count(*) - 1) // 2 AS total,
  count(*) - count(DISTINCT idx // 2) AS same, {_number("'42'", 'mix_id')} AS start FROM gapped GROUP BY 1 HAVING count(*) >= 2"""
C["neg_steps"] = """SELECT mix_id, wanted, step, (start % total + step * 2147483647 % total) % total AS number
  FROM (SELECT *, unnest(range(least(wanted + same, total))) AS step FROM neg_mixes)"""
C["neg_places"] = "SELECT *, number - b * (b - 1) // 2 AS a FROM (SELECT *, CAST(floor((1e0 + sqrt(1e0 + 8e0 * number)) / 2e0) AS BIGINT) AS b FROM neg_steps)"
C["negatives"] = f"""SELECT x.mix_id, x.idx AS i, y.idx AS j, CASE WHEN x.has_bp AND y.has_bp THEN {_cyc('x.bp', 'y.bp')} ELSE {_cyc('x.gp', 'y.gp')} END AS groove_sim,
  abs(x.sub - y.sub) AS sub_delta, abs(x.punch - y.punch) AS punch_delta, abs(x.bright - y.bright) AS brightness_delta, list_cosine_similarity(x.timbre, y.timbre) AS timbre_sim
 FROM neg_places p JOIN gapped x ON x.mix_id = p.mix_id AND x.place = p.a JOIN gapped y ON y.mix_id = p.mix_id AND y.place = p.b WHERE x.idx // 2 <> y.idx // 2
 QUALIFY row_number() OVER (PARTITION BY p.mix_id ORDER BY step) <= wanted"""


def _intervals(source: str, prefix: str) -> None:
    """Relations for the interval of every factor of a source, drawn by clusters."""
    C[f"{prefix}_clusters"] = f"SELECT mix_id, row_number() OVER (ORDER BY {_number('mix_id')}, mix_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT mix_id FROM {source} )"
    C[f"{prefix}_picks"] = f"""SELECT id // (2 * n) AS draw, id % 2 AS side, {_number("'42'", 'id')} % n AS k FROM (SELECT n, unnest(range(2000 * n * 2)) AS id FROM (SELECT count(*) AS n FROM {prefix}_clusters ))"""
    C[f"{prefix}_times"] = f"SELECT draw, side, mix_id, count(*) AS times FROM {prefix}_picks JOIN {prefix}_clusters USING (k) GROUP BY 1, 2, 3"
    C[f"{prefix}_drawn"] = f"""SELECT factor, draw, value, sum(CASE WHEN positive THEN times ELSE 0 END) AS p, sum(CASE WHEN positive THEN 0 ELSE times END) AS q
  FROM {source} s JOIN {prefix}_times d ON d.mix_id = s.mix_id AND side = CASE WHEN positive THEN 0 ELSE 1 END GROUP BY 1, 2, 3"""
    C[f"{prefix}_bounds"] = f"""SELECT factor, quantile_cont(a, 0.025) AS lower, quantile_cont(a, 0.975) AS upper FROM (
  SELECT factor, draw, sum(p * (below + q / 2e0)) / (sum(p) * sum(q)) AS a FROM (
    SELECT *, sum(q) OVER (PARTITION BY factor, draw ORDER BY value) - q AS below FROM {prefix}_drawn ) GROUP BY 1, 2 HAVING sum(p) > 0 AND sum(q) > 0) GROUP BY 1"""


_intervals("scores", "auc")
C["deltas"] = _delta("y.idx = x.idx + 1")
C["gapped_deltas"] = _delta("y.idx = x.idx + 1").replace("FROM windows x JOIN windows y", "FROM gapped x JOIN gapped y")
C["moved"] = _delta("(y.idx + 2) % 50 = x.idx + 1")
C["scores"] = """SELECT doc_id % 20 AS mix_id, quality = 1 AS positive, unnest(['first', 'second']) AS factor, unnest([floor(raw[1] * 100e0), raw[8]]) AS value FROM labels JOIN vectors ON vec_id = doc_id % """ + rel.VECTORS


def _auc(source: str, value: str = "value", key: str = "factor") -> str:
    return f"""SELECT {key}, sum(positive::INT) AS n_pos, sum((NOT positive)::INT) AS n_neg, (sum(CASE WHEN positive THEN r END) - sum(positive::INT) * (sum(positive::INT) + 1) / 2e0)
   / (sum(positive::INT) * sum((NOT positive)::INT)) AS auc FROM (
  SELECT *, rank() OVER (PARTITION BY {key} ORDER BY {value}) + (count(*) OVER (PARTITION BY {key}, {value}) - 1) / 2e0 AS r FROM {source}) GROUP BY 1"""


C["aucs"] = _auc("scores")
C["mined"] = "SELECT mix_id, positive, unnest([" + ", ".join(f"'{f}'" for f in mining.DIRECTIONS) + "]) AS factor, unnest([" + ", ".join(
    f if up else f"-{f}" for f, up in mining.DIRECTIONS.items()) + "]) AS value FROM (SELECT *, true AS positive FROM gapped_deltas UNION ALL SELECT *, false FROM negatives )"
_intervals("mined", "mined")
C["mined_aucs"] = _auc("mined")
C["mined_report"] = """SELECT factor, auc, lower, upper, n_pos AS n_true, n_neg AS n_random, CASE WHEN sum(raw) OVER () > 0 THEN least(1e0, max(raw) OVER ()) * 0.3e0 * raw / sum(raw) OVER () ELSE 0e0 END AS weight
  FROM (SELECT *, greatest(0e0, lower - 0.5e0) * 2 AS raw FROM mined_aucs JOIN mined_bounds USING (factor))"""
C["learned"] = "SELECT * FROM mined WHERE mix_id <> 0"
_intervals("learned", "learned")
C["learned_aucs"] = _auc("learned")
C["learned_report"] = C["mined_report"].replace("mined_", "learned_")
_SUMMED = ", ".join(f"sum(CASE WHEN factor IN ({', '.join(repr(f) for f in fs)}) THEN weight ELSE 0 END) AS {n}" for n, fs in mining.SCORE_WEIGHTS.items())
C["features"] = f"""SELECT doc_id, quality, {', '.join(f'CASE WHEN doc_id % 41 = {i} AND {i} < 3 THEN NULL ELSE (raw[{i + 1}] + 1e0) / 2e0 END AS {f}' for i, f in enumerate(FACTORS))}
  FROM labels JOIN vectors ON vec_id = doc_id % """ + rel.VECTORS
C["rated"] = """SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'missing' WHEN doc_id % 31 = 0 OR doc_id % 37 = 0 OR doc_id % 41 < 3 THEN 'invalid' ELSE 'ok' END AS status,
  CASE WHEN quality = 1 THEN 4 + doc_id % 2 ELSE 1 + doc_id % 3 END AS note FROM features"""
C["spread"] = "SELECT factor, min(v) AS low, max(v) AS high, stddev_pop(v) AS spread, median(v) AS median FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {f} AS v FROM features" for f in FACTORS) + ") GROUP BY 1"
C["new_weights"] = """SELECT factor, CASE WHEN sum(raw) OVER () > 0 THEN 0.3e0 * least(1e0, max(raw) OVER ()) * raw / sum(raw) OVER () ELSE 0e0 END AS weight FROM (
  SELECT factor, CASE WHEN median - 0.499e0 > 0 THEN median - 0.499e0 ELSE 0e0 END AS raw FROM spread WHERE factor IN ('groove', 'bass', 'timbre', 'mood'))"""
_MIDS = "[1e0 + (doc_id * 7 + s * 13) % 50 / 50e0 FOR s IN range(121)]"
C["blends"] = f"SELECT doc_id, {_MIDS} AS mids, doc_id % 40 AS half FROM documents"
_AROUND = "(list_median(list_concat(mids[16:40], mids[81:105])) + 0.000000001e0)".replace("list_median(", "list_aggregate(").replace("mids[81:105])", "mids[81:105]), 'median'")
C["blend_rows"] = f"""SELECT *, CASE WHEN w <= 8 THEN 'kurz' WHEN w <= 25 THEN 'mittel' ELSE 'lang' END AS grp FROM (SELECT *, {_AROUND} AS around, 2e0 * half + 1 AS w FROM blends)"""
C["diffs"] = """SELECT track_id, frame_idx, t_sec, sqrt(sum(((nx - x) / (sd + 0.000000001e0)) ** 2)) AS d FROM (
  SELECT track_id, frame_idx, t_sec, i, x, lead(x) OVER (PARTITION BY track_id, i ORDER BY frame_idx) AS nx, stddev_pop(x) OVER (PARTITION BY track_id, i) AS sd FROM (
   SELECT track_id, frame_idx, t_sec, unnest(range(13)) AS i, unnest(mfcc) AS x FROM frames WHERE track_id IN (SELECT track_id FROM frames GROUP BY 1 HAVING max(t_sec) >= 120))) WHERE nx IS NOT NULL GROUP BY 1, 2, 3"""
C["breaks"] = """SELECT * FROM (SELECT *, (nov - avg(nov) OVER w) / stddev_pop(nov) OVER w AS z FROM (
   SELECT *, sum(d) OVER (PARTITION BY track_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5e0 AS nov FROM diffs) WINDOW w AS (PARTITION BY track_id)) WHERE z >= 1.2e0"""
C["taken"] = """
  SELECT DISTINCT track_id, 0 AS step, CAST([] AS DOUBLE[]) AS ts FROM breaks
  UNION ALL
  SELECT track_id, step + 1, list_append(ts, best.t) FROM (SELECT x.track_id, x.step, x.ts, max({'z': b.z, 't': b.t_sec}) AS best FROM taken x JOIN breaks b ON b.track_id = x.track_id
    WHERE len(list_filter(x.ts, lambda g: abs(g - b.t_sec) < 60)) = 0 GROUP BY 1, 2, 3)"""

C["points"] = f"SELECT 'p' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS k, [{', '.join(FACTORS)}] AS x FROM features WHERE {' AND '.join(f'{f} IS NOT NULL' for f in FACTORS)}"
C["maximin"] = f"""
  SELECT k, x, 0 AS round, [k] AS taken, [x] AS spots FROM (SELECT * FROM points ORDER BY {_number("'42'", 'k')}, k LIMIT 1)
  UNION ALL
  SELECT best.k, best.x, round + 1, list_append(taken, best.k), list_append(spots, best.x) FROM (
    SELECT m.round, m.taken, m.spots, min({{'d': -list_min(list_transform(m.spots, lambda s: list_distance(s, p.x))), 'k': p.k, 'x': p.x}}) AS best
    FROM maximin m, points p WHERE m.round < 11 AND NOT list_contains(m.taken, p.k) GROUP BY 1, 2, 3)"""

_EVAL_INTS = ("adjudicated_tracks matched_tracks bpm_truth bpm_labeled key_truth key_labeled key_exact key_relative key_fifth key_wrong key_invalid genre_truth genre_labeled "
              "mix_in_truth mix_in_labeled mix_out_truth mix_out_labeled sections_truth sections_labeled boundaries_matched boundaries_predicted boundaries_true")
_EVAL_FLOATS = "bpm_mae bpm_within_0_5 genre_accuracy mix_in_mae mix_out_mae track_coverage precision recall f1 " + " ".join(f"{n}_coverage" for n in _COVER)
_R = ("WITH ", "WITH RECURSIVE ", 1)
_CLASSIC = {f: R.WEIGHT_DEFAULTS[f"{f}_weight"] for f in evaluate.CLASSIC_FACTORS}
SQL = {
    "a9_j11_evaluation": sql(with_ctes(C, ["eval_row"], _EVAL).replace(*_R), _EVAL_INTS, _EVAL_FLOATS),
    "a9_field_metrics": sql(with_ctes(C, ["eval_row"], " UNION ALL ".join(
        f"SELECT '{n}' AS field, {n}_truth AS truth, {n}_labeled AS labeled, {n}_labeled / {n}_truth AS coverage, {_VALUE.get(n, 'CAST(NULL AS DOUBLE)')} AS value FROM eval_row" for n in _COVER)).replace(*_R),
        "truth labeled", "coverage value", "field"),
    "j12_boundaries": sql(with_ctes(C, ["matched", "t_starts", "p_starts", "tracks"], """
        SELECT t.track_id, coalesce(n_matched, 0) AS n_matched, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_true, 0) AS n_true FROM tracks t
          LEFT JOIN matched m ON m.track_id = t.track_id LEFT JOIN (SELECT track_id, count(*) AS n_predicted FROM p_starts GROUP BY 1) p ON p.track_id = t.track_id
          LEFT JOIN (SELECT track_id, count(*) AS n_true FROM t_starts GROUP BY 1) s ON s.track_id = t.track_id WHERE t.track_id % 11 <> 0""").replace(*_R), "track_id n_matched n_predicted n_true"),
    "a11_validation_report": sql(with_ctes(C, ["tracks", "wheel"], f"""
        SELECT coalesce(artist, '(all)') AS folder, count(*) AS analyzed, sum(l::INT) AS labelled, sum((l AND e <= 0.5e0)::INT) AS bpm_correct,
          {', '.join(f"count(CASE WHEN kr = '{k}' THEN 1 END) AS key_{k}" for k in evaluate.KEY_CLASSES)}, avg(key_confidence) AS avg_key_confidence,
          sum((first_downbeat > 0)::INT) AS downbeat_detected, avg(CASE WHEN lufs < 0 THEN lufs END) AS avg_lufs FROM (
          SELECT *, CASE WHEN l THEN CASE WHEN code IS NULL THEN 'invalid' WHEN d = 0 AND right(code, 1) = ll THEN 'exact' WHEN d = 0 THEN 'relative' WHEN d = 1 AND right(code, 1) = ll THEN 'fifth' ELSE 'wrong' END END AS kr FROM (
           SELECT *, track_id % 4 <> 0 AS l, (track_id % 3) * 0.5e0 AS e, CASE WHEN track_id % 2 = 0 THEN 'A' ELSE 'B' END AS ll,
             least(abs(CAST(regexp_extract(code, '^[0-9]+') AS INT) - (track_id % 12 + 1)), 12 - abs(CAST(regexp_extract(code, '^[0-9]+') AS INT) - (track_id % 12 + 1))) AS d
           FROM tracks LEFT JOIN wheel ON note = key_note AND mode = key_mode)) GROUP BY ROLLUP (artist)"""),
        "analyzed labelled bpm_correct downbeat_detected " + " ".join(f"key_{k}" for k in evaluate.KEY_CLASSES), "avg_key_confidence avg_lufs", "folder"),
    "a12_factor_spread": sql(with_ctes(C, ["spread"], "SELECT *, factor IN ('groove', 'bass', 'timbre', 'mood') OR spread >= 0.05e0 AS active FROM spread"), "",
                             "low high spread median", "factor", "active"),
    "m1_mix_deltas": sql(with_ctes(C, ["deltas"], "SELECT * FROM deltas"), "mix_id i j", " ".join(mining.DIRECTIONS)),
    "m2_negative_pairs": sql(with_ctes(C, ["negatives"], "SELECT * FROM negatives"), "mix_id i j", " ".join(mining.DIRECTIONS)),
    "m4_auc_interval": sql(with_ctes(C, ["auc_bounds", "aucs"], "SELECT factor, auc, lower, upper FROM aucs JOIN auc_bounds USING (factor)"), floats="auc lower upper", texts="factor"),
    "m3_auc": sql(with_ctes(C, ["aucs"], "SELECT * FROM aucs"), "n_pos n_neg", "auc", "factor"),
    "m5_tolerances": sql(with_ctes(C, ["deltas"], """SELECT quantile_cont(groove_sim, 0.1) AS groove_sim_min, quantile_cont(sub_delta, 0.9) AS sub_delta_max,
        quantile_cont(brightness_delta, 0.9) AS brightness_delta_max FROM deltas"""), floats="groove_sim_min sub_delta_max brightness_delta_max"),
    "m6_weights": sql(with_ctes(C, ["aucs"], """SELECT factor, CASE WHEN sum(e) OVER () > 0 THEN 0.3e0 * e / sum(e) OVER () ELSE 0.3e0 / count(*) OVER () END AS weight
        FROM (SELECT factor, greatest(0e0, auc - 0.5e0) AS e FROM aucs)"""), floats="weight", texts="factor"),
    "m6_bounded_weights": sql(with_ctes(C, ["aucs"], """SELECT factor, CASE WHEN sum(e) OVER () > 0 THEN 0.3e0 * least(1e0, max(e) OVER ()) * e / sum(e) OVER () ELSE 0e0 END AS weight
        FROM (SELECT factor, greatest(0e0, auc - 0.51e0) * 2 AS e FROM aucs)"""), floats="weight", texts="factor"),
    "m7_holdout": sql(with_ctes(C, ["deltas", "moved"], f"""SELECT auc, auc >= 0.65e0 AS passed FROM ({_auc('''(
        SELECT 'all' AS k, positive, (0.1e0 * least(1e0, groove_sim / gs) + 0.2e0 * (1e0 - least(1e0, sub_delta / sd)) + 0.05e0 * (1e0 - least(1e0, brightness_delta / bd))) / (0.1e0 + 0.2e0 + 0.05e0) AS score
        FROM (SELECT *, max(groove_sim) OVER () AS gs, max(sub_delta) OVER () AS sd, max(brightness_delta) OVER () AS bd FROM (SELECT *, true AS positive FROM deltas UNION ALL SELECT *, false FROM moved)))''',
        'round(score, 9)', 'k')})"""), floats="auc", bools="passed"),
    "m8_mining_report": sql(with_ctes(C, ["mined_report"], "SELECT * FROM mined_report"), "n_true n_random", "auc lower upper weight", "factor"),
    "m8_mined_weights": sql(with_ctes(C, ["mined_report"], "SELECT genre, " + ", ".join(
        f"CASE WHEN genre = '{R.CANONICAL_GENRES[1]}' THEN m.{n} ELSE {float(R.WEIGHT_DEFAULTS[n])}e0 END AS {n}" for n in mining.SCORE_WEIGHTS)
        + " FROM (SELECT unnest([" + ", ".join(f"'{g}'" for g in R.CANONICAL_GENRES) + f"]) AS genre), (SELECT {_SUMMED} FROM mined_report ) m"),
        floats=" ".join(mining.SCORE_WEIGHTS), texts="genre"),
    "m8_summary": sql(with_ctes(C, ["learned_report", "gapped_deltas"], f"""SELECT 'Techno' AS genre, * FROM (SELECT max(n_true) AS n_true, max(n_random) AS n_random, {_SUMMED} FROM learned_report ),
        (SELECT quantile_cont(groove_sim, 0.1) AS groove_sim_min, quantile_cont(sub_delta, 0.9) AS sub_delta_max, quantile_cont(brightness_delta, 0.9) AS brightness_delta_max
         FROM gapped_deltas WHERE mix_id <> 0)"""), "n_true n_random", " ".join(mining.SCORE_WEIGHTS) + " groove_sim_min sub_delta_max brightness_delta_max", "genre"),
    "g27_transitions": sql(with_ctes(C, ["taken"], """SELECT track_id AS mix_id, unnest(range(len(ts))) AS transition_idx, unnest(list_sort(ts)) AS t FROM (
        SELECT track_id, arg_max(ts, step) AS ts FROM taken GROUP BY 1)""").replace(*_R), "mix_id transition_idx", "t"),
    "g28_window_bounds": sql(with_ctes(C, ["frames"], """SELECT track_id AS mix_id, frame_idx AS transition_idx, unnest([0, 1]) AS side, unnest([t_sec - 50, t_sec + 20]) AS start_s, unnest([t_sec - 20, t_sec + 50]) AS end_s
        FROM frames WHERE t_sec >= 50 AND t_sec + 50 <= 300"""), "mix_id transition_idx side", "start_s end_s"),
    "g29_second_profile": sql(with_ctes(C, ["frames"], f"""SELECT mix_id, second, {', '.join(f'{n} / (median({n}) OVER w + 0.000000001e0) AS {n}' for n in ('bass', 'mids', 'highs', 'onset'))} FROM (
        SELECT track_id AS mix_id, floor(t_sec) AS second, {', '.join(f'sqrt(avg({b}_ms)) AS {b}' for b in ('bass', 'mids', 'highs'))}, avg(onset) AS onset FROM frames GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY mix_id)"""), "mix_id second", "bass mids highs onset"),
    "g30_bands": sql(with_ctes(C, ["blend_rows"], "SELECT doc_id, list_sum(mids[58:64]) / 7e0 / around AS centre, CASE WHEN half >= 46 THEN 0e0 ELSE w END AS width FROM blend_rows"), "doc_id", "centre width"),
    "w8_blend_report": sql(with_ctes(C, ["blend_rows"], """SELECT grp, n, blend_s, n >= 30 AS sufficient, 1e0 - median(mids[61] / around) / median(mids[61 + r] / around) AS dip_depth FROM (
        SELECT *, greatest(1, least(CAST(round_even(blend_s / 2e0, 0) AS BIGINT), 59)) AS r FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS n, median(w) OVER (PARTITION BY grp) AS blend_s FROM blend_rows))
        GROUP BY 1, 2, 3"""), "n", "blend_s dip_depth", "grp", "sufficient"),
    "j8_rating_status": sql(with_ctes(C, ["rated"], "SELECT status, count(*) AS n, avg(CASE WHEN status = 'ok' THEN note END) AS avg_rating FROM rated GROUP BY 1"), "n", "avg_rating", "status"),
    "j9_u3_merged_ratings": sql("""SELECT CAST(doc_id AS VARCHAR) AS pair_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN CASE WHEN doc_id % 12 = 3 THEN '' ELSE CAST(doc_id % 5 + 1 AS VARCHAR) END
          WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN 'x' WHEN doc_id % 37 = 0 THEN '7' WHEN quality = 1 THEN CAST(4 + doc_id % 2 AS VARCHAR) ELSE CAST(1 + doc_id % 3 AS VARCHAR) END AS rating, 'known' AS kind FROM labels
        UNION ALL SELECT '?' || doc_id, CASE WHEN doc_id % 12 <> 3 THEN CAST(doc_id % 5 + 1 AS VARCHAR) END, 'unknown' FROM labels WHERE doc_id % 9 = 0""", texts="pair_id rating kind"),
    "j10_review_list": sql(with_ctes(C, ["tracks", "wheel"], f"""SELECT CAST(l.doc_id AS VARCHAR) AS pair_id, 'clip' || l.doc_id AS clip, upper(t.track_id || '.mp3') AS track_a, CASE WHEN t.track_id IS NOT NULL THEN 'none.mp3' END AS track_b,
        bpm AS bpm_a, CASE WHEN t.track_id IS NOT NULL THEN {resolved()} END AS genre_a, CASE WHEN t.track_id IS NOT NULL THEN coalesce(code, '') END AS key_a
        FROM labels l LEFT JOIN tracks t ON t.track_id = l.doc_id LEFT JOIN wheel ON note = key_note AND mode = key_mode"""), "", "bpm_a", "pair_id clip track_a track_b genre_a key_a"),
    "l1_design": sql(with_ctes(C, ["rated"], f"""SELECT CAST(doc_id AS VARCHAR) AS pair_id, (note >= 4)::INT AS y, {', '.join(f'({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}' for f in FACTORS)}
        FROM rated WHERE status = 'ok'"""), "", "y " + " ".join(FACTORS), "pair_id"),
    "l2_gradient": sql("SELECT unnest([" + ", ".join(f"'{f}'" for f in ("intercept", *FACTORS)) + "]) AS factor, 0e0 AS gradient", floats="gradient", texts="factor"),
    "l4_verdict": sql(with_ctes(C, ["rated"], """SELECT *, 80 AS needed, n_good >= 80 AND n_bad >= 80 AS sufficient FROM (SELECT sum((note >= 4)::INT) AS n_good, sum((note < 4)::INT) AS n_bad
        FROM rated WHERE status = 'ok')"""), "n_good n_bad needed", bools="sufficient"),
    "l5_derived_weights": sql(with_ctes(C, ["new_weights"], "SELECT * FROM new_weights"), floats="weight", texts="factor"),
    "l5_full_weights": sql(with_ctes(C, ["new_weights"], f"""SELECT * REPLACE (round_even(harmonic_weight + (1e0 - ({' + '.join(f'{f}_weight' for f in FACTORS)})), 9) AS harmonic_weight) FROM (
        SELECT *, {', '.join(f'round_even(rest * {w / sum(_CLASSIC.values())}e0, 6) AS {f}_weight' for f, w in _CLASSIC.items())} FROM (SELECT *, 1e0 - (groove_weight + bass_weight + timbre_weight + mood_weight) AS rest FROM (
          SELECT {', '.join(f"round_even(max(CASE WHEN factor = '{f}' THEN weight END), 6) AS {f}_weight" for f in evaluate.NEW_FACTORS)} FROM new_weights)))"""),
        floats=" ".join(f"{f}_weight" for f in FACTORS)),
    "q13_strided": sql(with_ctes(C, ["tracks"], """SELECT folder, path FROM (SELECT artist AS folder, file_path AS path, row_number() OVER (PARTITION BY artist ORDER BY file_path) - 1 AS p, count(*) OVER (PARTITION BY artist) AS n FROM tracks)
        WHERE n <= 20 OR p IN (SELECT floor(i * (n / 20e0)) FROM range(20) r(i))"""), texts="folder path"),
    "q12_maximin": sql(with_ctes(C, ["maximin"], "SELECT k AS pair_id, round FROM maximin").replace(*_R), "round", texts="pair_id"),
    "q14_blind": sql(f"""SELECT pair_id, 'pair_' || lpad(CAST(place AS VARCHAR), 3, '0') || '_A' AS candidate_a_id, 'pair_' || lpad(CAST(place AS VARCHAR), 3, '0') || '_B' AS candidate_b_id,
        CASE WHEN side <= n // 2 THEN 'candidate' ELSE 'baseline' END AS system_a, CASE WHEN side <= n // 2 THEN 'baseline' ELSE 'candidate' END AS system_b FROM (
        SELECT pair_id, row_number() OVER (ORDER BY {_number("'42'", "'1'", 'pair_id')}, pair_id) AS place, row_number() OVER (ORDER BY {_number("'42'", "'2'", 'pair_id')}, pair_id) AS side, count(*) OVER () AS n
        FROM (SELECT CAST(doc_id AS VARCHAR) AS pair_id FROM labels))""", texts="pair_id candidate_a_id candidate_b_id system_a system_b"),
}
