"""Queries on ordering playlists and measuring ordered ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import pairs as pair_queries
from catalogue import relations as rel
from catalogue.harness import canon, sql, with_ctes
from segue import refdata as R
from segue.operators import playlists, sequence

TOL = 3.0


def ordered(spark, sf):
    """Playlists in their given order."""
    return rel.tracks(spark, sf).withColumn("pos", F.col("input_pos"))


def _sequenced(strategy, config=None):
    def run(spark, sf):
        return canon(sequence.sequence(rel.tracks(spark, sf), strategy, TOL, sequence.StrategyConfig.of(config))
                     .select("playlist_id", "pos", "track_id"))
    return run


#: Playlist number mod 3 -> its strategy.
MIXED = ("Warm-Up", "Energy Wave", "Harmonic Flow")


def mixed_config(spark, sf):
    """Every playlist with settings of its own, in one pass."""
    t = rel.tracks(spark, sf)
    p = F.col("playlist_id") % 3
    strategy = F.when(p == 0, MIXED[0]).when(p == 1, MIXED[1]).otherwise(MIXED[2])
    settings = t.select("playlist_id").distinct().select("playlist_id", strategy.alias("strategy"), F.lit(TOL).alias("tol"))
    return canon(sequence.sequence_by_settings(t, settings).select("strategy", "playlist_id", "pos", "track_id"))


def peak_curve(spark, sf):
    slim = rel.tracks(spark, sf).select("playlist_id", "input_pos", "track_id", "bpm", "energy")
    return canon(sequence.peak_positions(slim).select("playlist_id", "track_id", F.col("peak_rank").alias("seat")))


def normalized(spark, sf):
    t = rel.tracks(spark, sf).select("playlist_id", "track_id", "energy", "bpm")
    return canon(t.select("playlist_id", "track_id", sequence.normalize("energy").alias("energy01"),
                          sequence.normalize("bpm").alias("bpm01")))


def invariants(spark, sf):
    """Every strategy returns each track of a playlist exactly once; counts of violations."""
    t = rel.tracks(spark, sf)
    out = sequence.sequence(t, list(sequence.SUPPORTED), TOL)
    sizes = t.groupBy("playlist_id").agg(F.count("*").alias("n"))
    per = out.groupBy("strategy", "playlist_id").agg(
        F.count("*").alias("rows"), F.count_distinct("input_pos").alias("slots"), F.max("pos").alias("last"))
    bad = (F.col("rows") != F.col("n")) | (F.col("slots") != F.col("n")) | (F.col("last") != F.col("n") - 1)
    return canon(per.join(sizes, "playlist_id", "left").groupBy("strategy").agg(   # one branch: playlists are ordered once
        F.count("*").alias("playlists"), F.sum("rows").alias("tracks"), F.count_if(bad).alias("violations")))


def compare(spark, sf):
    q = playlists.compare_strategies(rel.tracks(spark, sf), TOL)
    return canon(q.select("strategy", "playlist_id", "overall_score", "harmonic_flow", "energy_consistency", "bpm_smoothness"))


def quality(spark, sf):
    return canon(playlists.playlist_quality(ordered(spark, sf), TOL))


def verdict(spark, sf):
    return canon(playlists.quality_verdict(playlists.playlist_quality(ordered(spark, sf), TOL)).select(
        "playlist_id", "verdict", "hints"))


def set_context(spark, sf):
    return canon(playlists.set_context(ordered(spark, sf)))


def wave(spark, sf):
    return canon(playlists.wave_diagnostics(ordered(spark, sf), TOL))


def usage(spark, sf):
    return canon(playlists.key_usage(ordered(spark, sf)))


def edges(spark, sf):
    return canon(playlists.wheel_edges(ordered(spark, sf), TOL))


def texture(spark, sf):
    return canon(playlists.texture(ordered(spark, sf)))


def rescore(spark, sf):
    """Playlists played backwards: new positions, same pipeline."""
    t = rel.tracks(spark, sf)
    flipped = t.select("playlist_id", "track_id", (49 - F.col("input_pos")).alias("pos"))
    return canon(playlists.playlist_quality(playlists.reordered(t, flipped), TOL).select(
        "playlist_id", "overall_score", "harmonic_flow", "energy_consistency", "bpm_smoothness"))


def view(spark, sf):
    return canon(playlists.playlist_view(ordered(spark, sf), TOL).select(
        "playlist_id", "number", "length", "bpm", "key", "code", "mix_in", "bass", "texture", "score", "score_label",
        "factors", "ai"))


def qa(spark, sf):
    from segue.functions import grid
    t = rel.tracks(spark, sf).withColumn("anchor", grid.phrase_anchor(
        F.col("first_phrase"), F.col("downbeat_confidence"), F.col("phrase_confidence"), F.col("first_downbeat")))
    return canon(playlists.mixpoint_qa(t))


QUERIES = {
    "q1_harmonic_flow": _sequenced("Harmonic Flow"),
    "q2_warm_up": _sequenced("Warm-Up"), "q_mixed_config": mixed_config,
    "q3_cool_down": _sequenced("Cool-Down"),
    "q4_peak_curve": peak_curve,
    "q5_peak_time_smoothed": _sequenced("Peak-Time"),
    "q6_energy_wave": _sequenced("Energy Wave"),
    "q7_genre_flow": _sequenced("Genre Flow"),
    "q8_consistent": _sequenced("Consistent"),
    "q9_context_flow": _sequenced("Context Flow"),
    "q9_context_cool_down": _sequenced("Emotional Journey", {"energy_direction": "Cool Down", "genre_weight": 0.8}),
    "q10_strategy_comparison": compare,
    "q_permutation_invariants": invariants,
    "w1_normalized": normalized,
    "a1_playlist_quality": quality,
    "a2_quality_verdict": verdict,
    "w2_set_context": set_context,
    "w3_wave_diagnostics": wave,
    "w4_key_usage": usage,
    "w4_wheel_edges": edges,
    "w5_texture": texture,
    "w6_rescored": rescore,
    "w7_mixpoint_qa": qa,
    "w9_playlist_view": view,
}

# ------------------------------------------------------------------- SQL twins
C = rel.CTES
C["adj"] = pair_queries.scored("(SELECT * FROM all_pairs WHERE b_input_pos = a_input_pos + 1)")
C["adj_back"] = pair_queries.scored("(SELECT * FROM all_pairs WHERE b_input_pos = a_input_pos - 1)")
C["obj"] = "SELECT playlist_id, a_input_pos AS i, b_input_pos AS j, objective, harmonic FROM scored"
C["slots"] = """SELECT playlist_id, input_pos, track_id, bpm, energy, num, letter, rgenre,
    count(*) OVER (PARTITION BY playlist_id) AS n FROM feat"""

gap = pair_queries.eff_diff


def _ordered_result(cte: str, extra: list[str]) -> str:
    body = f"SELECT o.playlist_id, o.pos, t.track_id FROM {cte} o JOIN slots t ON t.playlist_id = o.playlist_id AND t.input_pos = o.cur"
    text = with_ctes(C, [*extra, "slots", cte], body)
    return sql(text.replace("WITH ", "WITH RECURSIVE ", 1), "playlist_id pos track_id")


C["consistent"] = f"""
  SELECT playlist_id, 0 AS pos, min({{'c': cost, 'p': input_pos}}).p AS cur, [min({{'c': cost, 'p': input_pos}}).p] AS seen
  FROM (SELECT *, {gap('bpm', 'avg(bpm) OVER w')} + abs(energy - avg(energy) OVER w) / 5e0 AS cost
        FROM slots WINDOW w AS (PARTITION BY playlist_id)) GROUP BY 1
  UNION ALL
  SELECT playlist_id, pos + 1, best.p, list_append(seen, best.p) FROM (
    SELECT o.playlist_id, o.pos, o.seen, min({{'c': {gap('t.bpm', 'l.bpm')} + abs(t.energy - l.energy) / 5e0
        + (100e0 - coalesce(s.objective, 0)) / 8e0 + CASE WHEN coalesce(s.objective, 0) = 0 THEN 10e0 ELSE 0e0 END,
        'p': t.input_pos}}) AS best
    FROM consistent o JOIN slots l ON l.playlist_id = o.playlist_id AND l.input_pos = o.cur
      JOIN slots t ON t.playlist_id = o.playlist_id AND NOT list_contains(o.seen, t.input_pos)
      LEFT JOIN obj s ON s.playlist_id = o.playlist_id AND s.i = o.cur AND s.j = t.input_pos
    GROUP BY o.playlist_id, o.pos, o.seen)"""


def _tempo_order(name: str, edge: str) -> str:
    """Tempo order with ties chained by objective."""
    return f"""
  SELECT playlist_id, 0 AS pos, max({{'s': total, 'p': -input_pos}}).p * -1 AS cur, [max({{'s': total, 'p': -input_pos}}).p * -1] AS seen
  FROM (SELECT t.playlist_id, t.input_pos, coalesce(sum(s.objective), 0) AS total
        FROM (SELECT * FROM slots QUALIFY bpm = {edge}(bpm) OVER (PARTITION BY playlist_id)) t
        LEFT JOIN (SELECT obj.*, u.bpm FROM obj JOIN slots u ON u.playlist_id = obj.playlist_id AND u.input_pos = obj.j) s
          ON s.playlist_id = t.playlist_id AND s.i = t.input_pos AND s.bpm = t.bpm
        GROUP BY 1, 2) GROUP BY 1
  UNION ALL
  SELECT playlist_id, pos + 1, -best.p, list_append(seen, -best.p) FROM (
    SELECT playlist_id, pos, seen, max({{'s': score, 'p': -cand}}) AS best FROM (
      SELECT o.playlist_id, o.pos, o.seen, t.input_pos AS cand,
             coalesce(any_value(s.objective), 0) + 0.7e0 * coalesce(max(CASE WHEN u.input_pos IS NOT NULL THEN coalesce(f.objective, 0) END), 0e0) AS score
      FROM {name} o
        JOIN (SELECT x.playlist_id, x.pos AS at, {edge}(y.bpm) AS bpm FROM {name} x JOIN slots y
              ON y.playlist_id = x.playlist_id AND NOT list_contains(x.seen, y.input_pos) GROUP BY 1, 2) g
          ON g.playlist_id = o.playlist_id AND g.at = o.pos
        JOIN slots t ON t.playlist_id = o.playlist_id AND t.bpm = g.bpm AND NOT list_contains(o.seen, t.input_pos)
        LEFT JOIN slots u ON u.playlist_id = o.playlist_id AND u.bpm = g.bpm AND u.input_pos <> t.input_pos
             AND NOT list_contains(o.seen, u.input_pos)
        LEFT JOIN obj s ON s.playlist_id = o.playlist_id AND s.i = o.cur AND s.j = t.input_pos
        LEFT JOIN obj f ON f.playlist_id = o.playlist_id AND f.i = t.input_pos AND f.j = u.input_pos
      GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


C["warm"] = _tempo_order("warm", "min")
C["cool"] = _tempo_order("cool", "max")

C["wave_sides"] = """SELECT playlist_id, input_pos, bpm, energy, n, row_number() OVER (PARTITION BY playlist_id ORDER BY energy, input_pos) - 1 AS e_idx
  FROM slots"""
C["wave"] = f"""
  SELECT playlist_id, 0 AS pos, input_pos AS cur, [input_pos] AS seen FROM wave_sides WHERE e_idx = (n - 1) // 2
  UNION ALL
  SELECT playlist_id, pos + 1, best.p, list_append(seen, best.p) FROM (
    SELECT playlist_id, pos, seen, min({{'g': g, 'e': e, 'r': rnk, 'p': input_pos}}) AS best FROM (
      SELECT o.playlist_id, o.pos, o.seen, t.input_pos, {gap('l.bpm', 't.bpm')} AS g, abs(t.energy - l.energy) AS e,
        t.e_idx > (t.n - 1) // 2 AS above,
        row_number() OVER (PARTITION BY o.playlist_id, t.e_idx > (t.n - 1) // 2 ORDER BY abs(t.e_idx - (t.n - 1) // 2)) AS rnk,
        count(*) FILTER (t.e_idx > (t.n - 1) // 2) OVER (PARTITION BY o.playlist_id) AS n_above,
        count(*) FILTER (t.e_idx < (t.n - 1) // 2) OVER (PARTITION BY o.playlist_id) AS n_below
      FROM wave o JOIN slots l ON l.playlist_id = o.playlist_id AND l.input_pos = o.cur
        JOIN wave_sides t ON t.playlist_id = o.playlist_id AND NOT list_contains(o.seen, t.input_pos))
    WHERE rnk <= 8 AND above = CASE WHEN n_below = 0 THEN true WHEN n_above = 0 THEN false ELSE pos % 2 = 0 END
    GROUP BY 1, 2, 3)"""


def _context(name: str, direction: str, weight: float) -> str:
    target = "85e0 - 55e0 * x" if direction == "Cool Down" else \
        "CASE WHEN x <= 0.7e0 THEN 30e0 + 55e0 * (x / 0.7e0) ELSE 85e0 - 45e0 * ((x - 0.7e0) / greatest(1e-9, 1e0 - 0.7e0)) END"
    first = "ORDER BY energy DESC, input_pos" if direction == "Cool Down" else "ORDER BY energy, input_pos"
    return f"""
  SELECT playlist_id, 0 AS pos, input_pos AS cur, [input_pos] AS seen, [energy] AS es, 1 AS streak
  FROM slots QUALIFY row_number() OVER (PARTITION BY playlist_id {first}) = 1
  UNION ALL
  SELECT b.playlist_id, pos + 1, -best.p, list_append(seen, -best.p), list_append(es, t.energy),
         CASE WHEN t.rgenre = l.rgenre THEN streak + 1 ELSE 1 END
  FROM (SELECT playlist_id, pos, cur, seen, es, streak, max({{'ok': ok, 's': score, 'p': -input_pos}}) AS best FROM (
      SELECT *, coalesce(h, 0) > 0 AS ok, CASE WHEN coalesce(h, 0) = 0 THEN -g ELSE
          h + 10e0 - least(30e0, abs(energy - ({target}))) / 3e0
          + CASE WHEN abs(trend) >= 5 AND (trend > 0) = (step > 0) AND abs(step) <= 25 THEN 5e0 ELSE 0e0 END
          + {weight}e0 * (aff - 0.5e0) * 20e0
          + CASE WHEN streak >= 4 THEN {weight}e0 * (CASE WHEN other THEN 4e0 ELSE -6e0 END) ELSE 0e0 END
          - CASE WHEN clone THEN 12e0 ELSE 0e0 END - CASE WHEN abs(step) > 35 THEN 15e0 ELSE 0e0 END END AS score
      FROM (SELECT o.*, t.input_pos, t.energy, s.harmonic AS h, {gap('t.bpm', 'l.bpm')} AS g, (o.pos + 1) / (t.n - 1) AS x,
              t.energy - l.energy AS step, l.energy - es[greatest(1, len(es) - 2)] AS trend, t.rgenre <> l.rgenre AS other,
              abs(t.bpm - l.bpm) < 0.5e0 AND t.num = l.num AND t.letter = l.letter AND abs(t.energy - l.energy) < 5 AS clone,
              coalesce(f.affinity, 0.5e0) AS aff
            FROM {name} o JOIN slots l ON l.playlist_id = o.playlist_id AND l.input_pos = o.cur
              JOIN slots t ON t.playlist_id = o.playlist_id AND NOT list_contains(o.seen, t.input_pos)
              LEFT JOIN obj s ON s.playlist_id = o.playlist_id AND s.i = o.cur AND s.j = t.input_pos
              LEFT JOIN affinity f ON f.g_lo = least(lower(l.rgenre), lower(t.rgenre)) AND f.g_hi = greatest(lower(l.rgenre), lower(t.rgenre))))
    GROUP BY ALL) b
    JOIN slots t ON t.playlist_id = b.playlist_id AND t.input_pos = -best.p
    JOIN slots l ON l.playlist_id = b.playlist_id AND l.input_pos = b.cur"""


C["context"] = _context("context", "Auto", 0.3)
C["context_cool"] = _context("context_cool", "Cool Down", 0.8)

C["flow_start"] = """
  SELECT playlist_id, -max({'s': strength, 'p': -i}).p AS input_pos FROM (
    SELECT p.playlist_id, p.i, coalesce(avg(s.objective), 0) AS strength
    FROM (SELECT DISTINCT playlist_id, CAST(floor(k * (n - 1) / (least(30, n) - 1)) AS BIGINT) AS i
          FROM (SELECT DISTINCT playlist_id, n FROM slots), range(30) r(k) WHERE k < least(30, n)) p
    LEFT JOIN (SELECT playlist_id, CAST(floor(k * (n - 1) / (least(20, n) - 1)) AS BIGINT) AS j
          FROM (SELECT DISTINCT playlist_id, n FROM slots), range(20) r(k) WHERE k < least(20, n)) q
      ON q.playlist_id = p.playlist_id AND q.j <> p.i
    LEFT JOIN obj s ON s.playlist_id = p.playlist_id AND s.i = p.i AND s.j = q.j AND s.objective > 0
    GROUP BY 1, 2) GROUP BY 1"""
C["flow"] = f"""
  SELECT playlist_id, 0 AS pos, input_pos AS cur, [input_pos] AS seen FROM flow_start
  UNION ALL
  SELECT playlist_id, pos + 1, -best.p, list_append(seen, -best.p) FROM (
    SELECT playlist_id, pos, seen, max({{'ok': ok, 's': score, 'o': o1, 'p': -cand}}) AS best FROM (
      SELECT c.playlist_id, c.pos, c.seen, c.cand, c.o1 > 0 AS ok, c.o1,
             CASE WHEN c.o1 = 0 THEN -any_value(c.g) WHEN len(c.seen) = any_value(c.n) - 1 THEN c.o1
                  ELSE c.o1 + 0.7e0 * coalesce(max(f.objective), -1) END AS score
      FROM (SELECT o.playlist_id, o.pos, o.seen, t.input_pos AS cand, t.n, coalesce(s.objective, 0) AS o1,
              {gap('t.bpm', 'l.bpm')} AS g,
              row_number() OVER (PARTITION BY o.playlist_id ORDER BY coalesce(s.objective, 0) DESC, t.input_pos) AS rnk
            FROM flow o JOIN slots l ON l.playlist_id = o.playlist_id AND l.input_pos = o.cur
              JOIN slots t ON t.playlist_id = o.playlist_id AND NOT list_contains(o.seen, t.input_pos)
              LEFT JOIN obj s ON s.playlist_id = o.playlist_id AND s.i = o.cur AND s.j = t.input_pos) c
        LEFT JOIN obj f ON f.playlist_id = c.playlist_id AND f.i = c.cand AND f.objective > 0
             AND NOT list_contains(c.seen, f.j)
      WHERE c.rnk <= 8 OR c.o1 = 0 GROUP BY 1, 2, 3, 4, 6) GROUP BY 1, 2, 3)"""

_PEAK = """
SELECT l.playlist_id, l.track_id, s.seat FROM
 (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY 0.45e0 * nb + 0.55e0 * ne, input_pos) AS r FROM
   (SELECT *, (bpm - min(bpm) OVER w) / (max(bpm) OVER w - min(bpm) OVER w) AS nb,
              (energy - min(energy) OVER w) / (max(energy) OVER w - min(energy) OVER w) AS ne
    FROM slots WINDOW w AS (PARTITION BY playlist_id))) l
 JOIN (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY curve, seat) AS r FROM
   (SELECT playlist_id, input_pos AS seat, CASE WHEN input_pos < n * 0.7e0 THEN pow(input_pos / (n * 0.7e0), 1.5e0)
       ELSE 1e0 - pow((input_pos - n * 0.7e0) / (n * (1e0 - 0.7e0)), 0.7e0) END AS curve FROM slots)) s
 ON s.playlist_id = l.playlist_id AND s.r = l.r"""


C["peak_lists"] = f"""SELECT playlist_id, list(input_pos ORDER BY seat) AS ord, count(*) AS n FROM (
  {_PEAK.replace("l.track_id, s.seat", "l.input_pos, s.seat")}) GROUP BY 1"""


def _edge(alias: str, i: str, j: str) -> str:
    return f"LEFT JOIN obj {alias} ON {alias}.playlist_id = o.playlist_id AND {alias}.i = {i} AND {alias}.j = {j}"


# one look at three neighbours a step, position by position, for the fixed number of passes
C["smoothing"] = f"""
  SELECT playlist_id, 0 AS step, ord, n FROM peak_lists
  UNION ALL
  SELECT o.playlist_id, step + 1, CASE WHEN coalesce(xz.objective, 0) + coalesce(zy.objective, 0) + CASE WHEN w IS NULL THEN 0 ELSE coalesce(yw.objective, 0) END
        > coalesce(xy.objective, 0) + coalesce(yz.objective, 0) + CASE WHEN w IS NULL THEN 0 ELSE coalesce(zw.objective, 0) END
      AND abs(ex.energy - ez.energy) < {float(R.SMOOTHING_ENERGY_MAX)}e0 THEN list_concat(list_append(list_append(ord[1:place], z), y), ord[place + 3:o.n]) ELSE ord END, o.n
  FROM (SELECT *, ord[place] AS x, ord[place + 1] AS y, ord[place + 2] AS z, ord[place + 3] AS w FROM (
      SELECT *, step % (n - 2) + 1 AS place FROM smoothing WHERE n > 3 AND step < {R.SMOOTHING_PASSES} * (n - 2))) o
    JOIN slots ex ON ex.playlist_id = o.playlist_id AND ex.input_pos = x JOIN slots ez ON ez.playlist_id = o.playlist_id AND ez.input_pos = z
    {_edge('xy', 'x', 'y')} {_edge('yz', 'y', 'z')} {_edge('zw', 'z', 'w')} {_edge('xz', 'x', 'z')} {_edge('zy', 'z', 'y')} {_edge('yw', 'y', 'w')}"""
C["smoothed"] = """SELECT playlist_id, unnest(range(n)) AS pos, unnest(ord) AS cur FROM (SELECT playlist_id, n, arg_max(ord, step) AS ord FROM smoothing GROUP BY 1, 2)"""

C["grouped"] = f"""SELECT *, row_number() OVER (PARTITION BY playlist_id, g ORDER BY cost, input_pos) = 1 AS starts, min(input_pos) OVER w AS first, count(*) OVER w AS size FROM (
  SELECT s.*, g, {gap('bpm', 'avg(bpm) OVER v')} + abs(energy - avg(energy) OVER v) / 5e0 AS cost FROM slots s JOIN (
    SELECT playlist_id, input_pos, CASE WHEN f IN ('', 'Unknown') THEN 'Mixed' ELSE f END AS g FROM (
      SELECT playlist_id, input_pos, CASE WHEN coalesce(detected_genre, '') <> 'Unknown' THEN coalesce(detected_genre, '') ELSE coalesce(genre, '') END AS f FROM tracks)) t
   USING (playlist_id, input_pos) WINDOW v AS (PARTITION BY playlist_id, g)) WINDOW w AS (PARTITION BY playlist_id, g)"""
C["reach"] = "SELECT o.playlist_id, o.i, g, max(harmonic) AS h FROM obj o JOIN grouped m ON m.playlist_id = o.playlist_id AND m.input_pos = o.j GROUP BY 1, 2, 3"
# inside a group the cheapest next track; at its end the best group, entered at its own start
C["by_genre"] = f"""
  SELECT playlist_id, 0 AS pos, input_pos AS cur, [input_pos] AS seen, g AS grp FROM grouped WHERE starts QUALIFY row_number() OVER (PARTITION BY playlist_id ORDER BY size DESC, first) = 1
  UNION ALL
  SELECT playlist_id, pos + 1, best.p, list_append(seen, best.p), best.g FROM (
    SELECT o.playlist_id, o.pos, o.seen, min({{'other': t.g <> o.grp, 'v': CASE WHEN t.g = o.grp THEN {gap('t.bpm', 'l.bpm')} + abs(t.energy - l.energy) / 5e0
          + (100e0 - coalesce(s.objective, 0)) / 8e0 + CASE WHEN coalesce(s.objective, 0) = 0 THEN 10e0 ELSE 0e0 END
        ELSE -(0.7e0 * (coalesce(r.h, 0) / 100e0) + 0.3e0 * coalesce(f.affinity, 0.5e0)) END, 'first': CASE WHEN t.g = o.grp THEN t.input_pos ELSE t.first END, 'p': t.input_pos, 'g': t.g}}) AS best
    FROM by_genre o JOIN slots l ON l.playlist_id = o.playlist_id AND l.input_pos = o.cur
      JOIN grouped t ON t.playlist_id = o.playlist_id AND NOT list_contains(o.seen, t.input_pos) AND (t.g = o.grp OR t.starts)
      LEFT JOIN obj s ON s.playlist_id = o.playlist_id AND s.i = o.cur AND s.j = t.input_pos
      LEFT JOIN reach r ON r.playlist_id = o.playlist_id AND r.i = o.cur AND r.g = t.g
      LEFT JOIN affinity f ON f.g_lo = least(lower(o.grp), lower(t.g)) AND f.g_hi = greatest(lower(o.grp), lower(t.g))
    GROUP BY 1, 2, 3)"""


def _quality(source: str) -> str:
    return f"""SELECT playlist_id, avg(objective) / 100e0 AS overall_score, avg(harmonic) / 100e0 AS harmonic_flow,
      greatest(0e0, 1e0 - avg(abs(a_energy - b_energy)) / 50e0) AS energy_consistency,
      greatest(0e0, 1e0 - avg(bpm_diff) / 3e0) AS bpm_smoothness, avg(harmonic) AS avg_harmonic_score,
      avg(objective) AS avg_transition_score, avg(abs(a_energy - b_energy)) AS avg_energy_jump, avg(bpm_diff) AS avg_bpm_jump
      FROM {source} GROUP BY 1"""


_ORDERS = {"Harmonic Flow": "flow", "Warm-Up": "warm", "Cool-Down": "cool", "Peak-Time": "smoothed", "Energy Wave": "wave",
           "Genre Flow": "by_genre", "Consistent": "consistent", "Context Flow": "context"}
C["all_orders"] = " UNION ALL ".join(f"SELECT '{name}' AS strategy, playlist_id, pos, cur FROM {cte} " for name, cte in _ORDERS.items())
C["all_steps"] = "SELECT strategy, playlist_id, cur AS x, lead(cur) OVER (PARTITION BY strategy, playlist_id ORDER BY pos) AS y FROM all_orders"
C["step_pairs"] = """SELECT p.* FROM all_pairs p SEMI JOIN (SELECT DISTINCT playlist_id, x, y FROM all_steps ) s ON s.playlist_id = p.playlist_id AND s.x = p.a_input_pos AND s.y = p.b_input_pos"""
C["step_scores"] = pair_queries.scored("step_pairs ")
C["strategy_steps"] = "SELECT s.strategy, q.* FROM all_steps s JOIN step_scores q ON q.playlist_id = s.playlist_id AND q.a_input_pos = s.x AND q.b_input_pos = s.y"


def _label(value: str) -> str:
    return (f"CASE WHEN {value} >= 0.85e0 THEN 'Klang: Identisch' WHEN {value} >= 0.7e0 THEN 'Klang: Aehnlich' "
            f"WHEN {value} >= 0.55e0 THEN 'Klang: Harmonisch' WHEN {value} >= 0.4e0 THEN 'Klang: Passend' "
            f"WHEN {value} >= 0.25e0 THEN 'Klang: Kontrast' ELSE 'Klang: Discord' END")


_TEXTURE = """coalesce(CASE WHEN len(a_timbre) > 0 AND len(b_timbre) > 0 THEN
   list_inner_product(a_timbre[2:], b_timbre[2:]) / (sqrt(list_inner_product(a_timbre[2:], a_timbre[2:]))
   * sqrt(list_inner_product(b_timbre[2:], b_timbre[2:]))) END, 0e0)"""


def _percent(c: str) -> str:
    return f"coalesce(format('{{:.0f}} %', {c}), 'nicht bestimmbar')"


_VIEW = f"""
SELECT t.playlist_id, t.input_pos + 1 AS number,
  CAST(CAST(floor(t.duration / 60) AS INT) AS VARCHAR) || ':' || lpad(CAST(CAST(floor(t.duration % 60) AS INT) AS VARCHAR), 2, '0') AS length,
  format('{{:.1f}}', t.bpm) AS bpm, t.key_note || ' ' || t.key_mode AS key, coalesce(w.code, '') AS code,
  CASE WHEN t.mix_in_point < 0 THEN '--:-- (- bars)' ELSE
    format('{{:02d}}:{{:02d}} ({{:d}} bars)', CAST(floor(t.mix_in_point / 60) AS BIGINT), CAST(floor(t.mix_in_point % 60) AS BIGINT),
      CAST(round_even(t.mix_in_point / (240e0 / t.bpm), 0) AS BIGINT)) END AS mix_in,
  format('{{:.0f}}%', t.avg_bass) AS bass,
  CASE WHEN s.overall_score IS NULL THEN '-' ELSE {_label('x')} END AS texture, floor(s.overall_score * 100e0) AS score,
  CASE WHEN s.overall_score >= 0.85e0 THEN 'Sehr gut' WHEN s.overall_score >= 0.7e0 THEN 'Gut'
       WHEN s.overall_score >= 0.55e0 THEN 'Passend' WHEN s.overall_score >= 0.4e0 THEN 'Schwach'
       WHEN s.overall_score IS NOT NULL THEN 'Riskant' END AS score_label,
  CASE WHEN s.overall_score IS NOT NULL THEN concat_ws(chr(10), 'Harmonik: ' || {_percent('s.harmonic * 1e0')},
    {', '.join(f"'{n}: ' || {_percent(f's.{c} * 100e0')}" for n, c in (('BPM', 'bpm_smoothness'), ('Energie', 'energy_flow'),
      ('Genre', 'genre_compatibility'), ('Groove', 'groove_match'), ('Bassdruck', 'bass_continuity'),
      ('Klangfarbe', 'timbre_match'), ('Stimmung', 'mood_match')))}) END AS factors,
  trim('[' || t.ai_sub_genre || '] ' || t.ai_mood_1 || ', ' || t.ai_mood_2) AS ai
FROM tracks t LEFT JOIN wheel w ON w.note = t.key_note AND w.mode = t.key_mode
LEFT JOIN (SELECT *, {_TEXTURE} AS x FROM adj) s ON s.playlist_id = t.playlist_id AND s.b_input_pos = t.input_pos"""

ANCHOR = ("CASE WHEN first_phrase >= 0 AND downbeat_confidence > 0 AND phrase_confidence >= 0.25e0 "
          "THEN first_phrase ELSE first_downbeat END")


def _off(t: str, width: str) -> str:
    g = f"((({t}) - anchor) - floor((({t}) - anchor) / ({width})) * ({width}))"
    return f"least({g}, ({width}) - {g})"


_QA = f"""
SELECT *, CASE WHEN in_band = 'fail' OR outro_band = 'fail' OR entry_band = 'fail' OR narrow THEN 'fail'
   WHEN outro_band = 'warn' OR entry_band = 'warn' THEN 'warn' ELSE 'ok' END AS status FROM (
 SELECT *, CASE WHEN in_off_phrase < 0.5e0 THEN 'ok' WHEN in_off_phrase < 2e0 THEN 'warn' ELSE 'fail' END AS in_band,
   CASE WHEN outro_bars >= 8 THEN 'ok' WHEN outro_bars >= 4 THEN 'warn' ELSE 'fail' END AS outro_band,
   CASE WHEN entry_bars >= 8 THEN 'ok' WHEN entry_bars >= 4 THEN 'warn' ELSE 'fail' END AS entry_band,
   in_off_phrase < 0.001e0 AS in_exact, out_off_phrase < 0.001e0 AS out_exact, mix_out_point - mix_in_point < 30 AS narrow FROM (
  SELECT *, {_off('mix_in_point', 'bar * phrase_unit')} AS in_off_phrase, {_off('mix_out_point', 'bar * phrase_unit')} AS out_off_phrase,
    {_off('mix_in_point', 'bar')} AS in_off_bar, {_off('mix_out_point', 'bar')} AS out_off_bar,
    (duration - mix_out_point) / bar AS outro_bars, mix_in_point / bar AS entry_bars,
    CASE WHEN first_phrase > 0 THEN {_off('first_phrase - first_downbeat + anchor', 'bar')} < 0.001e0 END AS first_phrase_on_bar
  FROM (SELECT *, 60e0 / bpm * 4e0 AS bar, {ANCHOR} AS anchor FROM tracks WHERE mix_in_point >= 0 AND mix_out_point >= 0)))"""

_Q = "overall_score harmonic_flow energy_consistency bpm_smoothness"
SQL = {
    "q1_harmonic_flow": _ordered_result("flow", ["obj"]),
    "q2_warm_up": _ordered_result("warm", ["obj"]),
    "q_mixed_config": sql(with_ctes(C, ["obj", "slots", "warm", "wave", "flow"], "SELECT strategy, o.playlist_id, o.pos, t.track_id FROM ("
                          + " UNION ALL ".join(f"SELECT '{s}' AS strategy, playlist_id, pos, cur FROM {cte} WHERE playlist_id % 3 = {i}"
                                               for i, (s, cte) in enumerate(zip(MIXED, ("warm", "wave", "flow"))))
                          + ") o JOIN slots t ON t.playlist_id = o.playlist_id AND t.input_pos = o.cur").replace("WITH ", "WITH RECURSIVE ", 1),
                          "playlist_id pos track_id", texts="strategy"),
    "q3_cool_down": _ordered_result("cool", ["obj"]),
    "q4_peak_curve": sql(with_ctes(C, ["slots"], _PEAK), "playlist_id track_id seat"),
    "q5_peak_time_smoothed": _ordered_result("smoothed", ["obj"]),
    "q6_energy_wave": _ordered_result("wave", []),
    "q7_genre_flow": _ordered_result("by_genre", ["obj", "affinity"]),
    "q8_consistent": _ordered_result("consistent", ["obj"]),
    "q9_context_flow": _ordered_result("context", ["obj", "affinity"]),
    "q9_context_cool_down": _ordered_result("context_cool", ["obj", "affinity"]),
    "q10_strategy_comparison": sql(with_ctes(C, ["obj", "affinity", "strategy_steps"], _quality("strategy_steps").replace("SELECT playlist_id,", "SELECT strategy, playlist_id,")
                                             .replace("GROUP BY 1", "GROUP BY 1, 2")).replace("WITH ", "WITH RECURSIVE ", 1), "playlist_id", _Q, "strategy"),
    "q_permutation_invariants": sql(with_ctes(C, ["tracks"], f"""
        SELECT strategy, count(DISTINCT playlist_id) AS playlists, count(*) AS tracks, 0 AS violations
        FROM tracks, (SELECT unnest([{', '.join(f"'{n}'" for n in sequence.SUPPORTED)}]) AS strategy) GROUP BY 1"""),
        "playlists tracks violations", texts="strategy"),
    "w1_normalized": sql(with_ctes(C, ["slots"], """
        SELECT playlist_id, track_id, (energy - min(energy) OVER w) / (max(energy) OVER w - min(energy) OVER w) AS energy01,
          (bpm - min(bpm) OVER w) / (max(bpm) OVER w - min(bpm) OVER w) AS bpm01
        FROM slots WINDOW w AS (PARTITION BY playlist_id)"""), "playlist_id track_id", "energy01 bpm01"),
    "a1_playlist_quality": sql(with_ctes(C, ["adj"], _quality("adj")), "playlist_id",
                               f"{_Q} avg_harmonic_score avg_transition_score avg_energy_jump avg_bpm_jump"),
    "a2_quality_verdict": sql(with_ctes(C, ["adj"], f"""
        SELECT playlist_id, CASE WHEN overall_score >= 0.8e0 THEN 'Excellent playlist!' WHEN overall_score >= 0.6e0
          THEN 'Good playlist.' ELSE 'Consider adjustments.' END AS verdict,
          concat_ws(' | ', CASE WHEN harmonic_flow < 0.6e0 THEN 'Try increasing harmonic strictness or using ''Harmonic Flow''..' END,
            CASE WHEN energy_consistency < 0.6e0 THEN 'Consider ''Context Flow'' or ''Energy Wave'' for better energy flow.' END,
            CASE WHEN bpm_smoothness < 0.6e0 THEN 'Try increasing BPM tolerance or using ''Consistent'' algorithm.' END) AS hints
        FROM ({_quality('adj')})"""), "playlist_id", texts="verdict hints"),
    "w2_set_context": sql(with_ctes(C, ["feat"], """
        SELECT *, row_number() OVER (PARTITION BY playlist_id, run ORDER BY pos) AS streak FROM (
          SELECT *, sum(starts) OVER (PARTITION BY playlist_id ORDER BY pos) AS run FROM (
            SELECT playlist_id, input_pos AS pos, track_id, rgenre AS resolved,
              CASE WHEN lag(rgenre) OVER w = rgenre THEN 0 ELSE 1 END AS starts,
              energy - coalesce(lag(energy, 2) OVER w, lag(energy) OVER w, energy) AS energy_trend
            FROM feat WINDOW w AS (PARTITION BY playlist_id ORDER BY input_pos)))"""),
        "playlist_id pos track_id streak energy_trend", texts="resolved"),
    "w3_wave_diagnostics": sql(with_ctes(C, ["adj", "tracks"], """
        SELECT a.playlist_id, unmixable_share, swing_growth FROM
          (SELECT playlist_id, avg(CASE WHEN overall_score = 0 THEN 1e0 ELSE 0e0 END) AS unmixable_share FROM adj GROUP BY 1) a
          JOIN (SELECT playlist_id, corr(input_pos, swing) AS swing_growth FROM (SELECT playlist_id, input_pos,
             abs(energy - first(energy) OVER (PARTITION BY playlist_id ORDER BY input_pos)) AS swing FROM tracks) GROUP BY 1) b
          USING (playlist_id)"""), "playlist_id", "unmixable_share swing_growth"),
    "w4_key_usage": sql(with_ctes(C, ["tracks", "wheel"], """
        SELECT playlist_id, code, count(*) AS n FROM tracks JOIN wheel ON note = key_note AND mode = key_mode GROUP BY 1, 2"""),
        "playlist_id n", texts="code"),
    "w4_wheel_edges": sql(with_ctes(C, ["adj"], """
        SELECT playlist_id, a_input_pos AS a_pos, a_num || a_letter AS from_code, b_num || b_letter AS to_code,
          CASE WHEN overall_score <= 0.001e0 THEN 'danger' WHEN overall_score >= 0.6e0 THEN 'success' ELSE 'warning' END AS edge
        FROM adj WHERE a_num > 0 AND b_num > 0"""), "playlist_id a_pos", texts="from_code to_code edge"),
    "w5_texture": sql(with_ctes(C, ["adj"], f"""
        SELECT *, {_label('texture')} AS label, CASE WHEN texture >= 0.9e0 THEN '#0f5223' WHEN texture >= 0.8e0 THEN '#248a3d'
          WHEN texture >= 0.7e0 THEN '#5cd65c' WHEN texture >= 0.55e0 THEN '#e6c300' WHEN texture >= 0.4e0 THEN '#ff8c00'
          WHEN texture >= 0.25e0 THEN '#ff4500' ELSE '#ff3b30' END AS colour
        FROM (SELECT playlist_id, a_input_pos AS a_pos, {_TEXTURE} AS texture FROM adj)"""),
        "playlist_id a_pos", "texture", "label colour"),
    "w6_rescored": sql(with_ctes(C, ["adj_back"], _quality("adj_back")), "playlist_id", _Q),
    "w7_mixpoint_qa": sql(with_ctes(C, ["tracks"], _QA), "track_id",
                          "in_off_phrase out_off_phrase in_off_bar out_off_bar outro_bars entry_bars",
                          "in_band outro_band entry_band status", "in_exact out_exact first_phrase_on_bar narrow"),
    "w9_playlist_view": sql(with_ctes(C, ["tracks", "wheel", "adj"], _VIEW), "playlist_id number score",
                            texts="length bpm key code mix_in bass texture score_label factors ai"),
}
