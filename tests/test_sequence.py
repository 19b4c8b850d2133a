"""Sequencing against direct re-computation on small playlists."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogue import relations as rel
from segue.operators import pairs, scoring, sequence

TOL = 3.0


@pytest.fixture(scope="module")
def small(spark):
    """Two playlists of 12 tracks with all scored edges, as plain dicts."""
    tracks = rel.tracks(spark, "/root/testdata/sf0.001").where("playlist_id < 2 AND input_pos < 12").cache()
    edges = {(r["playlist_id"], r["a_input_pos"], r["b_input_pos"]): (r["objective"], r["harmonic"])
             for r in scoring.scored_playlist_pairs(tracks, TOL).collect()}
    rows = tracks.select("playlist_id", "input_pos", "bpm", "energy", "detected_genre", "genre").collect()
    return tracks, edges, {(r["playlist_id"], r["input_pos"]): r for r in rows}


def ordered(tracks, strategy, **config):
    out = sequence.sequence(tracks, strategy, TOL, sequence.StrategyConfig.of(config)).orderBy("playlist_id", "pos").collect()
    return {p: [r["input_pos"] for r in out if r["playlist_id"] == p] for p in {r["playlist_id"] for r in out}}


def gap(a, b):
    return min(abs(a - b), abs(a - 2 * b), abs(a - b / 2))


def consistent(p, members, edges, info):
    left = list(members)
    mb, me = (sum(info[p, i][f] for i in left) / len(left) for f in ("bpm", "energy"))
    order = [min(left, key=lambda i: gap(info[p, i]["bpm"], mb) + abs(info[p, i]["energy"] - me) / 5)]
    left.remove(order[0])
    while left:
        last = order[-1]

        def cost(i):
            s = edges.get((p, last, i), (0, 0))[0]
            return (gap(info[p, i]["bpm"], info[p, last]["bpm"]) + abs(info[p, i]["energy"] - info[p, last]["energy"]) / 5
                    + (100 - s) / 8 + (10 if s == 0 else 0))
        order.append(min(left, key=cost))
        left.remove(order[-1])
    return order


def test_genre_flow(small):
    tracks, edges, info = small
    table = sequence.affinity_table()
    got = ordered(tracks, "Genre Flow", genre_weight=0.3)
    for p in (0, 1):
        groups = {}
        for i in range(12):
            r = info[p, i]
            g = r["detected_genre"] if r["detected_genre"] != "Unknown" else r["genre"]
            groups.setdefault("Mixed" if g in ("", "Unknown") else g, []).append(i)
        current, order = max(groups, key=lambda g: len(groups[g])), []
        while groups:
            order += consistent(p, groups.pop(current), edges, info)
            value = {g: 0.7 * max(edges.get((p, order[-1], i), (0, 0))[1] for i in m) / 100
                     + 0.3 * table.get((current.lower(), g.lower()), 0.5) for g, m in groups.items()}
            if groups:
                current = max(value, key=value.get)
        assert got[p] == order


def test_peak_time_smoothing(small):
    tracks, edges, info = small
    placed = sequence.peak_positions(tracks.select("playlist_id", "input_pos", "bpm", F.col("energy").cast("double").alias("energy")))
    seats = {}
    for r in placed.orderBy("peak_rank").collect():
        seats.setdefault(r["playlist_id"], []).append(r["input_pos"])
    got = ordered(tracks, "Peak-Time")
    for p, order in seats.items():
        def score(i, j):
            return edges.get((p, order[i], order[j]), (0, 0))[0] if j < len(order) else 0
        for _ in range(3):
            moved = False
            for i in range(len(order) - 2):
                before = score(i, i + 1) + score(i + 1, i + 2) + score(i + 2, i + 3)
                after = score(i, i + 2) + score(i + 2, i + 1) + score(i + 1, i + 3)
                if after > before and abs(info[p, order[i]]["energy"] - info[p, order[i + 2]]["energy"]) < 20:
                    order[i + 1], order[i + 2] = order[i + 2], order[i + 1]
                    moved = True
            if not moved:
                break
        assert got[p] == order


def test_every_strategy_returns_every_slot_once(small):
    tracks, _, _ = small
    out = sequence.sequence(tracks, list(sequence.SUPPORTED), TOL)
    per = out.groupBy("strategy", "playlist_id").agg(F.count("*").alias("n"), F.count_distinct("input_pos").alias("d")).collect()
    assert len(per) == 16 and all(r["n"] == 12 and r["d"] == 12 for r in per)


def test_repeated_track_and_tiny_playlists(spark, small):
    tracks, _, _ = small
    twice = tracks.where("playlist_id = 0 AND input_pos < 3").unionByName(
        tracks.where("playlist_id = 0 AND input_pos = 1").withColumn("input_pos", F.lit(7).cast("long"))).unionByName(
        tracks.where("playlist_id = 1 AND input_pos = 4"))
    for name in sequence.SUPPORTED:
        got = ordered(twice, name)
        assert sorted(got[0]) == [0, 1, 2, 7] and got[1] == [4], name


@pytest.mark.parametrize("name", ["Energy Wave", "Consistent", "Harmonic Flow", "Warm-Up"])
def test_playlist_of_any_size(spark, small, name):
    tracks, _, _ = small
    many = tracks.where("playlist_id = 0 AND input_pos = 1").crossJoin(spark.range(1500).withColumnRenamed("id", "n")) \
        .withColumn("input_pos", F.col("n")).withColumn("bpm", 90.0 + F.floor(F.col("n") / 3) * 0.7).drop("n")
    got = ordered(many, name)
    assert sorted(got[0]) == list(range(1500))


def test_different_scoring_parameters_in_one_call(small):
    tracks, _, _ = small
    config = sequence.StrategyConfig.of({"harmonic_strictness": 3})
    both = sequence.sequence(tracks, ["Harmonic Flow", "Warm-Up", "Energy Wave"], TOL, config)
    for name in ("Harmonic Flow", "Warm-Up", "Energy Wave"):
        alone = sequence.sequence(tracks, name, TOL, config)
        assert sorted(map(tuple, both.where(F.col("strategy") == name).collect())) == sorted(map(tuple, alone.collect()))


def test_registered_strategy(small):
    tracks, _, _ = small
    sequence.register_strategy("Reversed", lambda p, **_: list(range(len(p.bpm)))[::-1])
    try:
        assert ordered(tracks, "Reversed")[0] == list(range(12))[::-1]
    finally:
        del sequence.STRATEGIES["Reversed"], sequence.SUPPORTED["Reversed"]


def test_config_clamps_and_aliases():
    config = sequence.StrategyConfig.of({"peak_position": 5, "harmonic_strictness": 99, "genre_weight": 7, "overlap": 1, "target_energy": 300})
    assert (config.peak_position, config.harmonic_strictness, config.genre_weight, config.overlap, config.target_energy) == (40, 10, 1.0, 4.0, 100.0)
    assert config.effective("Warm-Up") == {} and set(config.effective("Peak-Time Enhanced")) == {
        "peak_position", "harmonic_strictness", "allow_experimental"}


def test_pair_join_plan_has_no_nested_loop(spark, small):
    tracks, _, _ = small
    plan = pairs.candidate_pairs(tracks.select("playlist_id", "input_pos", "track_id", "bpm"), TOL)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tol", [0.0, 0.5, 6.0])
def test_pair_join_is_complete(spark, tol):
    rows = [(0, i, i, float(b)) for i, b in enumerate([60, 64, 70, 120, 120, 123.5, 124, 128, 140, 146, 174, 240])]
    df = spark.createDataFrame(rows, "playlist_id long, input_pos long, track_id long, bpm double")
    got = {(r["a_input_pos"], r["b_input_pos"]) for r in pairs.candidate_pairs(df, tol).collect()}
    want = {(i, j) for _, i, _, a in rows for _, j, _, b in rows if i != j and gap(a, b) <= tol}
    assert got == want


def test_pair_join_of_a_large_playlist(spark):
    df = spark.range(2000).selectExpr("0L AS playlist_id", "id AS input_pos", "id AS track_id", "60e0 + id AS bpm")
    near = pairs.candidate_pairs(df, TOL).where("bpm_relation = 'direct'")
    assert near.count() == 2 * (1999 + 1998 + 1997)


def test_repeated_genre_in_an_override(spark):
    defaults = spark.createDataFrame([("House", 0.2), ("Techno", 0.3)], "genre string, harmonic_weight double")
    override = spark.createDataFrame([("House", 0.5), ("House", 0.4), ("Polka", 1.0)], "genre string, harmonic_weight double")
    assert sorted(map(tuple, pairs.resolve_weights(defaults, override).collect())) == [("House", 0.5), ("Techno", 0.3)]


def test_settings_per_playlist_equal_single_runs(spark, small):
    tracks, _, _ = small
    settings = spark.createDataFrame([(0, "Peak-Time", 4.0, 99, 9, False, None), (1, "Context Flow", None, None, 3, True, 0.9)],
                                     "playlist_id long, strategy string, tol double, peak_position int, harmonic_strictness int, allow_experimental boolean, genre_weight double")
    got = sorted(tuple(r) for r in sequence.sequence_by_settings(tracks, settings, TOL).collect())
    first = sequence.sequence(tracks.where("playlist_id = 0"), "Peak-Time", 4.0, sequence.StrategyConfig.of({"peak_position": 99, "harmonic_strictness": 9, "allow_experimental": False}))
    second = sequence.sequence(tracks.where("playlist_id = 1"), "Context Flow", TOL, sequence.StrategyConfig.of({"harmonic_strictness": 3, "genre_weight": 0.9}))
    assert got == sorted(tuple(r) for r in first.unionByName(second).collect())
    plain = sequence.sequence_by_settings(tracks, settings.where("playlist_id = 7"), TOL)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sequence.sequence(tracks, "Harmonic Flow", TOL).collect()))


def test_resolved_settings(spark):
    rows = spark.createDataFrame([(1, "Warm-Up", 3, 500), (2, None, 50, None), (3, "no such", 0, 10), (4, "Peak-Time Enhanced", None, 90)],
                                 "playlist_id long, strategy string, harmonic_strictness int, peak_position int")
    got = {r["playlist_id"]: (r["strategy"], r["harmonic_strictness"], r["peak_position"], r["tol"], r["target_energy"]) for r in sequence.resolved_settings(rows, 2.5).collect()}
    assert got == {1: ("Warm-Up", 7, 70, 2.5, None), 2: ("Harmonic Flow", 10, 70, 2.5, None), 3: ("no such", 1, 70, 2.5, None), 4: ("Peak-Time Enhanced", 7, 80, 2.5, None)}


def test_weights_reach_order_and_plan(spark, small):
    from segue import refdata as R
    from segue.operators import transitions
    tracks, _, _ = small
    names = list(R.WEIGHT_DEFAULTS)
    table = lambda w: spark.createDataFrame([(g, *[float(w[n]) for n in names]) for g in R.CANONICAL_GENRES], "genre string, " + ", ".join(f"{n} double" for n in names))
    usual, energetic = table(R.WEIGHT_DEFAULTS), table({**{n: v if not n.endswith("_weight") else 0.0 for n, v in R.WEIGHT_DEFAULTS.items()}, "energy_weight": 1.0})
    order = lambda w: sorted(map(tuple, sequence.sequence(tracks, "Harmonic Flow", TOL, weights=w).collect()))
    assert order(usual) == order(None) != order(energetic)
    rows = tracks.withColumn("pos", F.col("input_pos"))
    plan = lambda w: sorted(map(str, transitions.recommend(rows, TOL, weights=w).collect()))
    assert plan(usual) == plan(None) != plan(energetic)


def by_tempo(p, info, edges, descending):
    """Warm-Up and Cool-Down one track at a time."""
    slots = sorted((i for q, i in info if q == p), key=lambda i: (-info[p, i] if descending else info[p, i], i))
    score = lambda i, j: edges.get((p, i, j), 0)
    order = []
    while slots:
        left = [i for i in slots if info[p, i] == info[p, slots[0]]]
        slots = slots[len(left):]
        while left:
            if not order and len(left) > 1:
                best = max(left, key=lambda i: sum(score(i, j) for j in left if j != i))
            elif len(left) == 1:
                best = left[0]
            else:
                best = max(left, key=lambda i: score(order[-1], i) + sequence.R.LOOKAHEAD_FUTURE_WEIGHT * max(score(i, j) for j in left if j != i))
            order.append(best)
            left.remove(best)
    return order


@pytest.fixture(scope="module")
def tied(spark):
    """Playlists of ties at the start, in a row, at the end and apart; playlist 5 has none."""
    tempi = {1: [100] * 3 + [101, 102, 102, 103, 103, 103, 110], 2: [120, 121, 121, 90, 90, 95], 3: [128] * 6, 4: [90, 91, 91, 92, 93, 93, 94, 94],
             5: [100, 104, 99, 131, 120], 6: [77.0]}
    base = rel.tracks(spark, "/root/testdata/sf0.001").where("playlist_id < 1").drop("playlist_id", "input_pos", "bpm")
    first = base.orderBy("track_id").limit(10).collect()
    rows = [(p, i * 2, float(b), first[(i * 7 + p) % len(first)]["track_id"] ) for p, values in tempi.items() for i, b in enumerate(values)]
    slots = spark.createDataFrame(rows, "playlist_id long, input_pos long, bpm double, track_id long")
    return slots.join(base.dropDuplicates(["track_id"]), "track_id").cache(), {(p, i): b for p, i, b, _ in rows}


@pytest.mark.parametrize("block", [4, 4096])
@pytest.mark.parametrize("name", ["Warm-Up", "Cool-Down"])
def test_ties_by_tempo(tied, monkeypatch, name, block):
    monkeypatch.setattr(sequence, "TEMPO_BLOCK", block)
    tracks, info = tied
    pairs_scored = scoring.scored_playlist_pairs(tracks, TOL)
    edges = {(r["playlist_id"], r["a_input_pos"], r["b_input_pos"]): r["objective"] for r in pairs_scored.collect()}
    want = {p: by_tempo(p, info, edges, name == "Cool-Down") for p in {p for p, _ in info}}
    assert ordered(tracks, name) == want
    given = sequence.sequence(tracks, name, TOL, pairs_scored=pairs_scored).orderBy("playlist_id", "pos").collect()
    assert {p: [r["input_pos"] for r in given if r["playlist_id"] == p] for p in want} == want
    assert [r["pos"] for r in given if r["playlist_id"] == 1] == list(range(10))


def test_only_ties_reach_python(tied):
    tracks, _ = tied
    runs = sequence.tempo_runs(tracks, descending=False).collect()
    held = {(r["playlist_id"], r["input_pos"]): (r["run"], r["tied"]) for r in runs}
    assert all(held[5, i][0] is None for i in (0, 2, 4, 6, 8)) and held[6, 0] == (None, False)
    assert held[1, 18] == (None, False)                                    # 110 stands alone after the last run
    assert len({held[1, i][0] for i in (8, 10, 12, 14, 16)} - {None}) == 1  # 102 and 103 follow each other
    assert held[1, 6] == (held[1, 8][0], False)                            # 101 leads them
