"""Fits, samples and matchings against direct computation."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import evaluate, ratings

FACTORS = evaluate.FACTORS


@pytest.fixture(scope="module")
def rated(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(240, 8))
    good = rng.uniform(size=240) < 1 / (1 + np.exp(-6 * (x[:, 0] - 0.5)))
    rows = [(str(i), 5 if g else 2, *map(float, r)) for i, (r, g) in enumerate(zip(x, good))]
    return spark.createDataFrame(rows, "pair_id string, rating int, " + ", ".join(f"{f} double" for f in FACTORS)).cache()


def test_logistic_fit_is_a_stationary_point(spark, rated):
    design = ratings.design(rated)
    beta = {r["factor"]: r["coefficient"] for r in ratings.fit_logistic(design).collect()}
    pdf = design.toPandas()
    x = np.column_stack([np.ones(len(pdf)), pdf[list(FACTORS)]])
    b = np.array([beta["intercept"], *[beta[f] for f in FACTORS]])
    grad = x.T @ (1 / (1 + np.exp(-x @ b)) - pdf["y"].to_numpy()) + 2.0 * np.concatenate([[0.0], b[1:]])
    assert np.abs(grad).max() < 1e-4
    assert beta["groove"] > 0.5 and max(abs(beta[f]) for f in FACTORS[1:]) < beta["groove"]


def test_bootstrap_finds_the_real_factor(spark, rated):
    design = ratings.design(rated)
    ci = {r["factor"]: (r["lower"], r["upper"]) for r in ratings.bootstrap_ci(design, draws=60).collect()}
    point = {r["factor"]: r["coefficient"] for r in ratings.fit_logistic(design).collect()}
    assert ci["groove"][0] > 0 and all(lo <= hi for lo, hi in ci.values())
    assert sum(lo - 0.2 <= point[f] <= hi + 0.2 for f, (lo, hi) in ci.items()) == 8


def test_maximin_equals_direct_selection(spark, rated):
    points = rated.limit(60).select(F.col("pair_id").cast("int").alias("pair_id"), *FACTORS).cache()
    got = [r["pair_id"] for r in ratings.maximin_sample(points, 25, every=6).orderBy("round").collect()]
    pdf = points.toPandas().set_index("pair_id").sort_index()
    chosen = [got[0]]
    while len(chosen) < 25:
        near = np.min([np.linalg.norm(pdf.to_numpy() - pdf.loc[c].to_numpy(), axis=1) for c in chosen], axis=0)
        near[[pdf.index.get_loc(c) for c in chosen]] = -1
        chosen.append(int(pdf.index[int(np.argmax(near))]))
    assert got == chosen


def test_boundary_matching_is_maximum(spark):
    rng = np.random.default_rng(4)
    cases = [(i, sorted(rng.integers(1, 25, size=rng.integers(0, 5)).astype(float).tolist()),
              sorted(rng.integers(1, 25, size=rng.integers(0, 5)).astype(float).tolist())) for i in range(60)]
    df = spark.createDataFrame(cases, "track_id int, pred_starts array<double>, true_starts array<double>")
    for r in evaluate.match_boundaries(df).collect():
        p, t = sorted(set(r["pred_starts"])), sorted(set(r["true_starts"]))
        best = 0
        small, large = (p, t) if len(p) <= len(t) else (t, p)
        for perm in itertools.permutations(range(len(large)), len(small)):
            best = max(best, sum(abs(small[i] - large[j]) <= 2 for i, j in enumerate(perm)))
        assert r["n_matched"] == best


def test_hash_mismatch_fails(spark):
    truth = spark.createDataFrame([(1, "adjudicated", "aa")], "track_id int, label_status string, audio_sha256 string")
    pred = spark.createDataFrame([(1, "bb")], "track_id int, audio_sha256 string")
    with pytest.raises(Exception, match="audio hash differs"):
        evaluate.join_truth(truth, pred).collect()
