"""Distributed suppression against the greedy pass, on chains that cross many blocks and on one long mix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import mining, suppress


def greedy(hits, gap):
    """The same choice by one grid cell a gap: taken hits lie at least a gap apart, so only two cells can be near."""
    taken = {}
    for t, _ in sorted(hits, key=lambda h: (h[1], h[0]), reverse=True):
        cell = int(t // gap)
        if all(abs(t - g) >= gap for k in (cell - 1, cell, cell + 1) for g in taken.get(k, ())):
            taken.setdefault(cell, []).append(t)
    return sorted(t for cell in taken.values() for t in cell)


def chosen(spark, hits, gap):
    df = spark.createDataFrame([(k, float(t), float(s)) for k, rows in hits.items() for t, s in rows], "k string, t double, s double")
    out = {k: [] for k in hits}
    for r in suppress.strongest_apart(df.withColumn("gap", F.lit(float(gap))), "k", "t", "gap", ["s", "t"]).collect():
        out[r["k"]].append(r["t"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("first, last", [(64, 1 << 16), (1, 4)])
def test_equals_the_greedy_pass(spark, monkeypatch, first, last):
    monkeypatch.setattr(suppress, "FIRST_SPAN", first)
    monkeypatch.setattr(suppress, "LAST_SPAN", last)
    rng = np.random.default_rng(8)
    hits = {"random": list(zip(rng.uniform(0, 3000, 900), rng.normal(size=900))), "ties": [(t, t % 3) for t in range(0, 400)],
            "rising": [(t, t) for t in range(0, 260, 3)], "falling": [(t, -t) for t in range(0, 260, 3)], "one": [(5.0, 1.0)], "same place": [(7.0, 1.0), (7.0, 2.0)]}
    assert chosen(spark, hits, 10) == {k: greedy(v, 10) for k, v in hits.items()}


def test_no_hits(spark):
    empty = spark.createDataFrame([], "k string, t double, s double, gap double")
    assert suppress.strongest_apart(empty, "k", "t", "gap", ["s"]).count() == 0


def test_one_mix_of_a_million_frames(spark):
    n = 1_000_000
    frames = spark.range(n).select(F.lit("m").alias("mix_id"), F.col("id").alias("frame_idx"), F.col("id").cast("double").alias("t_sec"),
                                   F.transform(F.sequence(F.lit(1), F.lit(13)), lambda i: F.pmod(F.xxhash64(F.floor(F.col("id") / 37), i), F.lit(1000)) / 1000.0).alias("mfcc"))
    got = mining.find_transitions(frames, 1.0, 1.0).orderBy("transition_idx").toPandas()
    assert got["transition_idx"].tolist() == list(range(len(got))) and len(got) > 10_000
    assert (np.diff(got["t"]) >= 60.0).all()
