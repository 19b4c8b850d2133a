"""Resampling counts: every draw picks n of n rows, blocks agree with each other, and counts look multinomial."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from segue.operators import mining, resample


@pytest.mark.parametrize("n", [1, 5, 1024, 1025, 5000])
def test_every_draw_picks_n(n):
    blocks = [resample.multiplicities(b, n, 30, 4) for b in range(-(-n // resample.BLOCK))]
    assert sum(b.shape[1] for b in blocks) == n and all(b.shape[0] == 30 for b in blocks)
    assert (sum(b.sum(axis=1) for b in blocks) == n).all()
    assert (resample.multiplicities(0, n, 30, 4) == blocks[0]).all()


def test_counts_spread_like_a_resample():
    times = np.concatenate([resample.multiplicities(b, 3000, 400, 1) for b in range(3)], axis=1)
    assert abs(times.mean() - 1.0) < 1e-12 and abs(times.var() - (1 - 1 / 3000)) < 0.01
    assert abs((times == 0).mean() - np.exp(-1)) < 0.005
    halves = times[:, :1500].sum(axis=1)
    assert abs(halves.mean() - 1500) < 6 and abs(halves.std() - np.sqrt(750)) < 4
    assert (resample.multiplicities(0, 3000, 400, 2) != times[:, :1024]).any()


def _windows(spark, rows):
    """(key, half width of the raised onset, centre level, edge level) as windows of 121 seconds."""
    at = F.sequence(F.lit(0), F.lit(120))
    df = spark.createDataFrame(rows, "key long, half int, centre double, edge double")
    return df.select("key", F.transform(at, lambda s: F.when(F.abs(s - 60) <= F.col("half"), 2.0).otherwise(1.0)).alias("onset"),
                     F.transform(at, lambda s: F.when(F.abs(s - 60) <= 3, F.col("centre")).when(F.abs(s - 60) < 20, F.col("edge")).otherwise(1.0)).alias("mids"))


@pytest.mark.parametrize("chunk", [7, 50])
def test_dip_ranges_equal_whole_resamples(spark, monkeypatch, chunk):
    """Three blocks of one group, few rows and ties in another, a single transition in the third."""
    monkeypatch.setattr(mining, "DRAW_CHUNK", chunk)
    rng = np.random.default_rng(2)
    rows = [(i, 3, *map(float, rng.normal(1.0, 0.1, 2))) for i in range(2600)]
    rows += [(10_000 + i, 9, 0.8 if i % 2 else 0.9, 1.0) for i in range(12)] + [(20_000, 20, 0.5, 1.0)]
    windows, draws, seed = _windows(spark, rows), 120, 5
    got = {r["grp"]: r for r in mining.dip_ranges(windows, "key", draws, seed).collect()}
    assert sorted(got) == ["kurz", "lang", "mittel"]
    _, spots = mining._blend_spots(windows, ["key"])
    spots = spots.withColumn("h", mining.digest_number(F.lit(seed), F.col("key"))).toPandas()
    for grp, part in spots.groupby("grp"):
        if len(part) < 2:
            assert got[grp]["lower"] is None and got[grp]["carries"] is None
            continue
        part, n = part.sort_values(["h", "key"]), len(part)
        times = np.hstack([resample.multiplicities(b, n, draws, seed) for b in range(-(-n // resample.BLOCK))])
        assert (times.sum(axis=1) == n).all()
        depth = [1.0 - np.median(np.repeat(part["centre"].to_numpy(), t)) / np.median(np.repeat(part["edge"].to_numpy(), t)) for t in times]
        assert np.allclose([got[grp]["lower"], got[grp]["upper"]], np.percentile(depth, [2.5, 97.5]), atol=1e-12)
        assert got[grp]["carries"] == (np.percentile(depth, 2.5) > 0)


def test_dip_ranges_tell_an_effect_from_none(spark):
    rng = np.random.default_rng(1)
    none = [(i, 3, float(1 + rng.normal(0, 0.05)), float(1 + rng.normal(0, 0.05))) for i in range(60)]
    clear = [(100 + i, 10, 0.8, 1.0) for i in range(60)]
    got = {r["grp"]: r for r in mining.dip_ranges(_windows(spark, none + clear), "key", 200).collect()}
    assert not got["kurz"]["carries"] and got["kurz"]["lower"] <= 0.0 <= got["kurz"]["upper"]
    assert got["mittel"]["carries"] and abs(got["mittel"]["lower"] - 0.2) < 1e-6
    assert mining.dip_ranges(_windows(spark, []), "key", 20).collect() == []
