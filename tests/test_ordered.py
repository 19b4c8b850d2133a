"""Blocked order-dependent helpers against plain computations, with one hot key."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from segue.operators import mining, ordered


def hot_rows(spark):
    """One key holds two thirds of the rows."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1).alias("key"), F.col("id"),
        (F.pmod(F.col("id") * 7919, F.lit(1000)) / 10.0).alias("v"))


def test_dense_index(spark):
    rows = hot_rows(spark)
    got = ordered.dense_index(rows, ["key"], ["v", "id"], F.floor(F.col("v") / 5.0), "i")
    want = rows.withColumn("i", (F.row_number().over(Window.partitionBy("key").orderBy("v", "id")) - 1).cast("long"))
    assert got.select("id", "i").exceptAll(want.select("id", "i")).count() == 0


def test_blockwise_moving_sum(spark):
    rows = spark.range(500).select(F.lit("t").alias("k"), F.col("id").alias("i"), (F.col("id") % 11).alias("v"))
    cut = ordered.blockwise(rows, "i", 64, 2, 2)
    w = Window.partitionBy("k", "block").orderBy("i").rowsBetween(-2, 2)
    got = {r["i"]: r["s"] for r in cut.withColumn("s", F.sum("v").over(w)).where("own").collect()}
    v = np.arange(500) % 11
    assert got == {i: int(v[max(0, i - 2):i + 3].sum()) for i in range(500)}


def test_quantiles(spark):
    rows = hot_rows(spark)
    got = {r["key"]: (r["a"], r["b"]) for r in ordered.quantiles(rows, ["key"], "v", {"a": 0.1, "b": 0.5}).collect()}
    pdf = rows.toPandas()
    for key, part in pdf.groupby("key"):
        assert np.allclose(got[key], np.percentile(part["v"], [10, 50]))


def test_group_quantiles_with_one_huge_group(spark):
    """Groups of 1, 2, 3 and a few rows, ties, nulls only, and one that holds most rows."""
    rng = np.random.default_rng(9)
    groups = {0: rng.normal(size=60_000), 1: [4.0], 2: [1.0, 3.0], 3: [2.0, 2.0, 9.0], 4: rng.integers(0, 3, 5000), 5: rng.exponential(size=37), 6: [], 7: [5.0] * 999 + [6.0]}
    rows = [(k, i, float(v), float(-v)) for k, values in groups.items() for i, v in enumerate(values)] + [(6, 0, None, None), (5, 99, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, i int, v double, w double")
    got = {r["k"]: r for r in ordered.group_quantiles(df, "k", {"v": {"a": 0.1, "b": 0.5, "c": 0.95, "d": 1.0}, "w": {"e": 0.25}}, "i").collect()}
    for k, values in groups.items():
        if len(values):
            assert np.allclose([got[k][n] for n in "abcd"], np.percentile(values, [10, 50, 95, 100]), atol=1e-12), k
            assert np.allclose(got[k]["e"], np.percentile([*(-np.asarray(values, dtype=float)), *([1.0] if k == 5 else [])], 25), atol=1e-12)
        else:
            assert got[k]["a"] is None and got[k]["e"] is None


def test_attach_keeps_every_row(spark):
    rows = hot_rows(spark)
    per_key = rows.groupBy("key").agg(F.max("v").alias("top"))
    assert ordered.attach(rows, per_key, "key", "id").count() == 3000


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(1)
    data = [("f", float(rng.integers(0, 20)), bool(rng.integers(0, 2))) for _ in range(400)]
    got = mining.auc(spark.createDataFrame(data, "factor string, value double, positive boolean"), ["factor"]).collect()[0]["auc"]
    pos = np.array([v for _, v, p in data if p])
    neg = np.array([v for _, v, p in data if not p])
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert abs(got - want) < 1e-12
    empty = spark.createDataFrame([("f", 1.0, True)], "factor string, value double, positive boolean")
    assert mining.auc(empty, ["factor"]).collect()[0]["auc"] == 0.5


def test_auc_interval_brackets_the_point(spark):
    rng = np.random.default_rng(2)
    data = [("f", float(rng.normal(0.8 * p)), bool(p), int(m)) for m in range(12) for p in (0, 1) for _ in range(15)]
    df = spark.createDataFrame(data, "factor string, value double, positive boolean, mix_id int")
    r = mining.auc_interval(df, draws=300).collect()[0]
    assert r["lower"] < r["auc"] < r["upper"] and r["upper"] - r["lower"] < 0.3
    single = mining.auc_interval(df.where("mix_id = 0"), draws=20).collect()[0]
    assert (single["lower"], single["upper"]) == (0.0, 1.0)


def test_concordance_counts_pairs_of_clusters(spark, monkeypatch):
    """Several tiles and draw blocks, ties, clusters with one class only, against counting every pair."""
    monkeypatch.setattr(mining, "TILE", 3)
    monkeypatch.setattr(mining, "DRAW_BLOCK", 4)
    rng = np.random.default_rng(6)
    data = [(f, float(rng.integers(0, 12)), bool(rng.integers(0, 2)) if m else True, int(m)) for f in ("f", "g") for m in range(8) for _ in range(12)] + [("h", 1.0, True, 3)]
    df = spark.createDataFrame(data, "factor string, value double, positive boolean, mix_id int").repartition(5)
    clusters = spark.createDataFrame([(m, m) for m in range(8)], "mix_id int, cluster_idx long")
    for r in mining.concordance(df, "factor", "mix_id", clusters).collect():
        neg = [[v for f, v, p, m in data if f == r["factor"] and not p and m == j] for j in range(8)]
        if r["i"] < 0:
            assert r["won"] == [float(len(x)) for x in neg]
        else:
            pos = [v for f, v, p, m in data if f == r["factor"] and p and m == r["i"]]
            assert r["won"] == [float(sum((a > b) + (a == b) / 2 for a in pos for b in x)) for x in neg] and r["n_pos"] == len(pos)
    got = {r["factor"]: r for r in mining.auc_interval(df, draws=11).collect()}
    assert got["f"]["lower"] <= got["f"]["upper"] and (got["h"]["lower"], got["h"]["upper"]) == (0.0, 1.0)


def test_buckets_are_even_with_one_extreme_value(spark):
    values = spark.range(20000).select((F.col("id") / 20000.0).alias("v")).unionByName(spark.createDataFrame([(1e9,), (-1e12,)], "v double"))
    sizes = [r["count"] for r in ordered.with_bounds(values, [], "v").withColumn("b", ordered.value_bucket("v")).groupBy("b").count().collect()]
    assert sum(sizes) == 20002 and max(sizes) < 3 * 20002 / ordered.BUCKETS
    got = ordered.quantiles(values, [], "v", {"m": 0.5}).first()["m"]
    assert abs(got - np.median([-1e12, *(np.arange(20000) / 20000.0), 1e9])) < 1e-9


def test_range_index_with_an_odd_name(spark):
    rows = spark.range(5000).select(F.lit("f").alias("folder"), F.concat(F.lit("/music/same/prefix/"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("path"))
    rows = rows.unionByName(spark.createDataFrame([("f", "A")], "folder string, path string"))
    got = {r["path"]: r["i"] for r in ordered.range_index(rows, ["folder"], ["path"], "i").collect()}
    assert got == {p: i for i, p in enumerate(sorted(got))}
