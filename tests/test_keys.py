"""Golden rules of keys, tempo and grids."""

import pytest
from pyspark.sql import functions as F

from segue import refdata as R
from segue.functions import grid, keys, tempo


def one(spark, *columns):
    return spark.range(1).select(*columns).collect()[0]


def test_all_24_wheel_codes():
    codes = R.wheel_codes()
    assert len(codes) == 24 and len(set(codes.values())) == 24
    assert codes["A", "Minor"] == "8A" and codes["C", "Major"] == "8B" and codes["G#", "Minor"] == "1A"


SCORES = [("8A", "8A", 100), ("8A", "8B", 90), ("8B", "8A", 85), ("8A", "9A", 80), ("8A", "7A", 80), ("12A", "1A", 80),
          ("8A", "10A", 75), ("8A", "12A", 70), ("8A", "3A", 65), ("8A", "9B", 60), ("8A", "7B", 60), ("8A", "2A", 8), ("", "8A", 10)]


@pytest.mark.parametrize("relation,penalty", [("direct", 1.0), ("half", 0.85)])
def test_harmonic_rules(spark, relation, penalty):
    rows = spark.createDataFrame(SCORES, "a string, b string, want int")
    a, b = F.col("a"), F.col("b")
    score = keys.harmonic_score(keys.camelot_number(a), keys.camelot_letter(a), keys.camelot_number(b), keys.camelot_letter(b),
                                F.lit(1.0), F.lit(relation), 3.0)
    for r in rows.select("a", "b", "want", score.alias("got")).collect():
        assert r["got"] == max(5, int(r["want"] * penalty)), r


def test_strictness_and_gate(spark):
    def score(diff, strictness, experimental, to):
        return keys.harmonic_score(F.lit(8), F.lit("A"), F.lit(to), F.lit("A"), F.lit(diff), F.lit("direct"), 3.0, strictness, experimental)
    r = one(spark, score(3.1, 7, True, 8).alias("gated"), score(0.0, 10, True, 12).alias("strict"),
            score(0.0, 7, False, 12).alias("plain"), score(0.0, 1, True, 2).alias("loose"))
    assert (r["gated"], r["strict"], r["plain"], r["loose"]) == (0, 53, 8, 14)


@pytest.mark.parametrize("a,b,diff,relation", [(128.0, 126.0, 2.0, "direct"), (140.0, 70.0, 0.0, "half"), (70.0, 140.0, 0.0, "double"),
                                               (140.0, 73.0, 6.0, "half"), (0.0, 120.0, 120.0, "direct")])
def test_tempo_relation(spark, a, b, diff, relation):
    r = one(spark, tempo.effective_bpm_diff(F.lit(a), F.lit(b)).alias("d"), tempo.bpm_relation(F.lit(a), F.lit(b)).alias("r"))
    assert r["d"] == pytest.approx(diff) and r["r"] == relation


def test_quantize_tolerance(spark):
    """A point 3 ms behind the grid stays on it instead of jumping a phrase."""
    r = one(spark, grid.quantize_to_grid(F.lit(82.29), F.lit(27.4286), 0.0, "ceil").alias("on"),
            grid.quantize_to_grid(F.lit(82.40), F.lit(27.4286), 0.0, "ceil").alias("next"),
            grid.quantize_to_grid(F.lit(5.0), F.lit(0.0), 0.0, "ceil").alias("none"))
    assert r["on"] == pytest.approx(82.2858) and r["next"] == pytest.approx(109.7144) and r["none"] == 5.0
