"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
import check_queries

# a cross-section of every area; check_queries.py runs all of them
SAMPLE = ("p8_scored_pairs", "q11_top_partners", "q8_consistent", "q2_warm_up", "a1_playlist_quality", "p21_transition_plan", "p19_risk_notes",
          "p11_track_mix_points", "a3_timeline", "g1_g2_groove", "g6_g7_key", "g13_downbeat_vote", "g19_boundaries", "g22_section_labels",
          "v1_validated_records", "s5_catalog", "j5_catalog_match", "s9_xml_marks", "c5_c6_c7_candidates", "a9_j11_evaluation", "m3_auc",
          "l5_full_weights")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in check_queries.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, sf, duck, name):
    got = driver.queries()[name](spark, sf).toPandas()
    assert check_queries.compare(got, duck.execute(driver.oracle_sql()[name]).df()) == ""


def test_every_twin_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0
