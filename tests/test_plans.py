"""Plans of the queries on frames: no input planned again for every step, no nested loops."""

import pytest

import __spark_entry__ as driver

# exchanges that each query may plan (stored inputs count as scans)
MOST = {"g16_blended_novelty": 3, "g18_phrase_unit": 20, "p12_fallback_sections": 12, "g27_transitions": 12, "g10_danceability": 12,
        "q1_harmonic_flow": 6, "p21_transition_plan": 4}


@pytest.mark.parametrize("name", MOST)
def test_number_of_exchanges(spark, sf, name):
    plan = driver.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(f"Exchange {kind}") for kind in ("hash", "range", "Single")) <= MOST[name]
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
