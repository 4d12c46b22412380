"""The recap from log lines: its parts agree with the operators that stand alone, over facts that are built once."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import activity as A
from tidemark.operators import rollup as U
from tidemark.operators import sampling as S
from tidemark.operators import usage as K
from tidemark.plans import queries, report

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


@pytest.fixture(scope="module")
def built(spark):
    return queries._log_report(spark, DATA)


def test_parts_agree(spark, built):
    found, s = built
    rows = {r.window_key: r for r in report.recap(found, s).collect()}
    assert set(rows) == {"previous", "current"}
    totals = {r.window_key: r for r in A.window_totals(found.clipped).collect()}
    cost = {r.window_key: r for r in K.usage_totals(found.costed).collect()}
    slices = {r.window_key: r for r in found.slices.groupBy("window_key").agg(F.count("*").alias("n"), F.sum("active_us").alias("us")).collect()}
    for key, row in rows.items():
        assert row.hours == pytest.approx(totals[key].wall_us / 3.6e9, abs=0.005) and slices[key].us == totals[key].raw_us
        assert sum(b.sessions for b in row.buckets) == slices[key].n == sum(a.sessions for a in row.agents) == row.sampling.population == row.sampling.selected
        assert row.cost.output_tokens == cost[key].output_tokens and row.cost.cost_usd == pytest.approx(float(cost[key].cost_usd), abs=1e-6) and "s2" in row.cost.unpriced_models
        assert row.coverage.partial_agents == "agent_c" and row.sampling.coverage_complete
        assert row.lanes.covered_us == totals[key].raw_us and {g.goal_id for g in row.goals} >= {"g-stock", "g-idle"}
    assert rows["previous"].comparison is None
    want = {r.area: r.delta_min for r in U.compare(U.area_project_rollup(found.slices, A.window_totals(found.clipped)), *s.comparison).collect()}
    assert {c.area for c in rows["current"].comparison} == set(want)


def test_intervals_are_built_once(spark, built):
    found, s = built
    plans = [A.window_totals(found.clipped), U.area_project_rollup(found.slices, A.window_totals(found.clipped)), S.coverage_of(S.sketches(found.slices, found.evidence, s.zone), S.sketches(found.slices, found.evidence, s.zone).select("window_key", "internal_id"))]
    assert not any("lead(" in p._jdf.queryExecution().toString() for p in plans)


def test_sketches_are_of_texts(spark, built):
    found, s = built
    rows = S.sketches(found.slices, found.evidence, s.zone).collect()
    contained = {(r.window_key, f"{r.agent}/{r.session_id}") for r in found.slices.where("contained").collect()}
    assert len(rows) == found.slices.count() and {(r.window_key, r.internal_id) for r in rows if not r.internal_id.startswith("slice-")} == contained
    assert sum(r.chars > 0 for r in rows) > len(rows) / 2 and all(r.salience == [] for r in rows if not r.chars)


def test_prepared_messages_give_the_same(spark):
    rows = spark.createDataFrame([("a", "s", t * 1_000_000, t % 2 == 0) for t in (1, 5, 900, 901)] + [("a", "t", None, True)], "agent string, session_id string, ts_us long, is_real_user boolean")
    ready = A.with_next(rows)
    assert sorted(map(tuple, A.active_intervals(ready).collect())) == sorted(map(tuple, A.active_intervals(rows).collect()))
    assert sorted(map(tuple, A.sessions(ready).collect())) == sorted(map(tuple, A.sessions(rows).collect()))
