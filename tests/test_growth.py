"""What large tables need: work that is done once and doesn't grow in rounds."""

import random

from tidemark.operators import usage as K
from tidemark.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def _series(spark, of):
    rows = [(b, t, "m", v, 0, 0, 0) for b, values in of.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "branch string, ts_us long, model string, input_total long, cached_total long, write_total long, output_total long")


def _reached(own, theirs):
    at = 0
    for v in theirs:
        at += at < len(own) and own[at] == v
    return at


def test_inherited_prefix_takes_no_more_jobs_for_longer_series(spark):
    def jobs(n):
        series = _series(spark, {"a": list(range(n)), "b": list(range(n))})
        tree = spark.createDataFrame([("b", "a")], "branch string, ancestor string")
        spark.sparkContext.setJobGroup(f"inherited-{n}", "")
        try:
            assert [tuple(r) for r in K.inherited_prefix(series, tree).collect()] == [("b", n)]
            return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"inherited-{n}"))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    assert jobs(3) == jobs(300)


def test_inherited_prefix_against_plain_reading(spark):
    rng = random.Random(41)
    of = {f"s{i}": [rng.randrange(3) for _ in range(rng.randrange(0, 40))] for i in range(60)}
    pairs = {(f"s{i}", f"s{rng.randrange(60)}") for i in range(50) for _ in range(3)}
    pairs = sorted((b, a) for b, a in pairs if b != a)
    want = {}
    for b, a in pairs:
        want[b] = max(want.get(b, 0), _reached(of[b], of[a]))
    tree = spark.createDataFrame(pairs + pairs[:5], "branch string, ancestor string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # pairs and places lie across batches
    try:
        got = {r.branch: r.inherited for r in K.inherited_prefix(_series(spark, of), tree).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and max(want.values()) > 10


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_log_lines_are_parsed_once(spark):
    for name in ("log_messages_a", "log_messages_b", "log_messages_c", "log_usage_a", "log_usage_b", "log_usage_c", "log_sessions"):
        assert "parse_json" not in _plan(QUERIES[name](spark, SMALL)) and "to_json" not in _plan(QUERIES[name](spark, SMALL)), name


def test_recap_reads_its_facts_and_not_the_events_again(spark):
    assert "event_type" not in _plan(QUERIES["recap_json"](spark, SMALL))
