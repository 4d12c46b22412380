"""Evidence of slices, stored tables, id sets and sort keys."""

import os
from datetime import UTC, date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions.time import report_window, snapshot_age_days, to_us, windows_frame
from tidemark.operators import evidence as E
from tidemark.operators import repo as R
from tidemark.operators import sampling as S
from tidemark.operators import summaries as M
from tidemark.operators import usage as K
from tidemark.operators.stored import BucketTable
from tidemark.sources import prices as P

S1 = 1_000_000
MESSAGE = "agent string, session_id string, ts_us long, path string, line_no int, role string, text string, is_real_user boolean, project_raw string"


def said(spark, times, session="s"):
    rows = [("a", session, t * S1 if t is not None else None, "f", i, "user" if i % 2 == 0 else "assistant", f"text {i}", i % 2 == 0, "p") for i, t in enumerate(times)]
    return spark.createDataFrame(rows, MESSAGE)


def test_evidence_does_not_depend_on_the_end(spark):
    messages = said(spark, [10, 20, 400, 5000, None]).unionByName(said(spark, [15, 15], "t"))
    w = lambda until: windows_frame(spark, [("w", 0, until * S1)])
    early, late, later = (E.window_evidence(messages, w(u)).orderBy("session_id").collect() for u in (401, 4999, 5001))
    assert [r.asDict() for r in early] == [r.asDict() for r in late]
    first, again = early[0], later[0]
    assert (first.first_us, first.last_us, first.msg_count, first.user_msg_count, first.between_us, first.first_text, first.last_text) == (10 * S1, 400 * S1, 3, 2, 310 * S1, "text 0", "text 2")
    assert first.fingerprint != again.fingerprint and first.slice_id != again.slice_id and first.slice_id.startswith("slice-") and len(first.slice_id) == 30
    assert early[1].fingerprint == later[1].fingerprint
    assert E.window_evidence(messages.limit(0), w(10)).count() == 0
    shuffled = E.window_evidence(messages.orderBy(F.desc("line_no")).repartition(3), w(401)).orderBy("session_id").collect()
    assert shuffled == early


def test_evidence_is_checked(spark):
    messages = said(spark, [10, 20, 400, 5000])
    windows = windows_frame(spark, [("w", 0, 1000 * S1), ("v", 1000 * S1, 9000 * S1)])
    good = E.window_evidence(messages, windows)
    reasons = lambda rows: sorted((r.window_key, r.reason) for r in E.evidence_violations(rows, messages, windows).collect())
    assert reasons(good) == []
    assert reasons(good.withColumn("between_us", F.col("between_us") + 1)) == [("v", "sum"), ("w", "sum")]
    assert reasons(good.withColumn("last_us", F.when(F.col("window_key") == "w", 2000 * S1).otherwise(F.col("last_us")))) == [("w", "bounds")]
    assert reasons(good.withColumn("first_text", F.lit("x"))) == [("v", "fingerprint"), ("w", "fingerprint")]
    assert reasons(E.named(good.drop("fingerprint", "slice_id").withColumn("first_text", F.lit("x")))) == [("v", "facts"), ("w", "facts")]


def test_id_sets(spark):
    rows = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "1"), ("c", "3"), ("d", None)], "g string, id string")
    got = {r.g: r.digest for r in M.id_sets(rows.repartition(5), ["g"], ["id"]).collect()}
    assert got["a"] == got["b"] and len({got["a"], got["c"], got["d"]}) == 3
    assert "collect_" not in M.id_sets(rows, ["g"], ["id"])._jdf.queryExecution().toString()
    plain = E.summary_fingerprint(F.lit("f"), F.lit(None).cast("string"), F.lit("p"), F.lit("t"))
    other = E.summary_fingerprint(F.lit("f"), F.lit("x"), F.lit("p"), F.lit("t"))
    assert spark.range(1).select(plain == other).first()[0] is False


SUMMARY = "session_id string, summary string, source string, evidence_fingerprint string, observed_evidence_fingerprint string, created_at long"


def files(path):
    return {(folder, f) for folder, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_stored_table_rewrites_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "summaries")
    table = BucketTable(spark, path, buckets=16)
    table.create(spark.createDataFrame([(f"s{i}", f"old {i}", M.PROVIDED if i % 2 else M.GENERATED, "f", "f", 1) for i in range(100)], SUMMARY))
    before = files(path)
    change = spark.createDataFrame([("s1", "new", M.GENERATED, "g", "g", 2), ("s2", "new", M.GENERATED, "g", "g", 2), ("fresh", "new", M.GENERATED, "g", "g", 2)], SUMMARY)
    assert table.upsert(change, M.upsert) == {"added": 1, "deleted": 0, "changed": 1, "buckets": len({r[0] for r in change.select(table._bucket()).collect()})}
    touched = {f"{path}/bucket_no={r[0]}" for r in change.select(table._bucket()).collect()}
    assert {f for f in before if f[0] not in touched} == {f for f in files(path) if f[0] not in touched} and not {f for f in before if f[0] in touched} & files(path)
    rows = {r.session_id: r.summary for r in table.read().collect()}
    assert len(rows) == 101 and (rows["s1"], rows["s2"], rows["fresh"], rows["s3"]) == ("old 1", "new", "new", "old 3")
    seen = spark.createDataFrame([("s4", "h"), ("s5", "h"), ("nobody", "h")], "session_id string, fingerprint string")
    got = table.upsert(seen, M.observe)
    assert (got["added"], got["deleted"], got["changed"]) == (0, 0, 1)
    assert {r.observed_evidence_fingerprint for r in table.read().where("session_id in ('s4')").collect()} == {"h"}
    gone = spark.createDataFrame([("s7",), ("s8",), ("nobody",)], "session_id string")
    assert table.delete(gone)["deleted"] == 2 and table.read().count() == 99
    assert table.upsert(change.limit(0), M.upsert) == {"added": 0, "deleted": 0, "changed": 0, "buckets": 0}
    assert table.delete(None)["deleted"] == 99 and files(path) == set()


def test_stored_labels_and_stars(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "labels"), buckets=4)
    kind = "session_id string, bucket string, created_at long"
    table.create(spark.createDataFrame([("a", "one", 1), ("b", "two", 1)], kind))
    assert table.upsert(spark.createDataFrame([("a", "three", 2), ("c", "one", 2)], kind), M.upsert_labels)["changed"] == 1
    assert {r.session_id: r.bucket for r in table.read().collect()} == {"a": "three", "b": "two", "c": "one"}
    stars = spark.createDataFrame([("r", "2024-01-01", 5), ("r", "2024-01-02", 6)], "repo string, captured_at string, stars long")
    today = spark.createDataFrame([("r", "2024-01-02", 9), ("q", "2024-01-02", 1)], "repo string, captured_at string, stars long")
    assert sorted(map(tuple, R.record_stars(stars, today).collect())) == [("q", "2024-01-02", 1), ("r", "2024-01-01", 5), ("r", "2024-01-02", 9)]


def test_backfill_outcomes(spark):
    work = spark.createDataFrame([("a", True, True), ("b", True, True), ("c", True, False), ("d", False, True), ("e", True, True)], "session_id string, wanted boolean, has_evidence boolean")
    answers = spark.createDataFrame([("a",), ("e",)], "session_id string")
    table = spark.createDataFrame([("e", M.GENERATED), ("a", M.EXTRACTED)], "session_id string, source string")
    assert M.backfill_outcomes(work, answers, table).first().asDict() == {"summarized": 2, "fallback": 1, "skipped": 1, "already": 1, "regenerated": 1}


def test_one_name_in_two_spellings_sorts_together(spark):
    """Composed and decomposed, upper and lower case: one place in the order, told apart by the name itself."""
    names = ["café", "café", "CAFÉ", "cafz", "cafa"]
    rows = [("w", f"s{i}", "x", n, "d", 10, i, 1, []) for i, n in enumerate(names)]
    frame = spark.createDataFrame(rows, "window_key string, internal_id string, provider string, project string, local_day string, active_us long, start_us long, chars long, salience array<string>")
    tops = S._tops(S.canonical(frame), "project", "project_top", 2).orderBy("pos").collect()
    assert [r.internal_id for r in tops] == ["s4", "s2", "s1", "s0", "s3"]


def test_price_overrides_from_a_file(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[prices]\nsnapshot_date = "2026-01-02"\nbroken = 3\n[prices."Opus-Mine"]\ninput = 7\noutput = "much"\n[prices.new]\noutput = 2.5\n')
    own, date = P.read_overrides(spark, str(tmp_path / "c.toml"))
    assert date == "2026-01-02" and sorted(map(tuple, own.collect())) == [("new", None, 2.5, None, None), ("opus-mine", 7.0, None, None, None)]
    rates = "model string, inp double, out double, cw double, cr double"
    prices = K.layered_prices([(spark.createDataFrame([("opus", 5.0, 25.0, 6.0, 0.5), ("haiku", 1.0, 5.0, 1.2, 0.1)], rates), "default")], ["opus", "haiku"])
    got = {r.model: tuple(r)[1:] for r in P.overridden(prices, own, spark.createDataFrame([], "model string, target string")).select("model", "inp", "out", "cw", "cr", "provenance", "is_family").collect()}
    assert got == {"opus": (5.0, 25.0, 6.0, 0.5, "default", True), "haiku": (1.0, 5.0, 1.2, 0.1, "default", True), "opus-mine": (7.0, 25.0, 6.0, 0.5, "user", False), "new": (0.0, 2.5, 0.0, 0.0, "user", False)}


def test_report_windows_are_labelled():
    now = datetime(2024, 3, 13, 9, 30, tzinfo=UTC)
    day = lambda *d: to_us(datetime(*d, tzinfo=UTC))
    assert report_window("week", now) == ("2024-03-06_2024-03-13", to_us(now - timedelta(days=7)), to_us(now))
    assert report_window(None, now) == report_window("month", now) == report_window("2024-03", now) == ("2024-03-01_2024-03-13", day(2024, 3, 1), to_us(now))
    assert report_window("2023-12", now) == ("2023-12", day(2023, 12, 1), day(2024, 1, 1))
    assert report_window("all", now) == ("all-thru-2024-03-13", day(2000, 1, 1), to_us(now))
    for bad in ("2024-13", "year", ""):
        with pytest.raises(ValueError):
            report_window(bad, now)
    assert snapshot_age_days(date(2024, 1, 1), date(2024, 4, 1)) == (91, True) and snapshot_age_days(date(2024, 1, 1), date(2024, 3, 31)) == (90, False)


@pytest.mark.parametrize("connected", [True, False])
def test_totals_need_a_connection(spark, connected):
    rows = spark.createDataFrame([("w", "r", 1, 2, 3, True)], "window_key string, repo string, commits long, merged long, releases long, is_enriched boolean")
    assert R.totals(rows, connected).first().complete is connected
