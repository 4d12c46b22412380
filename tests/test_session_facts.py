"""Scheduled sessions, subagents and session texts from logs; places and exact costs."""

import json

from pyspark.sql import functions as F

from tidemark.operators import activity as A
from tidemark.operators import usage as K
from tidemark.operators.lineage import numbered
from tidemark.operators.sampling import with_texts
from tidemark.sources import logs


def line(kind, text, second, cwd=None):
    return {"type": kind, "timestamp": f"2026-01-05T10:00:{second:02d}Z", "cwd": cwd, "message": {"role": kind, "content": text}}


def test_sessions_of_message_logs(spark, tmp_path):
    files = {
        "projects/p/one.jsonl": [line("user", " ", 0), line("user", "<scheduled-task> do", 1, "/z"), line("user", "go on", 2, "/a"), line("assistant", "done", 3), line("assistant", "", 4)],
        "projects/p/two.jsonl": [line("user", "x" * 300, 0), line("user", "<scheduled-task> late", 5), line("user", "last", 6)],
        "projects/p/two/subagents/three.jsonl": [line("user", "inside", 0), line("user", "inside", 50)],
    }
    for name, lines in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("".join(json.dumps(x) + "\n" for x in lines))
    messages = logs.message_log(logs.raw_lines(spark, [str(tmp_path)], recursive=True))
    got = {r.session_id: r for r in A.sessions(messages).collect()}
    assert set(got) == {"one", "two"} and got["one"].is_scheduled and not got["two"].is_scheduled
    assert got["one"].engaged and got["one"].user_msg_count == 1
    facts = {r.session_id: r for r in A.session_facts(messages).collect()}
    assert (facts["one"].cwd, facts["one"].first_user_text, facts["one"].final_assistant_text) == ("/z", "go on", "done")
    assert (facts["two"].first_user_text, facts["two"].latest_user_text, facts["two"].final_assistant_text) == ("x" * 200, "last", None)


def test_numbered_is_dense(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k")).repartition(7)
    assert {r.k: r.n for r in numbered(rows, ["k"], "n").collect()} == {i: i + 1 for i in range(500)}
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_costs_are_exact(spark):
    rates = spark.createDataFrame([("m", 0.1, 0.2, 0.3, 0.7)], "model string, inp double, out double, cw double, cr double")
    rows = spark.createDataFrame([("w", "m", 1, 1, 2, 3, 4)] * 1000, "window_key string, model string, turns long, input_tokens long, cache_creation long, cache_read long, output_tokens long")
    for parts in (1, 7):
        t = K.usage_totals(K.cost(rows.repartition(parts), rates)).select(K.rounded("cost_usd"), K.rounded("savings_usd", 4)).first()
        assert (t.cost_usd, t.savings_usd) == (0.0036, -0.0022)


def test_texts_in_plan_order(spark):
    plan = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "id string, rank int")
    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, text string")
    assert [r.text for r in with_texts(plan, texts, "id", "rank").collect()] == ["B", "A"]
