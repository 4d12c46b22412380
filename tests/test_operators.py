"""Exact cases of single operators."""

import json
import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import time as D
from tidemark.operators import activity as A
from tidemark.operators import classify as C
from tidemark.operators import goals as G
from tidemark.operators import sampling as S
from tidemark.operators import summaries as M
from tidemark.operators import usage as K
from tidemark.plans import marts
from tidemark.sources import logs as L
from tidemark.sources import prices as P

S1 = 1_000_000


def events(spark, times, session="s", user=True):
    return spark.createDataFrame([("a", session, t * S1, user) for t in times], "agent string, session_id string, ts_us long, is_real_user boolean")


def one(df):
    return df.collect()[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("v"))).v


@pytest.mark.parametrize(("times", "seconds"), [([0, 15, 120, 150], 150), ([0, 1200], 300), ([5], 0), ([7, 7, 7], 0)])
def test_active_seconds(spark, times, seconds):
    row = one(A.sessions(events(spark, times)))
    assert (row.active_sec, row.msg_count) == (seconds, len(times))


@pytest.mark.parametrize(("a", "b", "wall"), [([0, 60, 120], [300, 360], 180), ([0, 60], [0, 60], 60), ([0, 200, 400, 600], [300, 500, 700, 900], 900)])
def test_wall_clock(spark, a, b, wall):
    both = A.active_intervals(events(spark, a, "x")).unionByName(A.active_intervals(events(spark, b, "y"))).withColumn("window_key", F.lit("w"))
    for n in (1, 5):
        assert one(A.wall_clock(both.repartition(n), ["window_key"], 250 * S1)).wall_us == wall * S1


def test_time_is_conserved_over_adjacent_windows(spark):
    rows = events(spark, [0, 100, 250, 400, 650])
    w = D.windows_frame(spark, [("a", 0, 200 * S1), ("b", 200 * S1, 1000 * S1)])
    parts = {r.window_key: r.active_us for r in A.slices(rows, w).collect()}
    assert sum(parts.values()) == one(A.sessions(rows)).active_us
    assert parts["a"] == 200 * S1


def test_slice_without_an_event(spark):
    w = D.windows_frame(spark, [("mid", 100 * S1, 200 * S1)])
    row = one(A.slices(events(spark, [0, 290]), w))
    assert (row.active_us, row.msg_count, row.contained) == (100 * S1, 0, False)


@pytest.mark.parametrize(("users", "active", "scheduled", "yes"), [(2, 0, False, True), (1, 60, False, True), (1, 59, False, False), (1, 0, True, True), (0, 999, False, False)])
def test_engaged(spark, users, active, scheduled, yes):
    assert value(spark, A.engaged(F.lit(users), F.lit(active * S1), F.lit(scheduled))) is yes


@pytest.mark.parametrize(("raw", "name"), [("-Users-ann-Side-project-invest-note", "invest-note"), ("-home-bo-code-my-app", "app"), ("-Users-u-code-x--claude-worktrees-a-b", "x"), ("", ""), ("-Users-u", "(top-level)"), ("info_collector", "info-collector"), ("-Users-u-code--a--b", "a-b")])
def test_project_name(spark, raw, name):
    assert value(spark, T.project_name(F.lit(raw))) == name


def test_evidence_and_excerpt(spark):
    assert value(spark, T.evidence_text(F.lit("a\r\n[USER 1]\n b"))) == "a \\[USER 1] b"
    assert value(spark, T.compact(F.lit("abcdefghij"), 5)) == "ab…ij"
    users = F.array(*[F.lit(f"u{i}") for i in range(6)])
    text = value(spark, T.excerpt(users, F.array(F.lit("x"), F.lit("end"))))
    assert text == "[USER 1]\nu0\n\n[USER 2]\nu1\n\n[USER 3]\nu2\n\n...\n\n[USER LATE]\nu4\n\n[USER LATE]\nu5\n\n[ASSISTANT END]\nend"
    assert value(spark, T.narrative(F.lit(text))) == "u0 → u5"
    assert value(spark, T.narrative(F.lit("[USER 1]\nonly"))) == "only"


def test_salience_and_names(spark):
    assert value(spark, T.salience(F.lit("Tests fixed; no secrets"))) == ["test", "security", "outcome"]
    assert value(spark, T.bucket_name(F.lit("  New   Label "))) == "new label"
    assert value(spark, T.bucket_name(F.lit("x" * 61))) is None
    assert value(spark, T.repository_slug(F.lit("git@github.com:me/tool.git"))) == "me/tool"


@pytest.mark.parametrize(("text", "us"), [("1970-01-01T00:00:01Z", S1), ("1970-01-01T02:00:01+02:00", S1), ("1970-01-01T00:00:00.5", 500_000), ("2026", None), ("never", None), (None, None)])
def test_parse_iso(spark, text, us):
    assert value(spark, D.parse_iso(F.lit(text).cast("string"))) == us


def test_local_days_over_a_clock_change(spark):
    start, end = D.to_us(datetime(2024, 3, 9, 12, tzinfo=UTC)), D.to_us(datetime(2024, 3, 12, 12, tzinfo=UTC))
    rows = spark.createDataFrame([(start, end)], "start_us long, end_us long")
    hours = {str(r.local_date): (r.end_us - r.start_us) / 3.6e9 for r in D.split_local_days(rows, "America/New_York").collect()}
    assert hours["2024-03-10"] == 23 and hours["2024-03-11"] == 24 and sum(hours.values()) == 72


def test_windows():
    now = datetime(2024, 3, 13, 9, 30, tzinfo=UTC)
    assert [k for k, *_ in D.rolling_weeks(now, 2)] == ["2024-W10", "2024-W11"]
    assert D.calendar_months(now, 2)[-1] == ("2024-03", D.to_us(datetime(2024, 3, 1, tzinfo=UTC)), D.to_us(now))
    weeks = D.completed_local_weeks(now, 2, "America/New_York")
    assert (weeks[-1][2] - weeks[-1][1]) / 3.6e9 == 167
    D.check_weekly_windows(weeks, "America/New_York")
    assert D.previous_window(10, 30) == (-10, 10)
    with pytest.raises(ValueError):
        D.completed_local_weeks(now, 25, "UTC")


def test_rules(spark):
    rules = C.rules_frame(spark, {"one": ["blog", "data-pipe"], "two": ["pipeline", "my-blog"]})
    names = spark.createDataFrame([(p,) for p in ("my-blog", "blog-x", "data-pipeline", "other")], "project string")
    assert {r.project: r.rule_area for r in C.match_areas(names, rules).collect()} == {"my-blog": "two", "blog-x": "one", "data-pipeline": "one"}


def test_vocabulary(spark):
    rows = spark.createDataFrame([("r", 0, 0, "a", "X"), ("r", 1, 0, "b", "x"), ("r", 1, 1, "c", "once"), ("r", 1, 2, "d", "known")], "run_id string, chunk int, pos int, session_id string, bucket string")
    assert {r.session_id for r in C.accept_labels(rows, ["known"]).collect()} == {"b", "d"}


def snaps(spark, rows):
    return spark.createDataFrame([(b, t, "m", i, c, 0, o) for b, t, i, c, o in rows], "branch string, ts_us long, model string, input_total long, cached_total long, write_total long, output_total long")


def test_branch_usage(spark):
    rows = snaps(spark, [("p", 1, 100, 20, 10), ("p", 2, 100, 20, 10), ("p", 3, 300, 60, 40), ("c", 4, 100, 20, 10), ("c", 5, 300, 60, 40), ("c", 6, 700, 160, 90)])
    tree = spark.createDataFrame([("p", None), ("c", "p")], "branch string, parent string")
    got = K.branch_usage(rows, tree).agg(F.sum("input_tokens"), F.sum("cache_read"), F.sum("output_tokens"), F.count("*")).first()
    assert tuple(got) == (540, 160, 90, 3)


def test_ancestors_end_in_a_cycle(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "branch string, parent string")
    assert sorted(map(tuple, K.ancestors(tree).collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]


@pytest.mark.parametrize("depth", [1, 2, 7, 8, 100])
def test_ancestors_of_a_long_chain(spark, depth):
    tree = spark.createDataFrame([(i, i - 1 if i else None) for i in range(depth + 1)] + [(-1, -1)], "branch long, parent long")
    assert sorted(map(tuple, K.ancestors(tree).collect())) == [(i, j) for i in range(depth + 1) for j in range(i)]


def test_recap_has_all_sessions(spark):
    rows = [("w", i, "a", f"s{i:04d}", "x", i % 600) for i in range(1500)] + [("w", 9, "a", "slice-0", "x", 999), ("v", 1, "a", "s", "x", 1)]
    sessions = spark.createDataFrame(rows, "window_key string, start_us long, agent string, session_id string, area string, active_us long")
    got = marts.recap_sessions(sessions)
    assert sorted(map(tuple, got.collect())) == sorted(r for r in rows if r[3] != "slice-0")
    assert marts.as_json(got).count() == 1501
    recaps = spark.createDataFrame([("w", 1.0, [("x", 2.0)], None), ("u", 0.0, [], None)], "window_key string, hours double, buckets array<struct<area string, minutes double>>, top_focus string")
    top = {r.window_key: r.sessions and [s.session_id for s in r.sessions] for r in marts.compact_recap(recaps, got, 3).collect()}
    assert top == {"w": ["s0599", "s1199", "s0598"], "u": None}


def test_step_times(spark):
    rows = spark.createDataFrame([("s", 0, None), ("s", 1, 100), ("s", 2, None), ("s", 5, 500), ("s", 9, None)], "session_id string, step long, ts_us long")
    assert [r.est_us for r in K.step_times(rows).orderBy("step").collect()] == [100, 100, 200, 500, 500]


def test_price_ladder(spark):
    table = lambda d: spark.createDataFrame([(m, float(x), 0.0, 0.0, 0.0) for m, x in d.items()], "model string, inp double, out double, cw double, cr double")
    prices = K.layered_prices([(table({"opus": 1, "haiku": 2}), "default"), (table({"haiku-9": 3, "alias-target": 4}), "listed"), (table({"big": 5}), "user")], ["opus", "haiku"])
    names = spark.createDataFrame([("short", "alias-target")], "model string, target string")
    models = spark.createDataFrame([(m,) for m in ("x-opus-1", "haiku-9", "haiku-9-b", "short", "opus-big", "none")], "model string")
    got = {r.model: r.inp for r in K.resolve_prices(models, prices, names).collect()}
    assert got == {"x-opus-1": 1.0, "haiku-9": 3.0, "haiku-9-b": 2.0, "short": 4.0, "opus-big": 5.0, "none": None}


def test_refreshed_prices(spark):
    raw = spark.createDataFrame([("opus-1", 1e-6, 2e-6, None, None), ("opus-2", 1.0, 1.0, None, None), ("gpt", 1e-6, 1e-6, None, None)], "model string, input double, output double, cache_write double, cache_read double")
    row = one(P.refreshed(raw, "^opus"))
    assert (row.model, round(row.cw, 6), round(row.cr, 6)) == ("opus-1", 1.25, 0.1)


def test_message_ids_count_once(spark):
    rows = spark.createDataFrame([(1, "m", "x", 1, "p", 1), (2, "m", "x", 9, "p", 2), (3, "m", None, 5, "p", 3), (10, "m", None, 7, "p", 4)], "ts_us long, model string, message_id string, input_tokens long, path string, line_no long")
    rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("cache_creation", "cache_read", "output_tokens")})
    w = D.windows_frame(spark, [("a", 0, 10), ("b", 10, 20)])
    got = {r.window_key: (r.turns, r.input_tokens) for r in K.by_model(K.usage_in_windows(rows, w)).collect()}
    assert got == {"a": (3, 13), "b": (1, 7)}  # the event on the bound counts in both


def test_goal_checks(spark):
    for bad in ([{"id": "a", "title": " "}], [{"id": "a", "title": "t"}] * 2, [{"id": "a", "title": "t", "x": 1}], [{"id": "a", "title": "t", "valid_from": "2024-02-01", "valid_until": "2024-01-01"}]):
        with pytest.raises(ValueError):
            G.goals_frame(spark, bad)


def sketches(spark, n=30):
    rows = [("w", f"s{i:02d}", f"p{i % 3}", f"x{i % 5}", f"d{i % 7}", (i * 37) % 11, i, 10 + i % 4, ["error"] if i % 6 == 0 else ["done"] if i == 7 else []) for i in range(n)]
    return spark.createDataFrame(rows, "window_key string, internal_id string, provider string, project string, local_day string, active_us long, start_us long, chars long, salience array<string>")


def test_plans_agree_without_a_budget(spark):
    rows = sketches(spark)
    a = sorted(map(tuple, S.plan(rows).collect()))
    assert a == sorted(map(tuple, S.budgeted_plan(rows.repartition(7)).collect()))


def test_budget_is_kept(spark):
    got = S.budgeted_plan(sketches(spark), char_budget=60, max_selected=4)
    assert got.count() == 4


def test_budget_fit_skips(spark):
    rows = spark.createDataFrame([("g", 0, 5), ("g", 1, 50), ("g", 2, 4)], "group string, pos int, chars int")
    assert [r.pos for r in S.budget_fit(rows, 10).orderBy("pos").collect()] == [0, 2]


def greedy(sizes, budget):
    """Places of the sizes that a scan with skips takes."""
    out = []
    for i, n in enumerate(sizes):
        if n <= budget:
            budget -= n
            out.append(i)
    return out


@pytest.mark.parametrize(("seed", "budget"), [(1, 100), (2, 5000), (3, 37), (4, 0)])
def test_budget_fit_is_the_greedy_scan(spark, seed, budget):
    """Many groups and one of nearly all rows, sizes from nothing to more than the budget."""
    rng = random.Random(seed)
    rows = [("all" if rng.random() < 0.8 else f"g{rng.randrange(5)}", i, int(rng.choice([0, 1, 3, budget // 9, budget // 2, budget // 2 + 1, budget, budget + 5]) * rng.random())) for i in range(400)]
    got = S.budget_fit(spark.createDataFrame(rows, "group string, pos int, chars int").repartition(6), budget).collect()
    want = set()
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want |= {own[i] for i in greedy([r[2] for r in own], budget)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_budget_holds_for_tied_places(spark):
    rows = [("a", 1, 60), ("a", 1, 60), ("a", 2, 30), ("b", 1, 50), ("b", 1, 10), ("b", 1, 50), (None, 1, 1), ("a", None, 1), ("a", 3, None)]
    got = S.budget_fit(spark.createDataFrame(rows, "group string, pos int, chars int"), 100).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 60), ("a", 2, 30), ("b", 1, 10), ("b", 1, 50)]
    assert S.budget_fit(spark.createDataFrame([], "group string, pos int, chars int"), 100).count() == 0


def test_budgets_have_no_python_and_no_group_in_a_task(spark):
    rows = spark.range(300).selectExpr("'g' as `group`", "id as pos", "id % 7 + 1 as chars")
    got = S.budget_fit(rows.repartition(4), 500)
    plan = got._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan
    assert [r.pos for r in got.orderBy("pos").collect()] == greedy([i % 7 + 1 for i in range(300)], 500)


def plain_plan(rows, budget, most):
    """What the passes choose, by their definitions: (id, reasons)."""
    order = sorted(rows, key=lambda r: (-r[5], r[6], r[2], r[1]))
    chosen, reasons, left = {}, {}, budget

    def offer(r, reason):
        nonlocal left
        if r[1] not in chosen:
            if r[7] > left or len(chosen) >= most:
                return
            chosen[r[1]] = r
            left -= r[7]
        reasons.setdefault(r[1], []).append(reason)

    for column, reason in ((2, "provider_top"), (3, "project_top"), (4, "day_top")):
        total = {}
        for r in rows:
            total[r[column]] = total.get(r[column], 0) + r[5]
        days = {r[4] for r in chosen.values()}
        for value in sorted(total, key=lambda v: (-total[v], v)):
            if reason != "day_top" or value not in days:
                offer(next(r for r in order if r[column] == value), reason)
    for code in T.SALIENCE:
        first = next((r for r in order if code in r[8] and r[1] not in chosen), None)
        if first:
            offer(first, f"salience:{code}")
    for r in order:
        if r[1] not in chosen:
            offer(r, "budget_fill")
    return {(i, ",".join(x)) for i, x in reasons.items()}


@pytest.mark.parametrize(("budget", "most"), [(60, 4), (130, 99), (7, 3), (10**6, 12)])
def test_budgeted_plan_follows_its_passes(spark, budget, most):
    frame = sketches(spark, 40)
    want = plain_plan([tuple(r) for r in frame.collect()], budget, most)
    assert {(r.internal_id, r.reasons) for r in S.budgeted_plan(frame.repartition(3), budget, most).collect()} == want


def test_upsert_authority(spark):
    kind = "session_id string, summary string, source string, evidence_fingerprint string, observed_evidence_fingerprint string, created_at long"
    table = spark.createDataFrame([("a", "mine", "provided", "", "", 1), ("b", "old", "generated", "f", "f", 1)], kind)
    new = spark.createDataFrame([("a", "x", "auto", "", "", 2), ("b", "kept", "record", "", "", 2), ("", "x", "auto", "", "", 2), ("c", " ", "auto", "", "", 2), ("d", "n", "auto", "", "", 2)], kind)
    got = {r.session_id: (r.summary, r.source, r.evidence_fingerprint) for r in M.upsert(table, new).collect()}
    assert got == {"a": ("mine", "provided", ""), "b": ("kept", "provided", ""), "d": ("n", "generated", "legacy-unknown")}


def test_parse_responses(spark):
    text = '```json\n{"session_id": "a", "summary": "good text"}\nbroken\n{"session_id": "b", "summary": "no"}\n{"session_id": "z", "summary": "not asked"}\n```'
    raw = spark.createDataFrame([("r", 0, text)], "run_id string, chunk int, text string")
    want = spark.createDataFrame([("a",), ("b",)], "session_id string")
    assert [(r.session_id, r.summary) for r in M.parse_responses(raw, want).collect()] == [("a", "good text")]


def test_message_log(spark, tmp_path):
    folder = tmp_path / "projects" / "-Users-u-code-x"
    folder.mkdir(parents=True)
    lines = [
        {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/w", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:15Z", "message": {"role": "assistant", "id": "m1", "model": "opus-1", "content": [{"type": "text", "text": "hi"}], "usage": {"input_tokens": 3, "output_tokens": 4}}},
        {"type": "assistant", "timestamp": "2024-01-01T00:00:20Z", "message": {"role": "assistant", "id": "m2", "usage": {"input_tokens": True, "output_tokens": 4}}},
        {"type": "summary"},
    ]
    (folder / "abc.jsonl").write_text("\n".join([*map(json.dumps, lines), "{broken", "", "[1]"]))
    raw = L.raw_lines(spark, [str(folder / "*.jsonl"), str(folder / "*.jsonl")])
    got = L.message_log(raw).orderBy("line_no").collect()
    assert [(r.session_id, r.line_no, r.text, r.is_real_user, r.project_raw) for r in got] == [("abc", 1, "hello", True, "-Users-u-code-x"), ("abc", 2, "hi", False, "-Users-u-code-x"), ("abc", 3, "", False, "-Users-u-code-x")]
    assert [(r.message_id, r.model, r.input_tokens, r.cache_read) for r in L.message_usage(raw).collect()] == [("m1", "opus-1", 3, 0)]
    m = one(L.scan_metrics(raw))
    assert (m.files, m.lines, m.bad_lines, m.inventory_complete) == (1, 6, 2, False)


def test_rollout_log(spark, tmp_path):
    def write(name, rows):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))

    at = "2024-01-01T00:00:0{}Z".format
    totals = lambda i, c, o: {"type": "token_count", "info": {"total_token_usage": {"input_tokens": i, "cached_input_tokens": c, "output_tokens": o}}}
    write("one", [
        {"timestamp": at(0), "type": "session_meta", "payload": {"id": "p", "cwd": "/w"}}, {"timestamp": at(1), "type": "turn_context", "payload": {"model": "m1"}},
        {"timestamp": at(2), "type": "event_msg", "payload": {"type": "user_message", "message": "<task>do it</task>"}}, {"timestamp": at(3), "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "ok"}]}},
        {"timestamp": at(4), "type": "event_msg", "payload": totals(100, 20, 10)},
    ])
    write("two", [{"timestamp": at(5), "type": "session_meta", "payload": {"id": "c", "parent_thread_id": "p"}}, {"timestamp": at(5), "type": "event_msg", "payload": totals(100, 20, 10)}, {"timestamp": at(6), "type": "event_msg", "payload": totals(150, 20, 30)}])
    raw = L.raw_lines(spark, [str(tmp_path)], recursive=True)
    got = L.rollout_log(raw).where("is_real_user").collect()
    assert [(r.session_id, r.text) for r in got] == [("p", "do it")]
    u = sorted((r.branch, r.model, r.input_tokens, r.cache_read, r.output_tokens) for r in K.branch_usage(*L.rollout_snapshots(raw)).collect())
    assert u == [("c", "unknown", 50, 0, 20), ("p", "m1", 80, 20, 10)]


def test_step_log_and_children(spark, tmp_path):
    parent, child = "11111111-1111-1111-1111-111111111111", "22222222-2222-2222-2222-222222222222"
    for name, rows in {
        parent: [{"step_index": 0, "type": "USER_INPUT", "created_at": "2024-01-01T00:00:00Z", "content": "<USER_REQUEST>go</USER_REQUEST>"}, {"step_index": 1, "type": "INVOKE_SUBAGENT", "content": f"see {child}", "usage": {"prompt_tokens": 5, "completion_tokens": 2, "model": "g"}}],
        child: [{"step_index": 0, "type": "USER_INPUT", "created_at": "2024-01-01T00:00:01Z", "content": "inner"}],
    }.items():
        d = tmp_path / "brain" / name
        d.mkdir(parents=True)
        (d / "transcript.jsonl").write_text("\n".join(map(json.dumps, rows)))
    raw = L.raw_lines(spark, [str(tmp_path / "brain" / "*" / "transcript.jsonl")])
    kept = L.without_children(L.step_log(raw), raw)
    assert {r.session_id for r in kept.collect()} == {parent}
    assert [r.text for r in kept.where("is_real_user").collect()] == ["go"]
    assert [(r.step, r.input_tokens, r.output_tokens) for r in L.step_usage(raw).collect()] == [(1, 5, 2)]


def test_registry():
    assert [p.name for p in L.providers()] == ["agent_a", "agent_b", "agent_c"]
    with pytest.raises(ValueError):
        L.register(L.providers("agent_a")[0])
    with pytest.raises(ValueError):
        L.providers("nobody")


def test_line_numbers_over_splits(spark, tmp_path):
    """Files of several splits are numbered as they read, and the lines themselves aren't moved."""
    rng = random.Random(5)
    want = {}
    for f in range(3):
        lines = ["" if rng.random() < 0.1 else json.dumps({"n": i, "x": "y" * rng.randint(0, 90)}) if rng.random() < 0.9 else "broken {" for i in range(200)]
        (tmp_path / f"f{f}.jsonl").write_text("\n".join(lines) + "\n")
        want |= {(f"f{f}", i + 1): line for i, line in enumerate(lines) if line}
    keys = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        got = L.scan(spark, [str(tmp_path)])
        rows = got.lines.collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.path.rsplit("/", 1)[1][:2], r.line_no): r.value for r in rows} == want
    assert got.metrics == {"files": 3, "lines": len(want), "bad_lines": sum(v == "broken {" for v in want.values()), "inventory_complete": False}
    plan = got.lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan


def test_a_failing_provider_is_a_report_row(spark, tmp_path):
    def broken(lines):
        raise ValueError("cannot read this")

    line = lambda role, s: json.dumps({"type": role, "timestamp": f"2024-01-01T00:00:{s:02d}Z", "message": {"role": role, "content": "words", "model": "m", "id": f"i{s}", "usage": {"input_tokens": s, "output_tokens": 1}}})
    for agent in ("agent_a", "agent_x", "agent_y"):
        (tmp_path / agent).mkdir()
        (tmp_path / agent / "s.jsonl").write_text("\n".join([line("user", 1), line("assistant", 31), "{"]) + "\n")
    L.register(L.Provider("agent_x", "X", "partial", broken))
    L.register(L.Provider("agent_y", "Y", "unavailable", lambda lines: L.message_log(lines).withColumn("agent", F.lit("agent_y"))))
    try:
        got = L.ingest(spark, {a: [str(tmp_path / a)] for a in ("agent_a", "agent_x", "agent_y")})
    finally:
        del L._REGISTRY["agent_x"], L._REGISTRY["agent_y"]
    assert {r.agent: (r.files, r.lines, r.bad_lines, r.error) for r in got.report.collect()} == {"agent_a": (1, 3, 1, None), "agent_x": (1, 3, 1, "ValueError: cannot read this"), "agent_y": (1, 3, 1, None)}
    assert sorted(r.agent for r in got.messages.collect()) == ["agent_a", "agent_a", "agent_y", "agent_y"]
    assert [(r.agent, r.input_tokens) for r in got.usage.collect()] == [("agent_a", 31)]
    start = D.to_us(datetime(2024, 1, 1, tzinfo=UTC))
    assert {r.agent: r.active_us for r in L.sessions_between(got.messages, start, start + 60 * S1).collect()} == {"agent_a": 30 * S1, "agent_y": 30 * S1}
    assert L.sessions_between(got.messages, start + 32 * S1).count() == 0 and L.sessions_between(got.messages, engaged_only=True).count() == 0
    assert L.usage_between(got.usage, start + 31 * S1, agent="agent_a").count() == 1 and L.usage_between(got.usage, agent="agent_b").count() == 0
    with pytest.raises(ValueError):
        L.collect_messages(spark, {})


def test_streaming_total(spark, tmp_path):
    from tidemark.streaming.activity import running_active_time

    events(spark, [0, 15, 120, 150]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("agent string, session_id string, ts_us long, is_real_user boolean").parquet(str(tmp_path / "in"))
    q = running_active_time(stream).writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert one(spark.table("running")).active_us == 150 * S1


A50, B50, C9 = "a" * 50, "b" * 50, "c" * 9
BATCHES = [  # worked out by hand: blocks, budget, text
    ([("USER 1", "hello"), ("USER LATE", "x"), ("ASSISTANT END", "bye")], 700, "[USER 1]\nhello\n\n[USER LATE]\nx\n\n[ASSISTANT END]\nbye"),
    # marks take 27 of 60, least sizes 4; 29 are left: 9 and 19 by weight, the last one goes to the answer
    ([("USER 1", A50), ("ASSISTANT END", B50)], 60, "[USER 1]\n" + "a" * 4 + "…" + "a" * 5 + "\n\n[ASSISTANT END]\n" + "b" * 11 + "…" + "b" * 11),
    # the short answer needs 9 of its share, so the message gets the rest: 60 - 27 - 9 = 24
    ([("USER 1", A50), ("ASSISTANT END", C9)], 60, "[USER 1]\n" + "a" * 11 + "…" + "a" * 12 + "\n\n[ASSISTANT END]\n" + C9),
    # three blocks need 46 and both messages' least; of 36 to 42 only one message and the answer fit
    ([("USER 1", A50), ("USER LATE", "zz"), ("ASSISTANT END", B50)], 31, "[USER 1]\na\n\n[ASSISTANT END]\nb…b"),
    ([("USER 1", A50), ("ASSISTANT END", B50)], 20, "[ASSISTANT END]\nb…bb"),
    ([("USER 1", A50), ("ASSISTANT END", B50)], 10, "b" * 4 + "…" + "b" * 5),
    ([("USER 1", A50)], 19, "[USER 1]\n" + "a" * 4 + "…" + "a" * 5),
    ([("ASSISTANT END", B50)], 2, "bb"), ([("ASSISTANT END", B50)], 1, "b"), ([("ASSISTANT END", B50)], 0, ""),
]


@pytest.mark.parametrize(("blocks", "most", "want"), BATCHES)
def test_batch_excerpt(spark, blocks, most, want):
    text = "\n\n".join(f"[{role}]\n{said}" for role, said in blocks)
    assert value(spark, T.batch_excerpt(F.lit(text), most)) == want


@pytest.mark.parametrize("most", [30, 47, 90, 200])
def test_batch_excerpts_keep_their_bounds(spark, most):
    """Never longer than the budget, all of it used if there is more to say, blocks in order, and nothing that isn't there."""
    rng = random.Random(most)
    rows = [(i, [("USER 1", "u" * rng.randint(1, 300)), ("USER LATE", "v" * rng.randint(1, 300)), ("ASSISTANT END", "w" * rng.randint(3, 300))]) for i in range(30)]
    frame = spark.createDataFrame([(i, "\n\n".join(f"[{r}]\n{s}" for r, s in b)) for i, b in rows] + [(-1, ""), (-2, None)], "i int, e string")
    got = {r.i: r.x for r in frame.select("i", T.batch_excerpt(F.col("e"), most).alias("x")).collect()}
    assert got[-1] == got[-2] == ""
    for i, blocks in rows:
        whole = "\n\n".join(f"[{r}]\n{s}" for r, s in blocks)
        assert len(got[i]) <= most and (len(whole) > most or got[i] == whole)
        marks = [m for m in ("[USER 1]", "[USER LATE]", "[ASSISTANT END]") if m in got[i]]
        assert [got[i].index(m) for m in marks] == sorted(got[i].index(m) for m in marks) and "[ASSISTANT END]" in marks
        sizes = {c: got[i].count(c) for c in "uvw"}
        if len(marks) == 3 and all(len(s) > most for _, s in blocks):  # all are short of room: shares of 1:1:2
            assert abs(sizes["u"] - sizes["v"]) <= 1 and abs(sizes["w"] - 2 * sizes["u"]) <= 6
            assert len(got[i]) == most


def test_inherited_prefix_passes_by(spark):
    row = lambda b, t, v: (b, t, v, 0, 0, 0)
    values = {"a": [1, 2, 1, 3, 5], "b": [2, 3, 4], "c": [1, 1, 3, 5, 5], "d": [9, 1]}
    snaps = spark.createDataFrame([row(b, t, v) for b, vs in values.items() for t, v in enumerate(vs)], ["branch", "ts_us", *K.TOTALS])
    line = spark.createDataFrame([(b, "a") for b in "bcd"], ["branch", "ancestor"])
    assert dict(map(tuple, K.inherited_prefix(snaps, line).collect())) == {"b": 2, "c": 4, "d": 0}
