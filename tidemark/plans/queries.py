"""Registered queries over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.time import epoch_us, local_day, parse_iso, split_local_days
from tidemark.operators import activity as A
from tidemark.operators import classify as C
from tidemark.operators import goals as G
from tidemark.operators import repo as R
from tidemark.operators import rollup as U
from tidemark.operators import sampling as S
from tidemark.operators import summaries as M
from tidemark.operators import usage as K
from tidemark.operators.lineage import numbered, written
from tidemark.sources import bindings as B
from tidemark.sources import logs as L

WIDE_CAP_US = 21_600_000_000
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _sessions(spark, sf_dir, cap=A.GAP_CAP_US):
    return A.sessions(B.activity(spark, sf_dir), cap, ("project_raw", "cwd"))


def _clipped(spark, sf_dir, windows=None, cap=A.GAP_CAP_US):
    return A.clip(A.active_intervals(B.activity(spark, sf_dir), cap), windows or B.windows(spark))


def _slices(spark, sf_dir, windows=None, messages=None):
    """Slices of each window with their session's folder, project and area."""
    messages = B.activity(spark, sf_dir) if messages is None else messages
    found = A.slices(messages, windows or B.windows(spark))
    folders = messages.groupBy("agent", "session_id").agg(F.min("project_raw").alias("project_raw"), F.min("cwd").alias("cwd"))
    rows = C.with_project(found.join(folders, A.SESSION), B.aliases(spark))
    return C.classify(rows, B.rules(spark))


def _rollup(spark, sf_dir, windows=None):
    return U.area_project_rollup(_slices(spark, sf_dir, windows), A.window_totals(_clipped(spark, sf_dir, windows)))


def _costed(spark, sf_dir, windows=None):
    rows = K.by_model(K.usage_in_windows(B.usage(spark, sf_dir), windows or B.windows(spark)))
    table = K.layered_prices([(B.prices(spark, B.FAMILY_PRICES), "default"), (B.prices(spark, B.LISTED_PRICES), "listed"), (B.prices(spark, B.USER_PRICES), "user")], list(B.FAMILY_PRICES))
    names = spark.createDataFrame([("quick-a", "haiku-z")], "model string, target string")
    return K.cost(rows, K.resolve_prices(rows, table, names))


@query
def active_time_per_session(spark, sf_dir):
    return _sessions(spark, sf_dir).select("agent", "session_id", "start_us", "end_us", "msg_count", "user_msg_count", "active_us", "active_sec")


@query
def active_time_wide_gap(spark, sf_dir):
    return _sessions(spark, sf_dir, WIDE_CAP_US).select("agent", "session_id", "active_us")


@query
def engaged_sessions(spark, sf_dir):
    return _sessions(spark, sf_dir).where("engaged").select("agent", "session_id", "user_msg_count", "active_us")


@query
def session_window_slices(spark, sf_dir):
    found = A.slices(B.activity(spark, sf_dir), B.windows(spark))
    return found.select("window_key", "agent", "session_id", "start_us", "end_us", "active_us", "msg_count", "user_msg_count", "engaged", "contained")


@query
def sessions_overlapping_windows(spark, sf_dir):
    return A.overlapping(_sessions(spark, sf_dir), B.windows(spark)).groupBy("window_key", "agent").agg(F.count("*").alias("sessions"))


@query
def wall_clock_by_window(spark, sf_dir):
    return A.window_totals(_clipped(spark, sf_dir)).select("window_key", "raw_us", "wall_us", "parallelism")


@query
def wall_clock_wide_gap(spark, sf_dir):
    return A.window_totals(_clipped(spark, sf_dir, cap=WIDE_CAP_US), WIDE_CAP_US).select("window_key", "raw_us", "wall_us", "parallelism")


@query
def wall_clock_by_agent(spark, sf_dir):
    return A.wall_clock(_clipped(spark, sf_dir), ["window_key", "agent"])


@query
def bounded_slice_check(spark, sf_dir):
    """Violations (none are expected) per window, with the number of slices looked at."""
    found, windows = A.slices(B.activity(spark, sf_dir), B.windows(spark)), B.windows(spark)
    bad = A.bounded_violations(found, windows).groupBy("window_key").agg(F.count("*").alias("bad"))
    twice = A.duplicate_sessions(found).groupBy("window_key").agg(F.count("*").alias("twice"))
    n = found.groupBy("window_key").agg(F.count("*").alias("slices"))
    return n.join(bad, "window_key", "left").join(twice, "window_key", "left").na.fill(0, ["bad", "twice"])


@query
def area_project_rollup(spark, sf_dir):
    """Hours per area and project with parallel work counted once."""
    return _rollup(spark, sf_dir)


@query
def shown_projects(spark, sf_dir):
    return U.shown_projects(_rollup(spark, sf_dir))


@query
def top_focus(spark, sf_dir):
    return U.top_focus(_rollup(spark, sf_dir))


@query
def top_sessions_per_area(spark, sf_dir):
    return U.top_sessions(_slices(spark, sf_dir)).select("window_key", "area", "rank", "agent", "session_id", "active_us", "start_us")


@query
def agent_breakdown(spark, sf_dir):
    return U.agent_breakdown(A.slices(B.activity(spark, sf_dir), B.windows(spark)))


@query
def agent_scope(spark, sf_dir):
    return U.agent_scope(A.slices(B.activity(spark, sf_dir), B.windows(spark)))


@query
def classification_sources(spark, sf_dir):
    """The priority chain with cached labels for every fifth user's sessions."""
    labels = table_labels(spark, sf_dir)
    rows = C.with_project(_sessions(spark, sf_dir), B.aliases(spark))
    return C.classify(rows, B.rules(spark), labels).groupBy("area", "area_source").agg(F.count("*").alias("sessions"))


def table_labels(spark, sf_dir):
    ids = B.activity(spark, sf_dir).select("session_id").distinct()
    user = F.regexp_extract("session_id", r"^u(\d+)-", 1).cast("long")
    return ids.where(user % 5 == 0).withColumn("bucket", F.lit("research"))


@query
def label_cache_by_fingerprint(spark, sf_dir):
    """Cached labels count only while the session's input fingerprint is the same."""
    now = _sessions(spark, sf_dir).select("session_id", F.col("msg_count").cast("string").alias("input_fingerprint"))
    kept = table_labels(spark, sf_dir).withColumn("input_fingerprint", F.when(F.length("session_id") % 2 == 0, "old"))
    cache = kept.join(now.withColumnRenamed("input_fingerprint", "now"), "session_id").select("session_id", F.coalesce("input_fingerprint", "now").alias("input_fingerprint"), "bucket")
    return C.cached_labels(cache, now).select("session_id", "bucket")


@query
def project_names(spark, sf_dir):
    rows = C.with_project(_sessions(spark, sf_dir), B.aliases(spark))
    return rows.groupBy("project_raw", "project").agg(F.count("*").alias("sessions"))


@query
def duplicate_memberships(spark, sf_dir):
    """Parts of project names that several folders share: needles that would be in more than one area."""
    parts = B.activity(spark, sf_dir).select("project_raw", F.explode(F.split(T.project_name(F.col("project_raw")), "-")).alias("needle")).distinct()
    areas = numbered(parts.select("project_raw").distinct(), ["project_raw"], "priority")
    return C.duplicate_memberships(parts.join(F.broadcast(areas), "project_raw").select("needle", F.col("project_raw").alias("area"), "priority"))


@query
def majority_vote(spark, sf_dir):
    """Most common language of each source among labelled documents."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(B.table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    votes = docs.select(F.col("source").alias("folder"), F.col("lang").alias("bucket"), F.col("doc_id").alias("start_us"), F.col("doc_id").alias("session_id"))
    return C.majority(votes)


@query
def label_distribution(spark, sf_dir):
    rows = C.with_project(_sessions(spark, sf_dir), B.aliases(spark))
    return C.classify(rows, B.rules(spark)).groupBy("area").agg(F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"), F.count("*").alias("sessions"))


@query
def label_vocabulary(spark, sf_dir):
    """Labels proposed per document in chunks of 80: accepted under the vocabulary cap."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    rows = docs.select(F.col("lang").alias("run_id"), F.expr("doc_id div 80").alias("chunk"), F.expr("doc_id % 80").alias("pos"), F.col("doc_id").alias("session_id"), F.upper("source").alias("bucket"))
    return C.accept_labels(rows, ["src1", "src2"]).groupBy("run_id", "bucket").agg(F.count("*").alias("n"))


@query
def usage_by_model_window(spark, sf_dir):
    return K.by_model(K.usage_in_windows(B.usage(spark, sf_dir), B.windows(spark)))


@query
def usage_merged_by_agent(spark, sf_dir):
    """Per-agent tables summed again."""
    rows = K.usage_in_windows(B.usage(spark, sf_dir), B.windows(spark))
    return K.merge_models([K.by_model(rows.where(F.col("agent") == a)) for a, *_ in B.PROVIDERS])


@query
def usage_cost_by_model(spark, sf_dir):
    return _costed(spark, sf_dir).select("window_key", "model", K.rounded("cost_usd"), K.rounded("cost_uncached_usd"), "priced")


@query
def usage_cost_totals(spark, sf_dir):
    t = K.usage_totals(_costed(spark, sf_dir))
    return t.select("window_key", *K.COUNTERS, "turns", "total_tokens", "unpriced_models", "cache_hit", *[K.rounded(c) for c in ("cost_usd", "cost_uncached_usd", "savings_usd")])


@query
def usage_coverage(spark, sf_dir):
    found = A.slices(B.activity(spark, sf_dir), B.windows(spark))
    return K.coverage(found, B.providers(spark))


@query
def usage_step_dedup(spark, sf_dir):
    """Log usage without the steps that companion rows counted."""
    rows = B.usage(spark, sf_dir).select(F.col("agent").alias("session_id"), F.col("line_no").alias("step"), "input_tokens")
    companion = rows.where("step % 3 = 0").select("session_id", F.col("step").alias("idx"))
    return K.without_counted(rows, companion).groupBy("session_id").agg(F.count("*").alias("steps"), F.sum("input_tokens").alias("input_tokens"))


@query
def cumulative_delta(spark, sf_dir):
    return K.grown(K.counter_deltas(K.distinct_snapshots(B.snapshots(spark, sf_dir))))


def _branches(spark, sf_dir):
    """Each order's counters, and a child branch that copied the first half of its parent's and went on."""
    base = K.distinct_snapshots(B.snapshots(spark, sf_dir)).where("input_total > 0")
    order = W.partitionBy("branch").orderBy("ts_us", *K.TOTALS)
    ranked = written(base.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("branch"))))  # read four times
    base = ranked.drop("i", "n")
    copied = ranked.where("i * 2 <= n").drop("i", "n").withColumn("branch", F.concat("branch", F.lit("-c")))
    more = ranked.where("i = n").drop("i", "n").withColumn("branch", F.concat("branch", F.lit("-c"))).withColumns({c: F.col(c) + 7 for c in K.TOTALS})
    tree = ranked.where("i = 1").select(F.concat("branch", F.lit("-c")).alias("branch"), F.col("branch").alias("parent"))
    return base.unionByName(copied).unionByName(more), tree


@query
def inherited_prefix(spark, sf_dir):
    rows, tree = _branches(spark, sf_dir)
    return K.inherited_prefix(K.distinct_snapshots(rows), K.ancestors(tree))


def _order_branches(spark, sf_dir):
    """Customers' orders as counters of few values, in a tree: what a branch shares with its ancestors is broken by other values."""
    o = B.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("long").alias("ts_us"), F.expr("(o_orderkey div 4) % 3").cast("long").alias("v"))
    rows = o.select(F.concat(F.lit("c"), "o_custkey").alias("branch"), "ts_us", F.lit("m1").alias("model"), F.col("v").alias("input_total"), F.lit(0).cast("long").alias("cached_total"), F.lit(0).cast("long").alias("write_total"), (2 * F.col("v")).alias("output_total"))
    tree = o.where("o_custkey % 4 >= 2").select(F.concat(F.lit("c"), "o_custkey").alias("branch"), F.concat(F.lit("c"), F.expr("o_custkey div 2")).alias("parent")).distinct()
    return rows, tree


@query
def inherited_broken_runs(spark, sf_dir):
    """How much of each branch its ancestors hold in order, over several generations, runs broken and values repeated."""
    rows, tree = _order_branches(spark, sf_dir)
    return K.inherited_prefix(K.distinct_snapshots(rows), K.ancestors(tree))


@query
def branch_usage(spark, sf_dir):
    rows, tree = _branches(spark, sf_dir)
    return K.branch_usage(rows, tree).groupBy("branch").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in K.COUNTERS])


@query
def ancestor_closure(spark, sf_dir):
    """A customer's orders as a chain of branches, three generations up."""
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    chain = o.withColumn("i", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    parent = F.when((F.col("i") - 1) % 4 > 0, F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    return K.ancestors(chain.select(F.col("o_orderkey").alias("branch"), parent.alias("parent")))


@query
def step_interpolation(spark, sf_dir):
    """Times of a user's events when every third is missing from the log."""
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", epoch_us("ts").alias("real_us"))
    steps = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 != 0, F.col("real_us")).alias("ts_us"))
    return K.step_times(steps).select("session_id", "step", "ts_us", "est_us")


@query
def steps_in_windows(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").select("user_id", "event_id", epoch_us("ts").alias("real_us"))
    steps = e.select(F.concat(F.lit("u"), F.col("user_id")).alias("session_id"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 3 != 0, F.col("real_us")).alias("ts_us"))
    return K.steps_in_windows(K.step_times(steps), B.windows(spark)).groupBy("window_key").agg(F.count("*").alias("steps"))


@query
def asof_model(spark, sf_dir):
    """Model in force at each event: the last one named in the user's stream."""
    e = B.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("line_no"), "event_type", "event_id")
    rows = e.withColumn("context_model", F.when(F.col("event_type") == "signup", F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))))
    return K.last_model(rows).select("path", "line_no", "model")


@query
def period_comparison(spark, sf_dir):
    return U.compare(_rollup(spark, sf_dir), "current", "previous")


@query
def comparison_totals(spark, sf_dir):
    """Hours, output tokens and cost of both windows side by side."""
    t = A.window_totals(_clipped(spark, sf_dir)).select("window_key", (F.col("wall_us") / 3.6e9).alias("hours"))
    u = K.usage_totals(_costed(spark, sf_dir)).select("window_key", "output_tokens", K.rounded("cost_usd"))
    both = t.join(u, "window_key")
    pick = lambda k, p: both.where(F.col("window_key") == k).select(*[F.col(c).alias(f"{p}_{c}") for c in ("hours", "output_tokens", "cost_usd")])
    return pick("current", "current").join(F.broadcast(pick("previous", "previous")), F.lit(True))


@query
def trend_points(spark, sf_dir):
    w = B.weekly(spark)
    got = U.trend_points(w, A.window_totals(_clipped(spark, sf_dir, w)), K.usage_totals(_costed(spark, sf_dir, w)))
    return got.select("window_key", "ord", "hours", "output_tokens", K.rounded("cost_usd"), F.round("quota_pct", 6).alias("quota_pct"))


@query
def trend_matrix(spark, sf_dir):
    w = B.weekly(spark)
    return U.trend_matrix(_rollup(spark, sf_dir, w), w)


@query
def trend_change(spark, sf_dir):
    w = B.weekly(spark)
    m = U.trend_matrix(_rollup(spark, sf_dir, w), w)
    got = U.series_change(m, "minutes", ("area",))
    return got.select("area", "window_key", "minutes", "previous", F.round("pct", 6).alias("pct"), F.round("mean", 6).alias("mean"))


def _attributed(spark, sf_dir, windows):
    clipped = _clipped(spark, sf_dir, windows)
    folders = B.activity(spark, sf_dir).groupBy("agent", "session_id").agg(F.min("project_raw").alias("project_raw"))
    rows = C.with_project(clipped.join(folders, A.SESSION), B.aliases(spark))
    items = G.contributions(rows.select("window_key", "agent", "session_id", "project", "start_us", "end_us"), B.ZONE)
    goals = G.goals_frame(spark, B.GOALS)
    return G.attribute(items, G.goal_projects(goals, B.aliases(spark))), goals


@query
def goal_breakdown(spark, sf_dir):
    attributed, goals = _attributed(spark, sf_dir, B.windows(spark))
    return G.goal_breakdown(attributed, goals, B.windows(spark), B.ZONE)


@query
def top_goals(spark, sf_dir):
    attributed, goals = _attributed(spark, sf_dir, B.windows(spark))
    return G.top_goals(G.goal_breakdown(attributed, goals, B.windows(spark), B.ZONE), 2).select("window_key", "goal_id", F.col("rank").cast("long").alias("rank"))


@query
def goal_lanes(spark, sf_dir):
    attributed, _ = _attributed(spark, sf_dir, B.windows(spark))
    return G.lanes(attributed)


@query
def goal_history(spark, sf_dir):
    w = B.weekly(spark)
    attributed, goals = _attributed(spark, sf_dir, w)
    rows = G.goal_breakdown(attributed, goals, w, B.ZONE)
    return G.scaled_hours(rows, A.window_totals(_clipped(spark, sf_dir, w)), ("exclusive_us", "shared_us")).drop("touched_projects")


@query
def local_day_split(spark, sf_dir):
    rows = split_local_days(A.active_intervals(B.activity(spark, sf_dir), WIDE_CAP_US), B.ZONE)
    return rows.groupBy("local_date").agg(F.count("*").alias("pieces"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


@query
def message_predicates(spark, sf_dir):
    rows = B.turns(spark, sf_dir)
    return rows.select("conv_id", "turn", "is_real_user", T.is_narrative(F.col("text")).alias("narrative"), F.length(T.collapse(F.col("text"))).alias("chars"))


def _excerpts(spark, sf_dir):
    rows = B.turns(spark, sf_dir).where(T.is_narrative(F.col("text")))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda r: r.text)
    both = rows.groupBy("conv_id").agg(of("user").alias("users"), of("assistant").alias("answers"))
    return both.select("conv_id", F.size("users").cast("long").alias("n_users"), T.excerpt(F.col("users"), F.col("answers")).alias("excerpt"))


@query
def excerpts(spark, sf_dir):
    return _excerpts(spark, sf_dir)


@query
def narratives(spark, sf_dir):
    return _excerpts(spark, sf_dir).select("conv_id", T.narrative(F.col("excerpt")).alias("narrative"))


@query
def batch_excerpts(spark, sf_dir):
    """Excerpts within 700 and within 90 characters."""
    rows = _excerpts(spark, sf_dir)
    return rows.select("conv_id", T.batch_excerpt(F.col("excerpt")).alias("batch"), T.batch_excerpt(F.col("excerpt"), 90).alias("short"))


@query
def summary_provenance(spark, sf_dir):
    """Where each conversation's shown text comes from; a fifth have no summary, a third of all a native title."""
    table = _summary_table(spark, sf_dir)
    native = F.when(F.col("conv_id") % 3 == 0, "title").otherwise("")
    return table.select("session_id", T.provenance(F.when(F.col("conv_id") % 5 != 0, F.col("source")), native).alias("provenance"))


@query
def compact_documents(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", T.compact(F.col("text"), 120).alias("short"))


@query
def salience_codes(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.salience(F.col("text")), ",").alias("codes"))


@query
def text_precedence(spark, sf_dir):
    """First text that isn't blank per conversation."""
    rows = B.turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.min_by(F.when(F.col("role") == "system", F.col("text")), "turn").alias("native"), F.count("*").alias("n"))
    rows = rows.select("conv_id", F.when(F.col("conv_id") % 3 == 0, "  ").when(F.col("conv_id") % 3 == 1, F.concat(F.lit("s"), F.col("n"))).alias("summary"), "native", F.lit(None).cast("string").alias("bounded"), F.left("first", F.lit(40)).alias("first"))
    return rows.select("conv_id", M.best_text("summary", "native", "bounded", "first").alias("text"))


def _sketches(spark, sf_dir):
    rows = _slices(spark, sf_dir).withColumn("local_day", local_day("start_us", B.ZONE))
    n = F.col("msg_count")
    codes = F.filter(F.array(*[F.when(n % (i + 7) == 0, F.lit(c)) for i, c in enumerate(T.SALIENCE)]), lambda c: c.isNotNull())
    return rows.select("window_key", F.concat_ws("/", "agent", "session_id").alias("internal_id"), F.col("agent").alias("provider"), "project", F.col("local_day").cast("string").alias("local_day"), "active_us", "start_us", (n * 40).alias("chars"), codes.alias("salience"))


@query
def sampling_plan_unbudgeted(spark, sf_dir):
    return S.plan(_sketches(spark, sf_dir))


@query
def plan_projection(spark, sf_dir):
    """Counts, coverage and reasons of the plan without a budget."""
    rows = _sketches(spark, sf_dir)
    return S.plan_projection(rows, S.plan(rows))


@query
def areas_under_budget(spark, sf_dir):
    """Sessions of all areas in one prompt of 3,000 characters per window."""
    items = _slices(spark, sf_dir).select("window_key", "area", F.concat_ws("/", "agent", "session_id").alias("internal_id"), F.concat("project", F.lit(": "), F.repeat(F.lit("step "), F.col("msg_count").cast("int"))).alias("text"))
    got = S.areas_under_budget(items, S.canonical(_sketches(spark, sf_dir)), 3000, 5)
    return got.select("window_key", "area", F.array_join("ids", ",").alias("ids"), F.array_join("texts", "|").alias("texts"))


@query
def area_texts(spark, sf_dir):
    """Area texts without prose: half of the sessions of areas other than coding have a summary."""
    tops = U.top_sessions(_slices(spark, sf_dir))
    summary = F.when((F.col("msg_count") % 2 == 0) & (F.col("area") != "coding"), F.concat(F.lit(" worked on "), "project", F.lit(" in "), "session_id"))
    return U.area_texts(_rollup(spark, sf_dir), tops.select("window_key", "area", "rank", summary.alias("summary")))


@query
def sampling_plan_budgeted(spark, sf_dir):
    return S.budgeted_plan(_sketches(spark, sf_dir), char_budget=6000)


@query
def sampling_coverage(spark, sf_dir):
    rows = _sketches(spark, sf_dir)
    return S.coverage_of(rows, S.budgeted_plan(rows, char_budget=6000))


@query
def budget_fit(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("source").alias("group"), F.col("doc_id").alias("pos"), F.length("text").alias("chars"))
    return S.budget_fit(docs, 6000, 5).select("group", "pos", "chars")


@query
def day_quota_sample(spark, sf_dir):
    rows = _sessions(spark, sf_dir).withColumn("local_day", local_day("start_us", "UTC"))
    return S.day_quota(rows, 7, 100).select("session_id", "active_us", F.col("place").cast("long").alias("place"))


@query
def first_texts(spark, sf_dir):
    docs = B.table(spark, sf_dir, "documents").select(F.col("source").alias("project"), F.col("text").alias("first_text"), F.col("doc_id").alias("start_us"), F.col("doc_id").alias("session_id"), F.col("n_chars").alias("active_us"))
    return S.first_texts(docs).select("project", F.col("rank").cast("long").alias("rank"), "text")


def _summary_table(spark, sf_dir):
    rows = B.turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    source = F.element_at(F.array(*[F.lit(s) for s in (M.PROVIDED, M.GENERATED, M.EXTRACTED, M.NO_EVIDENCE)]), (F.col("conv_id") % 4 + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("c"), F.col("conv_id")).alias("session_id"), F.concat(F.lit("old "), F.col("n")).alias("summary"), source.alias("source"),
        F.when(F.col("conv_id") % 8 < 4, F.col("n").cast("string")).otherwise(F.lit("")).alias("evidence_fingerprint"),
        F.when(F.col("conv_id") % 16 < 12, F.col("n").cast("string")).otherwise(F.lit("x")).alias("observed_evidence_fingerprint"), F.lit(1).cast("long").alias("created_at"),
        "conv_id", "n",
    )


@query
def summary_upsert(spark, sf_dir):
    table = _summary_table(spark, sf_dir)
    new = table.where("conv_id % 3 = 0").select(
        F.when(F.col("conv_id") % 5 == 0, F.concat("session_id", F.lit("-new"))).otherwise(F.col("session_id")).alias("session_id"), F.concat(F.lit(" new "), F.col("n")).alias("summary"),
        F.when(F.col("conv_id") % 2 == 0, "auto").otherwise("record").alias("source"), F.lit("").alias("evidence_fingerprint"), F.lit("").alias("observed_evidence_fingerprint"), F.lit(2).cast("long").alias("created_at"),
    )
    return M.upsert(table.drop("conv_id", "n"), new)


@query
def evidence_status(spark, sf_dir):
    return _summary_table(spark, sf_dir).select("session_id", M.evidence_status().alias("status"), M.eligible().alias("eligible"))


@query
def newest_generated(spark, sf_dir):
    return M.newest_generated(_summary_table(spark, sf_dir).withColumn("created_at", F.col("n")), 20)


@query
def session_facts(spark, sf_dir):
    """First, latest and final texts of conversations."""
    rows = B.turns(spark, sf_dir).select(F.lit("agent_a").alias("agent"), F.col("conv_id").alias("session_id"), F.lit("f").alias("path"), F.col("turn").alias("line_no"), "role", "text", "is_real_user", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("/d"), F.col("turn"))).alias("cwd"), F.lit(False).alias("is_subagent"))
    return A.session_facts(rows)


@query
def refresh_worklist(spark, sf_dir):
    table = _summary_table(spark, sf_dir)
    stored = table.where("conv_id % 7 <> 0").select("session_id", "source", (F.col("conv_id") % 3).cast("int").alias("prompt_version"), F.lit("n1").alias("narrator_fingerprint"), "evidence_fingerprint")
    found = table.select("session_id", F.when(F.col("conv_id") % 11 == 0, M.UNAVAILABLE).otherwise(F.col("n").cast("string")).alias("observed_now"), F.col("n").alias("plan_rank"), (F.col("conv_id") % 5 == 0).alias("has_reason"))
    got = M.refresh_worklist(found, stored, 2, "n1")
    return got.select("session_id", "plan_rank", "has_reason", F.col("priority").cast("long").alias("priority"))


@query
def summary_resolution(spark, sf_dir):
    table = _summary_table(spark, sf_dir)
    ids = table.select(F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("slice-"), F.col("session_id"))).otherwise(F.col("session_id")).alias("evidence_id"), F.col("session_id").alias("public_id"))
    return M.resolve(ids, table.select("session_id", "summary", "source"))


@query
def missing_summaries(spark, sf_dir):
    table = _summary_table(spark, sf_dir)
    return M.missing(table.select("session_id"), table.where("conv_id % 6 <> 0"))


@query
def aggregate_cache(spark, sf_dir):
    """Which areas of a window find their cached aggregate: the one of the sessions counted then."""
    rows = _slices(spark, sf_dir)
    n = rows.groupBy("window_key", "area").agg(F.count("*").alias("n"), F.expr("sum(active_us) div 3600000000").alias("hours"))
    cache = n.where("n % 2 = 0").select("window_key", "area", "n", "hours")
    return M.cache_hits(n, cache, ["window_key", "area", "n", "hours"])


@query
def invalidate_cache(spark, sf_dir):
    n = _slices(spark, sf_dir).groupBy("window_key", "area").agg(F.count("*").alias("n"))
    return M.invalidate(n, B.windows(spark).where("ord = 0"), ["window_key"])


def _repo_inputs(spark, sf_dir):
    """Orders as commits, lines as merged requests, parts as releases of the customers' nations."""
    customers = B.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("repo"), F.col("c_nationkey")).alias("repo"))
    o = B.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("repo", "o_orderkey", epoch_us("o_orderdate").alias("ts_us"), "o_orderstatus")
    c = o.select("repo", F.concat(F.lit("order "), F.col("o_orderkey")).alias("subject"), "ts_us", (F.col("o_orderstatus") == "P").alias("is_merge"))
    m = o.select("repo", F.when(F.col("o_orderkey") % 9 != 0, F.expr("o_orderkey div 4")).alias("number"), F.col("ts_us").alias("merged_us"))
    r = o.select("repo", F.concat(F.lit("v"), F.col("o_orderkey")).alias("tag"), F.col("ts_us").alias("published_us"), (F.col("o_orderstatus") == "F").alias("draft"))
    return c, m, r


def _order_windows(spark):
    from datetime import UTC, datetime

    from tidemark.functions.time import to_us, windows_frame

    return windows_frame(spark, [(f"y{y}", to_us(datetime(y, 1, 1, tzinfo=UTC)), to_us(datetime(y + 1, 1, 1, tzinfo=UTC))) for y in range(1992, 1999)])


@query
def repo_activity(spark, sf_dir):
    c, m, r = _repo_inputs(spark, sf_dir)
    w = _order_windows(spark)
    got = R.activity(R.commits(c, w), R.merged_requests(m, w), R.releases(r, w))
    return got.select("window_key", "repo", "commits", "newest", "merged", "releases", "tags", F.col("rank").cast("long").alias("rank"), "is_enriched")


@query
def repo_totals(spark, sf_dir):
    c, m, r = _repo_inputs(spark, sf_dir)
    w = _order_windows(spark)
    return R.totals(R.activity(R.commits(c, w), R.merged_requests(m, w), R.releases(r, w)))


@query
def star_delta(spark, sf_dir):
    """Orders so far per nation as star snapshots."""
    customers = B.table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("repo"), F.col("c_nationkey")).alias("repo"))
    o = B.table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("repo", F.col("o_orderdate").cast("date").alias("captured_at"))
    day = o.groupBy("repo", "captured_at").agg(F.count("*").alias("n"))
    stars = day.withColumn("stars", F.sum("n").over(W.partitionBy("repo").orderBy("captured_at").rowsBetween(W.unboundedPreceding, 0)))
    return R.star_delta(stars.select("repo", "captured_at", "stars"), _order_windows(spark))


@query
def parsed_timestamps(spark, sf_dir):
    """Instants written as ISO text, some with an offset or broken, read back."""
    e = B.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("t"))
    text = F.when(F.col("event_id") % 4 == 0, F.concat("t", F.lit("Z"))).when(F.col("event_id") % 4 == 1, F.col("t")).when(F.col("event_id") % 4 == 2, F.concat("t", F.lit("+02:00"))).otherwise(F.left("t", F.lit(4)))
    return e.select("event_id", parse_iso(text).alias("ts_us"))


@query
def price_changes(spark, sf_dir):
    """Rates of parts as two price lists: this year's and one with some parts dropped and raised."""
    from tidemark.sources.prices import price_changes as changes

    p = B.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("model"), F.col("p_partkey"), *[(F.col("p_partkey") % m).cast("double").alias(c) for c, m in (("inp", 7), ("out", 11), ("cw", 5), ("cr", 3))])
    old = p.where("p_partkey % 10 <> 1").drop("p_partkey")
    new = p.where("p_partkey % 10 <> 2").withColumn("inp", F.col("inp") + F.when(F.col("p_partkey") % 10 == 3, 1.0).otherwise(0.0)).drop("p_partkey")
    return changes(old, new)


@query
def recap_json(spark, sf_dir):
    """The recap envelope of both windows as JSON, and a JSON row for each of their sessions."""
    from tidemark.plans import marts

    messages = written(A.with_next(B.activity(spark, sf_dir)))  # facts are written once and read by every part
    rows, windows = written(_slices(spark, sf_dir, messages=messages)), B.windows(spark)
    totals = written(A.window_totals(A.clip(A.active_intervals(messages), windows)))
    rolled = written(U.area_project_rollup(rows, totals))
    got = marts.recap(windows, totals, rolled, U.agent_breakdown(rows), written(_costed(spark, sf_dir)), U.top_focus(rolled))
    return marts.as_json(got).unionByName(marts.as_json(marts.recap_sessions(rows)))


@query
def coverage_over_weeks(spark, sf_dir):
    """Least complete coverage of each agent over the weeks it was active in."""
    rows = A.slices(B.activity(spark, sf_dir), B.weekly(spark)).select("agent", "window_key").distinct().join(F.broadcast(B.providers(spark).select("agent", "usage_coverage")), "agent")
    return K.least_coverage(rows)


@query
def log_messages_a(spark, sf_dir):
    """Messages of shape A lines made from conversations."""
    got = L.message_log(B.message_lines(spark, sf_dir))
    return got.select("session_id", "line_no", "ts_us", "role", "is_real_user", "narrative", "text", "cwd", "is_subagent", "project_raw", "is_scheduled")


@query
def log_usage_a(spark, sf_dir):
    got = L.message_usage(B.message_lines(spark, sf_dir))
    return got.select("path", "line_no", "ts_us", "model", "message_id", *K.COUNTERS)


@query
def log_metrics(spark, sf_dir):
    """Files, lines and lines that are no JSON objects."""
    return L.scan_metrics(B.message_lines(spark, sf_dir))


@query
def log_messages_b(spark, sf_dir):
    got = L.rollout_log(B.rollout_lines(spark, sf_dir))
    return got.select("session_id", "line_no", "ts_us", "is_activity", "counts_msg", "is_real_user", "text", "role")


@query
def log_usage_b(spark, sf_dir):
    """Usage of rollouts from cumulative counters, without what children copied."""
    return K.branch_usage(*L.rollout_snapshots(B.rollout_lines(spark, sf_dir))).select("branch", "ts_us", "model", *K.COUNTERS)


@query
def log_messages_c(spark, sf_dir):
    got = L.step_log(B.step_lines(spark, sf_dir))
    return got.select("session_id", "line_no", "ts_us", "counts_msg", "is_real_user", "text", "role")


@query
def log_usage_c(spark, sf_dir):
    return L.step_usage(B.step_lines(spark, sf_dir)).select("session_id", "step", "ts_us", "model", *K.COUNTERS)


@query
def log_sessions(spark, sf_dir):
    """Sessions of all three shapes whose span meets a window of twelve days, engaged ones only."""
    parts = [L.message_log(B.message_lines(spark, sf_dir)), L.rollout_log(B.rollout_lines(spark, sf_dir)), L.step_log(B.step_lines(spark, sf_dir))]
    rows = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    got = L.sessions_between(rows.where("is_activity"), B.WINDOWS[0][1], B.WINDOWS[0][1] + 12 * 86_400 * 1_000_000, engaged_only=True)
    return got.select("agent", "session_id", "start_us", "end_us", "msg_count", "user_msg_count", "active_us", "is_scheduled")


EVIDENCE_WINDOWS = [(f"e{i:02d}", (1705276800 + (0 if i == 0 else 130 + 500 * 2 ** (i - 1))) * 1_000_000, (1705276800 + 130 + 500 * 2**i) * 1_000_000) for i in range(14)]


@query
def evidence_slices(spark, sf_dir):
    """Bounded evidence of the conversations in adjacent windows, with fingerprints and slice names."""
    from tidemark.functions.time import windows_frame
    from tidemark.operators import evidence as E

    return E.window_evidence(L.message_log(B.message_lines(spark, sf_dir)), windows_frame(spark, EVIDENCE_WINDOWS))


@query
def aggregate_cache_sets(spark, sf_dir):
    """Which days of a project find their cached aggregate: those whose sessions were all there at 18 o'clock (UTC), by id set and whole hours."""
    rows = _slices(spark, sf_dir).withColumn("day", F.expr("start_us div 86400000000")).withColumn("internal_id", F.concat_ws("/", "agent", "session_id"))
    by = ["window_key", "project", "day"]

    def keyed(part):
        hours = part.groupBy(*by).agg(F.expr("sum(active_us) div 3600000000").alias("hours"), F.count("*").alias("n"))
        return hours.join(M.id_sets(part, by, ["internal_id"]), by)

    cached = keyed(rows.where("start_us % 86400000000 < 64800000000"))
    return M.cache_hits(keyed(rows), cached, [*by, "digest", "hours"]).drop("digest")


def _log_report(spark, sf_dir):
    """Facts and settings of a report over lines of all three shapes."""
    from tidemark.plans import report

    a, b, c = B.message_lines(spark, sf_dir), B.rollout_lines(spark, sf_dir), B.step_lines(spark, sf_dir)
    messages = L.message_log(a).unionByName(L.rollout_log(b), allowMissingColumns=True).unionByName(L.step_log(c), allowMissingColumns=True)
    fields = ["agent", "path", "line_no", "ts_us", "model", "message_id", *K.COUNTERS]
    rollouts = K.branch_usage(*L.rollout_snapshots(b)).select(F.lit("agent_b").alias("agent"), F.col("branch").alias("path"), F.lit(0).cast("long").alias("line_no"), "ts_us", "model", F.lit(None).cast("string").alias("message_id"), *K.COUNTERS)
    steps = L.step_usage(c).select(F.lit("agent_c").alias("agent"), F.col("session_id").alias("path"), F.col("step").alias("line_no"), "ts_us", "model", F.lit(None).cast("string").alias("message_id"), *K.COUNTERS)
    usage = L.message_usage(a).select(fields).unionByName(rollouts).unionByName(steps)
    prices = K.layered_prices([(B.prices(spark, B.FAMILY_PRICES), "default"), (B.prices(spark, {"model-1": (1, 2, 1, 0.1), "s1": (2, 4, 2, 0.2)}), "listed")], list(B.FAMILY_PRICES))
    names = spark.createDataFrame([("model-2", "model-1")], "model string, target string")
    settings = report.Settings(B.windows(spark), B.ZONE, B.rules(spark), B.aliases(spark), prices, names, B.providers(spark), B.GOALS, ("current", "previous"))
    return report.facts(messages, usage, settings), settings


@query
def log_recap(spark, sf_dir):
    """The whole recap from log lines: an envelope a window with goals, comparison, sampling, cost and artifacts, as JSON."""
    from tidemark.plans import marts, report

    found, settings = _log_report(spark, sf_dir)
    c, m, r = _repo_inputs(spark, sf_dir)
    w = settings.windows
    return marts.as_json(report.recap(found, settings, R.activity(R.commits(c, w), R.merged_requests(m, w), R.releases(r, w))))
