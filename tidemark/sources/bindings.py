"""The driver tables seen as agent activity: what the registered queries read."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import is_real_user
from tidemark.functions.time import SECOND, epoch_us, to_us, windows_frame
from tidemark.operators.classify import DEFAULT_AREAS, rules_frame
from tidemark.operators.lineage import written

ZONE = "America/New_York"
FOLDERS = [
    "-Users-u-code-stock-dashboard", "-Users-u-code-blog-site", "-home-u-projects-web-app", "-Users-u-Side-project-data-pipeline",
    "-home-u-dev-scratch-pad", "-Users-u-code-acme-core", "-Users-u-code-web_app", "-Users-u-code-web-app--claude-worktrees-x-y",
]
ALIASES = [("web-app", "acme-web"), ("scratch-pad", "playground")]
WINDOWS = [
    ("previous", to_us(datetime(2024, 1, 8, 12, tzinfo=UTC)), to_us(datetime(2024, 1, 15, 12, tzinfo=UTC))),
    ("current", to_us(datetime(2024, 1, 15, 12, tzinfo=UTC)), to_us(datetime(2024, 1, 22, 12, tzinfo=UTC))),
]
GOALS = [
    {"id": "g-stock", "title": "Ship the dashboard", "projects": ["stock-dashboard"]},
    {"id": "g-web", "title": "New site", "projects": ["web-app", "blog-site"], "valid_from": "2024-01-10", "valid_until": "2024-01-18"},
    {"id": "g-data", "title": "Data quality", "projects": ["data-pipeline", "acme-web"], "valid_until": "2024-01-31"},
    {"id": "g-old", "title": "Finished", "projects": ["playground"], "valid_until": "2023-12-31"},
    {"id": "g-idle", "title": "Not started", "projects": ["nothing-yet"]},
]
FAMILY_PRICES = {"fable": (10, 50, 12.5, 1), "mythos": (10, 50, 12.5, 1), "opus": (5, 25, 6.25, 0.5), "sonnet": (3, 15, 3.75, 0.3), "haiku": (1, 5, 1.25, 0.1)}
USER_PRICES = {"sonnet-y": (4, 16, 5, 0.4)}
LISTED_PRICES = {"haiku-z": (0.8, 4, 1, 0.08)}
PROVIDERS = [("agent_a", "Agent A", "complete", 0), ("agent_b", "Agent B", "complete", 1), ("agent_c", "Agent C", "partial", 2)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages(agent, session_id, ts_us, event_id, is_real_user, project_raw, role, cwd) over events."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    user = F.col("event_type").isin("click", "purchase", "signup")
    week = F.concat(F.lit("u"), F.col("user_id"), F.lit("-"), F.expr("extract(yearofweek from ts)"), F.lit("W"), F.weekofyear("ts"))
    return e.select(
        _pick(["agent_a", "agent_b", "agent_c"], F.col("user_id") % 3).alias("agent"), week.alias("session_id"), epoch_us("ts").alias("ts_us"), "event_id",
        (user & (F.col("event_type") != "signup")).alias("is_real_user"), _pick(FOLDERS, F.col("user_id") % 8).alias("project_raw"),
        F.when(user, "user").otherwise("assistant").alias("role"), F.concat(F.lit("/work/"), (F.col("user_id") % 16).cast("string")).alias("cwd"),
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows over the view and error events."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'error')")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        _pick(["agent_a", "agent_b", "agent_c"], F.col("user_id") % 3).alias("agent"), epoch_us("ts").alias("ts_us"),
        _pick(["opus-x", "sonnet-y", "haiku-z", "mystery-1"], F.col("event_id") % 4).alias("model"),
        F.when(F.col("event_id") % 10 != 0, (F.col("event_id") - F.col("event_id") % 2).cast("string")).alias("message_id"),
        k.alias("input_tokens"), (2 * k).alias("cache_creation"), (10 * k).alias("cache_read"), F.floor("value").cast("long").alias("output_tokens"),
        F.lit("events").alias("path"), F.col("event_id").alias("line_no"),
    )


def windows(spark: SparkSession) -> DataFrame:
    return windows_frame(spark, WINDOWS)


def weekly(spark: SparkSession, count: int = 4) -> DataFrame:
    """Adjacent 7-day windows that end with the current one."""
    week, end = 7 * 86400 * SECOND, WINDOWS[1][2]
    return windows_frame(spark, [(f"w{i}", end - week * (count - i), end - week * (count - i - 1)) for i in range(count)])


def aliases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALIASES, "variant string, canonical string")


def rules(spark: SparkSession) -> DataFrame:
    return rules_frame(spark, DEFAULT_AREAS)


def prices(spark: SparkSession, rates: dict) -> DataFrame:
    return spark.createDataFrame([(m, *map(float, r)) for m, r in rates.items()], "model string, inp double, out double, cw double, cr double")


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "agent string, label string, usage_coverage string, ord int")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters per branch: running sums of an order's lines; every sixth line is reset."""
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("b"), F.col("l_orderkey")).alias("branch"), "l_linenumber", epoch_us("l_shipdate").alias("ts_us"),
        F.col("l_quantity").cast("long").alias("q"), F.col("l_partkey").cast("long").alias("p"), "l_suppkey", "l_quantity",
    )
    run = W.partitionBy("branch").orderBy("ts_us", "l_linenumber", "p", "l_suppkey", "l_quantity").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("q").over(run)
    held = F.when(F.col("l_linenumber") % 6 == 0, F.lit(0)).otherwise(total)
    return rows.select(
        "branch", "ts_us", F.when(F.col("p") % 3 == 0, "unknown").otherwise("m1").alias("model"),
        (held * 3).alias("input_total"), held.alias("cached_total"), (held * 2).alias("write_total"), (held * 5).alias("output_total"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations with a total order and its message flags."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("is_real_user", (F.col("role") == "user") & is_real_user(F.col("text")))


def _iso(us: Column) -> Column:
    """An instant as ISO text with the session's own offset."""
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _as_lines(rows: DataFrame) -> DataFrame:
    """rows (path, line_no, value) as the adapters take them: parsed once and written, as a scan of log files does.

    Otherwise Spark makes and parses the lines again in each filter and branch of each adapter.
    """
    v = F.try_parse_json("value")
    return written(rows.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v)))


def message_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as lines of one file each, shape A: text and parts, tools' files of subagents, scheduled tasks, broken lines, clocks and counters."""
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.when((c % 9 == 0) & (t <= 1) & (F.col("role") == "user"), F.concat(F.lit('<scheduled-task name="x"> '), "text")).otherwise(F.col("text"))
    counters = F.struct((10 * t).alias("input_tokens"), F.when(t % 2 == 0, 5).alias("cache_creation_input_tokens"), (F.length("text") % 100).alias("cache_read_input_tokens"), F.when(c % 10 == 3, -1).otherwise(c % 50).alias("output_tokens"))
    told = F.when(F.col("role") == "assistant", counters)
    common = [F.col("role"), F.concat(F.lit("m"), "conv_id", F.lit("-"), F.floor(t / 2)).alias("id"), F.when(c % 6 != 5, F.concat(F.lit("model-"), (c % 3).cast("string"))).alias("model"), told.alias("usage")]
    tool, part = F.lit(None).cast("string").alias("text"), F.lit("text").alias("type")
    parts = F.array(F.struct(F.lit("tool_use").alias("type"), tool), F.struct(part, said.alias("text")), F.struct(part, F.lit("second").alias("text")))
    stamp = F.when((c + t) % 13 == 0, F.lit("never")).otherwise(_iso((1705276800 + c * 600 + t * 37) * SECOND))
    line = lambda content: F.to_json(F.struct(F.col("role").alias("type"), stamp.alias("timestamp"), F.concat(F.lit("/work/"), (c % 16).cast("string")).alias("cwd"), F.struct(*common, content.alias("content")).alias("message")))
    value = F.when(t % 3 == 0, line(said)).otherwise(line(parts))
    path = F.concat(F.lit("projects/"), _pick(FOLDERS, c % 8), F.when(c % 11 == 0, F.lit("/subagents")).otherwise(F.lit("")), F.lit("/conv-"), c.cast("string"), F.lit(".jsonl"))
    return _as_lines(rows.select(path.alias("path"), (t + 1).alias("line_no"), F.when((c * 7 + t) % 23 == 0, F.left(value, F.lit(20))).otherwise(value).alias("value")))


def rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as rollout files, shape B, each after a line of session metadata; every tenth user is a child of the one before."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch_us("ts").alias("us"))
    kind, view = F.col("event_type"), F.col("event_type") == "view"
    from pyspark.sql import Window as W

    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    counted = e.where("event_type = 'signup'").select("event_id", n.alias("n"))
    e = e.join(counted, "event_id", "left")
    text = F.concat(F.lit("do "), F.col("event_id").cast("string"))
    total = F.when(F.col("n").isNotNull(), F.struct((10 * F.col("n")).alias("input_tokens"), (4 * F.col("n")).alias("cached_input_tokens"), F.col("n").alias("cache_write_input_tokens"), (3 * F.col("n")).alias("output_tokens")))
    switch = view & (F.col("event_id") % 3 == 0)
    payload = F.struct(
        F.when(kind == "click", "user_message").when(kind == "purchase", "message").when(switch, None).when(view, "function_call").when(kind == "error", "agent_message").otherwise("token_count").alias("type"),
        F.when(kind == "purchase", F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant")).alias("role"), F.when(kind.isin("click", "error"), text).alias("message"),
        F.when(kind == "purchase", F.array(F.struct(text.alias("text")), F.struct(F.lit("more").alias("text")))).alias("content"), F.when(switch, F.concat(F.lit("m"), (F.col("event_id") % 4).cast("string"))).alias("model"),
        F.when(F.col("n").isNotNull(), F.struct(total.alias("total_token_usage"))).alias("info"),
    )
    file = F.concat(F.lit("sessions/rollout-u"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    type_ = F.when(switch, "turn_context").when(kind.isin("purchase", "view"), "response_item").otherwise("event_msg")
    lines = e.select(file.alias("path"), (F.col("event_id") + 2).alias("line_no"), F.to_json(F.struct(type_.alias("type"), _iso(F.col("us")).alias("timestamp"), payload.alias("payload"))).alias("value"))
    u = e.groupBy("user_id").agg(F.min("us").alias("us"))
    meta = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.when(F.col("user_id") % 10 == 7, F.concat(F.lit("u"), (F.col("user_id") - 1).cast("string"))).alias("parent_thread_id"))
    heads = u.select(file.alias("path"), F.lit(1).cast("long").alias("line_no"), F.to_json(F.struct(F.lit("session_meta").alias("type"), _iso(F.col("us")).alias("timestamp"), meta.alias("payload"))).alias("value"))
    return _as_lines(heads.unionByName(lines))


def step_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as transcripts of steps, shape C; all that some users say is an identity prompt."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch_us("ts").alias("us"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    kind = F.col("event_type")
    asks = kind.isin("click", "purchase", "signup")
    text = F.concat(F.when(asks & (F.col("user_id") % 25 == 0), F.lit("<identity> ")).otherwise(F.lit("")), F.lit("say "), F.col("k").cast("string"))
    nested = F.when(kind == "view", F.struct(F.col("k").alias("input_tokens"), (F.col("k") + 1).alias("completion_tokens"), F.lit("s1").alias("model")))
    top = kind == "error"
    value = F.to_json(F.struct(
        F.when(asks, "USER_INPUT").when(kind == "view", "PLANNER_RESPONSE").alias("type"), F.when(kind == "click", "USER_EXPLICIT").when(kind == "signup", "SYSTEM").when(kind.isin("view", "error"), "MODEL").alias("source"),
        _iso(F.col("us")).alias("created_at"), F.col("event_id").alias("step_index"), text.alias("content"), nested.alias("usage"),
        F.when(top, F.col("k")).alias("prompt_tokens"), F.when(top, F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("k"))).alias("output_tokens"), F.when(top & (F.col("k") % 2 == 0), 2 * F.col("k")).alias("cached_tokens"), F.when(top, "s2").alias("model"),
    ))
    return _as_lines(e.select(F.concat(F.lit("brain/u"), F.col("user_id").cast("string"), F.lit("/transcript.jsonl")).alias("path"), (F.col("event_id") + 1).alias("line_no"), value.alias("value")))
