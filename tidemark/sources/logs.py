"""Adapters from the agents' JSON-lines logs to messages and usage events.

raw_lines reads text once and keeps each line as a VARIANT; the adapters project it to columns
early. A line that isn't a JSON object becomes a null and is counted, never fatal. Line numbers
are settled without moving the lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import file_stem, is_narrative, is_real_user, strip_task, unwrap_request
from tidemark.functions.time import parse_iso
from tidemark.operators import activity as A
from tidemark.operators import usage as K
from tidemark.operators.lineage import written

#: Splits of log files whose counts are broadcast (about 100 bytes each).
MOST_SPLITS = 200_000
MESSAGES = ["agent", "session_id", "path", "line_no", "ts_us", "is_activity", "counts_msg", "is_real_user", "text", "narrative", "cwd", "is_subagent", "is_scheduled"]


@dataclass(frozen=True)
class Scan:
    """Log files read once: lines (path, line_no, value, v) as a written table, and what was met on the way."""

    lines: DataFrame
    metrics: dict[str, int]


def numbered_lines(seen: DataFrame) -> DataFrame:
    """seen (path, _block, _at, ...) with line_no in place of _block and _at: lines counted in two levels.

    A split's lines are counted, the counts of a file's splits are summed up, and a line adds its
    place in its split. Only a row for each split is shuffled; it is broadcast up to MOST_SPLITS
    splits, beyond that joined.
    """
    first = W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    splits = seen.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = written(splits.select("path", "_block", (F.coalesce(F.sum("_n").over(first), F.lit(0)) - F.col("_first") + 1).alias("_shift")))
    few = splits.count() <= MOST_SPLITS
    met = seen.join(F.broadcast(splits) if few else splits, ["path", "_block"])
    return met.withColumn("line_no", F.col("_at") + F.col("_shift")).drop("_block", "_at", "_shift")


def scan(spark: SparkSession, paths: list[str], recursive: bool = False, modified_after: str | None = None, name: str = "*.jsonl") -> Scan:
    """The lines of log files, parsed once and written, so that all adapters and windows read the same table.

    Overlapping globs are one scan and a file counts once. modified_after prunes files by their
    time and is for sessions only: usage trusts the instants inside. Blank lines are numbered and left
    out. metrics: files that have lines, lines and bad_lines (not blank; no JSON object), counted
    during the scan, and inventory_complete.
    """
    reader = spark.read.option("pathGlobFilter", name)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = reader.text(list(dict.fromkeys(paths))).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    v = F.try_parse_json("value")
    lines = lines.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))
    told, there = Observation(), F.trim("value") != ""
    lines = lines.observe(told, F.count_if(there).alias("lines"), F.count_if(there & F.col("v").isNull()).alias("bad_lines"))
    seen = written(lines)
    files = seen.where(there).select("path").distinct().count()
    out = numbered_lines(seen).where(there).select("path", "line_no", "value", "v")
    return Scan(out, {"files": files, **told.get, "inventory_complete": told.get["bad_lines"] == 0})


def raw_lines(spark: SparkSession, paths: list[str], recursive: bool = False, modified_after: str | None = None, name: str = "*.jsonl") -> DataFrame:
    """(path, line_no, value, v) of every non-blank line; v is null where the line is no JSON object. See scan."""
    return scan(spark, paths, recursive, modified_after, name).lines


def scan_metrics(lines: DataFrame) -> DataFrame:
    """The same counts of lines that were not read by `scan`."""
    return lines.agg(F.count_distinct("path").alias("files"), F.count("*").alias("lines"), F.count_if(F.col("v").isNull()).alias("bad_lines")).withColumn("inventory_complete", F.col("bad_lines") == 0)


def _text(path: str) -> Column:
    """A string at path, else null (other kinds aren't turned into strings)."""
    return F.when(_kind(path) == "STRING", F.try_variant_get("v", path, "string"))


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _count(path: str, null_is_zero: bool = False) -> Column:
    """A non-negative integer at path; booleans, decimals and strings give null."""
    n = F.when(_kind(path) == "BIGINT", F.try_variant_get("v", path, "bigint"))
    n = F.when(n >= 0, n)
    absent = F.try_variant_get("v", path, "variant").isNull() | (_kind(path) == "VOID")
    return F.when(absent, F.lit(0)).otherwise(n).cast("long") if null_is_zero else n.cast("long")


def content_text(path: str, joined: bool) -> Column:
    """Text of a content field: the string itself, or the first (or all) text parts of a list."""
    parts = F.try_variant_get("v", path, "array<variant>")
    texts = F.filter(F.transform(parts, lambda p: F.try_variant_get(p, "$.text", "string")), lambda t: t.isNotNull() & (t != ""))
    many = F.array_join(texts, "\n") if joined else F.get(texts, F.lit(0))
    return F.when(_kind(path) == "STRING", F.try_variant_get("v", path, "string")).when(_kind(path).startswith("ARRAY"), many)


def message_log(lines: DataFrame) -> DataFrame:
    """Shape A: one file per session, user and assistant lines."""
    rows = lines.where(F.col("v").isNotNull()).withColumn("type", _text("$.type")).where(F.col("type").isin("user", "assistant"))
    text = F.coalesce(content_text("$.message.content", False), F.lit(""))
    sub = F.array_contains(F.split("path", "/"), "subagents")
    opening = F.first(F.when((F.col("type") == "user") & (F.trim(text) != ""), text), ignorenulls=True)
    opening = opening.over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return rows.select(
        F.lit("agent_a").alias("agent"), file_stem(F.col("path")).alias("session_id"), "path", "line_no", parse_iso(_text("$.timestamp")).alias("ts_us"),
        F.lit(True).alias("is_activity"), F.lit(True).alias("counts_msg"), ((F.col("type") == "user") & is_real_user(text)).alias("is_real_user"),
        text.alias("text"), is_narrative(text).alias("narrative"), _text("$.cwd").alias("cwd"), sub.alias("is_subagent"),
        F.regexp_extract("path", r"projects/([^/]+)/", 1).alias("project_raw"), F.col("type").alias("role"),
        F.coalesce(opening.startswith("<scheduled-task"), F.lit(False)).alias("is_scheduled"),
    )


def message_usage(lines: DataFrame) -> DataFrame:
    """Usage of assistant lines of shape A, subagents included; broken counters reject the line."""
    usage = "$.message.usage"
    n = {"input_tokens": "input_tokens", "cache_creation": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens", "output_tokens": "output_tokens"}
    rows = lines.where(F.col("v").isNotNull()).where((_text("$.message.role") == "assistant") & _kind(usage).startswith("OBJECT"))
    rows = rows.select(
        F.lit("agent_a").alias("agent"), "path", "line_no", parse_iso(_text("$.timestamp")).alias("ts_us"), F.coalesce(_text("$.message.model"), F.lit(K.UNKNOWN)).alias("model"),
        _text("$.message.id").alias("message_id"), *[_count(f"{usage}.{source}", True).alias(c) for c, source in n.items()],
    )
    return rows.where(" and ".join(f"{c} is not null" for c in ["ts_us", *n]))


def rollout_log(lines: DataFrame) -> DataFrame:
    """Shape B: rollouts with session metadata, events and response items; whole subagent files go."""
    rows = lines.where(F.col("v").isNotNull()).withColumns({"type": _text("$.type"), "kind": _text("$.payload.type"), "role": _text("$.payload.role")})
    by = W.partitionBy("path")
    meta = F.col("type") == "session_meta"
    first = lambda p: F.first(F.when(meta, _text(p)), ignorenulls=True).over(by.orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    sub = meta & (_text("$.payload.parent_thread_id").isNotNull() | F.coalesce(F.try_variant_get("v", "$.payload.source", "string").contains("subagent"), F.lit(False)))
    rows = rows.withColumn("session_id", F.coalesce(first("$.payload.id"), first("$.payload.session_id"), file_stem(F.col("path")))).withColumn("is_subagent", F.max(sub).over(by)).where("not is_subagent")
    item, event = F.col("type") == "response_item", F.col("type") == "event_msg"
    said = strip_task(F.coalesce(_text("$.payload.message"), content_text("$.payload.content", True), F.lit("")))
    counts = item & ((F.col("kind") == "message") & F.col("role").isin("user", "assistant") | F.col("kind").endswith("_call") | F.col("kind").endswith("_call_output")) | event & (F.col("kind") == "user_message")
    user = event & (F.col("kind") == "user_message")
    return rows.select(
        F.lit("agent_b").alias("agent"), "session_id", "path", "line_no", parse_iso(_text("$.timestamp")).alias("ts_us"), F.coalesce(item | event & F.col("kind").isin("user_message", "agent_message"), F.lit(False)).alias("is_activity"),
        F.coalesce(counts, F.lit(False)).alias("counts_msg"), F.coalesce(user & (F.trim(said) != ""), F.lit(False)).alias("is_real_user"), said.alias("text"), is_narrative(said).alias("narrative"), _text("$.payload.cwd").alias("cwd"), "is_subagent",
        F.lit(None).cast("string").alias("project_raw"), F.when(user, "user").otherwise(F.col("role")).alias("role"), F.lit(False).alias("is_scheduled"),
    )


def rollout_snapshots(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cumulative counters of shape B with the model in force, and the branch tree."""
    rows = lines.where(F.col("v").isNotNull()).withColumns({"type": _text("$.type"), "kind": _text("$.payload.type")})
    whole = W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first_meta = F.first(F.when(F.col("type") == "session_meta", F.struct(F.coalesce(_text("$.payload.id"), _text("$.payload.session_id")).alias("id"), _text("$.payload.parent_thread_id").alias("parent"))), ignorenulls=True).over(whole)
    rows = rows.withColumn("meta", first_meta).withColumn("branch", F.coalesce("meta.id", "path")).withColumn("context_model", F.when(F.col("type") == "turn_context", _text("$.payload.model")))
    rows = K.last_model(rows)
    total = "$.payload.info.total_token_usage"
    names = {"input_total": "input_tokens", "cached_total": "cached_input_tokens", "write_total": "cache_write_input_tokens", "output_total": "output_tokens"}
    snaps = rows.where((F.col("kind") == "token_count") & _kind(total).startswith("OBJECT")).select("branch", parse_iso(_text("$.timestamp")).alias("ts_us"), "model", *[F.coalesce(_count(f"{total}.{s}"), F.lit(0)).alias(c) for c, s in names.items()])
    tree = rows.groupBy("branch").agg(F.max("meta.parent").alias("parent"))
    return snaps.where("ts_us is not null"), tree


def step_log(lines: DataFrame) -> DataFrame:
    """Shape C: steps; every step is activity, only user and assistant steps are messages."""
    rows = lines.where(F.col("v").isNotNull()).withColumns({"type": _text("$.type"), "source": _text("$.source")})
    user = (F.col("type") == "USER_INPUT") & (F.col("source").isNull() | (F.col("source") == "USER_EXPLICIT")) | F.col("type").isNull() & (F.col("source") == "USER_EXPLICIT")
    answer = (F.col("type") == "PLANNER_RESPONSE") & (F.col("source").isNull() | (F.col("source") == "MODEL")) | F.col("type").isNull() & (F.col("source") == "MODEL")
    user, answer = F.coalesce(user, F.lit(False)), F.coalesce(answer, F.lit(False))
    text = unwrap_request(F.coalesce(content_text("$.content", True), F.lit("")))
    rows = rows.withColumns({"user": user, "said": text, "session_id": F.regexp_extract("path", r"brain/([^/]+)/", 1)})
    opening = F.first(F.when(F.col("user"), F.col("said")), ignorenulls=True).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("opening", opening).where(~F.coalesce(F.col("opening").startswith("<identity>") | F.col("opening").startswith("<subagents>"), F.lit(False)))
    return rows.select(
        F.lit("agent_c").alias("agent"), "session_id", "path", "line_no", parse_iso(_text("$.created_at")).alias("ts_us"), F.lit(True).alias("is_activity"), (F.col("user") | answer).alias("counts_msg"),
        (F.col("user") & is_real_user(F.col("said"))).alias("is_real_user"), F.col("said").alias("text"), is_narrative(F.col("said")).alias("narrative"), F.lit(None).cast("string").alias("cwd"), F.lit(False).alias("is_subagent"),
        F.lit(None).cast("string").alias("project_raw"), F.when(F.col("user"), "user").when(answer, "assistant").alias("role"), F.lit(False).alias("is_scheduled"),
    )


def step_usage(lines: DataFrame) -> DataFrame:
    """Usage of shape C lines: nested before top level, the first key that is there decides."""
    def first_key(names: list[str]) -> Column:
        out = F.lit(None).cast("long")
        for at in reversed([f"$.usage.{n}" for n in names] + [f"$.{n}" for n in names]):
            out = F.when(F.try_variant_get("v", at, "variant").isNotNull(), _count(at)).otherwise(out)
        return out

    rows = lines.where(F.col("v").isNotNull()).select(
        F.regexp_extract("path", r"brain/([^/]+)/", 1).alias("session_id"), _count("$.step_index").alias("step"), parse_iso(_text("$.created_at")).alias("ts_us"), F.coalesce(_text("$.usage.model"), _text("$.model")).alias("model"),
        first_key(["input_tokens", "prompt_tokens"]).alias("input_tokens"), first_key(["output_tokens", "completion_tokens"]).alias("output_tokens"),
        F.coalesce(first_key(["cache_read_tokens", "cached_tokens", "cache_read_input_tokens"]), F.lit(0)).alias("cache_read"), F.lit(0).cast("long").alias("cache_creation"),
    )
    return rows.where("model is not null and input_tokens is not null and output_tokens is not null")


def step_clock(main: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(session_id, step, ts_us): the first time written for each step; the overlay only fills in."""
    take = lambda rows, rank: rows.where(F.col("v").isNotNull()).select(F.regexp_extract("path", r"brain/([^/]+)/", 1).alias("session_id"), _count("$.step_index").alias("step"), parse_iso(_text("$.created_at")).alias("ts_us"), F.lit(rank).alias("rank"), "line_no")
    both = take(main, 0) if overlay is None else take(main, 0).unionByName(take(overlay, 1))
    return both.where("step is not null and ts_us is not null").groupBy("session_id", "step").agg(F.min_by("ts_us", F.struct("rank", "line_no")).alias("ts_us"))


def companion_rows(rows: DataFrame) -> DataFrame:
    """Decoded companion rows, the first valid one of each (session_id, idx)."""
    good = rows.where("idx is not null and model is not null and input_tokens >= 0 and output_tokens >= 0")
    return good.groupBy("session_id", "idx").agg(F.min_by(F.struct("model", "input_tokens", "output_tokens", "cache_read"), F.struct("model", "input_tokens", "output_tokens")).alias("r")).select("session_id", "idx", "r.*")


def without_children(messages: DataFrame, lines: DataFrame) -> DataFrame:
    """Sessions that another session started as its child go: named in a field or by UUID in a line.

    Only ids that exist count, and never a session's own.
    """
    some = lines.where(F.col("value").contains("INVOKE_SUBAGENT"))  # cheap test before the regular expression
    uuid = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
    named = some.select(F.regexp_extract("path", r"brain/([^/]+)/", 1).alias("parent"), F.explode(F.expr(f"regexp_extract_all(value, '({uuid})', 1)")).alias("child")).where("parent <> child")
    child = named.select(F.col("child").alias("session_id")).distinct().join(messages.select("session_id").distinct(), "session_id", "left_semi")
    return messages.join(child, "session_id", "left_anti")


def transcript_index(lines: DataFrame) -> DataFrame:
    """(key, path): files by stem and by trailing UUID, first path wins."""
    from tidemark.functions.text import file_uuid

    paths = lines.select("path").distinct()
    keys = paths.select("path", F.explode(F.array_compact(F.array(file_stem(F.col("path")), file_uuid(F.col("path"))))).alias("key"))
    return keys.groupBy("key").agg(F.min("path").alias("path"))


@dataclass(frozen=True)
class Provider:
    """An agent's adapter: name, label, how completely it reports usage, and its tables from lines."""

    name: str
    label: str
    usage_coverage: str
    messages: Callable[[DataFrame], DataFrame]
    usage: Callable[[DataFrame], DataFrame] | None = None
    recursive: bool = False


_REGISTRY: dict[str, Provider] = {}


def register(provider: Provider, replace: bool = False) -> None:
    if not provider.name.replace("_", "").isalnum() or provider.usage_coverage not in K.COVERAGE_RANK:
        raise ValueError(f"bad provider {provider.name!r}")
    if provider.name in _REGISTRY and not replace:
        raise ValueError(f"{provider.name} is there already")
    _REGISTRY[provider.name] = provider


def providers(agent: str = "all") -> list[Provider]:
    if agent == "all":
        return list(_REGISTRY.values())
    if agent not in _REGISTRY:
        raise ValueError(f"no provider {agent!r}")
    return [_REGISTRY[agent]]


@dataclass(frozen=True)
class Logs:
    """What the providers' files hold: messages and usage of all that could be read, and a report row for each.

    report: agent, files, lines, bad_lines, error (null: read). messages and usage are None if no provider has any.
    """

    messages: DataFrame | None
    usage: DataFrame | None
    report: DataFrame


def ingest(spark: SparkSession, roots: dict[str, list[str]], agent: str = "all", modified_after: str | None = None) -> Logs:
    """Messages and usage of the chosen providers; roots: paths of each provider, those without one are left out.

    Each provider's files are scanned once for both tables. A provider whose files or adapter fail
    becomes a report row with the error; the others go on.
    """
    messages, usage, report = None, None, []
    for p in providers(agent):
        if not roots.get(p.name):
            continue
        met: dict = {}
        try:
            got = scan(spark, roots[p.name], p.recursive, modified_after)
            met = got.metrics
            said = written(p.messages(got.lines))
            used = written(p.usage(got.lines).withColumn("agent", F.lit(p.name))) if p.usage else None
        except (PySparkException, ValueError, KeyError, TypeError) as e:
            report.append((p.name, met.get("files"), met.get("lines"), met.get("bad_lines"), f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"))
            continue
        report.append((p.name, met["files"], met["lines"], met["bad_lines"], None))
        messages = said if messages is None else messages.unionByName(said, allowMissingColumns=True)
        if used is not None:
            usage = used if usage is None else usage.unionByName(used, allowMissingColumns=True)
    return Logs(messages, usage, spark.createDataFrame(report, "agent string, files long, lines long, bad_lines long, error string"))


def collect_messages(spark: SparkSession, roots: dict[str, list[str]], agent: str = "all") -> DataFrame:
    """Messages of the chosen providers in one table; roots: paths of each provider. A failing provider is an error here."""
    got = ingest(spark, roots, agent)
    failed = got.report.where("error is not null").first()
    if failed is not None or got.messages is None:
        raise ValueError(f"{failed.agent}: {failed.error}" if failed is not None else "no provider has a path")
    return got.messages


def sessions_between(messages: DataFrame, since_us: int | None = None, until_us: int | None = None, engaged_only: bool = False, cap_us: int = A.GAP_CAP_US) -> DataFrame:
    """Sessions of messages whose closed span meets [since, until); open bounds are null."""
    found = A.sessions(messages, cap_us)
    if since_us is not None:
        found = found.where(F.col("end_us") >= since_us)
    if until_us is not None:
        found = found.where(F.col("start_us") < until_us)
    return found.where("engaged") if engaged_only else found


def usage_between(usage: DataFrame, since_us: int | None = None, until_us: int | None = None, agent: str | None = None) -> DataFrame:
    """Usage rows inside the closed bounds, of one agent or all; message ids aren't settled here (see usage_in_windows)."""
    rows = usage if agent is None else usage.where(F.col("agent") == agent)
    rows = rows if since_us is None else rows.where(F.col("ts_us") >= since_us)
    return rows if until_us is None else rows.where(F.col("ts_us") <= until_us)


register(Provider("agent_a", "Agent A", "complete", message_log, message_usage))
register(Provider("agent_b", "Agent B", "complete", rollout_log, lambda lines: K.branch_usage(*rollout_snapshots(lines)), recursive=True))
register(Provider("agent_c", "Agent C", "complete", step_log, step_usage))
