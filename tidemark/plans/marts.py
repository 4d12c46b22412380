"""Nested report tables: recap envelope, trend, goal history, compact recap and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import redact_paths

SCHEMA_VERSION = 1


def _listed(rows: DataFrame, name: str, *columns: str, order: list | None = None) -> DataFrame:
    """Rows of each window as one sorted array."""
    keys = [*(order or []), *columns]
    return rows.groupBy("window_key").agg(F.sort_array(F.collect_list(F.struct(*keys))).alias(name))


def recap(windows: DataFrame, totals: DataFrame, rollup: DataFrame, agents: DataFrame, models: DataFrame, focus: DataFrame) -> DataFrame:
    """One envelope row per window: totals, buckets with their projects, agents, models, focus.

    Areas and projects go by rounded minutes, most first, then name. Minutes have one decimal,
    hours two, shares four. Its sessions are rows of their own, see `recap_sessions`.
    """
    minutes = F.round("minutes", 1)
    projects = rollup.where("not is_area").withColumn("minutes", minutes).groupBy("window_key", "area").agg(F.sort_array(F.collect_list(F.struct((-F.col("minutes")).alias("by"), "project", "minutes", "sessions"))).alias("projects"))
    areas = rollup.where("is_area").withColumn("minutes", minutes).drop("project").join(projects, ["window_key", "area"], "left").withColumn("by", -F.col("minutes"))
    out = windows.select("window_key", "since_us", "until_us").join(totals.withColumn("hours", F.round(F.col("wall_us") / 3.6e9, 2)).select("window_key", "hours", "parallelism"), "window_key", "left")
    out = out.join(_listed(areas, "buckets", "area", "minutes", "sessions", "messages", "projects", order=["by"]), "window_key", "left")
    shares = agents.withColumns({c: F.round(c, 4) for c in ("time_share", "session_share")})
    out = out.join(_listed(shares, "agents", "agent", "sessions", "messages", "time_share", "session_share"), "window_key", "left")
    tokens = models.withColumn("by", -(F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read") + F.col("output_tokens")))
    out = out.join(_listed(tokens, "by_model", "model", "turns", "input_tokens", "output_tokens", order=["by"]), "window_key", "left")
    out = out.join(focus.select("window_key", F.struct("area", "project").alias("top_focus")), "window_key", "left")
    return out.withColumn("schema_version", F.lit(SCHEMA_VERSION))


def recap_sessions(sessions: DataFrame) -> DataFrame:
    """All sessions of each window, a row each, so that no window has to meet in one task. Only public ids appear."""
    return sessions.where(~F.col("session_id").startswith("slice-")).select("window_key", "start_us", "agent", "session_id", "area", "active_us")


def as_json(rows: DataFrame) -> DataFrame:
    """(window_key, json): absolute paths of the machine are redacted."""
    return rows.select("window_key", redact_paths(F.to_json(F.struct("*"))).alias("json"))


def compact_recap(recaps: DataFrame, sessions: DataFrame, n: int = 5) -> DataFrame:
    """Envelope with the n most active of the recap_sessions; ties by start and id."""
    rank = F.row_number().over(W.partitionBy("window_key").orderBy(F.desc("active_us"), "start_us", "session_id"))
    top = sessions.withColumn("r", rank).where(F.col("r") <= n).withColumn("by", -F.col("active_us"))
    top = _listed(top, "sessions", "by", "start_us", "session_id", "area")
    return recaps.join(top, "window_key", "left").select("window_key", "hours", F.transform("buckets", lambda b: F.struct(b.area.alias("area"), b.minutes.alias("minutes"))).alias("buckets"), "sessions", "top_focus")


def trend(points: DataFrame) -> DataFrame:
    """The points of a series as one sorted array."""
    p = F.struct("ord", "window_key", F.round("hours", 2).alias("hours"), "output_tokens", F.round("cost_usd", 2).alias("cost_usd"))
    return points.agg(F.sort_array(F.collect_list(p)).alias("points"), F.lit(SCHEMA_VERSION).alias("schema_version"))


def goal_history(rows: DataFrame) -> DataFrame:
    """Hours per window and goal, each rounded first and then added, so that lanes and totals agree."""
    r = rows.withColumns({"exclusive_hours": F.round("exclusive_hours", 2), "shared_hours": F.round("shared_hours", 2)})
    return r.withColumn("total_hours", F.col("exclusive_hours") + F.col("shared_hours"))


def compact_comparison(deltas: DataFrame) -> DataFrame:
    """Deltas by current minutes, most first, as one array."""
    d = F.struct((-F.col("current_min")).alias("by"), "area", F.round("current_min", 1).alias("current_min"), F.round("previous_min", 1).alias("previous_min"), F.round("pct_change", 1).alias("pct_change"))
    return deltas.agg(F.sort_array(F.collect_list(d)).alias("areas"))


def categories(rules: DataFrame) -> DataFrame:
    """Areas in the order in which rules are tried."""
    return rules.groupBy("area").agg(F.min("priority").alias("priority"), F.count("*").alias("needles")).orderBy("priority")
