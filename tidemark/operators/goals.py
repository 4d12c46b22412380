"""Goal attribution: exclusive, shared and unattributed lanes over local days and weeks."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.time import as_ntz, split_local_days
from tidemark.operators.classify import fold

_FIELDS = {"id", "title", "projects", "valid_from", "valid_until"}


def goals_frame(spark: SparkSession, goals: list[dict]) -> DataFrame:
    """goals(id, title, projects, valid_from, valid_until) after strict checks; goals are hand-written."""
    seen, rows = set(), []
    for goal in goals:
        if more := set(goal) - _FIELDS:
            raise ValueError(f"unknown fields: {sorted(more)}")
        for field in ("id", "title"):
            value = goal.get(field)
            if not isinstance(value, str) or not value.strip() or re.search(r"[\x00-\x1f\x7f]", value):
                raise ValueError(f"bad {field}: {value!r}")
        if goal["id"] in seen:
            raise ValueError(f"goal {goal['id']} is there twice")
        seen.add(goal["id"])
        projects = goal.get("projects") or []
        if any(not isinstance(p, str) or not p.strip() for p in projects):
            raise ValueError(f"bad projects of {goal['id']}")
        dates = [date.fromisoformat(goal[f]) if isinstance(goal.get(f), str) else goal.get(f) for f in ("valid_from", "valid_until")]
        if all(dates) and dates[0] > dates[1]:
            raise ValueError(f"{goal['id']} ends before it starts")
        rows.append((goal["id"], goal["title"].strip(), [p.strip().lower() for p in projects], *dates))
    return spark.createDataFrame(rows, "id string, title string, projects array<string>, valid_from date, valid_until date")


def contributions(intervals: DataFrame, zone: str) -> DataFrame:
    """Clipped intervals (window_key, agent, session_id, project, start_us, end_us) per local day: amount_us."""
    days = split_local_days(intervals, zone)
    return days.groupBy("window_key", "agent", "session_id", "project", "local_date").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("amount_us"))


def goal_projects(goals: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per goal and project, the project folded once."""
    rows = goals.select("id", F.explode(F.array_distinct("projects")).alias("project"), "valid_from", "valid_until")
    return fold(rows, aliases, "project").dropDuplicates(["id", "project"])


def attribute(items: DataFrame, projects: DataFrame) -> DataFrame:
    """Items (window_key, project, local_date, amount_us) with the goals they count for and their lane.

    Amounts are added up per project and day before the join, so it meets few rows. A row without
    a goal is unattributed, with one exclusive, with more shared (and repeated for each).
    """
    days = items.groupBy("window_key", "project", "local_date").agg(F.sum("amount_us").alias("amount_us"))
    g = F.broadcast(projects)
    on = (days.project == g.project) & (g.valid_from.isNull() | (days.local_date >= g.valid_from)) & (g.valid_until.isNull() | (days.local_date <= g.valid_until))
    met = days.join(g, on, "left").select("window_key", days.project, "local_date", "amount_us", g.id.alias("goal_id"))
    n = met.groupBy("window_key", "project", "local_date").agg(F.count("goal_id").alias("n_goals"))
    lane = F.when(F.col("n_goals") == 0, "unattributed").when(F.col("n_goals") == 1, "exclusive").otherwise("shared")
    return met.join(n, ["window_key", "project", "local_date"]).withColumn("lane", lane)


def goal_breakdown(attributed: DataFrame, goals: DataFrame, windows: DataFrame, zone: str) -> DataFrame:
    """Per window and effective goal: exclusive and shared time, projects touched, last day.

    A goal is effective if its validity meets the window's local days; without activity it has 0.
    """
    day = lambda c: F.convert_timezone(F.lit("UTC"), F.lit(zone), as_ntz(c)).cast("date")
    w = windows.withColumn("_last", F.col("until_us") - 1).select("window_key", "ord", day("since_us").alias("first_day"), day("_last").alias("last_day"))
    effective = F.broadcast(w).join(goals, (F.coalesce("valid_from", "first_day") <= F.col("last_day")) & (F.coalesce("valid_until", "last_day") >= F.col("first_day")))
    own = attributed.where("goal_id is not null").groupBy("window_key", "goal_id").agg(
        F.sum(F.when(F.col("lane") == "exclusive", F.col("amount_us")).otherwise(0)).alias("exclusive_us"),
        F.sum(F.when(F.col("lane") == "shared", F.col("amount_us")).otherwise(0)).alias("shared_us"),
        F.array_join(F.array_sort(F.collect_set("project")), ",").alias("touched_projects"), F.max("local_date").alias("latest_date"),
    )
    out = effective.select("window_key", F.col("id").alias("goal_id")).join(own, ["window_key", "goal_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("window_key", "goal_id", zero("exclusive_us"), zero("shared_us"), F.coalesce("touched_projects", F.lit("")).alias("touched_projects"), "latest_date")


def lanes(attributed: DataFrame) -> DataFrame:
    """Per window: exclusive, shared (each amount once), unattributed and all time; the lanes add up."""
    once = attributed.dropDuplicates(["window_key", "project", "local_date"])
    of = lambda lane: F.sum(F.when(F.col("lane") == lane, F.col("amount_us")).otherwise(0)).alias(f"{lane}_us")
    return once.groupBy("window_key").agg(of("exclusive"), of("shared"), of("unattributed"), F.sum("amount_us").alias("covered_us"))


def scaled_hours(rows: DataFrame, totals: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Lane columns in hours of wall clock: scaled by the window's wall over raw time."""
    scale = F.when(F.coalesce("raw_us", F.lit(0)) > 0, F.col("wall_us").cast("double") / F.col("raw_us")).otherwise(F.lit(1.0))
    joined = rows.join(F.broadcast(totals.select("window_key", "raw_us", "wall_us")), "window_key", "left")
    return joined.withColumns({c.replace("_us", "_hours"): F.col(c) * scale / 3.6e9 for c in columns}).drop("raw_us", "wall_us")


def top_goals(rows: DataFrame, n: int = 5) -> DataFrame:
    """The n goals of each window with most time, exclusive and shared; ties by id."""
    total = F.col("exclusive_us") + F.col("shared_us")
    rank = F.row_number().over(W.partitionBy("window_key").orderBy(F.desc(total), "goal_id"))  # a report has a few goals
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)
