"""Rollups of slices: areas and projects, agents, comparison, trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MINUTE_US = 60_000_000.0
HOUR_US = 3_600_000_000.0


def area_project_rollup(classified: DataFrame, totals: DataFrame) -> DataFrame:
    """Area rows (project null) and project rows in one grouping: minutes scaled to wall clock.

    The scale of a window is wall over raw time of all its sessions, 1.0 if nothing is active.
    Microseconds are added up first and scaled once.
    """
    sums = classified.groupingSets(
        [["window_key", "area"], ["window_key", "area", "project"]], "window_key", "area", "project"
    ).agg(F.sum("active_us").alias("active_us"), F.count("*").alias("sessions"), F.sum("msg_count").alias("messages"), F.grouping("project").alias("is_area"))
    scaled = sums.join(F.broadcast(totals.select("window_key", "raw_us", "wall_us")), "window_key", "left")
    minutes = F.when(F.coalesce("raw_us", F.lit(0)) > 0, F.col("active_us").cast("double") * F.col("wall_us") / F.col("raw_us")).otherwise(F.col("active_us").cast("double")) / MINUTE_US
    return scaled.select("window_key", "area", "project", (F.col("is_area") == 1).alias("is_area"), "active_us", minutes.alias("minutes"), "sessions", "messages")


def top_sessions(classified: DataFrame, n: int = 5) -> DataFrame:
    """The n most active sessions of each window and area; ties by start, then id."""
    rank = F.row_number().over(W.partitionBy("window_key", "area").orderBy(F.desc("active_us"), "start_us", "agent", "session_id"))
    return classified.withColumn("rank", rank).where(F.col("rank") <= n)


def agent_breakdown(found: DataFrame) -> DataFrame:
    """Sessions, messages and shares of time and sessions of each agent in a window."""
    own = found.groupBy("window_key", "agent").agg(F.count("*").alias("sessions"), F.sum("msg_count").alias("messages"), F.sum("active_us").alias("active_us"))
    whole = W.partitionBy("window_key")
    share = lambda c: F.when(F.sum(c).over(whole) > 0, F.col(c).cast("double") / F.sum(c).over(whole)).otherwise(F.lit(0.0))
    return own.withColumn("time_share", share("active_us")).withColumn("session_share", share("sessions"))


def agent_scope(found: DataFrame) -> DataFrame:
    """The one agent of a window's sessions, or `all`."""
    return found.groupBy("window_key").agg(F.when(F.count_distinct("agent") == 1, F.min("agent")).otherwise(F.lit("all")).alias("agent_scope"))


def pct_change(now: Column, before: Column) -> Column:
    """Change in percent; null unless there was something before."""
    return F.when(before > 0, (now - before) / before * 100)


def compare(areas: DataFrame, current: str, previous: str) -> DataFrame:
    """Minutes per area of two windows; no rows if the previous window has no session."""
    pick = lambda key, name: areas.where((F.col("window_key") == key) & F.col("is_area")).select("area", F.col("minutes").alias(name))
    both = pick(current, "current_min").join(pick(previous, "previous_min"), "area", "full_outer")
    out = both.select("area", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("current_min", "previous_min")])
    out = out.withColumn("delta_min", F.col("current_min") - F.col("previous_min")).withColumn("pct_change", pct_change(F.col("current_min"), F.col("previous_min")))
    some = pick(previous, "m").limit(1).select(F.lit(True).alias("_some"))
    return out.join(F.broadcast(some), F.lit(True), "left_semi")


def trend_points(windows: DataFrame, totals: DataFrame, usage: DataFrame, quota_usd: float = 3500.0) -> DataFrame:
    """One row per window, empty ones too: hours, output tokens, cost and the part of the quota spent."""
    days = F.greatest(F.lit(1.0), (F.col("until_us") - F.col("since_us")) / F.lit(86_400e6))
    rows = windows.join(totals.select("window_key", "wall_us"), "window_key", "left").join(usage.select("window_key", "output_tokens", "cost_usd"), "window_key", "left")
    rows = rows.select("window_key", "ord", (F.coalesce("wall_us", F.lit(0)) / HOUR_US).alias("hours"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"), F.coalesce("cost_usd", F.lit(0).cast("decimal(38,12)")).alias("cost_usd"), days.alias("_days"))
    quota = F.when(F.lit(quota_usd > 0), F.col("cost_usd").cast("double") / (F.lit(float(quota_usd)) * F.col("_days") / 30.0) * 100.0)
    return rows.withColumn("quota_pct", quota).drop("_days")


def series_change(points: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The value before, the change in percent and the mean of a series in window order."""
    order = W.partitionBy(*by).orderBy("ord") if by else W.partitionBy(F.lit(0)).orderBy("ord")
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.lag(value).over(order)
    return points.withColumn("previous", before).withColumn("pct", pct_change(F.col(value), before)).withColumn("mean", F.avg(value).over(whole))


def trend_matrix(areas: DataFrame, windows: DataFrame) -> DataFrame:
    """Minutes of every area in every window, 0 where it has none."""
    own = areas.where("is_area").select("window_key", "area", "minutes")
    grid = own.select("area").distinct().join(F.broadcast(windows.select("window_key", "ord")), F.lit(True))
    return grid.join(own, ["area", "window_key"], "left").select("area", "window_key", "ord", F.coalesce("minutes", F.lit(0.0)).alias("minutes"))


def top_focus(rollup: DataFrame) -> DataFrame:
    """Largest area of each window (the larger name on a tie) and its largest project."""
    area = rollup.where("is_area").groupBy("window_key").agg(F.max_by(F.struct("area", "minutes"), F.struct("minutes", "area")).alias("a"))
    top = area.select("window_key", F.col("a.area").alias("area"), F.col("a.minutes").alias("area_minutes"))
    own = rollup.where("not is_area").join(F.broadcast(top), ["window_key", "area"])
    return own.groupBy("window_key", "area", "area_minutes").agg(F.max_by(F.struct("project", "minutes"), F.struct("minutes", "project")).alias("p")).select("window_key", "area", "area_minutes", F.col("p.project").alias("project"), F.col("p.minutes").alias("project_minutes"))


def shown_projects(rollup: DataFrame, n: int = 3) -> DataFrame:
    """The first n projects of each area and how many more there are."""
    own = rollup.where("not is_area").groupBy("window_key", "area").agg(F.sort_array(F.collect_list(F.struct((-F.col("minutes")).alias("m"), "project"))).alias("p"))
    return own.select("window_key", "area", F.array_join(F.transform(F.slice("p", 1, n), lambda r: r.project), ",").alias("projects"), F.greatest(F.lit(0), F.size("p") - n).alias("more"))


def area_texts(rollup: DataFrame, tops: DataFrame, details: int = 4, projects: int = 3) -> DataFrame:
    """A text for each area of a window that has no prose: counts, then its top sessions' summaries or its projects.

    tops: window_key, area, rank, summary, which is null where a session has none that may be shown.
    """
    key = ["window_key", "area"]
    told = tops.where("trim(summary) <> ''").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", F.trim("summary").alias("s")))).alias("t"))
    own = rollup.where("not is_area").groupBy(*key).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("minutes")).alias("m"), "project"))), 1, projects).alias("p"))
    rows = rollup.where("is_area").select(*key, "sessions", "minutes").join(told, key, "left").join(own, key, "left")
    names = F.concat(F.lit("Projects: "), F.array_join(F.transform("p", lambda r: r.project), ", "), F.lit("."))
    lines = F.coalesce(F.transform(F.slice("t", 1, details), lambda r: r.s), F.array(F.coalesce(names, F.lit("No generated session summary was available."))))
    head = F.concat("area", F.lit(": "), F.col("sessions").cast("string"), F.when(F.col("sessions") == 1, " session · ").otherwise(" sessions · "), F.bround("minutes").cast("long").cast("string"), F.lit(" active min.\n\n"))
    return rows.select(*key, F.concat(head, F.array_join(F.transform(lines, lambda line: F.concat(F.lit("- "), line)), "\n")).alias("text"))
