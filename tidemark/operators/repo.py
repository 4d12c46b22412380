"""Output of repositories per window: commits, merged requests, releases, stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def repositories(sessions: DataFrame, cwd_to_repo: DataFrame, exclude: list[str] = ()) -> DataFrame:
    """Distinct repositories of the sessions' folders, without roots that hold an excluded part."""
    rows = sessions.select("cwd").distinct().join(F.broadcast(cwd_to_repo), "cwd")
    for part in exclude:
        rows = rows.where(~F.col("repo_root").contains(part))
    return rows.select("repo_root", "repo_name", "github_slug").distinct()


def commits(rows: DataFrame, windows: DataFrame, shown: int = 3) -> DataFrame:
    """Commits per window and repository, merges left out, and the newest subjects."""
    w = F.broadcast(windows.select("window_key", "since_us", "until_us"))
    inside = rows.where("not is_merge").join(w, (F.col("ts_us") >= F.col("since_us")) & (F.col("ts_us") < F.col("until_us")))
    keys = ["window_key", "repo"]
    # the filter on the rank lets Spark keep a few rows a group before the shuffle
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("ts_us"), "subject"))
    new = inside.withColumn("r", rank).where(F.col("r") <= shown).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "subject"))), lambda x: x.subject), " | ").alias("newest"))
    return inside.groupBy(*keys).agg(F.count("*").alias("commits")).join(new, keys)


def merged_requests(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Distinct numbers merged in each window; rows without a number count one by one."""
    w = F.broadcast(windows.select("window_key", "since_us", "until_us"))
    inside = rows.join(w, (F.col("merged_us") >= F.col("since_us")) & (F.col("merged_us") < F.col("until_us")))
    return inside.groupBy("window_key", "repo").agg((F.count_distinct("number") + F.count_if(F.col("number").isNull())).alias("merged"))


def releases(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Tags published in each window, drafts left out."""
    w = F.broadcast(windows.select("window_key", "since_us", "until_us"))
    inside = rows.where("not draft").join(w, (F.col("published_us") >= F.col("since_us")) & (F.col("published_us") < F.col("until_us")))
    return inside.groupBy("window_key", "repo").agg(F.count("*").alias("releases"), F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def star_delta(snapshots: DataFrame, windows: DataFrame) -> DataFrame:
    """Stars at the end of a window less the newest snapshot strictly before its first day."""
    day = lambda c: F.expr(f"cast(timestampadd(MICROSECOND, {c}, timestamp_ntz'1970-01-01 00:00:00') as date)")
    w = F.broadcast(windows.select("window_key", day("since_us").alias("first"), day("until_us").alias("last")))
    rows = snapshots.join(w, F.col("captured_at") <= F.col("last"))
    out = rows.groupBy("window_key", "repo").agg(F.max_by("stars", "captured_at").alias("stars"), F.max_by("stars", F.when(F.col("captured_at") < F.col("first"), F.col("captured_at"))).alias("before"))
    return out.withColumn("delta", F.col("stars") - F.col("before"))


def record_stars(snapshots: DataFrame, today: DataFrame) -> DataFrame:
    """Snapshots with today's values put in place of those of the same repository and day."""
    return snapshots.join(today.select("repo", "captured_at"), ["repo", "captured_at"], "left_anti").unionByName(today.dropDuplicates(["repo", "captured_at"]))


def activity(commits_: DataFrame, merged: DataFrame, released: DataFrame, enriched: int = 10) -> DataFrame:
    """One row per window and repository, most commits first; `is_enriched` marks the first ones."""
    keys = ["window_key", "repo"]
    out = commits_.join(merged, keys, "full_outer").join(released, keys, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = out.select(*keys, zero("commits"), F.coalesce("newest", F.lit("")).alias("newest"), zero("merged"), zero("releases"), F.coalesce("tags", F.lit("")).alias("tags"))
    rank = F.row_number().over(W.partitionBy("window_key").orderBy(F.desc("commits"), "repo"))
    return out.withColumn("rank", rank).withColumn("is_enriched", F.col("rank") <= enriched)


def totals(rows: DataFrame, connected: bool = True) -> DataFrame:
    """Sums per window and whether they are complete: the host was reached (connected) and every repository was enriched."""
    return rows.groupBy("window_key").agg(F.sum("commits").alias("commits"), F.sum("merged").alias("merged"), F.sum("releases").alias("releases"), F.count("*").alias("repositories"), (F.lit(connected) & F.bool_and("is_enriched")).alias("complete"))
