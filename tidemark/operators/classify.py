"""Areas of sessions: folder rules, cached labels, fallback; label votes and vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import bucket_name, project_name

# Fixed values, in priority order.
DEFAULT_AREAS = {
    "investment": ["investment", "stock", "stocks", "portfolio", "trading", "ticker", "equity", "etf", "options", "finance"],
    "writing": ["blog", "newsletter", "xhs", "rednote", "post", "draft", "docs", "content", "article", "essay", "writing"],
    "coding": ["app", "sdk", "cli", "plugin", "mcp", "skill", "server", "client", "frontend", "backend", "lib", "framework", "bot", "agent", "extension", "tool", "api", "scraper", "pipeline", "dashboard", "infra", "deploy"],
    "other": ["playground", "scratch", "sandbox", "tmp", "experiment", "test-bed", "misc"],
}
FALLBACK = "coding"


def rules_frame(spark: SparkSession, areas: dict[str, list[str]], user: bool = True, first: int = 0) -> DataFrame:
    """category_rules(priority, area, needle, needle_pos, is_user) of areas in order."""
    rows = [(first + i, area, needle.lower(), j, user) for i, (area, needles) in enumerate(areas.items()) for j, needle in enumerate(needles)]
    return spark.createDataFrame(rows, "priority int, area string, needle string, needle_pos int, is_user boolean")


def fold(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """Replace variants of a project name by the canonical one, once."""
    known = F.broadcast(aliases.select(F.lower(F.trim("variant")).alias("_v"), F.lower(F.trim("canonical")).alias("_c")).where("_v <> '' and _c <> ''"))
    return rows.join(known, F.col(column) == F.col("_v"), "left").withColumn(column, F.coalesce("_c", column)).drop("_v", "_c")


def with_project(rows: DataFrame, aliases: DataFrame, folder: str = "project_raw") -> DataFrame:
    """Adds project: the folded clean name of the folder."""
    return fold(rows.withColumn("project", project_name(F.col(folder))), aliases, "project")


def match_areas(projects: DataFrame, rules: DataFrame) -> DataFrame:
    """(project, rule_area) of distinct project names.

    A needle equal to the whole name wins over all others, first area first. Then areas in
    order: a needle with a dash anywhere in the name, another one as a whole word of it.
    """
    r = F.broadcast(rules)
    hit = F.when(F.col("needle") == F.col("project"), 0).when(F.when(F.col("needle").contains("-"), F.col("project").contains(F.col("needle"))).otherwise(F.array_contains(F.split("project", "-"), F.col("needle"))), 1)
    met = projects.select("project").distinct().join(r, F.col("project").contains(F.col("needle"))).withColumn("tier", hit).where("tier is not null")
    return met.groupBy("project").agg(F.min_by("area", F.struct("tier", "priority", "needle_pos", "area")).alias("rule_area"))


def classify(rows: DataFrame, rules: DataFrame, labels: DataFrame | None = None, mode: str = "hybrid", fallback: str = FALLBACK, use_default_rules: bool = False) -> DataFrame:
    """Adds area and area_source (user_rule, llm_cache or fallback) to rows with a project.

    mode: hybrid asks rules, then labels; content labels only; folder rules only. labels:
    session_id, bucket (cached, already filtered by fingerprint). The default areas take part
    only if use_default_rules is set.
    """
    if use_default_rules:
        rules = rules.unionByName(rules_frame(rows.sparkSession, DEFAULT_AREAS, False, 1_000_000))
    out = rows.join(F.broadcast(match_areas(rows, rules)), "project", "left") if mode != "content" else rows.withColumn("rule_area", F.lit(None).cast("string"))
    if labels is not None and mode != "folder":
        out = out.join(labels.select("session_id", F.col("bucket").alias("label")), "session_id", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    source = F.when(F.col("rule_area").isNotNull(), "user_rule").when(F.col("label").isNotNull(), "llm_cache").otherwise("fallback")
    return out.withColumn("area", F.coalesce("rule_area", "label", F.lit(fallback))).withColumn("area_source", source).drop("rule_area", "label")


def cached_labels(labels: DataFrame, wanted: DataFrame) -> DataFrame:
    """Labels whose input fingerprint is still the session's."""
    return labels.join(wanted.select("session_id", "input_fingerprint"), ["session_id", "input_fingerprint"])


def majority(votes: DataFrame, key: str = "folder", label: str = "bucket", order: tuple[str, ...] = ("start_us", "session_id")) -> DataFrame:
    """Most common label of each key; ties go to the label seen first."""
    n = votes.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    return n.groupBy(key).agg(F.min_by(F.struct(label, "n"), F.struct(-F.col("n"), F.col("first"), F.col(label))).alias("b")).select(key, F.col(f"b.{label}").alias(label), F.col("b.n").alias("votes"))


def duplicate_memberships(rules: DataFrame) -> DataFrame:
    """Needles under more than one area, areas in priority order."""
    own = rules.groupBy("needle", "area").agg(F.min("priority").alias("priority"))
    return own.groupBy("needle").agg(F.count("*").alias("n_areas"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("priority", "area"))), lambda r: r.area), ",").alias("areas")).where("n_areas > 1")


def accept_labels(responses: DataFrame, known: list[str], floor: int = 6, headroom: int = 2) -> DataFrame:
    """Labels of a run whose vocabulary is capped: (run_id, session_id, bucket).

    responses: run_id, chunk, pos, session_id, bucket. A new label needs two proposals up to and
    including its chunk and room under max(floor, known + headroom); others are dropped. The
    fold over a run keeps only the accepted names, whose number is bounded.
    """
    rows = responses.withColumn("bucket", bucket_name(F.col("bucket"))).where("bucket is not null")
    limit = max(floor, len(known) + headroom)
    per_chunk = rows.groupBy("run_id", "bucket", "chunk").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    so_far = F.sum("n").over(W.partitionBy("run_id", "bucket").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0))
    ready = per_chunk.withColumn("so_far", so_far).where((F.col("so_far") >= 2) & ~F.col("bucket").isin(known))
    since = ready.groupBy("run_id", "bucket").agg(F.min(F.struct("chunk", "pos")).alias("since"))
    place = F.row_number().over(W.partitionBy("run_id").orderBy("since", "bucket"))
    accepted = since.withColumn("place", place).where(F.col("place") <= limit - len(known)).select("run_id", "bucket", F.col("since.chunk").alias("from_chunk"), F.col("since.pos").alias("from_pos"))
    out = rows.join(F.broadcast(accepted), ["run_id", "bucket"], "left")
    keep = F.col("bucket").isin(known) | F.col("from_chunk").isNotNull() & (F.struct("chunk", "pos") >= F.struct(F.col("from_chunk").alias("chunk"), F.col("from_pos").alias("pos")))
    return out.where(keep).select("run_id", "session_id", "bucket")
