"""Summary tables: authority on upsert, evidence status, refresh work lists, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import collapse
from tidemark.operators.evidence import set_digest
from tidemark.operators.lineage import numbered

# Fixed values.
PROVIDED, GENERATED, EXTRACTED, NO_EVIDENCE = "provided", "generated", "extracted", "no_evidence"
OLD_NAMES = {"record": PROVIDED, "auto": GENERATED, "fallback": EXTRACTED, "skipped": NO_EVIDENCE}
LEGACY, UNAVAILABLE = "legacy-unknown", "unavailable"


def normal_source(source: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in OLD_NAMES.items() for x in pair])
    return F.coalesce(names[source], source)


def upsert(table: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes (session_id, summary, source, evidence_fingerprint, observed_evidence_fingerprint, created_at).

    A provided row gives way only to another provided one. Changes without id or summary are
    ignored; of several for one session the latest counts. Generated rows without evidence are
    marked as legacy. Partition the stored table by a hash of session_id to rewrite parts only.
    """
    rows = changes.where("session_id <> '' and trim(summary) <> ''").withColumn("source", normal_source(F.col("source"))).withColumn("summary", F.trim("summary"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    made = F.col("source") == GENERATED
    rows = rows.withColumn("evidence_fingerprint", F.when(made & blank("evidence_fingerprint"), LEGACY).otherwise(F.col("evidence_fingerprint")))
    rows = rows.withColumn("observed_evidence_fingerprint", F.when(made & blank("observed_evidence_fingerprint"), F.col("evidence_fingerprint")).otherwise(F.col("observed_evidence_fingerprint")))
    fields = [c for c in table.columns if c != "session_id"]
    # among changes: provided ones aren't replaced by others either
    last = rows.groupBy("session_id").agg(F.max_by(F.struct(*fields), F.struct(F.col("source") == PROVIDED, "created_at", "summary")).alias("s"))
    both = table.select("session_id", F.struct(*fields).alias("t")).join(last, "session_id", "full_outer")
    keep = F.col("s").isNull() | (F.col("t.source") == PROVIDED) & (F.col("s.source") != PROVIDED)
    return both.withColumn("r", F.when(F.coalesce(keep, F.lit(False)), F.col("t")).otherwise(F.col("s"))).select("session_id", *[F.col(f"r.{c}").alias(c) for c in fields])


def upsert_labels(table: DataFrame, changes: DataFrame) -> DataFrame:
    """Label rows keyed by session_id after the changes; the newest row wins."""
    whole = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    fields = [c for c in table.columns if c != "session_id"]
    return whole.groupBy("session_id").agg(F.max_by(F.struct(*fields), F.struct("_new", "created_at", "bucket")).alias("r")).select("session_id", *[F.col(f"r.{c}").alias(c) for c in fields])


def observe(table: DataFrame, seen: DataFrame) -> DataFrame:
    """Update the observed fingerprint of rows that are there and aren't provided."""
    new = seen.groupBy("session_id").agg(F.max("fingerprint").alias("_seen"))
    out = table.join(new, "session_id", "left")
    value = F.when((F.col("source") != PROVIDED) & F.col("_seen").isNotNull(), F.col("_seen")).otherwise(F.col("observed_evidence_fingerprint"))
    return out.withColumn("observed_evidence_fingerprint", value).drop("_seen")


def invalidate(table: DataFrame, scope: DataFrame | None, keys: list[str]) -> DataFrame:
    """The table without the rows of scope; without any if scope is None."""
    return table.limit(0) if scope is None else table.join(scope.select(*keys).distinct(), keys, "left_anti")


def evidence_status() -> Column:
    """not_applicable, unavailable, legacy, current or stale, of a summary row."""
    basis, observed = F.coalesce("evidence_fingerprint", F.lit("")), F.coalesce("observed_evidence_fingerprint", F.lit(""))
    made = F.when(basis.isin("", LEGACY), "legacy").when(observed.isin("", UNAVAILABLE), "unavailable").when(basis == observed, "current").otherwise("stale")
    return F.when(F.col("source") == NO_EVIDENCE, "unavailable").when(F.col("source") == GENERATED, made).otherwise("not_applicable")


def eligible() -> Column:
    """Whether a summary may go into derived text."""
    return F.coalesce((F.col("source") == PROVIDED) | ((F.col("source") == GENERATED) & (evidence_status() == "current")), F.lit(False))


def needs_refresh(prompt_version: int, narrator: str, observed: str = "observed_now", force: bool = False) -> Column:
    """Whether a session joined to its summary row (source null: none) goes to the narrator."""
    seen = F.col(observed)
    changed = seen.isNotNull() & ~F.col("evidence_fingerprint").eqNullSafe(seen)
    made = F.when(F.coalesce(seen == UNAVAILABLE, F.lit(False)), False).otherwise(
        F.lit(force) | (F.coalesce("prompt_version", F.lit(0)) < prompt_version) | ~F.col("narrator_fingerprint").eqNullSafe(F.lit(narrator)) | (F.col("evidence_fingerprint") == LEGACY) | changed
    )
    return (
        F.when(F.col("source").isNull(), True).when(F.col("source") == PROVIDED, False)
        .when(F.col("source") == NO_EVIDENCE, F.coalesce((seen != "") & (seen != UNAVAILABLE), F.lit(False)))
        .when(F.col("source") == EXTRACTED, ~seen.eqNullSafe(F.lit(UNAVAILABLE)))
        .when(F.col("source") == GENERATED, F.coalesce(made, F.lit(False))).otherwise(False)
    )


def refresh_worklist(found: DataFrame, table: DataFrame, prompt_version: int, narrator: str, force: bool = False) -> DataFrame:
    """Sessions to summarize in order: coverage reasons first, then plan rank, then id.

    found: session_id, observed_now, plan_rank, has_reason.
    """
    fields = table.select("session_id", "source", "prompt_version", "narrator_fingerprint", "evidence_fingerprint")
    todo = found.join(fields, "session_id", "left").where(needs_refresh(prompt_version, narrator, force=force))
    todo = todo.select("session_id", "plan_rank", "has_reason", "source", (~F.col("has_reason")).cast("int").alias("_later"))
    return numbered(todo, ["_later", "plan_rank", "session_id"], "priority").drop("_later")


def newest_generated(table: DataFrame, n: int) -> DataFrame:
    """(session_id, created_at) of the n newest generated summaries, oldest first; ties by id."""
    rows = table.where(F.col("source") == GENERATED).select("session_id", "created_at")
    return rows.orderBy(F.desc("created_at"), F.desc("session_id")).limit(n).orderBy("created_at", "session_id")


def resolve(identities: DataFrame, table: DataFrame) -> DataFrame:
    """Summary of each (evidence_id, public_id): a provided row of the public id, else the evidence id's own row."""
    t = table.select("session_id", "summary", "source")
    public = t.where(F.col("source") == PROVIDED).select(F.col("session_id").alias("public_id"), F.struct("session_id", "summary", "source").alias("p"))
    own = t.select(F.col("session_id").alias("evidence_id"), F.struct("session_id", "summary", "source").alias("o"))
    met = identities.where("evidence_id <> ''").join(public, "public_id", "left").join(own, "evidence_id", "left").withColumn("r", F.coalesce("p", "o"))
    return met.where("r is not null").select("evidence_id", "public_id", F.col("r.session_id").alias("row_id"), F.col("r.summary").alias("summary"), F.col("r.source").alias("source"))


def best_text(summary: str, native: str, bounded: str, first: str) -> Column:
    """First text that isn't blank: summary, native title, bounded first text, first user text."""
    return F.coalesce(*[F.nullif(collapse(F.col(c)), F.lit("")) for c in (summary, native, bounded, first)], F.lit(""))


def parse_responses(raw: DataFrame, requested: DataFrame, key: str = "session_id", value: str = "summary", least: int = 4, most: int = 200) -> DataFrame:
    """Rows of JSON-lines answers: fences dropped, broken lines skipped, texts of least..most characters, requested ids only.

    raw: run_id, chunk, text; the first answer of an id counts.
    """
    lines = raw.select("run_id", "chunk", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).where(~F.trim("line").startswith("```"))
    v = F.try_parse_json(F.trim("line"))
    rows = lines.select("run_id", "chunk", "pos", F.try_variant_get(v, f"$.{key}", "string").alias(key), collapse(F.try_variant_get(v, f"$.{value}", "string")).alias(value))
    rows = rows.where((F.length(value) >= least) & (F.length(value) <= most)).join(requested.select(key).distinct(), key, "left_semi")
    first = F.row_number().over(W.partitionBy("run_id", key).orderBy("chunk", "pos"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n")


def missing(requested: DataFrame, table: DataFrame, key: str = "session_id") -> DataFrame:
    return requested.select(key).distinct().join(table.select(key), key, "left_anti")


def id_sets(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Cache key of each group: `by`, and digest, which is that of the set of its distinct rows of `columns`."""
    return rows.select(*by, *columns).distinct().groupBy(*by).agg(set_digest(*[F.col(c) for c in columns]).alias("digest"))


def cache_hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """wanted with hit: whether the cache holds a row under exactly these keys."""
    return wanted.join(cache.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def backfill_outcomes(work: DataFrame, answers: DataFrame, table: DataFrame) -> DataFrame:
    """How a run over a work list (session_id, wanted) went: summarized, fallback, skipped, already, regenerated.

    skipped: wanted, not answered, and without evidence to fall back on (has_evidence false, where the list has it).
    """
    if "has_evidence" not in work.columns:
        work = work.withColumn("has_evidence", F.lit(True))
    rows = work.join(answers.select("session_id", F.lit(True).alias("_a")).distinct(), "session_id", "left").join(table.select("session_id", F.col("source").alias("_s")), "session_id", "left")
    got, had = F.col("_a").isNotNull(), F.col("_s") == GENERATED
    return rows.agg(
        F.count_if(F.col("wanted") & got).alias("summarized"), F.count_if(F.col("wanted") & ~got & F.col("has_evidence")).alias("fallback"), F.count_if(F.col("wanted") & ~got & ~F.col("has_evidence")).alias("skipped"), F.count_if(~F.col("wanted")).alias("already"), F.count_if(F.col("wanted") & got & F.coalesce(had, F.lit(False))).alias("regenerated")
    )
