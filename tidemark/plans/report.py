"""The recap from logs: facts that are built once, and all parts of the envelope over them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import activity as A
from tidemark.operators import classify as C
from tidemark.operators import evidence as E
from tidemark.operators import goals as G
from tidemark.operators import repo as R
from tidemark.operators import rollup as U
from tidemark.operators import sampling as S
from tidemark.operators import usage as K
from tidemark.operators.lineage import written
from tidemark.plans import marts


@dataclass(frozen=True)
class Settings:
    """What a recap needs besides messages and usage: small tables and choices. comparison: (current, previous) window keys."""

    windows: DataFrame
    zone: str
    rules: DataFrame
    aliases: DataFrame
    prices: DataFrame
    price_aliases: DataFrame
    coverage: DataFrame
    goals: list[dict] = field(default_factory=list)
    comparison: tuple[str, str] | None = None
    labels: DataFrame | None = None


@dataclass(frozen=True)
class Facts:
    """Written once and read by every part: messages with their session's next instant, clipped intervals, classified slices, evidence."""

    clipped: DataFrame
    slices: DataFrame
    evidence: DataFrame
    costed: DataFrame


def facts(messages: DataFrame, usage: DataFrame, s: Settings) -> Facts:
    """messages as the adapters give them; usage: agent, ts_us, model, message_id, path, line_no and the counters.

    Of messages only those that are activity count. The search for each session's next instant is done in one
    place, when the messages are written; intervals, sessions and slices read it.
    """
    rows = messages.where("is_activity") if "is_activity" in messages.columns else messages
    base = written(A.with_next(rows.select("agent", "session_id", "ts_us", "path", "line_no", "role", "text", "is_real_user", "project_raw", "cwd", "is_subagent", "is_scheduled")))
    folders = base.groupBy(*A.SESSION).agg(F.coalesce(F.min("project_raw"), F.min(F.regexp_extract("cwd", r"([^/]+)/*$", 1)), F.lit("")).alias("project_raw"), F.min("cwd").alias("cwd"))
    found = C.classify(C.with_project(A.slices(base, s.windows).join(folders, A.SESSION), s.aliases), s.rules, s.labels)
    models = K.by_model(K.usage_in_windows(usage, s.windows))
    return Facts(written(A.clip(A.active_intervals(base), s.windows)), written(found), written(E.window_evidence(base, s.windows)), written(K.cost(models, K.resolve_prices(models, s.prices, s.price_aliases))))


def recap(f: Facts, s: Settings, artifacts: DataFrame | None = None) -> DataFrame:
    """One envelope a window: those of marts.recap, and cost, coverage, goals, lanes, comparison, sampling and artifacts.

    artifacts: rows of repo.activity. A window without a part has null there. Sessions are rows of their own,
    see marts.recap_sessions(f.slices).
    """
    key = "window_key"
    totals = written(A.window_totals(f.clipped))
    rolled = written(U.area_project_rollup(f.slices, totals))
    out = marts.recap(s.windows, totals, rolled, U.agent_breakdown(f.slices), f.costed, U.top_focus(rolled))
    cost = K.usage_totals(f.costed).withColumns({c: K.rounded(c) for c in ("cost_usd", "cost_uncached_usd", "savings_usd")})
    out = out.join(cost.select(key, F.struct(*[c for c in cost.columns if c != key]).alias("cost")), key, "left")
    shown = K.coverage(f.slices, s.coverage)
    out = out.join(shown.select(key, F.struct("usage_complete", "partial_agents", "unavailable_agents").alias("coverage")), key, "left")
    if s.goals:
        frame = G.goals_frame(f.slices.sparkSession, s.goals)
        own = f.slices.select(key, *A.SESSION, "project")
        items = G.contributions(f.clipped.join(own, [key, *A.SESSION]).select(key, *A.SESSION, "project", "start_us", "end_us"), s.zone)
        met = written(G.attribute(items, G.goal_projects(frame, s.aliases)))
        goals = G.scaled_hours(G.goal_breakdown(met, frame, s.windows, s.zone), totals, ("exclusive_us", "shared_us"))
        out = out.join(marts._listed(goals, "goals", "goal_id", "exclusive_hours", "shared_hours", "touched_projects"), key, "left")
        lanes = G.lanes(met)
        out = out.join(lanes.select(key, F.struct(*[c for c in lanes.columns if c != key]).alias("lanes")), key, "left")
    if s.comparison:
        current, previous = s.comparison
        deltas = marts.compact_comparison(U.compare(rolled, current, previous)).select(F.lit(current).alias(key), F.col("areas").alias("comparison"))
        out = out.join(deltas, key, "left")
    drafts = written(S.sketches(f.slices, f.evidence, s.zone))
    seen = S.plan_projection(drafts, S.plan(drafts))
    out = out.join(seen.select(key, F.struct(*[c for c in seen.columns if c != key]).alias("sampling")), key, "left")
    if artifacts is not None:
        made = R.totals(artifacts)
        out = out.join(made.select(key, F.struct(*[c for c in made.columns if c != key]).alias("artifacts")), key, "left")
    return out
