"""Deterministic samples of sessions: coverage plans, budget fits, day quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import SALIENCE, salience
from tidemark.functions.time import local_day
from tidemark.operators.lineage import cut, running_sums


def tie_break() -> list[Column]:
    """The one order that settles every tie: most active first, then start, provider, id."""
    return [F.desc("active_us"), F.asc("start_us"), F.asc("provider"), F.asc("internal_id")]


def sort_key(name: Column) -> Column:
    """A name as it sorts: composed and decomposed spellings and upper and lower case are one; the name itself settles the rest."""
    return F.collate(name, "UNICODE_CI")


def sketches(found: DataFrame, evidence: DataFrame, zone: str) -> DataFrame:
    """What a plan looks at of each slice: window_key, internal_id, provider, project, local_day, active_us, start_us, chars, salience.

    found: slices with their project; evidence: their window_evidence. A session that isn't whole in its window
    goes by the name of its slice. chars and salience are of the bounded texts, so a long session costs no more than a short one.
    """
    keys = ["window_key", "agent", "session_id"]
    told = evidence.select(*keys, "slice_id", F.concat_ws("\n", "first_text", "last_text").alias("_text"))
    rows = found.join(told, keys, "left")
    name = F.when(F.col("contained"), F.concat_ws("/", "agent", "session_id")).otherwise(F.coalesce("slice_id", F.concat_ws("/", F.lit("slice-"), "agent", "session_id")))
    text = F.coalesce("_text", F.lit(""))
    return rows.select("window_key", name.alias("internal_id"), F.col("agent").alias("provider"), "project", local_day("start_us", zone).cast("string").alias("local_day"), "active_us", "start_us", F.length(text).alias("chars"), salience(text).alias("salience"))


def unique_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch per window_key and internal_id: the first in tie-break order."""
    own = F.row_number().over(W.partitionBy("window_key", "internal_id").orderBy(*tie_break()))
    return sketches.withColumn("_n", own).where("_n = 1").drop("_n")


def canonical(sketches: DataFrame) -> DataFrame:
    """One sketch per internal_id, with its place in plan order per window (plan_rank), numbered by ranges."""
    rows = unique_sketches(sketches).withColumns({"_less": -F.col("active_us"), "_one": F.lit(1).cast("long")})
    ranked = running_sums(rows, ["window_key"], ["_less", "start_us", "provider", "internal_id"], {"_ahead": "_one"})
    return ranked.withColumn("plan_rank", (F.col("_ahead") + 1).cast("int")).drop("_less", "_one", "_ahead")


def _tops(rows: DataFrame, by: str, reason: str, stage: int) -> DataFrame:
    """The first row in plan order of each value of `by`, in order of the value's total activity."""
    total = rows.groupBy("window_key", by).agg(F.sum("active_us").alias("total"), F.min_by("internal_id", "plan_rank").alias("internal_id"))
    place = F.row_number().over(W.partitionBy("window_key").orderBy(F.desc("total"), sort_key(F.col(by)), by))
    return total.select("window_key", "internal_id", F.lit(reason).alias("reason"), F.lit(stage).alias("stage"), place.alias("pos"))


def plan(sketches: DataFrame) -> DataFrame:
    """Coverage plan without a budget: every session is chosen; says when and why.

    Columns: window_key, internal_id, plan_rank, reasons (in order, comma-joined). Passes: top of
    each provider, of each project, of each local day not yet covered, of each salience code
    among those not yet chosen (one at most), then all others in plan order.
    """
    # read once and cut, as each pass looks at all that the passes before have chosen
    rows = cut(canonical(sketches))
    tops = _tops(rows, "provider", "provider_top", 1).unionByName(_tops(rows, "project", "project_top", 2))
    chosen = tops.select("window_key", "internal_id").distinct()
    covered = rows.join(chosen, ["window_key", "internal_id"], "left_semi").select("window_key", "local_day").distinct()
    days = _tops(rows, "local_day", "day_top", 3)
    day_of = rows.select("window_key", "internal_id", "local_day")
    days = days.join(day_of, ["window_key", "internal_id"]).join(covered, ["window_key", "local_day"], "left_anti").drop("local_day")
    tops = cut(tops.unionByName(days))
    for i, code in enumerate(SALIENCE):
        left = rows.where(F.array_contains("salience", code)).join(tops.select("window_key", "internal_id").distinct(), ["window_key", "internal_id"], "left_anti")
        best = left.groupBy("window_key").agg(F.min_by("internal_id", "plan_rank").alias("internal_id"))
        tops = cut(tops.unionByName(best.select("window_key", "internal_id", F.lit(f"salience:{code}").alias("reason"), F.lit(4 + i).alias("stage"), F.lit(1).alias("pos"))))
    why = tops.groupBy("window_key", "internal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stage", "pos", "reason"))), lambda r: r.reason), ",").alias("reasons"))
    return rows.join(why, ["window_key", "internal_id"], "left").select("window_key", "internal_id", "plan_rank", F.coalesce("reasons", F.lit("budget_fill")).alias("reasons"))


def _fit(items: DataFrame, limits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """items that fit a budget in order: those too large for what is left are skipped, later ones may fit.

    items has a column _size (long), limits the budget _left of each `by` (one row each, no nulls).
    One range sort, then phases: while half of what is left isn't used, all items of at most
    that half fit, and the first larger one that fits beside them ends the phase, as does passing the
    half. A phase is a segmented prefix sum (a sum for each range and group, then inside the ranges), and
    each at least halves the budget, so there are no more of them than the budget has bits. A group
    may be all of the rows. The result has _pos, which ascends in `order`.
    """
    dealt = items.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_pos", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_range", F.shiftright("_pos", 33)))
    none = F.lit(None).cast("long")
    step = F.struct(F.col("_after").alias("after"), F.col("_to").alias("to"), F.col("_left").alias("most"))
    state = cut(limits.select(*by, F.col("_left").cast("long").alias("_left"), F.lit(-1).cast("long").alias("_after"), F.array().cast("array<struct<after:bigint,to:bigint,most:bigint>>").alias("_steps"), F.lit(True).alias("_open")))
    ranges = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy("_range", *by).orderBy("_pos").rowsBetween(W.unboundedPreceding, -1)
    while not state.where("_open").isEmpty():
        asked = dealt.select(*by, "_range", "_pos", "_size").join(state.where("_open").select(*by, "_left", "_after"), by).where("_pos > _after and _size <= _left")
        asked = asked.withColumn("_small", 2 * F.col("_size") <= F.col("_left")).withColumn("_sure", F.when(F.col("_small"), F.col("_size")).otherwise(0))
        sums = asked.groupBy(*by, "_range").agg(F.sum("_sure").alias("_sum"))
        sums = sums.select(*by, "_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_base"))
        run = asked.withColumn("_in", F.coalesce(F.sum("_sure").over(inside), F.lit(0))).join(sums, [*by, "_range"])
        run = run.withColumn("_used", F.col("_base") + F.col("_in") + F.col("_size"))
        ends = run.where("case when _small then 2 * _used > _left else _used <= _left end").groupBy(*by).agg(F.min(F.struct("_pos", "_used")).alias("_end"))
        now = state.where("_open").join(ends, by, "left").withColumn("_to", F.coalesce(F.col("_end._pos"), none))
        now = now.select(*by, F.coalesce(F.col("_left") - F.col("_end._used"), F.col("_left")).alias("_left"), F.coalesce("_to", "_after").alias("_after"), F.concat("_steps", F.array(step)).alias("_steps"), F.col("_to").isNotNull().alias("_open"))
        state = cut(now.unionByName(state.where("not _open")))
    took = F.exists("_steps", lambda t: (F.col("_pos") > t.after) & F.coalesce(F.col("_pos") <= t.to, F.lit(True)) & ((2 * F.col("_size") <= t.most) | F.coalesce(F.col("_pos") == t.to, F.lit(False))))
    return dealt.join(state.select(*by, "_steps"), by).where(took).drop("_steps", "_range")


def budgeted_plan(sketches: DataFrame, char_budget: int | None = None, max_selected: int | None = None) -> DataFrame:
    """The same passes under a budget of characters and a largest number of sessions, per window.

    A session that doesn't fit is skipped and adds no reason; the scan goes on. Each pass is a fit of its
    offers to what the passes before have left (see _fit), so no window is read by one task. Sessions
    of unknown size count as empty.
    """
    most = 1 << 60
    key, both = ["window_key"], ["window_key", "internal_id"]
    rows = cut(canonical(sketches).withColumn("_size", F.coalesce(F.col("chars").cast("long"), F.lit(0).cast("long"))))
    own = rows.select(*both, "local_day", "_size", "plan_rank")
    state = cut(rows.select(*key).distinct().select(*key, F.lit(most if char_budget is None else char_budget).alias("_left"), F.lit(most if max_selected is None else max_selected).alias("_room")))
    chosen = cut(own.limit(0).select(*both, "local_day"))
    reasons = chosen.select(*both, F.lit("").alias("reason"), F.lit(0).alias("stage"), F.lit(0).alias("pos"))

    def take(offers: DataFrame) -> DataFrame:
        """Of offers (window_key, internal_id, local_day, _size, pos) not chosen yet, those that fit; the state goes on."""
        nonlocal state, chosen
        new = _fit(offers.join(chosen.select(*both), both, "left_anti"), state, key, ["pos", "internal_id"])
        one = new.withColumn("_one", F.lit(1).cast("long"))
        if max_selected is not None:
            one = running_sums(one, key, ["_pos"], {"_ahead": "_one"}).join(state.select(*key, "_room"), key).where("_ahead < _room").drop("_ahead", "_room")
        new = cut(one)
        used = new.groupBy(*key).agg(F.sum("_size").alias("_u"), F.sum("_one").alias("_k"))
        state = cut(state.join(used, key, "left").select(*key, (F.col("_left") - F.coalesce("_u", F.lit(0))).alias("_left"), (F.col("_room") - F.coalesce("_k", F.lit(0))).alias("_room")))
        chosen = cut(chosen.unionByName(new.select(*both, "local_day")))
        return new

    for by, reason, stage in (("provider", "provider_top", 1), ("project", "project_top", 2), ("local_day", "day_top", 3)):
        offers = _tops(rows, by, reason, stage).join(own.select(*both, "local_day", "_size"), both)
        if by == "local_day":
            offers = offers.join(chosen.select(*key, "local_day").distinct(), [*key, "local_day"], "left_anti")
        offers = cut(offers)
        take(offers)
        reasons = cut(reasons.unionByName(offers.join(chosen.select(*both), both, "left_semi").select(*reasons.columns)))
    for i, code in enumerate(SALIENCE):
        # the first session with the code that isn't chosen is asked, no other
        left = rows.where(F.array_contains("salience", code)).join(chosen.select(*both), both, "left_anti")
        asked = left.groupBy(*key).agg(F.min(F.struct("plan_rank", "internal_id", "local_day", "_size")).alias("s")).select(*key, "s.*")
        new = cut(asked.join(state, key).where("_size <= _left and _room >= 1"))
        state = cut(state.join(new.select(*key, F.col("_size").alias("_u")), key, "left").select(*key, (F.col("_left") - F.coalesce("_u", F.lit(0))).alias("_left"), (F.col("_room") - F.when(F.col("_u").isNotNull(), 1).otherwise(0)).alias("_room")))
        chosen = cut(chosen.unionByName(new.select(*both, "local_day")))
        reasons = reasons.unionByName(new.select(*both, F.lit(f"salience:{code}").alias("reason"), F.lit(4 + i).alias("stage"), F.col("plan_rank").alias("pos")))
    new = take(own.withColumn("pos", F.col("plan_rank")))
    reasons = reasons.unionByName(new.select(*both, F.lit("budget_fill").alias("reason"), F.lit(4 + len(SALIENCE)).alias("stage"), "pos"))
    why = F.transform(F.array_sort(F.collect_list(F.struct("stage", "pos", "reason"))), lambda r: r.reason)
    told = reasons.groupBy(*both).agg(F.array_join(why, ",").alias("reasons"))
    return told.join(rows.select(*both, F.col("plan_rank").cast("long").alias("plan_rank")), both).select(*both, "plan_rank", "reasons")


def coverage_of(sketches: DataFrame, chosen: DataFrame) -> DataFrame:
    """Targets and hits of providers, projects and days per window, and what was left out."""
    rows = unique_sketches(sketches).join(chosen.select("window_key", "internal_id", F.lit(True).alias("_in")), ["window_key", "internal_id"], "left")
    aggs = []
    for d in ("provider", "project", "local_day"):
        aggs += [F.count_distinct(d).alias(f"{d}_target"), F.count_distinct(F.when(F.col("_in"), F.col(d))).alias(f"{d}_hit")]
    return rows.groupBy("window_key").agg(F.count("*").alias("population"), F.count_if("_in").alias("selected"), *aggs)


def plan_projection(sketches: DataFrame, chosen: DataFrame) -> DataFrame:
    """What a plan did in each window, without ids: counts, targets and hits, reasons, whether all targets were hit.

    reasons is a JSON object with a count for every code of the vocabulary, in order.
    """
    cover = coverage_of(sketches, chosen)
    vocabulary = sorted(["provider_top", "project_top", "day_top", "budget_fill", *[f"salience:{c}" for c in SALIENCE]])
    given = chosen.groupBy("window_key").agg(*[F.count_if(F.array_contains(F.split("reasons", ","), c)).alias(c) for c in vocabulary])
    counts = F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias(c) for c in vocabulary]))
    whole = " and ".join(f"{d}_hit >= {d}_target" for d in ("provider", "project", "local_day"))
    out = cover.join(given, "window_key", "left").withColumn("reasons", counts).drop(*vocabulary)
    return out.withColumn("unselected", F.col("population") - F.col("selected")).withColumn("coverage_complete", F.expr(whole))


def budget_fit(items: DataFrame, budget: int, overhead: int = 0, by: tuple[str, ...] = ("group",), order: tuple[str, ...] = ("pos",), chars: str = "chars") -> DataFrame:
    """Items that fit a budget of characters per group, in order; one too large is skipped, not cut.

    Items without a group, place or size are left out. Items that share a place are taken by size,
    then by their other columns, and each is fitted for itself. See _fit for the phases.
    """
    keys, places = list(by), list(order)
    sized = items.withColumn("_size", F.col(chars).cast("long") + overhead).dropna(subset=[*keys, *places, "_size"]).where(F.col("_size") <= budget)
    ties = [f.name for f in items.schema.fields if f.name not in (*keys, *places) and f.dataType.typeName() not in ("map", "variant")]
    limits = sized.select(*keys).distinct().withColumn("_left", F.lit(budget).cast("long"))
    return _fit(sized, limits, keys, [*places, "_size", *ties]).select(*items.columns)


def areas_under_budget(items: DataFrame, plan: DataFrame, budget: int, overhead: int = 0) -> DataFrame:
    """Texts of all areas that fit one budget per window in plan order, then regrouped by area.

    items: window_key, area, internal_id, text; plan: window_key, internal_id, plan_rank. Returns window_key, area, ids and
    texts (arrays in plan order); what is collected is bounded by the budget.
    """
    ranked = items.join(plan.select("window_key", "internal_id", "plan_rank"), ["window_key", "internal_id"]).withColumn("chars", F.length("text"))
    fitted = budget_fit(ranked, budget, overhead, ("window_key",), ("plan_rank",))
    grouped = fitted.groupBy("window_key", "area").agg(F.sort_array(F.collect_list(F.struct("plan_rank", "internal_id", "text"))).alias("r"))
    return grouped.select("window_key", "area", F.transform("r", lambda r: r.internal_id).alias("ids"), F.transform("r", lambda r: r.text).alias("texts"))


def day_quota(rows: DataFrame, days: int = 7, most: int = 200, by: tuple[str, ...] = ()) -> DataFrame:
    """The most active sessions of each day up to a quota; free places go to the most active others.

    The first cut is per day; what is left over is at most `most` rows a day by then.
    """
    days = max(1, days)
    quota = max(1, most // days)
    order = [F.desc("active_us"), F.asc("start_us"), F.asc("session_id")]
    ranked = rows.withColumn("_day", F.row_number().over(W.partitionBy(*by, "local_day").orderBy(*order))).where(F.col("_day") <= most + quota)
    ranked = ranked.withColumn("_over", (F.col("_day") > quota).cast("int"))
    # sampled rows go by day and activity, the overflow by activity alone
    key = [F.asc("_over"), F.when(F.col("_over") == 0, F.col("local_day")).asc(), *order]
    place = F.row_number().over(W.partitionBy(*(by or (F.lit(0),))).orderBy(*key))
    return ranked.withColumn("place", place).where(F.col("place") <= most).drop("_day", "_over")


def first_texts(rows: DataFrame, per_project: int = 2, chars: int = 160, projects: int = 40) -> DataFrame:
    """Up to two distinct first texts of each of the most active projects, cut for a prompt."""
    text = rows.withColumn("text", F.left("first_text", F.lit(chars))).groupBy("project", "text").agg(F.min(F.struct("start_us", "session_id")).alias("first"), F.sum("active_us").alias("active_us"))
    rank = F.row_number().over(W.partitionBy("project").orderBy("first"))
    total = text.groupBy("project").agg(F.sum("active_us").alias("total")).orderBy(F.desc("total"), "project").limit(projects)
    return text.where("text is not null and text <> ''").withColumn("rank", rank).where(F.col("rank") <= per_project).join(F.broadcast(total), "project").select("project", "rank", "text")


def with_texts(plan: DataFrame, texts: DataFrame, id_col: str, rank_col: str) -> DataFrame:
    """Chosen rows with their texts, by rank; ids without a text go."""
    return plan.join(texts, id_col).orderBy(rank_col, id_col)
