"""Token usage: deduplication, counter differences along branch trees, step times, prices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.activity import events_in
from tidemark.operators.lineage import written

COUNTERS = ["input_tokens", "cache_creation", "cache_read", "output_tokens"]
TOTALS = ["input_total", "cached_total", "write_total", "output_total"]
UNKNOWN = "unknown"
COVERAGE_RANK = {"complete": 0, "partial": 1, "unavailable": 2}


def usage_in_windows(usage: DataFrame, windows: DataFrame, order: tuple[str, ...] = ("path", "line_no")) -> DataFrame:
    """Usage rows of each window (bounds included), each message id once.

    The earliest row of an id wins, ties by `order`. Rows without an id all stay and don't
    enter the grouping, so they can't pile up under one null key.
    """
    rows = events_in(usage, windows, closed=True).drop("since_us", "until_us", "ord")
    named = rows.where("message_id is not null")
    rank = F.struct("ts_us", *order)
    fields = [c for c in named.columns if c not in ("window_key", "message_id")]
    once = named.groupBy("window_key", "message_id").agg(F.min_by(F.struct(*fields), rank).alias("r")).select("window_key", "message_id", *[F.col(f"r.{c}").alias(c) for c in fields])
    return rows.where("message_id is null").unionByName(once)


def by_model(rows: DataFrame, keys: tuple[str, ...] = ("window_key",)) -> DataFrame:
    """Turns and counters per key and model."""
    return rows.groupBy(*keys, "model").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in COUNTERS])


def merge_models(parts: list[DataFrame], keys: tuple[str, ...] = ("window_key",)) -> DataFrame:
    """Sum of several by_model tables."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*keys, "model").agg(F.sum("turns").alias("turns"), *[F.sum(c).alias(c) for c in COUNTERS])


def distinct_snapshots(snapshots: DataFrame) -> DataFrame:
    """Cumulative snapshots once per branch, instant and totals; a known model is preferred."""
    known = F.struct((F.col("model") != UNKNOWN).alias("known"), F.col("model"))
    return snapshots.groupBy("branch", "ts_us", *TOTALS).agg(F.max(known).alias("m")).select("branch", "ts_us", *TOTALS, F.col("m.model").alias("model"))


def counter_deltas(snapshots: DataFrame) -> DataFrame:
    """Growth of each cumulative total since the branch's snapshot before (never negative), with its place.

    pos counts the branch's snapshots from 0; rows without growth stay (drop them with `grown`).
    """
    order = W.partitionBy("branch").orderBy("ts_us", *TOTALS)
    rows = snapshots.select("branch", "ts_us", "model", *[F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).alias(c) for c in TOTALS])
    rows = rows.withColumn("pos", F.row_number().over(order) - 1)
    return rows.withColumns({f"d_{c}": F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(order), F.lit(0))) for c in TOTALS})


def grown(deltas: DataFrame) -> DataFrame:
    """One usage event per delta row that grew: uncached input, cache reads and writes, output."""
    some = deltas.where(" or ".join(f"d_{c} > 0" for c in TOTALS))
    return some.select(
        "branch", "ts_us", "model",
        F.greatest(F.lit(0), F.col("d_input_total") - F.col("d_cached_total")).alias("input_tokens"),
        F.col("d_write_total").alias("cache_creation"), F.col("d_cached_total").alias("cache_read"), F.col("d_output_total").alias("output_tokens"),
    )


def ancestors(branches: DataFrame) -> DataFrame:
    """(branch, ancestor) once for each ancestor of each branch(branch, parent); in a cycle none is its own.

    Each round doubles the generations that are known: those up to 2^k, then 2^k further up from
    each. It ends with the first round that finds no new pair.
    """
    jump = written(branches.where("parent is not null and branch <> parent").select("branch", F.col("parent").alias("ancestor")).distinct())
    out = jump
    while not jump.isEmpty():
        onward = jump.select(F.col("branch").alias("ancestor"), F.col("ancestor").alias("next"))
        further = out.join(onward, "ancestor").select("branch", F.col("next").alias("ancestor")).where("branch <> ancestor").distinct()
        new = written(further.join(out, ["branch", "ancestor"], "left_anti"))
        if new.isEmpty():
            break
        out = out.unionByName(new)
        jump = written(jump.join(onward, "ancestor").select("branch", F.col("next").alias("ancestor")).distinct())
    return out


def inherited_prefix(snapshots: DataFrame, lineage: DataFrame) -> DataFrame:
    """(branch, inherited): the longest leading run of a branch's totals that an ancestor holds in order.

    The ancestor's series is read once, in order, with the place reached in the branch's own: what
    isn't the next value looked for is passed by. Branches without an ancestor are left out, those
    without a match inherit 0. Each pair of equal values (place i in the branch, place j in the
    ancestor) is a row; sorted by j they are one reading of the ancestor, of which a task holds no
    more than a batch. A value that both hold several times makes as many rows as their product, less those
    with j < i, where no reading can have come so far.
    """
    pair = ["branch", "ancestor"]
    least = F.lit(-(2**63))
    place = F.row_number().over(W.partitionBy("branch").orderBy("ts_us", *TOTALS)) - 1
    placed = written(snapshots.select("branch", place.alias("i"), *[F.coalesce(F.col(c).cast("long"), least).alias(c) for c in TOTALS]))
    theirs = placed.select(F.col("branch").alias("ancestor"), F.col("i").alias("j"), *TOTALS)
    nodes = lineage.select(*pair).distinct().join(placed, "branch").join(theirs, ["ancestor", *TOTALS]).where("i <= j").select(*pair, "i", "j")
    kind = lineage.schema["branch"].dataType.simpleString()
    reached = nodes.repartition(*pair).sortWithinPartitions(*pair, "j", "i").mapInArrow(_places_reached, f"branch {kind}, inherited long")
    return lineage.select("branch", F.lit(0).cast("long").alias("inherited")).unionByName(reached).groupBy("branch").agg(F.max("inherited").alias("inherited"))


def _places_reached(batches):
    """(branch, inherited) of each pair; batches: (branch, ancestor, i, j) sorted by branch, ancestor, j, i, each pair in one task."""
    now, reach, last = None, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        branch, ancestor = batch.column(0), batch.column(1)
        new = pc.or_(pc.not_equal(branch[1:], branch[:-1]), pc.not_equal(ancestor[1:], ancestor[:-1]))
        starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        i, j = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        names, found = [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a or now != (branch[0], ancestor[0]):
                if now is not None:
                    names.append(now[0])
                    found.append(reach)
                now, reach, last = (branch[a], ancestor[a]), 0, -1
            for k in range(a, b):
                if i[k] == reach and j[k] > last:
                    reach, last = reach + 1, j[k]
        yield pa.RecordBatch.from_arrays([pa.array(names, branch.type), pa.array(found, pa.int64())], ["branch", "inherited"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], now[0].type), pa.array([reach], pa.int64())], ["branch", "inherited"])


def branch_usage(snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    """Usage events of branches of cumulative counters, without what a branch copied from its ancestors."""
    once = written(distinct_snapshots(snapshots))
    copied = inherited_prefix(once, ancestors(branches))
    own = counter_deltas(once).join(copied, "branch", "left").where(F.col("pos") >= F.coalesce("inherited", F.lit(0)))
    return grown(own)


def last_model(rows: DataFrame, path: str = "path", order: str = "line_no") -> DataFrame:
    """model of the last context row at or before each row of its file, else `unknown`."""
    before = W.partitionBy(path).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("model", F.coalesce(F.last("context_model", ignorenulls=True).over(before), F.lit(UNKNOWN)))


def step_times(steps: DataFrame) -> DataFrame:
    """Times of steps(session_id, step, ts_us): exact, else between both neighbours, else the nearer side's.

    est_us is null where a session has no known time; lo_us and hi_us are the session's bounds.
    """
    by = W.partitionBy("session_id").orderBy("step")
    known = F.when(F.col("ts_us").isNotNull(), F.struct("step", "ts_us"))
    rows = steps.withColumn("low", F.last(known, ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("high", F.first(known, ignorenulls=True).over(by.rowsBetween(0, W.unboundedFollowing)))
    whole = W.partitionBy("session_id")
    rows = rows.withColumn("lo_us", F.min("ts_us").over(whole)).withColumn("hi_us", F.max("ts_us").over(whole))
    between = F.expr("low.ts_us + ((step - low.step) * (high.ts_us - low.ts_us)) div (high.step - low.step)")
    est = F.coalesce(F.col("ts_us"), F.when(F.col("low").isNotNull() & F.col("high").isNotNull(), between), F.col("low.ts_us"), F.col("high.ts_us"))
    return rows.withColumn("est_us", est).drop("low", "high")


def steps_in_windows(timed: DataFrame, windows: DataFrame) -> DataFrame:
    """Steps in each window: by their time, or with the whole session where that lies inside."""
    w = F.broadcast(windows)
    inside = (F.col("since_us") <= F.col("lo_us")) & (F.col("hi_us") <= F.col("until_us"))
    return timed.join(w, F.when(F.col("ts_us").isNull() & inside, F.lit(True)).otherwise(F.col("est_us").between(F.col("since_us"), F.col("until_us"))))


def without_counted(log_usage: DataFrame, companion: DataFrame) -> DataFrame:
    """Log usage of steps that the companion table hasn't counted; rows without a step stay."""
    return log_usage.join(companion.select("session_id", F.col("idx").alias("step")).distinct(), ["session_id", "step"], "left_anti")


def layered_prices(tables: list[tuple[DataFrame, str]], families: list[str]) -> DataFrame:
    """prices(model, inp, out, cw, cr, provenance, is_family): later tables win."""
    rows = None
    for rank, (table, provenance) in enumerate(tables):
        part = table.select(F.lower("model").alias("model"), "inp", "out", "cw", "cr", F.lit(provenance).alias("provenance"), F.lit(rank).alias("rank"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("model").agg(F.max_by(F.struct("inp", "out", "cw", "cr", "provenance"), "rank").alias("p"))
    return best.select("model", "p.*", F.col("model").isin(families).alias("is_family"))


def resolve_prices(models: DataFrame, prices: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rates of each distinct model by the resolution ladder; models without a price have nulls.

    User keys win (whole name, then longest part of the name; the alias target likewise), then
    the table's own entries (alias target first), then the longest family name inside the name.
    """
    named = models.select("model").distinct().withColumn("mk", F.lower(F.trim("model"))).join(F.broadcast(aliases.select(F.col("model").alias("mk"), "target")), "mk", "left")
    p = F.broadcast(prices.select(F.col("model").alias("key"), "inp", "out", "cw", "cr", "provenance", "is_family"))
    user, key, mk, target = F.col("provenance") == "user", F.col("key"), F.col("mk"), F.coalesce("target", F.lit(""))
    tier = (
        F.when(user & (key == mk), 1).when(user & mk.contains(key), 2).when(user & (key == target), 3).when(user & target.contains(key), 4)
        .when(key == target, 5).when(key == mk, 6).when(F.col("is_family") & (mk.contains(key) | target.contains(key)), 7)
    )
    met = named.join(p, (mk != "") & (mk.contains(key) | target.contains(key))).withColumn("tier", tier).where("tier is not null")
    best = met.groupBy("model").agg(F.min_by(F.struct("key", "inp", "out", "cw", "cr"), F.struct("tier", -F.length("key"), "key")).alias("p"))
    return named.select("model").join(best, "model", "left").select("model", F.col("p.key").alias("price_key"), "p.inp", "p.out", "p.cw", "p.cr")


def cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """by_model rows with cost_usd, cost_uncached_usd (all input at the input rate) and whether a price was found.

    Costs are DECIMAL(38,12), exact for rates of up to six decimals, so that no sum depends on its order.
    """
    rate = lambda c: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(10,6)")
    tokens = lambda c: c.cast("decimal(19,0)")
    dollars = lambda c: (c.cast("decimal(25,6)") * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)")
    own = tokens(F.col("input_tokens")) * rate("inp") + tokens(F.col("output_tokens")) * rate("out") + tokens(F.col("cache_creation")) * rate("cw") + tokens(F.col("cache_read")) * rate("cr")
    plain = tokens(F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read")) * rate("inp") + tokens(F.col("output_tokens")) * rate("out")
    return usage.join(F.broadcast(rates), "model", "left").withColumn("cost_usd", dollars(own)).withColumn("cost_uncached_usd", dollars(plain)).withColumn("priced", F.col("inp").isNotNull())


def rounded(column: str, digits: int = 6) -> Column:
    """A cost rounded once, half up, and then a double."""
    return F.round(column, digits).cast("double").alias(column)


def usage_totals(costed: DataFrame, keys: tuple[str, ...] = ("window_key",)) -> DataFrame:
    """Totals per window: counters, tokens, cost, savings, cache-hit ratio, models without a price."""
    tokens = sum((F.col(c) for c in COUNTERS), F.lit(0))
    sums = costed.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in COUNTERS], F.sum("turns").alias("turns"), F.sum("cost_usd").alias("cost_usd"), F.sum("cost_uncached_usd").alias("cost_uncached_usd"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("priced") & (tokens > 0), F.col("model")))), ",").alias("unpriced_models"),
    )
    read = F.col("input_tokens") + F.col("cache_creation") + F.col("cache_read")
    return sums.withColumn("total_tokens", tokens).withColumn("savings_usd", F.col("cost_uncached_usd") - F.col("cost_usd")).withColumn("cache_hit", F.when(read > 0, F.col("cache_read").cast("double") / read).otherwise(F.lit(0.0)))


def coverage(active: DataFrame, providers: DataFrame) -> DataFrame:
    """Per window: whether all agents with sessions there report usage completely, and the others.

    active: window_key, agent; providers: agent, usage_coverage.
    """
    rows = active.select("window_key", "agent").distinct().join(F.broadcast(providers), "agent")
    of = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("usage_coverage") == kind, F.col("agent")))), ",")
    return rows.groupBy("window_key").agg(F.bool_and(F.col("usage_coverage") == "complete").alias("usage_complete"), of("partial").alias("partial_agents"), of("unavailable").alias("unavailable_agents"))


def least_coverage(rows: DataFrame) -> DataFrame:
    """Least complete coverage of each agent over a series of windows."""
    rank = F.create_map(*[F.lit(x) for pair in COVERAGE_RANK.items() for x in pair])
    return rows.groupBy("agent").agg(F.max_by("usage_coverage", rank[F.col("usage_coverage")]).alias("usage_coverage"))


def combined_status(status: str = "status") -> Column:
    """complete if all are, unavailable if all are, else partial (an aggregate expression)."""
    return F.when(F.bool_and(F.col(status) == "complete"), "complete").when(F.bool_and(F.col(status) == "unavailable"), "unavailable").otherwise("partial")
