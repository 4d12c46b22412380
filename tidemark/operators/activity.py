"""Active time: gap-capped intervals, sessions, window slices, wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAP_CAP_US = 300_000_000
ENGAGED_US = 60_000_000
SESSION = ["agent", "session_id"]


def with_next(messages: DataFrame) -> DataFrame:
    """Messages with an instant, and after_us: that of their session's next one (null after the last).

    The one shuffle by session that intervals, sessions and slices need: given rows that have after_us
    (a written table of them, if several are wanted), they don't look for it again. Rows of subagents are left out.
    """
    rows = messages.where("ts_us is not null")
    if "is_subagent" in rows.columns:
        rows = rows.where(~F.col("is_subagent"))
    return rows.withColumn("after_us", F.lead("ts_us").over(W.partitionBy(*SESSION).orderBy("ts_us")))


def _next(rows: DataFrame) -> Column:
    return F.col("after_us") if "after_us" in rows.columns else F.lead("ts_us").over(W.partitionBy(*SESSION).orderBy("ts_us"))


def active_intervals(events: DataFrame, cap_us: int = GAP_CAP_US) -> DataFrame:
    """Half-open intervals from each event to the next of its session, each at most `cap_us` long.

    One shuffle by session; equal instants give no interval.
    """
    after = _next(events)
    end = F.when(after.isNotNull(), F.least(after, F.col("ts_us") + F.lit(cap_us)))  # least() skips nulls
    return events.where("ts_us is not null").select(*SESSION, F.col("ts_us").alias("start_us"), end.alias("end_us")).where("end_us > start_us")


def engaged(user_msgs: Column, active_us: Column, scheduled: Column | None = None) -> Column:
    """Scheduled sessions need one user message; others two, or one and a minute of activity."""
    usual = (user_msgs >= 2) | ((user_msgs == 1) & (active_us >= ENGAGED_US))
    return usual if scheduled is None else F.when(scheduled, user_msgs >= 1).otherwise(usual)


def sessions(messages: DataFrame, cap_us: int = GAP_CAP_US, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per session: bounds, messages, active time, engagement.

    messages: agent, session_id, ts_us, is_real_user, text and the constant columns in `more`;
    is_scheduled is used if there, and rows of subagents (is_subagent) make no sessions. Gaps and
    totals share one shuffle by session.
    """
    if "is_subagent" in messages.columns:
        messages = messages.where(~F.col("is_subagent"))
    scheduled = F.col("is_scheduled") if "is_scheduled" in messages.columns else F.lit(False)
    after = _next(messages)
    gap = F.when(after.isNotNull(), F.least(after - F.col("ts_us"), F.lit(cap_us)))
    rows = messages.where("ts_us is not null").withColumn("_gap", F.coalesce(gap, F.lit(0))).withColumn("_scheduled", scheduled)
    out = rows.groupBy(*SESSION).agg(
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("end_us"),
        F.count("*").alias("msg_count"),
        F.sum(F.col("is_real_user").cast("long")).alias("user_msg_count"),
        F.sum("_gap").alias("active_us"),
        F.max("_scheduled").alias("is_scheduled"),
        *[F.min(c).alias(c) for c in more],
    )
    return out.withColumn("active_sec", F.expr("active_us div 1000000")).withColumn("engaged", engaged(F.col("user_msg_count"), F.col("active_us"), F.col("is_scheduled")))


def session_facts(messages: DataFrame, chars: int = 200) -> DataFrame:
    """First cwd, first and latest user text and final assistant text of each session, in file order.

    messages: agent, session_id, path, line_no, role, text, is_real_user, cwd, is_subagent.
    Rows of subagents and blank texts don't count; the first user text is cut to `chars`.
    """
    place = F.struct("path", "line_no")
    said = F.when(F.trim("text") != "", F.col("text"))
    user, answer = F.when(F.col("is_real_user"), said), F.when(F.col("role") == "assistant", said)
    of = lambda pick, value: pick(value, F.when(value.isNotNull(), place))
    return messages.where(~F.col("is_subagent")).groupBy(*SESSION).agg(
        of(F.min_by, F.col("cwd")).alias("cwd"), F.left(of(F.min_by, user), F.lit(chars)).alias("first_user_text"),
        of(F.max_by, user).alias("latest_user_text"), of(F.max_by, answer).alias("final_assistant_text"),
    )


def overlapping(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Sessions whose closed span meets a window (start before its end, end not before its start)."""
    w = F.broadcast(windows)  # a report has at most a few dozen windows
    return rows.join(w, (F.col("end_us") >= F.col("since_us")) & (F.col("start_us") < F.col("until_us")))


def events_in(rows: DataFrame, windows: DataFrame, closed: bool = False) -> DataFrame:
    """Rows with their windows: half-open by default, closed for usage."""
    w = F.broadcast(windows)
    upper = F.col("ts_us") <= F.col("until_us") if closed else F.col("ts_us") < F.col("until_us")
    return rows.join(w, (F.col("ts_us") >= F.col("since_us")) & upper)


def clip(intervals: DataFrame, windows: DataFrame) -> DataFrame:
    """Intervals cut to each window they overlap; only positive lengths stay."""
    w = F.broadcast(windows)
    met = intervals.join(w, (F.col("start_us") < F.col("until_us")) & (F.col("end_us") > F.col("since_us")))
    return met.withColumn("start_us", F.greatest("start_us", "since_us")).withColumn("end_us", F.least("end_us", "until_us")).where("end_us > start_us")


def slices(messages: DataFrame, windows: DataFrame, cap_us: int = GAP_CAP_US) -> DataFrame:
    """Window-pure views of sessions: what of a session lies in each window.

    A slice exists where an interval or an event does; counts are of events in the window. A
    session inside one window is its own slice (contained).
    """
    inside = clip(active_intervals(messages, cap_us), windows).groupBy(*SESSION, "window_key").agg(
        F.sum(F.col("end_us") - F.col("start_us")).alias("active_us"), F.min("start_us").alias("i_start"), F.max("end_us").alias("i_end")
    )
    seen = events_in(messages.where("ts_us is not null"), windows).groupBy(*SESSION, "window_key").agg(
        F.count("*").alias("msg_count"), F.sum(F.col("is_real_user").cast("long")).alias("user_msg_count"), F.min("ts_us").alias("e_start"), F.max("ts_us").alias("e_end")
    )
    both = inside.join(seen, [*SESSION, "window_key"], "full_outer")
    whole = sessions(messages, cap_us).select(*SESSION, F.col("start_us").alias("s_start"), F.col("end_us").alias("s_end"), "engaged")
    out = both.join(whole, SESSION).join(F.broadcast(windows.select("window_key", "since_us", "until_us")), "window_key")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        "window_key", *SESSION,
        F.least("i_start", "e_start").alias("start_us"), F.greatest("i_end", "e_end").alias("end_us"),
        zero("active_us"), zero("msg_count"), zero("user_msg_count"), "engaged",
        ((F.col("s_start") >= F.col("since_us")) & (F.col("s_end") < F.col("until_us"))).alias("contained"),
    )


def wall_clock(intervals: DataFrame, keys: list[str], slot_us: int = 900_000_000) -> DataFrame:
    """Microseconds covered by the union of intervals, per key.

    Intervals are cut at the bounds of slots, so that the running maximum of ends is taken per
    key and slot: parts of a slot's length, not of a whole report.
    """
    first, last = F.expr(f"start_us div {slot_us}"), F.expr(f"(end_us - 1) div {slot_us}")
    cut = intervals.withColumn("slot", F.explode(F.sequence(first, last)))
    cut = cut.withColumn("a", F.greatest("start_us", F.col("slot") * slot_us)).withColumn("b", F.least("end_us", (F.col("slot") + 1) * slot_us))
    before = F.max("b").over(W.partitionBy(*keys, "slot").orderBy("a", "b").rowsBetween(W.unboundedPreceding, -1))
    own = F.greatest(F.lit(0), F.col("b") - F.greatest(F.col("a"), F.coalesce(before, F.col("a"))))
    return cut.select(*keys, own.alias("own")).groupBy(*keys).agg(F.sum("own").alias("wall_us"))


def window_totals(intervals: DataFrame, slot_us: int = 900_000_000) -> DataFrame:
    """raw_us, wall_us and parallelism (raw over wall, 1.0 where nothing is active) per window_key."""
    raw = intervals.groupBy("window_key").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("raw_us"))
    out = raw.join(wall_clock(intervals, ["window_key"], slot_us), "window_key")
    return out.withColumn("parallelism", F.when(F.col("wall_us") > 0, F.col("raw_us").cast("double") / F.col("wall_us")).otherwise(F.lit(1.0)))


def bounded_violations(found: DataFrame, windows: DataFrame) -> DataFrame:
    """Slices that break their bounds: outside the window, or more active time than span."""
    w = F.broadcast(windows.select("window_key", "since_us", "until_us"))
    bad = (F.col("start_us") < F.col("since_us")) | (F.col("end_us") > F.col("until_us")) | (F.col("active_us") > F.col("end_us") - F.col("start_us")) | (F.col("active_us") < 0)
    return found.join(w, "window_key").where(bad).drop("since_us", "until_us")


def duplicate_sessions(found: DataFrame) -> DataFrame:
    """Sessions that one window holds more than once."""
    return found.groupBy("window_key", *SESSION).agg(F.count("*").alias("n")).where("n > 1")
