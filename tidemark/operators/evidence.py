"""Bounded evidence of sessions in windows: what a slice rests on, its fingerprint and its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import fingerprint, slice_id
from tidemark.operators.activity import GAP_CAP_US, SESSION, events_in

#: Version of what goes into a fingerprint; other versions never compare equal.
POLICY = 1
FACTS = ["project", "first_us", "last_us", "msg_count", "user_msg_count", "between_us", "events_digest", "first_text", "last_text"]


def row_digest(*columns: Column) -> tuple[Column, Column]:
    """Two 60-bit numbers of a row (nulls as empty text): their sums over rows tell sets of rows apart."""
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)
    number = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    return number(1), number(16)


def set_digest(*columns: Column) -> Column:
    """Aggregate: a digest of the group's rows that doesn't depend on their order.

    Made of a count and two sums, so partial aggregates merge and no group is collected.
    """
    a, b = row_digest(*columns)
    return F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.sum(a).cast("string"), F.sum(b).cast("string")), 256)


def window_evidence(messages: DataFrame, windows: DataFrame, cap_us: int = GAP_CAP_US, chars: int = 200) -> DataFrame:
    """One bounded record for each session and window that has events of it: window_key, agent, session_id, FACTS, fingerprint, slice_id.

    messages: agent, session_id, ts_us, path, line_no, role, text, is_real_user, project_raw. Events without an
    instant don't count. Only what lies between the first and the last event inside counts
    (between_us: gaps of at most cap_us), so that a later end of the window that adds no event
    changes nothing. Texts are the first and the last of the user, cut to `chars`.
    """
    inside = events_in(messages.where("ts_us is not null"), windows)
    order = W.partitionBy("window_key", *SESSION).orderBy("ts_us", "path", "line_no")
    gap = F.least(F.lead("ts_us").over(order) - F.col("ts_us"), F.when(F.lead("ts_us").over(order).isNotNull(), F.lit(cap_us)))
    rows = inside.withColumn("_gap", F.coalesce(gap, F.lit(0).cast("long")))
    place = F.struct("ts_us", "path", "line_no")
    said = F.when(F.col("is_real_user") & (F.trim("text") != ""), F.col("text"))
    cut_text = lambda pick: F.coalesce(F.left(pick(said, F.when(said.isNotNull(), place)), F.lit(chars)), F.lit(""))
    found = rows.groupBy("window_key", *SESSION).agg(
        F.coalesce(F.min("project_raw"), F.lit("")).alias("project"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.count("*").alias("msg_count"), F.coalesce(F.sum(F.col("is_real_user").cast("long")), F.lit(0)).alias("user_msg_count"),
        F.sum("_gap").alias("between_us"), set_digest(F.col("ts_us"), F.col("path"), F.col("line_no"), F.col("role"), F.col("text")).alias("events_digest"), cut_text(F.min_by).alias("first_text"), cut_text(F.max_by).alias("last_text"),
    )
    return named(found)


def named(evidence: DataFrame) -> DataFrame:
    """Evidence rows with their fingerprint and slice_id."""
    out = evidence.withColumn("fingerprint", fingerprint(F.lit(POLICY), *[F.col(c) for c in FACTS]))
    return out.withColumn("slice_id", slice_id(POLICY, F.col("agent"), F.col("session_id"), F.col("fingerprint")))


def evidence_violations(evidence: DataFrame, messages: DataFrame, windows: DataFrame, cap_us: int = GAP_CAP_US, chars: int = 200) -> DataFrame:
    """Evidence rows (window_key, agent, session_id, reason) that break their bounds or don't say what the messages say.

    reason: `bounds` (an instant outside the window), `sum` (between_us isn't the sum of the gaps, or longer than the span),
    `fingerprint` (not that of the facts), `facts` (another record than that of the messages, or none).
    """
    w = F.broadcast(windows.select("window_key", "since_us", "until_us"))
    keys = ["window_key", *SESSION]
    own = window_evidence(messages, windows, cap_us, chars).select(*keys, F.col("fingerprint").alias("_f"), F.col("between_us").alias("_b"))
    rows = evidence.join(w, "window_key").join(own, keys, "left")
    reason = (
        F.when((F.col("first_us") < F.col("since_us")) | (F.col("last_us") >= F.col("until_us")), "bounds")
        .when((F.col("between_us") > F.col("last_us") - F.col("first_us")) | (F.col("between_us") < 0) | (F.col("_b") != F.col("between_us")), "sum")
        .when(F.col("fingerprint") != fingerprint(F.lit(POLICY), *[F.col(c) for c in FACTS]), "fingerprint").when(~F.col("_f").eqNullSafe(F.col("fingerprint")), "facts")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*keys, "reason")


def summary_fingerprint(family: Column, lane: Column, project: Column, text: Column) -> Column:
    """Fingerprint of what a summary was made from: family, policy, lane, project and the text shown."""
    return fingerprint(F.lit(POLICY), *[F.coalesce(c, F.lit("")) for c in (family, lane, project, text)])
