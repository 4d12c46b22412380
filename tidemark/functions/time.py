"""Instants, local days and report windows.

Instants are epoch microseconds (BIGINT, UTC). Wall-clock values are TIMESTAMP_NTZ, so no
result depends on the session's time zone.
"""

from __future__ import annotations

import re
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_us(column: str) -> Column:
    """Microseconds of a TIMESTAMP_NTZ column read as UTC."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{column}`)")


def as_ntz(column: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, `{column}`, {_EPOCH})")


def parse_iso(text: Column) -> Column:
    """Epoch microseconds of an ISO-8601 string; no offset means UTC, anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
    trimmed = F.trim(text)
    with_zone = F.when(trimmed.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & (F.length(trimmed) > 10), trimmed).otherwise(F.concat(trimmed, F.when(F.length(trimmed) == 10, F.lit("T00:00:00Z")).otherwise(F.lit("Z"))))
    return F.when(trimmed.rlike(shape), F.unix_micros(F.try_to_timestamp(with_zone)))


def local_day(column: str, zone: str) -> Column:
    """Calendar day in `zone` of epoch microseconds."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), as_ntz(column)).cast("date")


def split_local_days(intervals: DataFrame, zone: str, start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Cut half-open intervals at local midnights; adds local_date and replaces both bounds.

    Midnights are converted from local time one by one, so days of 23 and 25 hours come out right.
    """
    last = F.expr(f"timestampadd(MICROSECOND, `{end}` - 1, {_EPOCH})")
    first_day = local_day(start, zone)
    last_day = F.convert_timezone(F.lit("UTC"), F.lit(zone), last).cast("date")
    days = intervals.where(F.col(end) > F.col(start)).withColumn("local_date", F.explode(F.sequence(first_day, last_day)))
    midnight = lambda d: F.convert_timezone(F.lit(zone), F.lit("UTC"), d.cast("timestamp_ntz"))
    days = days.withColumn("_from", midnight(F.col("local_date"))).withColumn("_to", midnight(F.date_add("local_date", 1)))
    days = days.withColumn(start, F.greatest(F.col(start), epoch_us("_from"))).withColumn(end, F.least(F.col(end), epoch_us("_to")))
    return days.where(F.col(end) > F.col(start)).drop("_from", "_to")


def to_us(moment: datetime) -> int:
    """Exact microseconds; a naive moment is UTC."""
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    gap = moment - datetime(1970, 1, 1, tzinfo=UTC)
    return (gap.days * 86400 + gap.seconds) * SECOND + gap.microseconds


def windows_frame(spark: SparkSession, windows: list[tuple[str, int, int]]) -> DataFrame:
    """windows(window_key, since_us, until_us, ord) of (key, since, until) in report order."""
    rows = [(key, since, until, i) for i, (key, since, until) in enumerate(windows)]
    return spark.createDataFrame(rows, "window_key string, since_us long, until_us long, ord int")


def previous_window(since: int, until: int) -> tuple[int, int]:
    """The window of the same length that ends where this one starts."""
    return since - (until - since), since


def rolling_weeks(now: datetime, count: int) -> list[tuple[str, int, int]]:
    """`count` adjacent 7-day windows that end at `now`, oldest first, named by the ISO week of their end."""
    out = []
    for i in reversed(range(count)):
        end = now - timedelta(days=7 * i)
        year, week, _ = end.isocalendar()
        out.append((f"{year}-W{week:02d}", to_us(end - timedelta(days=7)), to_us(end)))
    return out


def _month(year: int, month: int, back: int) -> tuple[int, int]:
    n = year * 12 + month - 1 - back
    return n // 12, n % 12 + 1


def calendar_months(now: datetime, count: int) -> list[tuple[str, int, int]]:
    """`count` calendar months up to the month of `now`, oldest first; the last ends at `now`."""
    out = []
    for i in reversed(range(count)):
        year, month = _month(now.year, now.month, i)
        start = datetime(year, month, 1, tzinfo=now.tzinfo)
        after = datetime(*_month(year, month, -1), 1, tzinfo=now.tzinfo)
        out.append((f"{year}-{month:02d}", to_us(start), to_us(min(after, now))))
    return out


def completed_local_weeks(now: datetime, weeks: int, zone: str) -> list[tuple[str, int, int]]:
    """The last `weeks` (1 to 24) whole ISO weeks, Monday to Monday in `zone`, oldest first."""
    if isinstance(weeks, bool) or not isinstance(weeks, int) or not 1 <= weeks <= 24:
        raise ValueError("weeks must be an integer between 1 and 24")
    local = now.astimezone(ZoneInfo(zone)).date()
    monday = local - timedelta(days=local.weekday())
    midnight = lambda d: to_us(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(zone)))
    out = []
    for i in reversed(range(weeks)):
        start = monday - timedelta(days=7 * (i + 1))
        out.append((start.isoformat(), midnight(start), midnight(start + timedelta(days=7))))
    return out


def report_window(name: str | None, now: datetime) -> tuple[str, int, int]:
    """(label, since, until) of week (the last 7 days), month (since the first; the default), all (since 2000) or YYYY-MM.

    A window that ends now is labelled by both its dates, so that runs on different days don't share a
    label; a month that is over keeps its name.
    """
    first = lambda year, month: datetime(year, month, 1, tzinfo=now.tzinfo)
    if name == "all":
        return f"all-thru-{now:%Y-%m-%d}", to_us(first(2000, 1)), to_us(now)
    over = None
    if name in (None, "month"):
        since = first(now.year, now.month)
    elif name == "week":
        since = now - timedelta(days=7)
    elif re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", name):
        year, month = map(int, name.split("-"))
        since, over = first(year, month), first(*_month(year, month, -1))
    else:
        raise ValueError(f"no such window: {name!r} (week, month, all or YYYY-MM)")
    if over is not None and over <= now:
        return name, to_us(since), to_us(over)
    return f"{since:%Y-%m-%d}_{now:%Y-%m-%d}", to_us(since), to_us(now)


def check_weekly_windows(windows: list[tuple[str, int, int]], zone: str) -> None:
    """Refuse windows that aren't 7 local days at one wall time each, or that overlap."""
    at = lambda us: datetime.fromtimestamp(us / SECOND, ZoneInfo(zone))
    last = None
    for key, since, until in sorted(windows, key=lambda w: w[1]):
        a, b = at(since), at(until)
        if b.date() - a.date() != timedelta(days=7) or a.time() != b.time():
            raise ValueError(f"{key} isn't a local week")
        if last is not None and since < last:
            raise ValueError(f"{key} overlaps the window before it")
        last = until


def snapshot_age_days(snapshot: date, today: date) -> tuple[int, bool]:
    """Age of a price snapshot and whether it is stale (over 90 days)."""
    age = (today - snapshot).days
    return age, age > 90
