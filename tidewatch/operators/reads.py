"""Newest events, newest flags and time windows."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.text import display_text
from tidewatch.functions.times import bucket_hour, bucket_minute, rfc3339
from tidewatch.plans.latest import first_per_key

# Limits and look-back used when none is given.
EVENT_LIMIT = 50
FLAG_LIMIT = 100
LOOKBACK = timedelta(minutes=10)
TEXT_WIDTH = 80
REASON_WIDTH = 60


def recent_events(view: DataFrame, did: str, limit: int = EVENT_LIMIT) -> DataFrame:
    """The newest events of one author."""
    return (view.filter(F.col("did") == did)
            .orderBy(F.desc("received_at"), "id").limit(limit if limit > 0 else EVENT_LIMIT))


def recent_events_per_author(view: DataFrame, limit: int = EVENT_LIMIT) -> DataFrame:
    """The newest events of every author."""
    return first_per_key(view, ["did"], [F.desc("received_at"), F.col("id")],
                         limit if limit > 0 else EVENT_LIMIT)


def recent_flagged(flags: DataFrame, as_of: datetime, since: timedelta = LOOKBACK,
                   limit: int = FLAG_LIMIT) -> DataFrame:
    """The newest flags received in the last `since`, from the hour of `as_of` back.

    The hour and date ranges are derived here so that only those partitions are read.
    """
    since = since if since > timedelta(0) else LOOKBACK
    now, cutoff = _time(as_of), _time(as_of - since)
    recent = (F.col("bucket_hour").between(bucket_hour(cutoff), bucket_hour(now))
              & (F.col("received_at") >= cutoff))
    if "bucket_date" in flags.columns:
        recent &= F.col("bucket_date").between(F.to_date(cutoff), F.to_date(now))
    return (flags.filter(recent).orderBy(F.desc("received_at"), "id", "rule_id")
            .limit(limit if limit > 0 else FLAG_LIMIT))


def hours_back(as_of: datetime, since: timedelta = LOOKBACK) -> tuple[int, int]:
    """The hours (since 1970) of the cutoff and of `as_of`."""
    since = since if since > timedelta(0) else LOOKBACK
    at = as_of if as_of.tzinfo else as_of.replace(tzinfo=timezone.utc)
    return tuple(int(t.timestamp() // 3600) for t in (at - since, at))


def _time(at: datetime) -> Column:
    """A time without zone counts as UTC."""
    at = at.astimezone(timezone.utc) if at.tzinfo else at
    return F.lit(at.replace(tzinfo=None).isoformat(sep=" ") + "Z").cast("timestamp")


def kind_window(view: DataFrame, kind: str, first: datetime, last: datetime) -> DataFrame:
    """Events of one kind in the minutes `first` to `last`, both included."""
    begin, end = bucket_minute(_time(first)), bucket_minute(_time(last))
    inside = (F.col("kind") == kind) & F.col("bucket_minute").between(begin, end)
    if "bucket_date" in view.columns:
        inside &= F.col("bucket_date").between(F.to_date(begin), F.to_date(end))
    return view.filter(inside)


def display_events(rows: DataFrame) -> DataFrame:
    return rows.select(rfc3339(F.col("received_at")).alias("received_at"), "id", "kind",
                       display_text(F.col("text"), TEXT_WIDTH).alias("text"))


def display_flagged(rows: DataFrame) -> DataFrame:
    return rows.select(rfc3339(F.col("received_at")).alias("received_at"),
                       F.col("rule_id").alias("rule"), "severity", "did",
                       display_text(F.col("reason"), REASON_WIDTH).alias("reason"))
