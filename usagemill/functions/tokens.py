"""Column functions of the accounting rules."""

from __future__ import annotations

from datetime import datetime, time, timedelta, tzinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sources, statuses that count, and token columns of an event.
SOURCES = ["codex", "claude", "pi", "opencode"]
COUNTED = ["canonical", "provisional"]
TOKENS = ["input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "cache_write_5m_tokens", "cache_write_1h_tokens", "reasoning_tokens", "reported_total_tokens", "derived_total_tokens"]
UNKNOWN_SPELLINGS = ["(unknown)", "<unknown>", "unknown", "unknown model", "unknown models"]
UNKNOWN_DAY, UNKNOWN_MODEL = "(unknown)", "(unknown)"
NANOS = 1_000_000_000


def counted(status: str = "status") -> Column:
    """Whether an event's status counts."""
    return F.coalesce(F.col(status).isin(COUNTED), F.lit(False))


def event_total() -> Column:
    """The reported total, else the derived one, else the parts; input of codex already holds what was read from cache."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    parts = zero("input_tokens") + zero("output_tokens") + zero("cache_write_tokens") + F.when(F.col("source") == "codex", F.lit(0)).otherwise(zero("cache_read_tokens"))
    return F.coalesce(F.col("reported_total_tokens"), F.col("derived_total_tokens"), parts)


def local_day(ns: str, tz: str) -> Column:
    """H8: the local date of epoch nanoseconds; rounds towards the past."""
    seconds = F.expr(f"(`{ns}` - pmod(`{ns}`, {NANOS}L)) div {NANOS}L")
    return F.to_date(F.from_utc_timestamp(F.timestamp_seconds(seconds), tz))


def window_bounds(period: str | int, tz: tzinfo, now: datetime) -> tuple[int, int] | None:
    """Half-open bounds in nanoseconds of the local days of '7d', '28d' or a number of days up to now's; None for 'all'."""
    if now.tzinfo is None or now.utcoffset() is None:
        raise ValueError("now must have an explicit timezone")
    if period == "all":
        return None
    days = {"7d": 7, "28d": 28}.get(period, period) if isinstance(period, str) else period
    if isinstance(days, bool) or not isinstance(days, int) or days <= 0:
        raise ValueError("the number of days must be a positive integer")
    today = now.astimezone(tz).date()
    lo, hi = (datetime.combine(d, time.min, tzinfo=tz) for d in (today - timedelta(days=days - 1), today + timedelta(days=1)))
    return int(lo.timestamp()) * NANOS, int(hi.timestamp()) * NANOS


def in_window(bounds: tuple[int, int] | None, ns: str = "occurred_at_ns") -> Column:
    if bounds is None:
        return F.lit(True)
    return F.coalesce((F.col(ns) >= bounds[0]) & (F.col(ns) < bounds[1]), F.lit(False))


def epoch_to_ns(x: Column) -> Column:
    """Nanoseconds of a number whose size tells its unit: nanoseconds, milliseconds or seconds."""
    size = F.abs(x)
    return F.when(size >= 10**15, x).when(size >= 10**12, x * 10**6).otherwise(x * NANOS).cast("long")


def iso_to_ns(text: Column) -> Column:
    """Nanoseconds of an ISO-8601 time, through a double as the ledger always did; 0 if it is none. Without a zone it is UTC."""
    at = F.try_to_timestamp(text)
    return F.coalesce((F.unix_micros(at).cast("double") / 1e6 * 1e9).cast("long"), F.lit(0))


def money_to_nanos(value: Column) -> Column:
    """Nanodollars of a decimal(38,29) amount, half up."""
    return F.round(value * F.lit(NANOS).cast("decimal(10,0)"), 0).cast("long")


def dominates(new: list[Column], old: list[Column]) -> Column:
    """Whether each new component is at least the old one, nulls counting as 0."""
    out = F.lit(True)
    for a, b in zip(new, old, strict=True):
        out = out & (F.coalesce(a, F.lit(0)) >= F.coalesce(b, F.lit(0)))
    return out


def display_model(model: Column) -> Column:
    """One name for the spellings of an unknown model."""
    return F.when(F.lower(F.trim(model)).isin(UNKNOWN_SPELLINGS), "unknown models").otherwise(model)
