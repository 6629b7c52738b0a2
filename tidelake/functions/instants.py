"""Epoch-millisecond arithmetic as columns and in Python."""

from __future__ import annotations

from datetime import UTC, date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelake.model import DAY_MS

EPOCH = date(1970, 1, 1)


def bucket(ts: Column, width: int) -> Column:
    """WIN-1: start of the tumbling window, aligned to the epoch; right for negative times too."""
    return ts - F.pmod(ts, F.lit(width))


def iso(ts: Column) -> Column:
    """PRJ-11: ISO 8601 with milliseconds (the session runs in UTC)."""
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def day_of(ts: Column) -> Column:
    """FUN-8 as a date column."""
    return F.date_from_unix_date(F.floor(ts / DAY_MS).cast("int"))


def day_segment(ts: int) -> str:
    """FUN-8: YYYY-MM-DD in UTC; ValueError beyond the years 1 to 9999."""
    try:
        return (EPOCH + timedelta(days=ts // DAY_MS)).isoformat()
    except OverflowError as problem:
        raise ValueError(f"{ts} has no four-digit year") from problem


def segment_start(entry: str) -> int | None:
    """FUN-9: start of a ``date=`` directory, or None if the name isn't one."""
    if not entry.startswith("date="):
        return None
    try:
        day = date.fromisoformat(entry[5:])
    except ValueError:
        return None
    return (day - EPOCH).days * DAY_MS if day.isoformat() == entry[5:] else None


def day_start(ts: int) -> int:
    return ts - ts % DAY_MS


def iso_text(ts: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ts)).strftime("%Y-%m-%dT%H:%M:%S.") + f"{ts % 1000:03d}Z"


def parse_iso(text: str) -> int:
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    moment = moment if moment.tzinfo else moment.replace(tzinfo=UTC)
    return (moment - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(milliseconds=1)


def next_slot(now: int, interval_minutes: int) -> int:
    """FUN-16: the next roll, counted from midnight UTC; the interval must divide a day."""
    if interval_minutes < 1 or 1440 % interval_minutes:
        raise ValueError(f"{interval_minutes} minutes do not divide a day")
    width = interval_minutes * 60_000
    return now - now % width + width
