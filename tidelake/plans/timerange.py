"""Time ranges, durations and parameters of requests (plain Python; instants are epoch milliseconds)."""

from __future__ import annotations

import math
import re

from tidelake.model import EMA_DEFAULT, SMA_DEFAULT

_PERIOD = re.compile(r"P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def duration_seconds(duration: float | int | str) -> float:
    """FUN-14: seconds, or an ISO 8601 duration of weeks, days and time."""
    if isinstance(duration, (int, float)) and not isinstance(duration, bool):
        return float(duration)
    found = _PERIOD.fullmatch(duration)
    if not found or not any(found.groups()):
        raise ValueError(f"not a duration: {duration}")
    return sum(float(x or 0) * k for x, k in zip(found.groups(), (604800, 86400, 3600, 60, 1), strict=True))


def resolve(start: int | None = None, end: int | None = None, duration: float | str | None = None, now: int | None = None) -> tuple[int, int]:
    """FUN-13: from and to; from and duration; to and duration; from until now; or a duration until now. Zero is a duration."""
    span = None if duration is None else round(duration_seconds(duration) * 1000)
    if start is not None and end is not None:
        found = (start, end)
    elif start is not None and span is not None:
        found = (start, start + span)
    elif end is not None and span is not None:
        found = (end - span, end)
    elif start is not None and now is not None:
        found = (start, now)
    elif span is not None and now is not None:
        found = (now - span, now)
    else:
        raise ValueError("a time range needs two of from, to and duration")
    if found[0] > found[1]:
        raise ValueError("a time range ends after it starts")
    return found


def resolution_seconds(resolution: float | None) -> int | None:
    """WIN-2: whole seconds, at least 1; none or nothing positive means no buckets."""
    if resolution is None or not math.isfinite(resolution) or resolution <= 0:
        return None
    return max(1, math.floor(resolution))


def sma_window(parameter: str | None) -> int:
    """WIN-6: a positive whole number, else the default."""
    return int(parameter) if parameter and re.fullmatch(r"[0-9]+", parameter) and int(parameter) > 0 else SMA_DEFAULT


def ema_alpha(parameter: str | None) -> float:
    """WIN-6: above 0 and at most 1, else the default."""
    try:
        alpha = float(parameter)
    except (TypeError, ValueError):
        return EMA_DEFAULT
    return alpha if 0 < alpha <= 1 else EMA_DEFAULT
