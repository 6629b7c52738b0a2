"""Replay: a range played back as deltas, window by window, in pages that never cut a delta (STR-14, STR-15)."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidelake.model import REPLAY_CHUNK_MS, REPLAY_PAGE_ROWS
from tidelake.operators.scan import raw_range
from tidelake.operators.snapshot import deltas, first_labelled, names


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    resume: int
    more: bool


def page(samples: DataFrame, start: int, end: int, limit: int = REPLAY_PAGE_ROWS) -> Page:
    """Rows of [start, end), at most ``limit``. If there are more, the last millisecond's rows are held back and the next page starts
    at it; a page of one millisecond is given whole, and the next starts after it."""
    found = raw_range(samples, start, end, limit)
    first, last, n = found.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).first()
    if n <= limit:
        return Page(found, end, False)
    if first == last:
        return Page(samples.where(F.col("ts") == first), first + 1, True)
    return Page(found.where(F.col("ts") < last), last, True)


def play(rows_between: Callable[[int, int], DataFrame], start: int, now: Callable[[], int], rate: float = 1.0, end: int | None = None, chunk_ms: int = REPLAY_CHUNK_MS, limit: int = REPLAY_PAGE_ROWS, sleep: Callable[[float], None] = time.sleep) -> Iterator[Row]:
    """Deltas from ``start`` on; names come before a context's first delta. Windows are paced by ``chunk_ms / rate``; an empty
    window passes after 100 ms, a window in the future is waited for, and a failed read is tried again after a second."""
    cursor, labels, known = start, None, set()
    while end is None or cursor < end:
        stop = cursor - cursor % chunk_ms + chunk_ms if end is None else min(cursor + chunk_ms, end)
        if stop > now():
            sleep((stop - now()) / 1000)
            continue
        try:
            samples = rows_between(cursor, stop)
            part = page(samples, cursor, stop, limit)
            if labels is None:
                labels = names(rows_between(0, start + 1), start)
            found = first_labelled(deltas(part.rows), labels).orderBy("ts", F.col("source").asc_nulls_first(), "context").collect()
        except Exception:
            sleep(1.0)
            continue
        for delta in found:
            if delta["name"] is not None and delta["context"] in known:
                delta = Row(**{**delta.asDict(), "name": None})
            known.add(delta["context"])
            yield delta
        cursor = part.resume
        if not part.more:
            sleep(chunk_ms / rate / 1000 if found else 0.1)
