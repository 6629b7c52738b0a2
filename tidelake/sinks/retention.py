"""Retention by whole days, and sweeps of what crashed writers left (SNK-6, SNK-13)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.instants import segment_start
from tidelake.model import DAY_MS, HOUR_MS
from tidelake.sources import tree
from tidelake.sources.files import Store


@dataclass
class Expired:
    removed: list[str] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)
    tree_error: str | None = None


def expired(day: Column, newest_day: Column, now: Column, keep_days: int) -> Column:
    """A day goes if it ended before the reference instant (now, but no later than the end of the newest day) less the days kept."""
    reference = F.least(now, newest_day + DAY_MS - 1)
    return day + DAY_MS < reference - keep_days * DAY_MS


def expired_days(days: DataFrame, now: int, keep_days: int) -> DataFrame:
    """The decision over a table of distinct days (ms); days in the future don't move the reference."""
    past = days.where(F.col("day") <= now).agg(F.max("day").alias("newest"))
    return days.crossJoin(F.broadcast(past)).where(expired(F.col("day"), F.col("newest"), F.lit(now), keep_days)).select("day")  # one row on the right


def expire(store: Store, now: int, keep_days: int) -> Expired:
    """Drops whole ``date=`` folders; reports and never raises."""
    out = Expired()
    try:
        days = {d: n for n in store.names(tree.TREE) if (d := segment_start(n)) is not None}
    except Exception as problem:
        out.tree_error = str(problem)
        return out
    past = [d for d in days if d <= now]
    if not past:
        return out
    reference = min(now, max(past) + DAY_MS - 1)
    for day, name in sorted(days.items()):
        if day + DAY_MS < reference - keep_days * DAY_MS:
            try:
                store.delete(tree.TREE, name)
                out.removed.append(name)
            except Exception as problem:
                out.failures[name] = str(problem)
    return out


def sweep(store: Store, now: int, roll_age: int = HOUR_MS, merge_age: int = 6 * HOUR_MS) -> list[str]:
    """SNK-13: removes work folders of rolls and merges that are older than their age."""
    gone = []
    for name, changed in store.entries():
        age = roll_age if name.startswith("_roll-") or name == "_latest" else merge_age if name.startswith("_merge-") else None
        if age is not None and now - changed > age:
            store.delete(name)
            gone.append(name)
    return gone
