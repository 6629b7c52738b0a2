"""Hourly compaction: the rolls of a closed hour become one file per day, sorted by path and time (SNK-4, SNK-5)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.instants import segment_start
from tidelake.model import COLUMNS, HOUR_MS
from tidelake.sinks.roll import write_single
from tidelake.sources import pending, tree
from tidelake.sources.files import Store


@dataclass(frozen=True)
class Unit:
    segment: str
    inputs: tuple[str, ...]
    output: str
    exists: bool


class NotNow(ValueError):
    """The hour can't be merged (yet)."""


def plan(store: Store, hour: int) -> list[Unit]:
    """SNK-5: per day, the hour's rolls: two or more, or one or more that a merged file has left behind."""
    units = []
    for segment in store.names(tree.TREE):
        if segment_start(segment) is None:
            continue
        names = store.names(tree.TREE, segment)
        inputs = tuple(n for n in names if (r := tree.roll_id(n)) is not None and tree.covers(r, hour))
        output = f"hour-{hour}.parquet"
        if len(inputs) >= (1 if output in names else 2):
            units.append(Unit(segment, inputs, output, output in names))
    return units


def missing_rows(whole: DataFrame, part: DataFrame) -> DataFrame:
    """JON-8, SET-5: rows of ``part`` that ``whole`` lacks, as multisets."""
    return part.select(*COLUMNS).exceptAll(whole.select(*COLUMNS))


def state_of(spark: SparkSession, store: Store, unit: Unit) -> str:
    """VAL-10: is a merged file that is there 'complete', 'incomplete' or 'unreadable'?"""
    inputs = tree.read_files(spark, [store.at(tree.TREE, unit.segment, n) for n in unit.inputs])
    try:
        merged = tree.read_files(spark, [store.at(tree.TREE, unit.segment, unit.output)])
        merged.count()
    except Exception:
        return "unreadable"
    return "complete" if missing_rows(merged, inputs).isEmpty() else "incomplete"


def compact_hour(spark: SparkSession, store: Store, hour: int, now: int) -> dict[str, str]:
    """Merges a closed hour; per day 'merged', 'removed' (inputs of a complete merge) or 'orphaned' (kept beside it)."""
    if hour % HOUR_MS:
        raise NotNow(f"{hour} is no full hour")
    if now < hour + HOUR_MS:
        raise NotNow("the hour is still open")
    record = pending.read(store)
    if record is not None and tree.covers(record.roll_id, hour):
        raise NotNow("a roll of the hour is unfinished")
    result = {}
    for unit in plan(store, hour):
        if unit.exists:
            state = state_of(spark, store, unit)
            if state == "incomplete":
                result[unit.segment] = "orphaned"
                continue
            if state == "unreadable":
                place = f"{tree.TREE}/{unit.segment}/{unit.output}"
                store.rename(place, f"{place}.unreadable")
            else:
                _remove(store, unit)
                result[unit.segment] = "removed"
                continue
        rows = tree.read_files(spark, [store.at(tree.TREE, unit.segment, n) for n in unit.inputs])
        expected = rows.count()
        # an hour of one day fits a task; sorted by path and time, row groups have narrow ranges that prune by path
        merged = rows.coalesce(1).sortWithinPartitions("path", "ts")
        target = f"{tree.TREE}/{unit.segment}/{unit.output}"
        written = write_single(spark, store, merged, f"{target}.tmp", f"_merge-{hour}-{unit.segment}")
        if written != expected:
            store.delete(f"{target}.tmp")
            raise OSError(f"{target}: {written} of {expected} rows")
        store.rename(f"{target}.tmp", target)
        _remove(store, unit)
        result[unit.segment] = "merged"
    return result


def _remove(store: Store, unit: Unit) -> None:
    for name in unit.inputs:
        store.delete(tree.TREE, unit.segment, name)


def newest_closed_hour(slot: int) -> int:
    """STR-13: the hour to merge after the roll of a slot."""
    return (slot - HOUR_MS) // HOUR_MS * HOUR_MS
