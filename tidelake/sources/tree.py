"""The tiers: hot batches, the dated tree of Parquet files, and the table of newest values.

``tree/date=YYYY-MM-DD/<rollId>.parquet`` and ``hour-<ms>.parquet``, ``hot/batch=<n>``, ``latest/latest.parquet``. A roll named T
holds rows that arrived before T, so the merge of hour H owns the ids in (H, H + 1 h].
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.instants import day_start, segment_start
from tidelake.model import COLUMNS, DAY_MS, HOT, HOUR_MS, SAMPLE, SNAPSHOT_SCAN_DAYS
from tidelake.operators.snapshot import snapshot
from tidelake.sources import pending
from tidelake.sources.files import Store

TREE, HOT_DIR, LATEST = "tree", "hot", "latest/latest.parquet"
_ROLL, _HOUR = re.compile(r"([0-9]+)\.parquet"), re.compile(r"hour-([0-9]+)\.parquet")


def roll_id(name: str) -> int | None:
    """FUN-10."""
    found = _ROLL.fullmatch(name)
    return int(found[1]) if found and 0 < int(found[1]) < 2**53 else None


def hour_id(name: str) -> int | None:
    found = _HOUR.fullmatch(name)
    return int(found[1]) if found and int(found[1]) < 2**53 else None


def covers(roll: int, hour: int) -> bool:
    """JON-9."""
    return hour < roll <= hour + HOUR_MS


def live(names: list[str]) -> list[str]:
    """SRC-3: a folder's data files, without rolls that a merged hour there holds."""
    hours = {h for h in map(hour_id, names) if h is not None}
    out = []
    for name in names:
        roll = roll_id(name)
        if hour_id(name) is not None or roll is not None and -(-roll // HOUR_MS) * HOUR_MS - HOUR_MS not in hours:
            out.append(name)
    return sorted(out)


def files_in_range(store: Store, start: int, end: int) -> list[str]:
    """SRC-2: live files of the days that overlap [start, end); no tree, no files."""
    out = []
    for entry in store.names(TREE):
        day = segment_start(entry)
        if day is not None and day < end and day + DAY_MS > start:
            out += [store.at(TREE, entry, n) for n in live(store.names(TREE, entry))]
    return out


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """SRC-1: an explicit list; columns by name, missing ones null."""
    return spark.read.schema(SAMPLE).parquet(*files) if files else spark.createDataFrame([], SAMPLE)


def read_tree(spark: SparkSession, store: Store) -> DataFrame:
    """SRC-7: every live file, whatever its date."""
    return read_files(spark, files_in_range(store, -(2**62), 2**62))


def read_hot(spark: SparkSession, store: Store) -> DataFrame:
    """SRC-4: all batches that were committed."""
    batches = [store.at(HOT_DIR, n) for n in store.names(HOT_DIR) if n.startswith("batch=")]
    return spark.read.schema(HOT).option("pathGlobFilter", "*.parquet").parquet(*batches) if batches else spark.createDataFrame([], HOT)


def read_latest(spark: SparkSession, store: Store) -> DataFrame | None:
    """SRC-6."""
    return spark.read.schema(SAMPLE).parquet(store.at(LATEST)) if store.exists(LATEST) else None


@dataclass(frozen=True)
class Plan:
    """Which files to read, and how much of the hot tier they already hold."""

    files: tuple[str, ...]
    seam: Column | None
    read_hot: bool


def needs_hot(oldest: int | None, end: int) -> bool:
    """SRC-5: not if the window ends at or before the oldest hot row; an empty store is read."""
    return oldest is None or end > oldest


def seam(store: Store, record: pending.PendingRoll | None, names: dict[str, list[str]]) -> Column | None:
    """FLT-7: while a roll is unfinished, a hot row counts unless a day's file of that roll already holds it."""
    if record is None:
        return None
    rolled = [segment_start(entry) for entry, files in names.items() if f"{record.roll_id}.parquet" in files or any(h is not None and covers(record.roll_id, h) for h in map(hour_id, files))]
    rolled = [d for d in rolled if d is not None]
    if not rolled:
        return None
    inside = F.lit(False)
    for day in rolled:
        inside = inside | ((F.col("ts") >= day) & (F.col("ts") < day + DAY_MS))
    return (F.col("rowid") > record.max_rowid) | ~inside


def plan_sources(spark: SparkSession, store: Store, start: int, end: int) -> Plan:
    """Files first, then the pending record: the other order could turn rows that move between tiers into a gap."""
    listing = {entry: store.names(TREE, entry) for entry in store.names(TREE)}
    files = []
    for entry, names in sorted(listing.items()):
        day = segment_start(entry)
        if day is not None and day < end and day + DAY_MS > start:
            files += [store.at(TREE, entry, n) for n in live(names)]
    record = pending.read(store)
    oldest = read_hot(spark, store).agg(F.min("ts")).first()[0] if store.exists(HOT_DIR) else None
    return Plan(tuple(files), seam(store, record, listing), store.exists(HOT_DIR) and needs_hot(oldest, end))


def rows_between(spark: SparkSession, store: Store, start: int, end: int) -> DataFrame:
    """SET-1: the union of the tiers for a range, each row once; rows of the tree have arrival order 0."""
    plan = plan_sources(spark, store, start, end)
    rows = read_files(spark, list(plan.files)).withColumn("rowid", F.lit(0).cast("long"))
    if plan.read_hot:
        hot = read_hot(spark, store)
        rows = rows.unionByName(hot if plan.seam is None else hot.where(plan.seam))
    return rows.where((F.col("ts") >= start) & (F.col("ts") < end))


def snapshot_at(spark: SparkSession, store: Store, at: int, context: str | None = None, paths: list[str] | None = None) -> DataFrame:
    """SET-4: newest values, the hot tier and the last ``SNAPSHOT_SCAN_DAYS`` days up to the instant; the days only if the table
    of newest values is missing or newer. A key that moved on later and was last seen before those days is absent."""
    latest = read_latest(spark, store)
    rows = read_hot(spark, store)
    fresh = latest is not None and latest.where(F.col("ts") > at).limit(1).count() == 0  # AGG-19
    if latest is not None:
        rows = rows.unionByName(latest.withColumn("rowid", F.lit(0).cast("long")))
    if not fresh:
        first = day_start(at) - (SNAPSHOT_SCAN_DAYS - 1) * DAY_MS
        tree = read_files(spark, files_in_range(store, first, at + 1))
        rows = rows.unionByName(tree.withColumn("rowid", F.lit(0).cast("long")))
    return snapshot(rows, at, context, paths).select(*COLUMNS)
