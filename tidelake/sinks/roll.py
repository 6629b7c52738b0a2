"""From the hot tier to the tree: append, roll, fold of newest values, truncation (SNK-1, 2, 3, 7, 9, 10)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.instants import day_of, day_segment
from tidelake.model import COLUMNS, DAY_MS, HOT, split_valid
from tidelake.operators.snapshot import newest
from tidelake.sources import pending, tree
from tidelake.sources.files import Store


class NameTaken(FileExistsError):
    """A roll of this name, or a merged hour that owns it, is there already."""


@dataclass(frozen=True)
class Rolled:
    roll_id: int
    max_rowid: int
    rows: int
    files: dict[str, int]


def append_batch(store: Store, batch: DataFrame, batch_id: int) -> bool:
    """SNK-1: one batch of valid rows as ``hot/batch=<id>``, once: a batch that is there already is skipped.

    Arrival order is the batch, then the row within it."""
    spark = batch.sparkSession
    name = f"batch={batch_id:012d}"
    if store.exists(tree.HOT_DIR, name) or store.exists(tree.HOT_DIR, f".done-{batch_id:012d}"):
        return False
    good, _ = split_valid(batch)
    rows = good.select(*COLUMNS, (F.lit(batch_id << 33) + F.monotonically_increasing_id() % (1 << 33)).alias("rowid")) if "rowid" not in good.columns else good.select(*HOT.names)
    aside = store.at(tree.HOT_DIR, f"_{name}")
    rows.write.mode("overwrite").parquet(aside)
    store.rename(f"{tree.HOT_DIR}/_{name}", f"{tree.HOT_DIR}/{name}")
    return True


def write_single(spark: SparkSession, store: Store, rows: DataFrame, target: str, aside: str) -> int:
    """Rows as one named Parquet file: written aside, counted by reading back (SRC-11), then renamed."""
    rows.coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(store.at(aside))
    written = spark.read.parquet(store.at(aside)).count()
    part = next(n for n in store.names(aside) if n.endswith(".parquet"))
    store.rename(f"{aside}/{part}", target)
    store.delete(aside)
    return written


def roll(spark: SparkSession, store: Store, roll_id: int, max_rowid: int, replace: bool = False) -> Rolled:
    """SNK-2: hot rows up to a bound, one file per day, in one shuffle by day; each is counted before it gets its name.

    Partition-by-day writing lets Spark stream every day in parallel; a day's rows are then one file."""
    rows = tree.read_hot(spark, store).where(F.col("rowid") <= max_rowid)
    days = [r["day"] for r in rows.select((F.floor(F.col("ts") / DAY_MS)).alias("day")).distinct().orderBy("day").collect()]  # AGG-16
    segments = [f"date={day_segment(d * DAY_MS)}" for d in days]
    for segment in segments:
        names = store.names(tree.TREE, segment)
        merged = any(h is not None and tree.covers(roll_id, h) for h in map(tree.hour_id, names))
        if merged or (f"{roll_id}.parquet" in names and not replace):
            raise NameTaken(f"{segment}/{roll_id}")
    aside = f"_roll-{roll_id}"
    dated = rows.select(*COLUMNS, day_of(F.col("ts")).alias("date")).repartition("date")
    dated.write.mode("overwrite").partitionBy("date").option("compression", "zstd").parquet(store.at(aside))
    counted = {r["date"].isoformat(): r["n"] for r in spark.read.parquet(store.at(aside)).groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()} if days else {}
    total = rows.count()
    if sum(counted.values()) != total:
        raise OSError(f"roll {roll_id} wrote {sum(counted.values())} of {total} rows")
    for segment in segments:
        part = next(n for n in store.names(aside, segment) if n.endswith(".parquet"))
        store.rename(f"{aside}/{segment}/{part}", f"{tree.TREE}/{segment}/{roll_id}.parquet")
    store.delete(aside)
    fold_latest(spark, store, rows)
    return Rolled(roll_id, max_rowid, total, counted)


def fold_latest(spark: SparkSession, store: Store, fresh: DataFrame) -> None:
    """SNK-3: newest value of each key over the fresh rows and the table so far; an unreadable table is set aside and rebuilt."""
    previous = tree.read_latest(spark, store)
    if previous is not None:
        try:
            previous.limit(1).count()
        except Exception:
            store.rename(tree.LATEST, f"{tree.LATEST}.unreadable")
            previous = tree.read_tree(spark, store)
    rows = fresh.select(*COLUMNS, "rowid")
    if previous is not None:
        rows = rows.unionByName(previous.withColumn("rowid", F.lit(0).cast("long")), allowMissingColumns=True)
    write_single(spark, store, newest(rows).select(*COLUMNS), tree.LATEST, "_latest")


def delete_through(spark: SparkSession, store: Store, max_rowid: int) -> None:
    """SNK-7: drops hot batches whose rows are all rolled; a batch across the bound is rewritten without them."""
    for name in store.names(tree.HOT_DIR):
        if not name.startswith("batch="):
            continue
        rows = spark.read.schema(HOT).parquet(store.at(tree.HOT_DIR, name))
        low, high = rows.agg(F.min("rowid"), F.max("rowid")).first()
        if high is None or high <= max_rowid:
            store.write_text("", tree.HOT_DIR, f".done-{name[6:]}")
            store.delete(tree.HOT_DIR, name)
        elif low <= max_rowid:
            rows.where(F.col("rowid") > max_rowid).write.mode("overwrite").parquet(store.at(tree.HOT_DIR, f"_{name}"))
            store.rename(f"{tree.HOT_DIR}/_{name}", f"{tree.HOT_DIR}/{name}")


def roll_once(spark: SparkSession, store: Store, now: int) -> Rolled | None:
    """SNK-9: bound, record 'rolling', roll, record 'written', truncate, clear. A record left by a crash is finished first."""
    record = pending.read(store)
    if record is None:
        bound = tree.read_hot(spark, store).agg(F.max("rowid")).first()[0]  # AGG-17
        if bound is None:
            return None
        record = pending.PendingRoll(now, bound, "rolling")
        pending.write(store, record)
    done = None
    if record.phase == "rolling":
        done = roll(spark, store, record.roll_id, record.max_rowid, replace=True)
        pending.write(store, pending.PendingRoll(record.roll_id, record.max_rowid, "written"))
    delete_through(spark, store, record.max_rowid)
    pending.clear(store)
    return done
