"""State at an instant, and rows regrouped into deltas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import pointer
from tidelake.model import COLUMNS, with_rowid


def snapshot(samples: DataFrame, at: int, context: str | None = None, paths: Iterable[str] | None = None) -> DataFrame:
    """AGG-11: the newest row of each (context, path) at or before ``at``; whole rows, never column by column.

    Tiers may overlap: a repeated row doesn't change the newest."""
    ok = F.col("ts") <= at
    if context is not None:
        ok = ok & (F.col("context") == context)
    if paths is not None:
        ok = ok & F.col("path").isin(list(paths))
    return newest(samples.where(ok))


def newest(samples: DataFrame) -> DataFrame:
    """AGG-12, SNK-3's fold: one row per (context, path)."""
    rest = [c for c in COLUMNS if c not in ("context", "path")]
    rows = with_rowid(samples)
    picked = rows.groupBy("context", "path").agg(F.max_by(F.struct(*rest, "rowid"), F.struct("ts", "source", "rowid")).alias("newest"))
    return picked.select(*[F.col(c) if c in ("context", "path") else F.col(f"newest.{c}").alias(c) for c in [*COLUMNS, "rowid"]])


def restamped(rows: DataFrame) -> DataFrame:
    """JON-7: the fields of an object take time and source of its newest field."""
    group = Window.partitionBy("context", pointer.object_path(F.col("path")), pointer.is_field(F.col("path")))
    newest_of = F.max(F.struct("ts", "source")).over(group)
    field = pointer.is_field(F.col("path"))
    marked = rows.withColumn("_n", F.when(field, newest_of))
    return marked.withColumns({"ts": F.when(field, F.col("_n.ts")).otherwise(F.col("ts")), "source": F.when(field, F.col("_n.source")).otherwise(F.col("source"))}).drop("_n")


def deltas(rows: DataFrame) -> DataFrame:
    """AGG-18: (ts, context, source, values), values being (path, fields or a single value with key ''), by path and key.

    Of several rows with one key a number beats text, then the later row counts."""
    rows = with_rowid(rows)
    keyed = rows.select("ts", "context", "source", pointer.object_path(F.col("path")).alias("path"), F.coalesce(pointer.field_key(F.col("path")), F.lit("")).alias("key"), "value_kind", "value_num", "value_str", "value_lat", "value_lon", "rowid")
    value = F.struct("value_kind", "value_num", "value_str", "value_lat", "value_lon")
    one = keyed.groupBy("ts", "context", "source", "path", "key").agg(F.max_by(value, F.struct(F.col("value_num").isNotNull(), "rowid")).alias("value"))
    objects = one.groupBy("ts", "context", "source", "path").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("fields"))
    return objects.groupBy("ts", "context", "source").agg(F.sort_array(F.collect_list(F.struct("path", "fields"))).alias("values"))


def names(samples: DataFrame, at: int) -> DataFrame:
    """FLT-11: the name of each context at an instant, from identity rows that aren't empty."""
    rows = snapshot(samples.where((F.col("value_kind") == "identity") & (F.col("value_str") != "")), at, paths=["name"])
    return rows.select("context", F.col("value_str").alias("name"))


def first_labelled(delta_rows: DataFrame, labels: DataFrame) -> DataFrame:
    """JON-6: the name put before a context's first delta, null on the others. ``labels`` is one row a context."""
    order = Window.partitionBy("context").orderBy("ts", F.col("source").asc_nulls_first())
    joined = delta_rows.join(labels, "context", "left").withColumn("_n", F.row_number().over(order))
    return joined.withColumn("name", F.when(F.col("_n") == 1, F.col("name"))).drop("_n")
