"""Multi-series answers: all series of a request in one pass over the rows (JON-10).

Series are a table of specs, at most 200 rows, broadcast to the rows; a row joins the specs of its own path and, if it is an
object's field, those of the object. One grouping per (spec, bucket) computes what scalar series need, one more folds fields
into deltas and picks whole deltas; a spec with rows of its own drops its fields.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.functions import pointer
from tidelake.functions.instants import bucket
from tidelake.model import CELL_COLUMNS, FIELD, OBJECT, RAW_SERIES_LIMIT, VALUE_COLUMNS, with_rowid
from tidelake.plans.requests import ANY, ValueSpec

_SPECS = "spec int, key string, aggregate string, any_source boolean, wanted string"


def specs_table(rows: DataFrame, specs: Sequence[ValueSpec]) -> DataFrame:
    return rows.sparkSession.createDataFrame([(i, s.path, s.aggregate, s.source == ANY, None if s.source == ANY else s.source) for i, s in enumerate(specs)], _SPECS)


def matched(samples: DataFrame, specs: Sequence[ValueSpec]) -> DataFrame:
    """Each row with each spec it belongs to; ``field`` tells an object's field from a row of the path itself."""
    path = F.col("path")
    keys = F.when(pointer.is_field(path), F.array(path, pointer.object_path(path))).otherwise(F.array(path))
    keyed = with_rowid(samples).withColumn("key", F.explode(keys))
    joined = keyed.join(F.broadcast(specs_table(samples, specs)), "key").where(F.col("any_source") | F.col("source").eqNullSafe(F.col("wanted")))
    return joined.withColumn("field", F.col("key") != path)


def _late(picked: Column) -> Column:
    """The row that 'last' takes from a bucket; the others take the first."""
    order = F.struct("ts", "source", "rowid")
    return F.when(F.first("aggregate") == "last", F.max_by(picked, order)).otherwise(F.min_by(picked, order))


def bucketed_scalars(rows: DataFrame, width: int) -> DataFrame:
    """AGG-1 to AGG-8, all reductions in one grouping."""
    has = F.when(F.col("value_num").isNotNull(), F.struct("ts", "source", "rowid"))
    grouped = rows.groupBy("spec", bucket(F.col("ts"), width).alias("bucket")).agg(
        F.first("aggregate").alias("aggregate"),
        F.avg("value_num").alias("average"),
        F.min("value_num").alias("low"),
        F.max("value_num").alias("high"),
        F.min_by("value_num", has).alias("early"),
        F.max_by("value_num", has).alias("late"),
        _late(F.struct("value_str", "value_kind", "value_lat", "value_lon")).alias("picked"),
    )
    num = (
        F.when(F.col("aggregate") == "min", F.col("low"))
        .when(F.col("aggregate") == "max", F.col("high"))
        .when(F.col("aggregate") == "mid", (F.col("low") + F.col("high")) / 2)
        .when(F.col("aggregate") == "first", F.col("early"))
        .when(F.col("aggregate") == "last", F.col("late"))
        .otherwise(F.col("average"))
    )
    return grouped.select(
        "spec", "bucket", num.alias("num"), F.col("picked.value_str").alias("str"), F.col("picked.value_kind").alias("kind"), F.col("picked.value_lat").alias("lat"), F.col("picked.value_lon").alias("lon"), F.lit(None).cast(OBJECT).alias("obj"), F.lit(0).alias("_n")
    )


def raw_scalars(rows: DataFrame, limit: int = RAW_SERIES_LIMIT) -> DataFrame:
    """TOP-2: recorded rows as they are, the first ``limit`` of each series."""
    order = Window.partitionBy("spec").orderBy("ts", F.col("source").asc_nulls_first(), "rowid")
    kept = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return kept.select(
        "spec", F.col("ts").alias("bucket"), F.col("value_num").alias("num"), F.col("value_str").alias("str"), F.col("value_kind").alias("kind"), F.col("value_lat").alias("lat"), F.col("value_lon").alias("lon"), F.lit(None).cast(OBJECT).alias("obj"), "_n"
    )


def deltas(rows: DataFrame) -> DataFrame:
    """AGG-9: one row per object and delta (spec, ts, source) with its fields in key order."""
    field = F.struct(pointer.field_key(F.col("path")).alias("key"), F.col("value_num").alias("num"), F.col("value_str").alias("str"), F.col("value_kind").alias("kind")).cast(FIELD)
    return rows.groupBy("spec", "aggregate", "ts", "source").agg(F.sort_array(F.collect_list(field)).alias("obj"))


def _object_row(bucket_at: Column, obj: Column, n: Column | None = None) -> list[Column]:
    text = F.lit(None).cast("string")
    real = F.lit(None).cast("double")
    return [F.col("spec"), bucket_at.alias("bucket"), real.alias("num"), text.alias("str"), text.alias("kind"), real.alias("lat"), real.alias("lon"), obj.alias("obj"), (F.lit(0) if n is None else n).alias("_n")]


def bucketed_objects(rows: DataFrame, width: int) -> DataFrame:
    """AGG-10: the first or last whole delta of a bucket. Other aggregates give one marker row with an empty object a series."""
    whole = deltas(rows.where(F.col("aggregate").isin("first", "last"))).withColumn("bucket", bucket(F.col("ts"), width))
    order = F.struct("ts", "source")
    picked = whole.groupBy("spec", "bucket").agg(F.when(F.first("aggregate") == "last", F.max_by("obj", order)).otherwise(F.min_by("obj", order)).alias("obj"))
    marks = rows.where(~F.col("aggregate").isin("first", "last")).groupBy("spec").agg(bucket(F.min("ts"), width).alias("bucket"))
    return picked.select(*_object_row(F.col("bucket"), F.col("obj"))).unionAll(marks.select(*_object_row(F.col("bucket"), F.array().cast(OBJECT))))


def raw_objects(rows: DataFrame, limit: int = RAW_SERIES_LIMIT) -> DataFrame:
    """TOP-3: every delta, the first ``limit`` deltas of each series."""
    order = Window.partitionBy("spec").orderBy("ts", F.col("source").asc_nulls_first())
    kept = deltas(rows).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit)
    return kept.select(*_object_row(F.col("ts"), F.col("obj"), F.col("_n")))


def values(samples: DataFrame, specs: Sequence[ValueSpec], bucket_ms: int | None = None, limit: int = RAW_SERIES_LIMIT, placed: bool = False) -> DataFrame:
    """(spec, bucket, num, str, kind, lat, lon, obj) of all series; ``samples`` are the rows of one context and range.

    Without ``bucket_ms`` every series is raw; with it, only specs that ask for raw are. ``placed`` adds ``_n``, a raw row's place in its series."""
    rows = matched(samples, specs)
    scalars, fields = rows.where("not field"), rows.where("field")
    if bucket_ms is None:
        own, objects = raw_scalars(scalars, limit), raw_objects(fields, limit)
    else:
        raw = F.col("aggregate") == "raw"
        own, objects = bucketed_scalars(scalars.where(~raw), bucket_ms), bucketed_objects(fields.where(~raw), bucket_ms)
        if any(s.aggregate == "raw" for s in specs):
            own, objects = own.unionAll(raw_scalars(scalars.where(raw), limit)), objects.unionAll(raw_objects(fields.where(raw), limit))
    if any("#" not in s.path for s in specs):
        owned = own.select("spec").distinct()  # at most a row a spec
        own = own.unionAll(objects.join(F.broadcast(owned), "spec", "left_anti"))  # JON-2
    return own.select(*VALUE_COLUMNS, *(["_n"] if placed else []))


def ordered(answer: DataFrame) -> DataFrame:
    """TOP-4."""
    return answer.orderBy("bucket", "spec")


def by_source(specs: Sequence[ValueSpec], sources: Sequence[tuple[str, str | None]]) -> list[ValueSpec]:
    """JON-5: specs that name no source become one series per source of their path, the missing source last."""
    out = []
    for spec in specs:
        if spec.source != ANY:
            out.append(spec)
            continue
        found = sorted({s for p, s in sources if p == spec.path}, key=lambda s: (s is None, s or ""))
        out += [ValueSpec(spec.path, spec.aggregate, s) for s in found]
    return out


def numbers_win(answer: DataFrame) -> DataFrame:
    """VAL-7: a series with a number anywhere loses its text. One row a spec decides, so no series has to fit a task."""
    numeric = answer.where(F.col("num").isNotNull()).select("spec").distinct().withColumn("_numeric", F.lit(True))
    textual = F.col("num").isNull() & F.col("str").isNotNull()
    return answer.join(F.broadcast(numeric), "spec", "left").where(~(F.coalesce("_numeric", F.lit(False)) & textual)).select(*answer.columns)  # at most MAX_SPECS rows


def one_per_stamp(answer: DataFrame) -> DataFrame:
    """(spec, bucket, v) with ``v`` the cell of a ``placed`` answer: where a series has several rows at one time the last in the total order
    counts, text before the rest. Series are told apart first, so no source hides another's rows."""
    cell = F.struct(*CELL_COLUMNS)
    textual = F.col("num").isNull() & F.col("str").isNotNull()
    return answer.groupBy("spec", "bucket").agg(F.max_by(cell, F.struct(textual, "_n")).alias("v"))
