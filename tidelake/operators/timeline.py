"""Shared timelines: gap fill and alignment of series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(series: DataFrame, width: int, per_spec: bool = False) -> DataFrame:
    """WIN-7, WIN-8: all buckets between the first and the last that have data; none beyond. The budget bounds their number."""
    keys = ["spec"] if per_spec else []
    ends = series.groupBy(*keys).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    return ends.select(*keys, F.explode(F.sequence("a", "b", F.lit(width).cast("long"))).alias("bucket"))


def fill(series: DataFrame, width: int) -> DataFrame:
    """JON-4 per series: (spec, bucket, v) with null rows for interior gaps."""
    return grid(series, width, per_spec=True).join(series.select("spec", "bucket", "v"), ["spec", "bucket"], "left")


def matrix(series: DataFrame, specs: int, width: int | None = None, on_grid: list[int] | None = None) -> DataFrame:
    """JON-3: (bucket, v0, v1, ...), one row per time of any series, and per bucket between the first and last of the series
    on the grid (all if ``on_grid`` is None and there is a width)."""
    columns = list(range(specs))
    wide = series.groupBy("bucket").pivot("spec", columns).agg(F.first("v", ignorenulls=True))
    if width is not None and on_grid != []:
        bucketed = series if on_grid is None else series.where(F.col("spec").isin(on_grid))
        wide = grid(bucketed, width).join(wide, "bucket", "full_outer")
    return wide.select("bucket", *[F.col(str(k)).alias(f"v{k}") for k in columns])
