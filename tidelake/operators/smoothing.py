"""Moving averages and the middle value of series (spec, bucket, v).

``order`` names the columns that order a series: rows that share a bucket need more than its time, or any order of them may come out."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sma(series: DataFrame, window: int, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """WIN-3: the mean of the last ``window`` values that aren't null; null stays null, and the start uses what it has.

    Nulls form a partition of their own, so frames count values only, in one window and without a join back."""
    there = F.col("v").isNotNull()
    frame = Window.partitionBy("spec", there).orderBy(*order).rowsBetween(-(window - 1), 0)
    return series.withColumn("v", F.when(there, F.avg("v").over(frame)))


def sma_running(series: DataFrame, window: int, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """PHY-8: the same in linear time for wide windows. The values are cut into blocks of ``window``; a frame is the end of one block and
    the start of the next, both running sums of their block, so no value outside a frame leaves a rounding error in it."""
    there = F.col("v").isNotNull()
    block = F.floor(F.col("_i") / window)
    inside = Window.partitionBy("spec", there, block)
    placed = series.withColumn("_i", F.row_number().over(Window.partitionBy("spec", there).orderBy(*order)) - 1)
    summed = placed.withColumn("_head", F.sum("v").over(inside.orderBy("_i"))).withColumn("_tail", F.sum("v").over(inside.orderBy(F.desc("_i"))))
    before = F.lag("_tail", window - 1, 0.0).over(Window.partitionBy("spec", there).orderBy("_i"))
    total = F.col("_head") + F.when(F.col("_i") % window == window - 1, 0.0).otherwise(before)
    return summed.withColumn("v", F.when(there, total / F.least(F.col("_i") + 1, F.lit(window)))).drop("_i", "_head", "_tail")


def ema(series: DataFrame, alpha: float, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """WIN-4: alpha * v + (1 - alpha) * previous, seeded by the first value; null repeats the previous one.

    A recursion over one series, which must fit a task: the bucket budget bounds it, but a raw series read without limit does not."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(list(order))
        part["v"] = part["v"].astype("float64").ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        return part[["spec", "bucket", "v"]]

    return series.select("spec", "v", *order).groupBy("spec").applyInPandas(one, "spec int, bucket long, v double")


def middle_index(series: DataFrame, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """WIN-5: only the value at position floor(n / 2) stays; the other stamps stay as nulls."""
    part = Window.partitionBy("spec")
    place = F.row_number().over(part.orderBy(*order)) - 1
    middles = series.groupBy("spec").agg(F.floor(F.count(F.lit(1)) / 2).alias("_m"))  # at most MAX_SPECS rows
    return series.withColumn("_k", place).join(F.broadcast(middles), "spec").withColumn("v", F.when(F.col("_k") == F.col("_m"), F.col("v"))).select(*series.columns)
