"""Statistics over repeated measurements and counters (AGG-20, AGG-21, BEN-1 to BEN-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dispersion(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """BEN-4: n, mean, min, max and the sample deviation, null below three values."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.when(F.count(value) >= 3, F.stddev_samp(value)).alias("sd"))


def counter_rates(rows: DataFrame, subject: str, seconds: str, counter: str) -> DataFrame:
    """BEN-1: change per second since the reading before; an error if a counter falls or time stands still."""
    order = Window.partitionBy(subject).orderBy(seconds)
    step, span = F.col(counter) - F.lag(counter).over(order), F.col(seconds) - F.lag(seconds).over(order)
    fall = F.when(step < 0, F.raise_error(F.lit("a counter fell")).cast("double")).when(span <= 0, F.raise_error(F.lit("no time passed")).cast("double"))
    return rows.withColumn("rate", F.when(step.isNotNull(), F.coalesce(fall, step / span)))


def drift(first: Column, second: Column) -> Column:
    """BEN-2: |second - first| over their mean; 0 if both are 0, infinite if only the mean is."""
    mean = (first + second) / 2
    return F.when((first == 0) & (second == 0), F.lit(0.0)).when(mean == 0, F.lit(float("inf"))).otherwise(F.abs(second - first) / F.abs(mean))


def steady(first: Column, second: Column, floor: Column, tolerance: float = 0.1) -> Column:
    """BEN-3: both halves are below the noise floor, or the drift is within the tolerance."""
    return ((first < floor) & (second < floor)) | (drift(first, second) <= tolerance)


def halves(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Means of the earlier and the later half of each group's windows (a middle one counts as later)."""
    part = Window.partitionBy(*keys)
    place = F.row_number().over(part.orderBy(order))
    early = F.col("_k") <= F.floor(F.col("_c") / 2)
    ranked = rows.withColumn("_k", place).withColumn("_c", F.count(F.lit(1)).over(part))
    return ranked.groupBy(*keys).agg(F.avg(F.when(early, F.col(value))).alias("first"), F.avg(F.when(~early, F.col(value))).alias("second"))


def gauges(rows: DataFrame, keys: list[str], value: str, high_water: str) -> DataFrame:
    """BEN-6: mean of the samples, and the larger of the kernel's high-water mark and the largest sample."""
    return rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.greatest(F.max(high_water), F.max(value)).alias("peak"))


def rate_metrics(rows: DataFrame, scales: dict[str, tuple[float, str]]) -> DataFrame:
    """BEN-5: per (subject, metric) the dispersion of rates over windows, in the unit that ``scales`` names (factor, unit)."""
    known = rows.sparkSession.createDataFrame([(m, float(f), u) for m, (f, u) in scales.items()], "metric string, factor double, unit string")
    scaled = rows.join(F.broadcast(known), "metric").withColumn("value", F.col("rate") * F.col("factor"))  # one row a metric
    return dispersion(scaled, ["subject", "metric", "unit"], "value")


def disks(rows: DataFrame, line: str = "line") -> DataFrame:
    """BEN-7: sectors read and written of whole disks (no partitions, loop or ram devices) from lines of disk counters."""
    fields = F.split(F.trim(F.col(line)), r"\s+")
    parsed = rows.select(F.try_element_at(fields, F.lit(3)).alias("device"), F.try_element_at(fields, F.lit(6)).try_cast("long").alias("read"), F.try_element_at(fields, F.lit(10)).try_cast("long").alias("written"))
    whole = F.col("device").rlike(r"^(?:[shv]d[a-z]+|xvd[a-z]+|nvme[0-9]+n[0-9]+|mmcblk[0-9]+)$")
    return parsed.where(whole).groupBy("device").agg(F.sum("read").alias("read"), F.sum("written").alias("written"))


def comparison(rows: DataFrame, labels: list[str]) -> DataFrame:
    """BEN-8: (subject, metric, unit) by condition; a metric with two units is an error."""
    units = Window.partitionBy("subject", "metric")
    checked = rows.withColumn("unit", F.when(F.min("unit").over(units) == F.max("unit").over(units), F.col("unit")).otherwise(F.raise_error(F.concat(F.lit("two units of "), F.col("metric")))))
    return checked.groupBy("subject", "metric", "unit").pivot("label", labels).agg(F.first("value"))


def cold_warm(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """BEN-9: the first timing against the mean of the rest."""
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return ranked.groupBy(key).agg(F.max(F.when(F.col("_k") == 1, F.col(value))).alias("cold"), F.avg(F.when(F.col("_k") > 1, F.col(value))).alias("warm"))


def agrees(sent: Column, observed: Column, band: float = 0.15) -> Column:
    """BEN-10: do two rates agree within the band of the first?"""
    return F.abs(observed - sent) <= band * F.abs(sent)
