"""The sample model: one fixed schema, closed sets of kinds and aggregates, and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model and its limits.
KINDS = ("number", "string", "boolean", "position", "identity")
ENGINE_AGGREGATES = ("average", "min", "max", "first", "last", "mid", "raw")
API_AGGREGATES = ("average", "min", "max", "first", "last", "mid", "middle_index", "sma", "ema")
SELF_CONTEXT = "self"
POSITION_PATH = "navigation.position"
NAME_PATH = "name"
DAY_MS = 86_400_000
HOUR_MS = 3_600_000
ROW_LIMIT = 100_000
RAW_SERIES_LIMIT = 50_000
BUCKET_BUDGET = 1_000_000
MAX_SPECS = 200
SNAPSHOT_SCAN_DAYS = 2
REPLAY_CHUNK_MS = 60_000
REPLAY_PAGE_ROWS = 10_000
SMA_DEFAULT = 5
EMA_DEFAULT = 0.2

SAMPLE = T.StructType(
    [
        T.StructField("ts", T.LongType(), False),
        T.StructField("context", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("source", T.StringType(), True),
        T.StructField("value_kind", T.StringType(), False),
        T.StructField("value_num", T.DoubleType(), True),
        T.StructField("value_str", T.StringType(), True),
        T.StructField("value_lat", T.DoubleType(), True),
        T.StructField("value_lon", T.DoubleType(), True),
    ]
)
HOT = T.StructType([*SAMPLE.fields, T.StructField("rowid", T.LongType(), False)])
COLUMNS = [f.name for f in SAMPLE.fields]
VALUE_COLUMNS = ["spec", "bucket", "num", "str", "kind", "lat", "lon", "obj"]
CELL_COLUMNS = VALUE_COLUMNS[2:]
FIELD = "struct<key:string,num:double,str:string,kind:string>"
OBJECT = f"array<{FIELD}>"


def session(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with the settings that answers depend on (UTC) and adaptive plans."""
    builder = builder or SparkSession.builder
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()


def finite(column) -> "F.Column":
    """FLT-15: neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) < float("inf"))


def split_valid(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that obey the model, and the rejects: unknown kinds, missing keys, numbers that aren't finite."""
    ok = F.col("value_kind").isin(*KINDS) & F.col("ts").isNotNull() & F.col("context").isNotNull() & F.col("path").isNotNull()
    ok = ok & F.when(F.col("value_kind") == "number", finite(F.col("value_num"))).when(F.col("value_kind") == "position", finite(F.col("value_lat")) & finite(F.col("value_lon"))).otherwise(F.col("value_str").isNotNull())
    ok = F.coalesce(ok, F.lit(False))
    return samples.where(ok), samples.where(~ok)


def order_key():
    """The total order of rows with one key: time, then source (none first), then arrival."""
    return F.struct("ts", "source", "rowid")


def with_rowid(samples: DataFrame) -> DataFrame:
    return samples if "rowid" in samples.columns else samples.withColumn("rowid", F.lit(0).cast("long"))
