"""The driver's tables as sample rows: ``events`` becomes telemetry of every kind, deterministically."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.instants import day_of
from tidelake.model import COLUMNS, HOT, SAMPLE
from tidelake.operators.snapshot import newest

STORED = T.StructType([*HOT.fields, T.StructField("date", T.StringType())])

_ROW = "named_struct('path', {0}, 'value_kind', '{1}', 'value_num', {2}, 'value_str', {3}, 'value_lat', {4}, 'value_lon', {5}, 'k', {6})"
_NUM, _STR = "cast(null as double)", "cast(null as string)"

#: path, kind, number, text, latitude, longitude of the rows that each event gives
_ROWS = [
    ("concat('events.', event_type)", "number", "value", _STR, _NUM, _NUM),
    ("'state.type'", "string", _NUM, "event_type", _NUM, _NUM),
    ("'state.large'", "boolean", _NUM, "case when value > 100 then 'true' else 'false' end", _NUM, _NUM),
    ("'navigation.position'", "position", _NUM, _STR, "60.0D + value / 1000.0D", "cast(24 + event_id % 1000 as double)"),
    ("concat('attrs.', event_type, '#/k')", "number", "cast(n as double)", _STR, _NUM, _NUM),
    ("concat('attrs.', event_type, '#/a~1b')", "number", "value", _STR, _NUM, _NUM),
    ("concat('attrs.', event_type, '#/tag')", "string", _NUM, "event_type", _NUM, _NUM),
]


_stored: dict[str, str] = {}


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The sample rows as a merged tree (a folder a day, sorted by path and time, so that Parquet prunes by both) and the table of
    newest values; later calls of ``samples`` and ``newest_values`` in this process read them."""
    made = samples(spark, sf_dir).withColumn("date", day_of(F.col("ts")))
    made.repartition("date").sortWithinPartitions("path", "ts").write.mode("overwrite").partitionBy("date").parquet(f"{folder}/tree")
    newest(spark.read.schema(STORED).parquet(f"{folder}/tree")).select(*COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/latest")
    _stored[sf_dir.rstrip("/")] = folder


def newest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state now: the stored table of newest values, else the newest of all rows."""
    folder = _stored.get(sf_dir.rstrip("/"))
    return newest(samples(spark, sf_dir)).select(*COLUMNS) if folder is None else spark.read.schema(SAMPLE).parquet(f"{folder}/latest")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven rows an event, a mixed number-or-text row, an object that a scalar shadows, and one name row a user; (ts, source,
    rowid) orders them totally."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    if sf_dir.rstrip("/") in _stored:
        return spark.read.schema(STORED).parquet(f"{_stored[sf_dir.rstrip('/')]}/tree")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    base = events.selectExpr(
        "event_id", "user_id", "event_type", "value", "cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as n",
        "cast(floor(unix_micros(cast(ts as timestamp)) / 1000) as bigint) as ts",
        "case when user_id % 10 = 0 then 'self' else concat('user.', user_id % 10) end as context",
        "case event_id % 3 when 0 then cast(null as string) when 1 then 's1' else 's2' end as source",
    )
    made = [_ROW.format(*r, i) for i, r in enumerate(_ROWS)]
    mixed = _ROW.format("'mixed.path'", "number", "value", _STR, _NUM, _NUM, 7), _ROW.format("'mixed.path'", "string", _NUM, "event_type", _NUM, _NUM, 7)
    made.append(f"case when event_id % 2 = 0 then {mixed[0]} else {mixed[1]} end")
    shadow = _ROW.format("'shadow.path'", "number", "value", _STR, _NUM, _NUM, 8), _ROW.format("'shadow.path#/c'", "number", "value", _STR, _NUM, _NUM, 8)
    made.append(f"case when event_id % 5 = 0 then {shadow[0]} else {shadow[1]} end")
    rows = base.selectExpr("event_id", "ts", "context", "source", f"inline(array({', '.join(made)}))")
    rows = rows.select(*COLUMNS, (F.col("event_id") * 10 + F.col("k")).cast("long").alias("rowid"))
    firsts = base.groupBy("user_id").agg(F.min_by(F.struct("event_id", "ts", "context", "source"), "event_id").alias("e"))
    names = firsts.selectExpr("e.ts", "e.context", "'name' as path", "e.source", "'identity' as value_kind", f"{_NUM} as value_num", "concat('crew-', user_id) as value_str", f"{_NUM} as value_lat", f"{_NUM} as value_lon", "e.event_id * 10 + 9 as rowid")
    return rows.unionByName(names)


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` by day, with many rows at one time: status is the path, the total the value."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/orders.parquet")
    return rows.selectExpr(
        "cast(floor(unix_micros(cast(o_orderdate as timestamp)) / 1000) as bigint) as ts", "'self' as context", "concat('orders.', o_orderstatus) as path", "o_orderpriority as source", "'number' as value_kind", "o_totalprice as value_num",
        f"{_STR} as value_str", f"{_NUM} as value_lat", f"{_NUM} as value_lon", "o_orderkey as rowid",
    )


def bus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as unrouted bus values: JSON values of every shape, for the ingest chain."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    return events.selectExpr(
        "case event_id % 7 when 0 then '' when 5 then 'navigation.position' else concat('bus.', event_type) end as path",
        """case event_id % 7
             when 0 then concat('{"name":"crew-', user_id % 20, '"}')
             when 1 then cast(cast(floor(value) as bigint) as string)
             when 2 then concat('"', event_type, '"')
             when 3 then case when value > 100 then 'true' else 'false' end
             when 4 then concat('{"a/b":', cast(floor(value) as bigint), ',"tag":"', event_type, '","on":true,"deep":{"x":1},"list":[1],"none":null,"":5}')
             when 5 then concat('{"latitude":', cast(floor(value) as bigint), ',"longitude":', event_id % 100, '}')
             else '[1,2]' end as value""",
        "concat('v', user_id % 10) as context", "case event_id % 3 when 0 then cast(null as string) when 1 then 's1' else 's2' end as source", "event_id % 11 = 0 as is_meta",
        "cast(floor(unix_micros(cast(ts as timestamp)) / 1000) as bigint) as recv_ts", "event_id as seq",
    )
