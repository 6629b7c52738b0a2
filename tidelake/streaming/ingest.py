"""From bus values to samples: gates, routing, one-level flattening, filter, caps, rates (STR-1 to STR-7).

Input rows: path, value (JSON), context, source, is_meta, recv_ts (ms), seq (order of arrival). Every step but the throttle is a
DataFrame expression that works on batches and streams alike; the throttle is a sequential scan per (path, context).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions import globs
from tidelake.functions.pointer import escape_column
from tidelake.model import COLUMNS, NAME_PATH, POSITION_PATH, SELF_CONTEXT, finite
from tidelake.plans.config import Config

BUS = "path string, value string, context string, source string, is_meta boolean, recv_ts long, seq long"


def gated(bus: DataFrame, config: Config, self_context: str) -> DataFrame:
    """FLT-13, FLT-14: no meta, no nulls, only what is recorded; the own entity becomes 'self'. Adds the parsed value."""
    own = F.col("context") == self_context
    rows = bus.where(~F.coalesce("is_meta", F.lit(False))).withColumn("v", F.try_parse_json("value"))
    rows = rows.where(F.col("v").isNotNull() & ~F.is_variant_null("v"))
    rows = rows.where(F.when(own, config.record_self).otherwise(config.record_others))
    return rows.withColumn("context", F.when(own, SELF_CONTEXT).otherwise(F.col("context")))


def _kind_of(text) -> "F.Column":
    """The kind of a JSON value by its first character; null for arrays, null and numbers that aren't finite."""
    first = F.left(F.ltrim(text, F.lit(" \t\r\n")), F.lit(1))
    return F.when(first == '"', "string").when(first.isin("t", "f"), "boolean").when(first == "{", "object").when(first.rlike("[-0-9]"), F.when(finite(text.try_cast("double")), "number"))


def identities(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """FUN-12, STR-7: names from objects at the empty path, only where a context's name changed, also against ``state``."""
    name = F.to_json(F.try_variant_get("v", "$.name", "variant"))
    objects = rows.where((F.col("path") == "") & (_kind_of(F.col("value")) == "object") & F.startswith(name, F.lit('"')))
    named = objects.withColumn("name", F.try_variant_get("v", "$.name", "string")).where(F.trim("name") != "")
    order = Window.partitionBy("context").orderBy("seq")
    named = named.withColumn("_before", F.lag("name").over(order))
    if state is not None:
        known = state.where("kind = 'name'").select(F.col("a").alias("context"), F.col("b").alias("_known"))
        named = named.join(known, "context", "left").withColumn("_before", F.coalesce("_before", "_known")).drop("_known")
    return named.where(F.coalesce(F.col("_before") != F.col("name"), F.lit(True))).drop("_before")


def routed(rows: DataFrame) -> DataFrame:
    """FUN-11: adds ``route``: number, string, boolean, position or flatten; the rest goes."""
    kind = _kind_of(F.col("value"))
    numeric = [_kind_of(F.to_json(F.try_variant_get("v", f"$.{axis}", "variant"))) == "number" for axis in ("latitude", "longitude")]
    place = F.col("path") == POSITION_PATH
    route = F.when(kind != "object", kind).when((kind == "object") & ~place, "flatten").when(place & numeric[0] & numeric[1], "position")
    return rows.where(F.coalesce(F.col("path") != "", F.lit(False))).withColumn("route", route).where(F.col("route").isNotNull())


def leaves(rows: DataFrame) -> DataFrame:
    """STR-2: the scalar leaves of objects, one level deep, as array<struct<path, kind, num, str>> in ``leaves``; empty keys, nested
    values and numbers that aren't finite are no leaves, and an object without any goes."""
    entries = F.map_entries(F.from_json("value", "map<string,variant>"))
    made = F.transform(
        entries,
        lambda e: F.struct(
            F.concat(F.col("path"), F.lit("#/"), escape_column(e["key"])).alias("path"),
            F.when(e["key"] != "", F.nullif(_kind_of(F.to_json(e["value"])), F.lit("object"))).alias("kind"),
            F.try_variant_get(e["value"], "$", "double").alias("num"),
            F.try_variant_get(e["value"], "$", "string").alias("str"),
        ),
    )
    return rows.withColumn("leaves", F.filter(made, lambda x: x["kind"].isNotNull())).where(F.size("leaves") > 0)


def _slots(seen: DataFrame, column: str, most: int, state: DataFrame | None) -> DataFrame:
    """(column) of the names that have a slot: those of ``state``, then the first of ``seen`` (column, seq) up to ``most`` in all."""
    first = seen.groupBy(column).agg(F.min("seq").alias("seq")).withColumn("_old", F.lit(False))
    if state is not None:
        known = state.where(F.col("kind") == column).select(F.col("a").alias(column), F.lit(None).cast("long").alias("seq"), F.lit(True).alias("_old"))
        first = known.unionByName(first.join(F.broadcast(known.select(column)), column, "left_anti"))  # at most ``most`` names
    return first.orderBy(F.desc("_old"), "seq", column).limit(most).select(column)


def context_slots(rows: DataFrame, config: Config, named: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """STR-6: the contexts that have a slot; names take slots too."""
    seen = rows.where(globs.admits(F.col("path"), config.filter_mode, config.filter_paths)).select("context", "seq")
    return _slots(seen if named is None else seen.unionAll(named.select("context", "seq")), "context", config.max_contexts, state)


def admitted(rows: DataFrame, config: Config, named: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """FLT-12, STR-6: the filter, then the first ``max_contexts`` contexts (names take slots too), then the first ``max_paths`` paths.

    ``state`` holds the names that earlier batches admitted. The names are broadcast; there are at most as many as the caps say."""
    contexts = context_slots(rows, config, named, state)
    rows = rows.where(globs.admits(F.col("path"), config.filter_mode, config.filter_paths)).join(F.broadcast(contexts), "context", "left_semi")
    return rows.join(F.broadcast(_slots(rows.select("path", "seq"), "path", config.max_paths, state)), "path", "left_semi")


def throttled(rows: DataFrame, rate: "F.Column", state: DataFrame | None = None) -> DataFrame:
    """STR-4: drops a row that comes less than ``rate`` ms after the last kept one of its (path, context), in order of arrival; a clock
    that went back admits. ``state`` knows the last kept times of earlier batches. A stream through sorted partitions: memory doesn't grow with a path's rows."""
    timed = rows.withColumn("_rate", rate)
    if state is None:
        timed = timed.withColumn("_last", F.lit(None).cast("long"))
    else:
        timed = timed.join(state.where("kind = 'last'").select(F.col("a").alias("path"), F.col("b").alias("context"), F.col("ts").alias("_last")), ["path", "context"], "left")
    columns = timed.columns
    at = [columns.index(c) for c in ("path", "context", "recv_ts", "_rate", "_last")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for batch in batches:
            keep = []
            for p, c, now, least, before in zip(*(batch.column(k).to_pylist() for k in at), strict=True):
                if (p, c) != key:
                    key, last = (p, c), before
                ok = last is None or not 0 <= now - last < least
                if ok:
                    last = now
                keep.append(ok)
            yield batch.filter(pa.array(keep, pa.bool_()))

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = timed.repartition(parts, "path", "context").sortWithinPartitions("path", "context", "seq")
    return dealt.mapInArrow(run, T.StructType(timed.schema.fields)).drop("_rate", "_last")


def to_samples(rows: DataFrame) -> DataFrame:
    """Routed rows (with ``leaves`` for objects) to sample rows; ``rowid`` is the order of arrival."""
    text = F.try_variant_get("v", "$", "string")
    none = F.lit(None)
    one = F.struct(
        F.col("path"), F.col("route").alias("kind"), F.when(F.col("route") == "number", F.try_variant_get("v", "$", "double")).alias("num"), F.when(F.col("route").isin("string", "boolean"), text).alias("str"),
        F.when(F.col("route") == "position", F.try_variant_get("v", "$.latitude", "double")).alias("lat"), F.when(F.col("route") == "position", F.try_variant_get("v", "$.longitude", "double")).alias("lon"),
    )
    many = F.transform("leaves", lambda x: F.struct(x["path"].alias("path"), x["kind"].alias("kind"), F.when(x["kind"] == "number", x["num"]).alias("num"), F.when(x["kind"] != "number", x["str"]).alias("str"), none.cast("double").alias("lat"), none.cast("double").alias("lon")))
    exploded = rows.select("recv_ts", "context", "source", "seq", F.explode(F.when(F.col("route") == "flatten", many).otherwise(F.array(one))).alias("x"))
    return exploded.select(
        F.col("recv_ts").alias("ts"), "context", F.col("x.path").alias("path"), "source", F.col("x.kind").alias("value_kind"), F.col("x.num").alias("value_num"), F.col("x.str").alias("value_str"), F.col("x.lat").alias("value_lat"), F.col("x.lon").alias("value_lon"), F.col("seq").alias("rowid")
    )


def with_leaves(rows: DataFrame) -> DataFrame:
    """Routed rows with ``leaves`` (null unless the row is an object)."""
    flat = leaves(rows.where(F.col("route") == "flatten"))
    return flat.unionByName(rows.where(F.col("route") != "flatten"), allowMissingColumns=True)


STATE = "kind string, a string, b string, ts long"


def record(bus: DataFrame, config: Config, self_context: str) -> DataFrame:
    """STR-1: the whole chain over a batch, in the order that decides what takes a slot: gates, names, routing, flattening, filter,
    context cap, path cap, throttle."""
    return record_on(bus, config, self_context, None)[0]


def record_on(bus: DataFrame, config: Config, self_context: str, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``record`` over a batch that follows others, and the state to go on with.

    ``state`` (``STATE``) has a row for each admitted context and path, the last name of each context (a, b), and the last kept
    time of each path and context (a, b, ts); the caps bound it."""
    rows = gated(bus, config, self_context)
    names = identities(rows, state)
    routes = with_leaves(routed(rows))
    passed = admitted(routes, config, names, state)
    kept = throttled(passed.withColumn("v", F.to_json("v")).withColumn("leaves", F.to_json("leaves")), globs.rate(F.col("path"), config.rates_ms, config.default_rate_ms), state)
    shown = kept.withColumn("v", F.parse_json("v")).withColumn("leaves", F.from_json("leaves", "array<struct<path:string,kind:string,num:double,str:string>>"))
    contexts = context_slots(routes, config, names, state)
    named = names.join(F.broadcast(contexts), "context", "left_semi")
    people = named.select(
        F.col("recv_ts").alias("ts"), "context", F.lit(NAME_PATH).alias("path"), "source", F.lit("identity").alias("value_kind"), F.lit(None).cast("double").alias("value_num"), F.col("name").alias("value_str"),
        F.lit(None).cast("double").alias("value_lat"), F.lit(None).cast("double").alias("value_lon"), F.col("seq").alias("rowid"),
    )
    none, no_time = F.lit(None).cast("string"), F.lit(None).cast("long")
    paths = passed.select("path").distinct()
    last = kept.groupBy(F.col("path").alias("a"), F.col("context").alias("b")).agg(F.max_by("recv_ts", "seq").alias("ts"))
    called = named.groupBy(F.col("context").alias("a")).agg(F.max_by("name", "seq").alias("b"))
    if state is not None:
        paths = paths.unionAll(state.where("kind = 'path'").select("a")).distinct()
        last = last.unionByName(state.where("kind = 'last'").select("a", "b", "ts").join(last, ["a", "b"], "left_anti"))
        called = called.unionByName(state.where("kind = 'name'").select("a", "b").join(called, "a", "left_anti"))
    after = contexts.select(F.lit("context").alias("kind"), F.col("context").alias("a"), none.alias("b"), no_time.alias("ts"))
    after = after.unionAll(paths.select(F.lit("path"), "path", none, no_time)).unionAll(last.select(F.lit("last"), "a", "b", "ts")).unionAll(called.select(F.lit("name"), "a", "b", no_time))
    return to_samples(shown).unionByName(people).select(*COLUMNS, "rowid"), after
