"""Values of rows as typed columns or JSON at the edge of an API."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def by_shape(num: Column, text: Column, kind: Column, lat: Column, lon: Column, obj: Column) -> Column:
    """PRJ-8: object, then position, then number, then text (true or false for booleans), as a JSON string."""
    fields = F.map_from_entries(F.transform(obj, lambda f: F.struct(f["key"], _scalar(f["num"], f["str"], f["kind"]))))
    as_object = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))
    position = F.when(lat.isNotNull() & lon.isNotNull(), F.to_json(F.struct(lat.alias("latitude"), lon.alias("longitude"))))
    return F.coalesce(F.when(F.size(obj) > 0, as_object), position, _scalar(num, text, kind))


def by_kind(kind: Column, num: Column, text: Column, lat: Column, lon: Column) -> Column:
    """PRJ-9: decided by the kind alone, as a JSON string."""
    position = F.to_json(F.struct(lat.alias("latitude"), lon.alias("longitude")))
    return F.when(kind == "number", num.cast("string")).when(kind == "boolean", F.when(text == "true", "true").otherwise("false")).when(kind == "position", position).otherwise(_quoted(text))


def _quoted(text: Column) -> Column:
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def _scalar(num: Column, text: Column, kind: Column) -> Column:
    return F.coalesce(num.cast("string"), F.when(kind == "boolean", F.when(text == "true", "true").otherwise("false")), F.when(text.isNotNull(), _quoted(text)))
