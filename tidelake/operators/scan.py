"""Filters and raw ranges over sample rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions import pointer
from tidelake.functions.instants import day_of
from tidelake.model import COLUMNS, with_rowid
from tidelake.plans.requests import ANY


def in_range(start: int, end: int, partitioned: bool = False) -> Column:
    """FLT-1, OPT-1: [start, end); over a partitioned tree the dates too, since a time filter implies none."""
    ok = (F.col("ts") >= start) & (F.col("ts") < end)
    return ok & F.col("date").between(day_of(F.lit(start)), day_of(F.lit(end - 1))) if partitioned else ok


def paths_with_fields(paths: Iterable[str]) -> Column:
    """FLT-3, FLT-4: exact names, and for object paths the key range of their fields, so that Parquet statistics prune.

    A path that holds '#' is a field itself and has none."""
    names = list(dict.fromkeys(paths))
    ok = F.col("path").isin(names)
    for name in names:
        if "#" not in name:
            ok = ok | ((F.col("path") >= f"{name}#/") & (F.col("path") < f"{name}#0"))
    return ok


def source_is(source: str | None) -> Column:
    """FLT-6: any source, one source, or rows without one."""
    return F.lit(True) if source == ANY else F.col("source").eqNullSafe(F.lit(source))


def select(samples: DataFrame, start: int, end: int, context: str | None = None, paths: Iterable[str] | None = None, fields: bool = False, source: str | None = ANY) -> DataFrame:
    """FLT-1 to FLT-6 in one predicate; ``fields`` adds the fields of object paths."""
    ok = in_range(start, end, "date" in samples.columns)
    if context is not None:
        ok = ok & (F.col("context") == context)
    if paths is not None:
        names = list(dict.fromkeys(paths))
        ok = ok & (paths_with_fields(names) if fields else F.col("path").isin(names))
    return samples.where(ok & source_is(source))


def raw_range(samples: DataFrame, start: int, end: int, limit: int, context: str | None = None, paths: Iterable[str] | None = None) -> DataFrame:
    """TOP-1: rows in time order, one more than ``limit`` so that a reader sees whether the answer is cut; exact paths only."""
    rows = with_rowid(select(samples, start, end, context, paths))
    return rows.orderBy("ts", F.col("source").asc_nulls_first(), "rowid").limit(limit + 1).select(*COLUMNS, "rowid")


def truncated(rows: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first ``limit`` rows and whether there were more."""
    return rows.limit(limit), rows.count() > limit


def list_names(samples: DataFrame, column: str) -> DataFrame:
    """AGG-13: distinct paths (objects by their own name) or contexts, in order."""
    name = pointer.object_path(F.col("path")) if column == "path" else F.col(column)
    return samples.select(name.alias("name")).distinct().orderBy("name")


def list_sources(samples: DataFrame) -> DataFrame:
    """AGG-14: distinct (path, source), the missing source last."""
    return samples.select(pointer.object_path(F.col("path")).alias("name"), "source").distinct().orderBy("name", F.col("source").asc_nulls_last())


def exists(samples: DataFrame) -> DataFrame:
    """AGG-15: 1 if there is a row, else 0; reads no more than one."""
    return samples.limit(1).agg(F.count(F.lit(1)).alias("count"))
