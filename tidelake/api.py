"""The history API: validated requests over one or several tiers, answered as plain Python.

``rows_between(start, end)`` gives the sample rows of a range (one table, or the union of tiers); everything else is a plan on it.
Answers are bounded by the limits of the model, so collecting them is safe.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.instants import iso_text
from tidelake.model import CELL_COLUMNS, COLUMNS, RAW_SERIES_LIMIT, ROW_LIMIT, SELF_CONTEXT
from tidelake.operators import scan, smoothing, snapshot, timeline
from tidelake.operators.values import by_source, numbers_win, one_per_stamp, ordered, values
from tidelake.plans import requests
from tidelake.plans.requests import ANY, Refused, Request, ValueSpec
from tidelake.plans.timerange import ema_alpha, resolution_seconds, sma_window
from tidelake.sources import tree
from tidelake.sources.files import Store
from tidelake.streaming import replay


@dataclass(frozen=True)
class PathSpec:
    """A column of a request: path, API aggregate, its parameter (window or alpha), and a source or ANY."""

    path: str
    aggregate: str = "average"
    parameter: str | None = None
    source: str | None = ANY


def over_store(spark: SparkSession, store: Store) -> Callable[[int, int], DataFrame]:
    return lambda start, end: tree.rows_between(spark, store, start, end)


def over_table(samples: DataFrame) -> Callable[[int, int], DataFrame]:
    return lambda start, end: samples.where(scan.in_range(start, end, "date" in samples.columns))


class Engine:
    """The seven request kinds (section by section: range, values, paths, contexts, sources, exists, snapshot)."""

    def __init__(self, rows_between: Callable[[int, int], DataFrame], snapshot_at: Callable[..., DataFrame] | None = None):
        self.rows_between, self.snapshot_at = rows_between, snapshot_at

    def frame(self, request: Request) -> DataFrame:
        """The answer's plan; ranges and snapshots have one row more than the limit if they are cut."""
        r = requests.validate(request)
        limit = requests.clamp_limit(r.limit)
        if r.kind == "snapshot":
            rows = self.snapshot_at(int(r.at), r.context, r.paths) if self.snapshot_at else snapshot.snapshot(self.rows_between(-(2**62), int(r.at) + 1), int(r.at), r.context, r.paths)
            return rows.select(*COLUMNS).orderBy("context", "path").limit(limit + 1)
        start, end = int(r.start), int(r.end)
        rows = self.rows_between(start, end)
        if r.kind == "range":
            return scan.raw_range(rows, start, end, limit, r.context, r.paths).select(*COLUMNS)
        if r.kind == "values":
            return ordered(self.series(r)).drop("_n")
        inside = scan.select(rows, start, end, r.context, r.paths, fields=r.kind == "sources")
        if r.kind == "exists":
            return scan.exists(inside)
        if r.kind == "sources":
            return scan.list_sources(inside)
        return scan.list_names(inside, "path" if r.kind == "paths" else "context")

    def series(self, request: Request) -> DataFrame:
        """The rows of a values request in any order, with their places in raw series (``_n``)."""
        r = requests.validate(request)
        start, end = int(r.start), int(r.end)
        inside = scan.select(self.rows_between(start, end), start, end, r.context, [s.path for s in r.specs], fields=True)
        return values(inside, r.specs, r.bucket_ms, min(requests.clamp_limit(r.limit), RAW_SERIES_LIMIT), placed=True)

    def read(self, request: Request) -> tuple[list[Row], bool]:
        """Rows, and whether there were more than the limit."""
        limit = requests.clamp_limit(request.limit)
        found = self.frame(request).limit(limit + 1).collect()
        return found[:limit], len(found) > limit


class History:
    """The bucketed, multi-series API and the replay API on top of an engine."""

    def __init__(self, engine: Engine, self_context: str = "vessels.self"):
        self.engine, self.self_context = engine, self_context

    def _stored(self, context: str | None) -> str:
        return SELF_CONTEXT if context in (None, SELF_CONTEXT, self.self_context, "vessels.self") else context

    def get_values(self, specs: Sequence[PathSpec], start: int, end: int, context: str | None = None, resolution: float | None = None, source_policy: str | None = None) -> dict:
        """{context, range, values, data}: one row [time, v0, v1, ...] per time of the shared timeline."""
        columns, width = self._columns(specs, start, end, context, resolution, source_policy)
        shown = [{"path": c.path, "method": c.aggregate} | ({"$source": c.source} if c.source not in (ANY, None) else {}) for c in columns]
        answer = {"context": context or self.self_context, "range": {"from": iso_text(start), "to": iso_text(end)}, "values": shown, "data": []}
        if not columns:
            return answer
        found = self._found(columns, start, end, context, width).persist()  # read twice; too many rows are refused after the first
        try:
            self._check(found, columns, width)
            rows = self._matrix(found, columns, width).orderBy("bucket").collect()
        finally:
            found.unpersist()
        return answer | {"data": [[iso_text(r[0]), *(None if cell is None else decode(cell) for cell in r[1:])] for r in rows]}

    def values_frame(self, specs: Sequence[PathSpec], start: int, end: int, context: str | None = None, resolution: float | None = None, source_policy: str | None = None, along: int | None = None) -> DataFrame:
        """The numbers of the same answer as a DataFrame (bucket, v0, v1, ...), for answers too large to collect: neither the number of rows
        nor the aggregates of text and objects are checked. The series' rows, which the limits of the model bound, are cached.
        ``along`` names a column whose recorded times alone are the answer's; each series ends at its own limit, so others may go on after it."""
        columns, width = self._columns(specs, start, end, context, resolution, source_policy)
        found = self._found(columns, start, end, context, width).persist()
        wide = self._matrix(found, columns, width)
        if along is not None:
            wide = wide.join(numbers_win(found).where(F.col("spec") == along).select("bucket").distinct(), "bucket", "left_semi")
        return wide.select("bucket", *[F.col(f"v{k}.num").alias(f"v{k}") for k in range(len(columns))]).orderBy("bucket")

    def _columns(self, specs: Sequence[PathSpec], start: int, end: int, context: str | None, resolution: float | None, source_policy: str | None) -> tuple[list[PathSpec], int | None]:
        """The columns of an answer, one a source if the policy says so, and the bucket's width."""
        for spec in specs:
            requests.check_aggregate(spec.aggregate)
        seconds = resolution_seconds(resolution)
        width = None if seconds is None else seconds * 1000
        requests.refuse_positions([ValueSpec(s.path, s.aggregate, s.source) for s in specs], width is not None)
        columns = list(specs)
        for split in (False, True) if source_policy == "all" else (False,):
            columns = self._by_source(columns, start, end, self._stored(context)) if split else columns
            requests.guard_buckets(sum(s.aggregate != "middle_index" for s in columns) if width else 0, seconds, end - start)
        return columns, width

    def _found(self, columns: Sequence[PathSpec], start: int, end: int, context: str | None, width: int | None) -> DataFrame:
        wanted = tuple(ValueSpec(c.path, requests.engine_aggregate(c.aggregate), c.source) for c in columns)
        return self.engine.series(Request("values", start, end, context=self._stored(context), specs=wanted, bucket_ms=width, limit=ROW_LIMIT))

    @staticmethod
    def _check(found: DataFrame, columns: Sequence[PathSpec], width: int | None) -> None:
        """VAL-4, VAL-6: what only the rows can tell."""
        facts = found.groupBy("spec").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(c) for c in ("num", "str", "obj")]).collect()  # a row a column
        if sum(r["n"] for r in facts) > ROW_LIMIT:
            raise Refused("the answer is too long: ask for a shorter range or a coarser resolution")
        for r in sorted(facts, key=lambda r: (not r["obj"], r["spec"])):
            column = columns[r["spec"]]
            if not requests.applies_to_value(column.aggregate, width is not None):
                if r["obj"]:
                    raise requests.refusal(column.aggregate, "object", column.path)
                if r["str"] and not r["num"]:
                    raise requests.refusal(column.aggregate, "text", column.path)

    @staticmethod
    def _matrix(found: DataFrame, columns: Sequence[PathSpec], width: int | None) -> DataFrame:
        """(bucket, v0, v1, ...) with cells of ``CELL_COLUMNS``: numbers win, one value a time, then the aggregates over whole series."""
        series = one_per_stamp(numbers_win(found)) if width is None or any(c.aggregate == "middle_index" for c in columns) else numbers_win(found).select("spec", "bucket", F.struct(*CELL_COLUMNS).alias("v"))
        groups: dict[tuple, list[int]] = {}
        for k, c in enumerate(columns):
            how = ("sma", sma_window(c.parameter)) if c.aggregate == "sma" else ("ema", ema_alpha(c.parameter)) if c.aggregate == "ema" else (c.aggregate,) if c.aggregate == "middle_index" else ()
            groups.setdefault(how, []).append(k)
        parts = []
        for how, own in groups.items():
            part = series.where(F.col("spec").isin(own))
            if how and how[0] == "middle_index":
                part = smoothing.middle_index(part)
            elif how:
                line = part.select("spec", "bucket", F.col("v.num").alias("v"))
                line = line if width is None else timeline.fill(line, width)
                smooth = smoothing.sma(line, how[1]) if how[0] == "sma" else smoothing.ema(line, how[1])
                empty = [F.lit(None).cast(series.schema["v"].dataType[c].dataType).alias(c) for c in CELL_COLUMNS[1:]]
                part = smooth.select("spec", "bucket", F.when(F.col("v").isNotNull(), F.struct(F.col("v").alias("num"), *empty)).alias("v"))
            parts.append(part.select("spec", "bucket", "v"))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionAll(part)
        return timeline.matrix(union, len(columns), width, [k for k, c in enumerate(columns) if c.aggregate != "middle_index"])

    def _by_source(self, columns: Sequence[PathSpec], start: int, end: int, context: str) -> list[PathSpec]:
        rows = self._names("sources", start, end, context, tuple(dict.fromkeys(c.path for c in columns)))
        pairs = [(r["name"], r["source"]) for r in rows]
        out = []
        for c in columns:
            for s in by_source([ValueSpec(c.path, c.aggregate, c.source)], pairs):
                out.append(PathSpec(c.path, c.aggregate, c.parameter, s.source))
        return out

    def _names(self, kind: str, start: int, end: int, context: str | None = None, paths: tuple[str, ...] | None = None) -> list[Row]:
        rows, cut = self.engine.read(Request(kind, start, end, context=context, paths=paths))
        if cut:
            raise Refused(f"more than {ROW_LIMIT} {kind}: ask for a shorter range")
        return rows

    def get_paths(self, start: int, end: int, context: str | None = None) -> list[str]:
        return [r["name"] for r in self._names("paths", start, end, context and self._stored(context))]

    def get_contexts(self, start: int, end: int) -> list[str]:
        """PRJ-10: the own entity by its public name."""
        return [self.self_context if r["name"] == SELF_CONTEXT else r["name"] for r in self._names("contexts", start, end)]

    def has_any_data(self, start: int, end: int) -> bool:
        return self.engine.read(Request("exists", start, end))[0][0]["count"] > 0

    def get_history(self, at: int, context: str | None = None, paths: Sequence[str] | None = None) -> list[dict]:
        """State at an instant as deltas: objects restamped with their newest field, then grouped."""
        rows = self.engine.frame(Request("snapshot", at=at, context=context and self._stored(context), paths=tuple(paths) if paths else None)).persist()
        if rows.count() > ROW_LIMIT:
            rows.unpersist()
            raise Refused(f"more than {ROW_LIMIT} values: name a context or paths")
        found = snapshot.deltas(snapshot.restamped(rows)).orderBy("ts", F.col("source").asc_nulls_first(), "context").collect()
        rows.unpersist()
        return [delta_dict(r) for r in found]

    def stream_history(self, start: int, now: Callable[[], int] | None = None, rate: float = 1.0, end: int | None = None, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
        """Playback as deltas; see ``streaming.replay``."""
        now = now or (lambda: int(time.time() * 1000))
        for row in replay.play(self.engine.rows_between, start, now, rate, end, sleep=sleep):
            yield delta_dict(row)


def decode(row: Row) -> object:
    """PRJ-8: object, position, number, text."""
    if row["obj"]:
        return {f["key"]: f["num"] if f["num"] is not None else (f["str"] == "true" if f["kind"] == "boolean" else f["str"]) for f in row["obj"]}
    if row["lat"] is not None and row["lon"] is not None:
        return {"latitude": row["lat"], "longitude": row["lon"]}
    if row["num"] is not None:
        return row["num"]
    return row["str"] == "true" if row["kind"] == "boolean" else row["str"]


def decode_kind(value: Row) -> object:
    """PRJ-9."""
    kind = value["value_kind"]
    if kind == "number":
        return value["value_num"]
    if kind == "position":
        return {"latitude": value["value_lat"], "longitude": value["value_lon"]}
    return value["value_str"] == "true" if kind == "boolean" else value["value_str"]


def delta_dict(row: Row) -> dict:
    """{context, updates: [{timestamp, $source, values: [{path, value}]}]}; a name comes first, at the empty path."""
    made = [] if "name" not in row.asDict() or row["name"] is None else [{"path": "", "value": {"name": row["name"]}}]
    for value in row["values"]:
        fields = {f["key"]: decode_kind(f["value"]) for f in value["fields"]}
        if value["path"] == "name" and set(fields) == {""} and value["fields"][0]["value"]["value_kind"] == "identity":
            made.append({"path": "", "value": {"name": fields[""]}})
        else:
            made.append({"path": value["path"], "value": fields[""] if set(fields) == {""} else {k: v for k, v in fields.items() if k}})
    update = {"timestamp": iso_text(row["ts"]), "values": made} | ({"$source": row["source"]} if row["source"] is not None else {})
    return {"context": row["context"], "updates": [update]}


def write_ndjson(rows: DataFrame, out, batch: int = 1000) -> int:
    """SNK-11: rows as JSON lines, a summary last; streams partition by partition."""
    n, lines = 0, []
    for (text,) in rows.select(F.to_json(F.struct("*"))).toLocalIterator():
        lines.append(text)
        n += 1
        if len(lines) == batch:
            out.write("\n".join(lines) + "\n")
            lines = []
    out.write("\n".join([*lines, json.dumps({"rows": n})]) + "\n")
    return n


def maintenance_slot(spark: SparkSession, store: Store, now: int, retention_days: int = 0) -> dict:
    """STR-12, STR-13: what runs at a slot: roll, merge of the newest closed hour, expiry, sweep."""
    from tidelake.sinks import compaction, retention, roll

    rolled = roll.roll_once(spark, store, now)
    merged: dict | str
    try:
        merged = compaction.compact_hour(spark, store, compaction.newest_closed_hour(now), now)
    except compaction.NotNow as reason:
        merged = str(reason)
    gone = retention.expire(store, now, retention_days) if retention_days else retention.Expired()
    return {"rolled": rolled, "merged": merged, "expired": gone.removed, "swept": retention.sweep(store, now)}


