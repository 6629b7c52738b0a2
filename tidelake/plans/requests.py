"""Requests as frozen dataclasses, with the checks every one passes before a plan is built (VAL-1 to VAL-5)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from tidelake.model import API_AGGREGATES, BUCKET_BUDGET, ENGINE_AGGREGATES, MAX_SPECS, POSITION_PATH, ROW_LIMIT

ANY = "*any*"  # a spec that takes every source; None takes rows without one


class Refused(ValueError):
    """The request can't be answered; the message says why."""


@dataclass(frozen=True)
class ValueSpec:
    path: str
    aggregate: str = "average"
    source: str | None = ANY


@dataclass(frozen=True)
class Request:
    """kind: range, values, paths, contexts, sources, exists or snapshot; ``at`` for the last, else [start, end)."""

    kind: str
    start: float | None = None
    end: float | None = None
    at: float | None = None
    context: str | None = None
    paths: tuple[str, ...] | None = None
    specs: tuple[ValueSpec, ...] = field(default=())
    bucket_ms: int | None = None
    limit: int | None = None


REQUEST_KINDS = ("range", "values", "paths", "contexts", "sources", "exists", "snapshot")


def _number(name: str, value: object) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise Refused(f"{name} must be a finite number")


def validate(request: Request) -> Request:
    """VAL-1 to VAL-3; returns the request."""
    if request.kind not in REQUEST_KINDS:
        raise Refused(f"unknown request kind {request.kind}")
    for name in ("at",) if request.kind == "snapshot" else ("start", "end"):
        _number(name, getattr(request, name))
    if request.context is not None and not isinstance(request.context, str):
        raise Refused("context must be a string")
    if request.kind == "values" and not request.context:
        raise Refused("context is needed")
    if request.paths is not None and not all(isinstance(p, str) for p in request.paths):
        raise Refused("paths must be strings")
    if request.limit is not None:
        _number("limit", request.limit)
    if request.bucket_ms is not None:
        _number("bucket_ms", request.bucket_ms)
        if request.bucket_ms <= 0:
            raise Refused("bucket_ms must be positive")
    if request.kind == "values":
        if not 1 <= len(request.specs) <= MAX_SPECS:
            raise Refused(f"1 to {MAX_SPECS} specs are needed")
        for spec in request.specs:
            if spec.aggregate not in ENGINE_AGGREGATES:
                raise Refused(f"unknown aggregate {spec.aggregate}")
    return request


def clamp_limit(asked: float | None) -> int:
    """TOP-8."""
    return ROW_LIMIT if asked is None else max(1, min(math.floor(asked), ROW_LIMIT))


def check_aggregate(name: str) -> None:
    """VAL-3, with the message clients see."""
    if name not in API_AGGREGATES:
        raise Refused(f"Unknown aggregate {name}: use average, min, max, first, last, mid, middle_index, sma or ema")


def applies_to_value(aggregate: str, bucketed: bool) -> bool:
    """VAL-4: does the aggregate make sense for text, positions and objects?"""
    return aggregate in ("first", "last", "middle_index") or (not bucketed and aggregate not in ("sma", "ema"))


def refusal(aggregate: str, kind: str, path: str) -> Refused:
    return Refused(f"Aggregate {aggregate} does not apply to {kind} path {path}: use first, last or middle_index")


def refuse_positions(specs: list[ValueSpec], bucketed: bool) -> None:
    for spec in specs:
        if spec.path == POSITION_PATH and not applies_to_value(spec.aggregate, bucketed):
            raise refusal(spec.aggregate, "position", spec.path)


def guard_buckets(bucketed_specs: int, bucket_seconds: int | None, range_ms: int) -> None:
    """VAL-5: the answer's size, before anything is read."""
    if bucket_seconds and math.ceil(range_ms / 1000 / bucket_seconds) * bucketed_specs > BUCKET_BUDGET:
        raise Refused(f"more than {BUCKET_BUDGET} buckets: ask for a shorter range or a coarser resolution")


def engine_aggregate(aggregate: str) -> str:
    """What the engine computes for an API aggregate: averages below moving averages, raw rows for the middle one."""
    return {"sma": "average", "ema": "average", "middle_index": "raw"}.get(aggregate, aggregate)
