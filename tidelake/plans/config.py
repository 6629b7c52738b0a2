"""Settings of the recorder, with range checks and defaults (VAL-11)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    record_self: bool = True
    record_others: bool = False
    filter_mode: str = "exclude"
    filter_paths: tuple[str, ...] = ()
    default_rate_ms: int = 2000
    rates_ms: dict[str, float] = field(default_factory=dict)
    max_paths: int = 2000
    max_contexts: int = 100
    flush_seconds: int = 5
    flush_samples: int = 1000
    roll_minutes: int = 5
    retention_days: int = 0  # 0 keeps everything


def _whole(value: object, low: int, high: int, default: int) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        return default
    value = math.floor(value)
    return value if low <= value <= high else default


def normalise(stored: dict) -> Config:
    """A usable configuration from whatever was stored; anything out of range takes its default."""
    base = Config()
    roll = _whole(stored.get("roll_minutes"), 1, 1440, base.roll_minutes)
    rates = stored.get("rates_ms")
    paths = stored.get("filter_paths")
    return Config(
        record_self=stored["record_self"] if isinstance(stored.get("record_self"), bool) else base.record_self,
        record_others=stored["record_others"] if isinstance(stored.get("record_others"), bool) else base.record_others,
        filter_mode=stored["filter_mode"] if stored.get("filter_mode") in ("include", "exclude") else base.filter_mode,
        filter_paths=tuple(p for p in paths if isinstance(p, str) and p.strip()) if isinstance(paths, (list, tuple)) else (),
        default_rate_ms=_whole(stored.get("default_rate_ms"), 0, 86_400_000, base.default_rate_ms),
        rates_ms={k: float(v) for k, v in rates.items() if isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)} if isinstance(rates, dict) else {},
        max_paths=_whole(stored.get("max_paths"), 1, 1_000_000, base.max_paths),
        max_contexts=_whole(stored.get("max_contexts"), 1, 1_000_000, base.max_contexts),
        flush_seconds=_whole(stored.get("flush_seconds"), 1, 3600, base.flush_seconds),
        flush_samples=_whole(stored.get("flush_samples"), 1, 1_000_000, base.flush_samples),
        roll_minutes=roll if 1440 % roll == 0 else base.roll_minutes,
        retention_days=_whole(stored.get("retention_days"), 0, 36_500, base.retention_days),
    )
