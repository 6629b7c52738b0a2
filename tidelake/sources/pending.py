"""The record of an unfinished roll: {rollId, maxRowid, phase}, phase rolling or written (SRC-10, SNK-9)."""

from __future__ import annotations

import json
from dataclasses import dataclass

from tidelake.sources.files import Store

PLACE = ("hot", "roll-pending.json")
_SAFE = 2**53 - 1


@dataclass(frozen=True)
class PendingRoll:
    roll_id: int
    max_rowid: int
    phase: str


def read(store: Store) -> PendingRoll | None:
    """The record, or None if it is missing, torn or out of bounds."""
    text = store.read_text(*PLACE)
    try:
        found = json.loads(text) if text else None
    except ValueError:
        return None
    if not isinstance(found, dict) or found.get("phase") not in ("rolling", "written"):
        return None
    numbers = [found.get("rollId"), found.get("maxRowid")]
    if not all(isinstance(n, int) and not isinstance(n, bool) and 0 < n <= _SAFE for n in numbers):
        return None
    return PendingRoll(*numbers, found["phase"])


def write(store: Store, record: PendingRoll) -> None:
    store.write_text(json.dumps({"rollId": record.roll_id, "maxRowid": record.max_rowid, "phase": record.phase}), *PLACE)


def clear(store: Store) -> None:
    store.delete(*PLACE)
