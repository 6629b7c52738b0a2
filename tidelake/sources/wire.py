"""Samples from a socket's frames or JSON lines, validated field by field (SRC-9)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.model import SAMPLE, split_valid

MAX_FRAME = 4 << 20  # fixed value: bytes of one frame


class FrameDecoder:
    """4-byte big-endian lengths, each with that many bytes of JSON; keeps what is incomplete."""

    def __init__(self) -> None:
        self.rest = b""

    def push(self, chunk: bytes) -> Iterator[object]:
        self.rest += chunk
        while len(self.rest) >= 4:
            size = int.from_bytes(self.rest[:4], "big")
            if size > MAX_FRAME:
                raise ValueError(f"a frame of {size} bytes")
            if len(self.rest) < 4 + size:
                return
            body, self.rest = self.rest[4 : 4 + size], self.rest[4 + size :]
            yield json.loads(body)


def frame(message: object) -> bytes:
    body = json.dumps(message).encode()
    if len(body) > MAX_FRAME:
        raise ValueError(f"a frame of {len(body)} bytes")
    return len(body).to_bytes(4, "big") + body


def parse_lines(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Sample rows from JSON lines, and the lines that are none (malformed, or against the model)."""
    parsed = lines.withColumn("_s", F.from_json(column, SAMPLE.simpleString(), {"mode": "PERMISSIVE"}))
    good, bad = split_valid(parsed.select(column, "_s.*"))
    return good.select(*SAMPLE.names), bad.select(column)
