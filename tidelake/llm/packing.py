"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt into groups of bounded size by a hash; each group is packed on its own, so groups run in parallel and
the loss is at most one open bin a group and length. Pieces go in descending size into the open bin that leaves the least
room; a piece that fits nowhere opens the bin whose length has the least expected cost per token, the waste being
estimated from the sizes still to come and attention counting with the square of the length; at the end each bin is downsized
to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage, blocks_for
from tidelake.llm.words import batches_of, word_bounds

CAPACITIES = (512, 1024, 2048, 4096)
GROUP_PIECES = 32768
ATTENTION = 6144.0  # the length at which attention costs as much as all that is linear (six times a model width of 1,024)
OVERHEAD = 8.0
SCHEMA = "id long, piece int, offset long, n_tokens long, bin long, position int, bin_capacity long, bin_used long"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to (id, n): words, and one for the end of the document."""
    for batch in batches:
        n = np.ones(batch.num_rows, np.int64)
        for i, data, offsets in batches_of(batch.column(1)):
            starts, _ = word_bounds(data, offsets)
            n[i : i + len(offsets) - 1] += np.diff(np.searchsorted(starts, offsets))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], ["id", "n"])


def length_cost(length: int, attention: float = ATTENTION, overhead: float = OVERHEAD) -> float:
    """What training on one sequence costs, in tokens: its length, attention that grows with the square of it, and a constant."""
    return length + length * length / attention + overhead


class _Rest:
    """The sizes that are still to come, for estimates of how a bin will fill."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.distinct = sorted(self.count)
        self.total = sum(sizes)

    def take(self, size: int) -> None:
        self.total -= size
        self.count[size] -= 1
        if not self.count[size]:
            del self.distinct[bisect_left(self.distinct, size)]

    def fill(self, room: int, steps: int = 64) -> int:
        """How much of ``room`` the largest fitting sizes fill, as often as they occur; what is left after ``steps`` of them is small enough
        to count as filled."""
        filled, top = 0, len(self.distinct)
        for _ in range(steps):
            top = bisect_right(self.distinct, room - filled, 0, top) - 1
            if top < 0:
                return filled
            size = self.distinct[top]
            filled += size * min(self.count[size], (room - filled) // size)
        return room


def best_fit(sizes: list[int], capacities: tuple[int, ...], attention: float = ATTENTION, overhead: float = OVERHEAD) -> tuple[list[int], list[int]]:
    """The bin of each piece (sizes within the largest capacity) and each bin's capacity.

    Pieces come in descending size. A piece that fits no open bin opens one: for every length that holds it, the room beside it is
    filled from the sizes that remain, as far as the bins already open leave any; the least ``length_cost`` per token placed wins,
    ties to the longer."""
    caps = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rest = _Rest(sizes)
    room: list[tuple[int, int]] = []  # (space left, bin), ascending
    free = 0  # space left in all open bins
    bin_of, used = [0] * len(sizes), []
    for i in order:
        s = sizes[i]
        rest.take(s)
        k = bisect_left(room, (s, -1))
        if k < len(room):
            space, b = room.pop(k)
            free -= space
        else:
            best = None
            for c in caps:
                if c >= s:
                    filled = min(rest.fill(c - s), max(0, rest.total - free))
                    cost = length_cost(c, attention, overhead) / (s + filled)
                    if best is None or cost <= best[0]:
                        best = (cost, c)
            space, b = best[1], len(used)
            used.append(0)
        bin_of[i] = b
        used[b] += s
        if space > s:
            insort(room, (space - s, b))
            free += space - s
    return bin_of, [caps[bisect_left(caps, u)] for u in used]


def _pack(capacities: tuple[int, ...], attention: float, overhead: float):
    largest = max(capacities)

    def of(group: int, rows: list[tuple[int, int]]) -> pa.RecordBatch:
        pieces = []  # (id, piece, offset, size)
        for i, n in rows:
            for k, at in enumerate(range(0, n, largest)):
                pieces.append((i, k, at, min(largest, n - at)))
        bins, caps = best_fit([p[3] for p in pieces], capacities, attention, overhead)
        used, place = [0] * len(caps), [0] * len(caps)
        position = []
        for p, b in zip(pieces, bins, strict=True):
            used[b] += p[3]
            position.append(place[b])
            place[b] += 1
        columns = [[p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces], [p[3] for p in pieces], [(group << 32) + b for b in bins], position, [caps[b] for b in bins], [used[b] for b in bins]]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for g, i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != now and rows:
                    yield of(now, rows)
                    rows = []
                now = g
                rows.append((i, n))
        if rows:
            yield of(now, rows)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", tokens: Column | str | None = None, text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, attention: float = ATTENTION, overhead: float = OVERHEAD, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(id_col, piece, offset, n_tokens, bin, position, bin_capacity, bin_used)``, one row per piece.

    ``tokens`` gives each document's length (by default the words of ``text_col`` and an end mark, which a null text has too; a
    document of length 0 or null has no piece). Documents longer than the largest capacity are cut into full pieces and a rest.
    Bins hold at most their capacity, one of ``capacities``. Repeated ids are packed once per row; a null id is kept.
    Other columns are ignored. An empty table gives an empty result. Results depend on the rows only, not on their
    order or partitions."""
    key = F.col(id_col).cast("long").alias("id")
    if tokens is None:
        sized = docs.select(key, F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths, "id long, n long")
    else:
        length = F.col(tokens) if isinstance(tokens, str) else tokens
        sized = docs.select(key, F.coalesce(length.cast("long"), F.lit(0)).alias("n"))
    sized = Stage(sized.where("n > 0"), "lengths").read()
    count = sized.agg(F.sum(F.ceil(F.col("n") / max(capacities)))).first()[0] or 0
    groups = blocks_for(count, group_pieces)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sized.select(F.pmod(F.xxhash64("id", "n"), F.lit(groups)).alias("g"), "id", "n").repartition(parts, "g").sortWithinPartitions("g", F.desc("n"), "id")
    return dealt.mapInArrow(_pack(tuple(capacities), attention, overhead), SCHEMA).withColumnRenamed("id", id_col)
