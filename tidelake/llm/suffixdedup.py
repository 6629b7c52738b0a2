"""Removal of repeated byte strings between documents, by external induced suffix sorting.

1. Documents are packed (about 2 MB of text a pack, compressed) into a table in the shared folder.
2. Every 50-byte window has a minimizer: the least hash of its 20-byte strings. Each pack sends its distinct
   minimizers, as short blobs by hash bucket; a bucket answers with one bit for each: does it occur in two documents?
   A window that occurs in two documents has such a minimizer, so all other text needs no sorting.
3. Neighbouring windows with one minimizer form a segment (80 bytes at most). Segments with such minimizers are sent
   by the minimizer's bucket, identical ones within a pack once. Equal windows meet in one bucket.
4. A bucket sorts the suffixes of its distinct segments by external induced sorting, but for those that are alone with
   their minimizer, which no other segment shares a window with; runs with common prefixes of 50 bytes are equal
   windows, whose least document decides. Bit masks go back to the packs.
5. Each pack joins its masks and cuts the covered bytes.

The number of buckets follows the input's bytes, so a bucket's size doesn't; a string in many documents
reaches its bucket once a pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage, blocks_for, forget_shuffles
from tidelake.llm.suffix import suffix_batches
from tidelake.llm.words import U, batches_of, mix

LENGTH, SEED = 50, 20
PACK_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
PACKS = "pack long, ids binary, sizes binary, data binary, n_bytes long"
PARTS = "pack long, bucket long, a binary, b binary, c binary, d binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to packs sorted by id; a null id comes first, as -1 in ``sizes``' sign bit."""
    first = TaskContext.get().partitionId() << 40
    press = zstandard.ZstdCompressor(level=6)  # packs are written once and shuffled twice
    made = 0
    for batch in batches:
        ids = batch.column(0)
        order = pc.sort_indices(ids, null_placement="at_start")
        batch = batch.take(order)
        ids = batch.column(0)
        nulls = ids.null_count
        ids = ids.fill_null(0).to_numpy().astype(np.int64)
        for i, data, offsets in batches_of(batch.column(1), PACK_BYTES):
            sizes = np.diff(offsets)
            here = np.arange(i, i + len(sizes))
            sizes = np.where(here < nulls, -1 - sizes, sizes)
            yield pa.RecordBatch.from_pydict(
                {
                    "pack": pa.array([first + made], pa.int64()),
                    "ids": pa.array([ids[i : i + len(sizes)].tobytes()], pa.binary()),
                    "sizes": pa.array([sizes.astype(np.int64).tobytes()], pa.binary()),
                    "data": pa.array([press.compress(data.tobytes())], pa.binary()),
                    "n_bytes": pa.array([len(data)], pa.int64()),
                }
            )
            made += 1


def _gram_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each ``seed``-byte string of the bytes."""
    grams = len(data) - seed + 1
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), strides=(1,))
    h = np.zeros(grams, U)
    at = list(range(0, seed - 7, 8)) + ([seed - 8] if seed % 8 else [])
    for k, factor in zip(at, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB), strict=False):
        h += words[k : k + grams] * U(factor)
        h ^= h >> U(29)
    h *= U(0xD1342543DE82EF95)
    h ^= h >> U(32)
    return h


class _Pack:
    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        sizes = np.frombuffer(sizes, np.int64)
        self.known = sizes >= 0  # the id is not null
        self.sizes = np.where(self.known, sizes, -1 - sizes)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)

    def runs(self, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Minimizer, document, first and last window of each run of windows with one minimizer."""
        n = len(self.data) - length + 1
        empty = np.zeros(0, np.int64)
        if n <= 0:
            return empty.astype(U), empty, empty, empty
        h = _gram_hashes(self.data, seed)
        span, width, low = length - seed + 1, 1, h
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: n], low[span - width : span - width + n])
        low = low[:n]
        good = np.zeros(n, bool)  # windows inside one document with a known id
        mark = np.zeros(n + 1, np.int32)
        use = np.flatnonzero(self.known & (self.sizes >= length))
        np.add.at(mark, self.offsets[use], 1)
        np.add.at(mark, self.offsets[use] + self.sizes[use] - length + 1, -1)
        good = np.cumsum(mark[:-1]) > 0
        head = good.copy()
        same = np.zeros(n, bool)
        same[1:] = (low[1:] == low[:-1]) & good[:-1] & good[1:]
        same[self.offsets[use]] = False
        head &= ~same
        first = np.flatnonzero(head)
        tail = good.copy()
        tail[:-1] &= ~same[1:]
        last = np.flatnonzero(tail)
        pieces = -(-(last - first + 1) // span)  # periodic text keeps a minimizer for long; a segment stays bounded
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = np.repeat(first, pieces) + nth * span, np.repeat(last, pieces)
        last = np.minimum(last, first + span - 1)
        return low[first], np.searchsorted(self.offsets, first, side="right") - 1, first, last


def _keys(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    g = mix(values)
    return ((g >> U(32)) % U(buckets)).astype(np.int64), (g & U(0xFFFFFFFF)).astype(np.uint32)


def _distinct(values: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and whether each occurs in two documents here. ``docs`` ascends."""
    order = np.argsort(values, kind="stable")
    v, d = values[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
    stops = np.append(head[1:], len(v))
    return v[head], (d[head] != d[stops - 1]) if len(v) else np.zeros(0, bool)


def _groups(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of the runs of sorted keys."""
    if len(keys):
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(keys[a]), a, b


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    names = ["pack", "bucket", "a", "b", "c", "d"]
    kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], names)


def _order_in(values: np.ndarray, buckets: int):
    bucket, rest = _keys(values, buckets)
    return bucket, rest, np.argsort(bucket, kind="stable")


def _send_minimizers(length: int, seed: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values, docs, _, _ = _Pack(row["ids"], row["sizes"], row["data"]).runs(length, seed)
                values, twice = _distinct(values, docs)
                bucket, rest, order = _order_in(values, buckets)
                yield _parts([(row["pack"], k, rest[order[a:b]].tobytes(), np.packbits(twice[order[a:b]]).tobytes(), None, None) for k, a, b in _groups(bucket[order])])

    return run


def _find_repeated(table: pa.Table) -> pa.Table:
    """One bucket: which entries of each blob occur in two documents."""
    blobs = [np.frombuffer(x, np.uint32) for x in table["a"].to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(y)].astype(bool) for x, y in zip(table["b"].to_pylist(), blobs, strict=True)]
    values = np.concatenate(blobs)
    order = np.argsort(values, kind="stable")
    v = values[order]
    equal = v[1:] == v[:-1]
    hit = np.concatenate(twice)
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    cuts = np.cumsum([0, *map(len, blobs)])
    found = [(p, b, np.packbits(hit[cuts[i] : cuts[i + 1]]).tobytes(), None, None, None) for i, (p, b) in enumerate(zip(table["pack"].to_pylist(), table["bucket"].to_pylist(), strict=True)) if hit[cuts[i] : cuts[i + 1]].any()]
    return pa.Table.from_batches([_parts(found)])


def _send_segments(length: int, seed: int, buckets: int):
    """Per pack: a row with bucket -1 that says where its repeated runs are, and rows of segments by bucket."""

    def of(row: dict) -> list[tuple]:
        press = zstandard.ZstdCompressor(level=6)
        pack = _Pack(row["ids"], row["sizes"], row["data"])
        values, docs, first, last = pack.runs(length, seed)
        distinct, _ = _distinct(values, docs)
        bucket, _, order = _order_in(distinct, buckets)
        hit = np.zeros(len(distinct), bool)
        answers = {x["bucket"]: x["a"] for x in row["hits"]}
        for k, a, b in _groups(bucket[order]):
            if k in answers:
                hit[order[a:b]] = np.unpackbits(np.frombuffer(answers[k], np.uint8))[: b - a].astype(bool)
        chosen = np.flatnonzero(hit[np.searchsorted(distinct, values)])
        values, docs, first, last = values[chosen], docs[chosen], first[chosen], last[chosen]
        source = np.empty(len(chosen), np.int64)  # the run whose verdict counts; -1: it is removed whole
        seen: dict[bytes, int] = {}
        data = pack.data.tobytes()
        ids = pack.ids[docs]
        for i, (a, b) in enumerate(zip(first.tolist(), (last + length).tolist(), strict=True)):
            j = seen.setdefault(data[a:b], i)
            source[i] = j if ids[j] == ids[i] else -1
        own = np.flatnonzero(source == np.arange(len(source)))
        bucket, _, order = _order_in(values[own], buckets)
        out = [(row["pack"], -1, first.astype(np.int32).tobytes(), (last - first + 1).astype(np.uint8).tobytes(), source.astype(np.int32).tobytes(), None)]
        for k, a, b in _groups(bucket[order]):
            mine = own[order[a:b]]
            text = b"".join(data[x:y] for x, y in zip(first[mine].tolist(), (last[mine] + length).tolist(), strict=True))
            out.append((row["pack"], k, mine.astype(np.int32).tobytes(), (last - first + length)[mine].astype(np.uint8).tobytes(), ids[mine].tobytes(), press.compress(text)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _parts(of(row))

    return run


def _company(texts: list[bytes], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Which of some different segments share their minimizer, the least hash of their ``seed``-byte strings, with another. Only these can
    have a window of another."""
    if len(texts) < 2:
        return np.zeros(0, np.int64)
    hashes = np.append(_gram_hashes(np.frombuffer(b"".join(texts), np.uint8), seed), U(0))
    starts = np.cumsum(sizes) - sizes
    least = np.minimum.reduceat(hashes, np.column_stack([starts, starts + sizes - seed + 1]).ravel())[::2]
    order = np.argsort(least)
    same = least[order[1:]] == least[order[:-1]]
    shared = np.zeros(len(texts), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    return np.flatnonzero(shared)


def _judge(length: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        """One bucket: masks of the windows that also start in a document with a smaller id."""
        rows = table.to_pylist()
        unpress = zstandard.ZstdDecompressor()
        known: dict[bytes, int] = {}
        least: list[int] = []
        uses = []
        for row in rows:
            sizes = np.frombuffer(row["b"], np.uint8)
            ids = np.frombuffer(row["c"], np.int64)
            stops = np.cumsum(sizes, dtype=np.int64)
            use = np.empty(len(sizes), np.int64)
            text = unpress.decompress(row["d"])
            for i, (a, b, d) in enumerate(zip((stops - sizes).tolist(), stops.tolist(), ids.tolist(), strict=True)):
                j = known.setdefault(text[a:b], len(least))
                if j == len(least):
                    least.append(d)
                elif d < least[j]:
                    least[j] = d
                use[i] = j
            uses.append((use, ids))
        texts = list(known)
        del known
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        least = np.array(least, np.int64)
        windows = sizes - length + 1
        slot = np.cumsum(windows) - windows
        low = np.repeat(least, windows)  # least document of each window; a segment of no other's windows has its own
        sorted_ones = _company(texts, sizes, seed)
        text = np.frombuffer(b"\xff".join(texts[i] for i in sorted_ones.tolist()) + b"\xff\xff", np.uint8) + np.uint8(1)  # 255 is no byte of UTF-8; it becomes 0
        text = np.concatenate([text[:-1] + np.uint8(1), text[-1:]])  # texts' bytes 2.., separators 1, the end 0
        del texts
        starts = np.zeros(len(sizes), np.int64)  # in the sorted text
        starts[sorted_ones] = np.cumsum(sizes[sorted_ones] + 1) - sizes[sorted_ones] - 1
        owner = np.full(len(text), -1, np.int32)
        places = np.cumsum(windows[sorted_ones]) - windows[sorted_ones]
        owner[np.repeat(starts[sorted_ones] - places, windows[sorted_ones]) + np.arange(int(windows[sorted_ones].sum()))] = np.repeat(sorted_ones, windows[sorted_ones])

        def settle(pos: np.ndarray, cut: np.ndarray) -> None:
            """pos: window starts in order of suffixes; cut: where a run of equal windows begins."""
            heads = np.flatnonzero(cut)
            mine = owner[pos]
            best = np.minimum.reduceat(least[mine], heads)
            low[slot[mine] + pos - starts[mine]] = np.repeat(best, np.diff(np.append(heads, len(pos))))

        open_pos, open_cut = np.zeros(0, np.int64), np.zeros(0, bool)
        new_run = True
        for pos, lcp in suffix_batches(text, cap=length) if len(sorted_ones) else ():
            fresh = np.asarray(lcp) < length
            isw = owner[pos] >= 0
            # a run ends at any suffix that shares less; such marks move to the next window
            group = np.cumsum(fresh)
            wpos, wgroup = pos[isw], group[isw]
            if len(wpos):
                cut = np.concatenate([[new_run or wgroup[0] > 0], wgroup[1:] != wgroup[:-1]])
                new_run = bool(group[-1] > wgroup[-1])
                open_pos, open_cut = np.concatenate([open_pos, wpos]), np.concatenate([open_cut, cut])
                heads = np.flatnonzero(open_cut)
                if len(heads) and heads[-1] > 0:
                    settle(open_pos[: heads[-1]], open_cut[: heads[-1]])
                    open_pos, open_cut = open_pos[heads[-1] :], open_cut[heads[-1] :]
            else:
                new_run = new_run or bool(len(group) and group[-1] > 0)
        if len(open_pos):
            settle(open_pos, open_cut)
        found = []
        for row, (use, ids) in zip(rows, uses, strict=True):
            mask = np.zeros(len(use), np.uint64)
            for k in range(int(windows[use].max()) if len(use) else 0):
                has = windows[use] > k
                mask[has] |= (low[slot[use[has]] + k] < ids[has]).astype(np.uint64) << U(k)
            some = np.flatnonzero(mask)
            if len(some):
                found.append((row["pack"], row["bucket"], np.frombuffer(row["a"], np.int32)[some].tobytes(), mask[some].tobytes(), None, None))
        return pa.Table.from_batches([_parts(found)])

    return run


def _cut(length: int):
    def of(row: dict) -> pa.RecordBatch:
        pack = _Pack(row["ids"], row["sizes"], row["data"])
        cover = np.zeros(len(pack.data) + 1, np.int32)
        if row["first"]:
            first = np.frombuffer(row["first"], np.int32).astype(np.int64)
            counts = np.frombuffer(row["counts"], np.uint8)
            source = np.frombuffer(row["source"], np.int32)
            masks = np.zeros(len(first), np.uint64)
            for x in row["verdicts"] or []:
                masks[np.frombuffer(x["a"], np.int32)] = np.frombuffer(x["b"], np.uint64)
            masks = np.where(source >= 0, masks[source], (U(1) << counts.astype(np.uint64)) - U(1))
            for k in range(int(counts.max()) if len(counts) else 0):
                at = first[(masks >> U(k)) & U(1) == 1] + k
                np.add.at(cover, at, 1)
                np.add.at(cover, at + length, -1)
        gone = np.cumsum(cover[:-1]) > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = pack.offsets[:-1][pack.sizes > 0]
        begins[inner] = gone[inner]
        spans = np.concatenate([[0], np.cumsum(begins)])
        a, b = pack.offsets[:-1], pack.offsets[1:]
        removed = total[b] - total[a]
        data = pack.data.tobytes()
        sums, kept = [], []
        for x, y, r in zip(a.tolist(), b.tolist(), removed.tolist(), strict=True):
            rest = pack.data[x:y][~gone[x:y]].tobytes() if r else data[x:y]
            sums.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        ids = pa.array(pack.ids, pa.int64(), mask=~pack.known)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(b - a, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans[b] - spans[a], pa.int64()), pa.array(sums), pa.array(kept, pa.binary())],
            ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield of(row)

    return run


def _repeated_segments(packs: DataFrame, length: int, seed: int, buckets: int) -> DataFrame:
    sent = packs.mapInArrow(_send_minimizers(length, seed, buckets), PARTS)
    hits = sent.groupBy("bucket").applyInArrow(_find_repeated, PARTS).groupBy("pack").agg(F.collect_list(F.struct("bucket", "a")).alias("hits"))
    return Stage(packs.join(hits, "pack").mapInArrow(_send_segments(length, seed, buckets), PARTS), "segments").read()


def _verdicts(segments: DataFrame, length: int, seed: int) -> DataFrame:
    judged = segments.where("bucket >= 0").groupBy("bucket").applyInArrow(_judge(length, seed), PARTS)
    return Stage(judged.groupBy("pack").agg(F.collect_list(F.struct("a", "b")).alias("verdicts")), "verdicts").read()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``(id_col, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row per input row; ``kept`` holds the bytes left.

    Each byte goes that is covered by a ``length``-byte string (UTF-8 bytes, within one document, as given)
    that also starts in a document with a smaller id. Null texts are empty; texts shorter than ``length`` stay whole;
    rows with one id don't remove from each other; a row with a null id neither removes nor loses anything.
    Other columns are ignored. An empty table gives an empty result. ``length`` is at most ``seed`` + 63 and 200,
    and ``seed`` at least 8."""
    if not (8 <= seed <= length <= min(200, seed + 63)):
        raise ValueError("8 <= seed <= length <= min(200, seed + 63) is needed")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    packs = Stage(docs.mapInArrow(_pack, PACKS), "packs").read()
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = blocks_for(total, BUCKET_BYTES)
    segments = _repeated_segments(packs, length, seed, buckets)
    forget_shuffles(docs.sparkSession)
    verdicts = _verdicts(segments, length, seed)
    forget_shuffles(docs.sparkSession)
    runs = segments.where("bucket = -1").select("pack", F.col("a").alias("first"), F.col("b").alias("counts"), F.col("c").alias("source"))
    told = runs.join(verdicts, "pack", "left")
    cut = packs.join(told, "pack", "left").mapInArrow(_cut(length), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumnRenamed("id", id_col)
