"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

One pass over the documents looks up every word n-gram in the benchmark's (a table whose size is bounded by
``slice_words``; a larger benchmark is taken slice by slice) and stages the few documents with a match. Document frequencies
of the matched n-grams, over all documents, then tell which n-grams of an item are rare; those are its seeds.
Each cluster of seed matches on neighbouring diagonals is one local alignment of the item with the text around it. A cluster of
other matches is aligned too if the text around it holds so many of the item's words that the score can reach the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage, blocks_for
from tidelake.llm.words import U, batches_of, grams, scan

GRAM = 4
COMMON, COMMONER = 100, 8
MIN_SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
SLICE_WORDS = 1 << 20
PAIRS = 1 << 13  # alignments at a time

#: Bytes that separate words here: ASCII other than letters and digits, so that punctuation doesn't matter.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Local alignment scores (match 2, mismatch -1, gap -1) of pairs of word sequences, over 2 * the item's words."""
    out = np.zeros(len(items))
    order = sorted(range(len(items)), key=lambda i: len(windows[i]))
    i = 0
    while i < len(order):
        width = max(1, len(windows[order[min(i + 255, len(order) - 1)]]))
        part = order[i : i + max(1, min(256, (1 << 20) // width))]
        i += len(part)
        width = max(1, max(len(windows[p]) for p in part))
        w = np.zeros((len(part), width), U)
        for r, p in enumerate(part):
            w[r, : len(windows[p])] = windows[p]
        there = np.arange(width)[None, :] < np.array([len(windows[p]) for p in part])[:, None]
        lengths = np.array([len(items[p]) for p in part])
        words = np.zeros((len(part), int(lengths.max())), U)
        for r, p in enumerate(part):
            words[r, : lengths[r]] = items[p]
        slope = np.arange(width, dtype=np.int32) * -GAP
        row = np.zeros((len(part), width + 1), np.int32)
        best = np.zeros(len(part), np.int32)
        for k in range(words.shape[1]):
            hit = (w == words[:, k : k + 1]) & there
            new = np.maximum(np.maximum(row[:, :-1] + np.where(hit, MATCH, MISMATCH), row[:, 1:] + GAP), 0)
            new = np.maximum.accumulate(new + slope, axis=1) - slope
            row[:, 1:] = new
            best = np.where(k < lengths, np.maximum(best, new.max(1)), best)
        out[part] = best / (MATCH * lengths)
    return out


class _Index:
    """One slice of the benchmark: items' words and the sorted n-grams with where they occur."""

    def __init__(self, ids: list[int], texts: list[str | None], n: int):
        self.n, self.ids = n, ids
        self.words = []
        for _, data, offsets in batches_of(pc.utf8_lower(pa.array(texts, pa.large_string()))):
            hashes, first, _, _ = scan(data, offsets, SEPARATORS)
            self.words += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.sizes = sorted({min(n, len(w)) for w in self.words if len(w)})
        values, item, pos = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, w in enumerate(self.words):
            g = grams(w, n)
            values.append(g)
            item.append(np.full(len(g), i))
            pos.append(np.arange(len(g)))
        values, item, pos = np.concatenate(values), np.concatenate(item), np.concatenate(pos)
        order = np.argsort(values, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.grams, self.first = np.unique(values[order], return_index=True)
        self.first = np.append(self.first, len(values))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.grams & U((1 << 20) - 1)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text and numbers of the n-grams found there."""
        at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in self.sizes:
            if len(words) < size:
                continue
            g = grams(words, size)
            p = np.flatnonzero(self.maybe[(g & U((1 << 20) - 1)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.grams, g[p]), len(self.grams) - 1)
            ok = self.grams[k] == g[p]
            at.append(p[ok])
            found.append(k[ok])
        return np.concatenate(at), np.concatenate(found)


def _matches(shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, at, found = [], [], []
            for i, data, offsets in batches_of(pc.utf8_lower(batch.column(1))):
                words, first, _, _ = scan(data, offsets, SEPARATORS)
                p, k = index.find(words)  # also across texts, which the next line undoes
                doc = np.searchsorted(first, p, side="right") - 1
                ends = p + np.minimum(index.n, np.array([len(index.words[j]) for j in index.item[index.first[k]]], np.int64))
                ok = ends <= first[doc + 1]
                for d in np.unique(doc[ok]).tolist():
                    mine = ok & (doc == d)
                    rows.append(i + d)
                    at.append((p[mine] - first[d]).tolist())
                    found.append(k[mine].tolist())
            part = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))], ["id", "text", "at", "found"])

    return run


def _scores(shared, seeds, least: float) -> object:
    """Aligns every cluster of seeds, and every cluster of other matches whose window holds enough of the item's words for ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seed = shared.value, seeds.value
        starts, spread = index.first[:-1], np.diff(index.first)
        names = np.array(index.ids, np.int64)
        for batch in batches:
            rows, items, windows, places, rare = [], [], [], [], []
            at_all, found_all = batch.column(2).to_pylist(), batch.column(3).to_pylist()

            def aligned() -> pa.RecordBatch:
                scores = align([index.words[j] for j in items], windows)
                kept = np.array(rare, bool) | (scores >= least)
                ids = batch.column(0).take(pa.array(np.array(rows, np.int64)[kept]))
                out = [ids, pa.array(names[np.array(items, np.int64)[kept]]), pa.array(scores[kept]), pa.array(np.array(places, np.int64)[kept])]
                for done in (rows, items, windows, places, rare):
                    done.clear()
                return pa.RecordBatch.from_arrays(out, ["id", "item_id", "score", "word"])

            for i, data, offsets in batches_of(pc.utf8_lower(batch.column(1))):
                words, first, _, _ = scan(data, offsets, SEPARATORS)
                for d in range(len(offsets) - 1):
                    text = words[first[d] : first[d + 1]]
                    at, found = np.array(at_all[i + d], np.int64), np.array(found_all[i + d], np.int64)
                    many = spread[found]
                    e = np.repeat(starts[found] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                    item, diagonal = index.item[e], np.repeat(at, many) - index.pos[e]
                    centres: dict[int, list[int]] = {}
                    for is_rare in (True, False):
                        last: dict[int, int] = {}
                        own = seed[e] if is_rare else ~seed[e]
                        for j, x in sorted(set(zip(item[own].tolist(), diagonal[own].tolist(), strict=True))):
                            m = len(index.words[j])
                            if j in last and x - last[j] <= m // 4:
                                continue  # the window around the cluster's first diagonal holds this one
                            if not is_rare and any(abs(x - c) <= m // 4 for c in centres.get(j, ())):
                                continue  # so does that of a cluster of seeds
                            last[j] = x
                            slack = m // 2 + 1
                            window = text[max(0, x - slack) : x + m + slack]
                            if is_rare:
                                centres.setdefault(j, []).append(x)
                            elif np.isin(index.words[j], window).sum() < least * m:
                                continue  # a score is at most the share of the item's words that are here
                            rows.append(i + d)
                            items.append(j)
                            windows.append(window)
                            places.append(max(0, x))
                            rare.append(is_rare)
                    if len(rows) >= PAIRS:
                        yield aligned()
            if rows:
                yield aligned()

    return run


def _rare(item: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which n-grams of the items are seeds: those in at most COMMON + COMMONER * d documents, d being the median over the item's
    n-grams that occur at all. Documents that hold only others of an item's n-grams are judged by their words instead."""
    seed = np.zeros(len(item), bool)
    order = np.argsort(item, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1):
        there = count[own][count[own] > 0]
        if len(there):
            seed[own] = (count[own] > 0) & (count[own] <= COMMON + COMMONER * np.median(there))
    return seed


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = GRAM, slice_words: int = SLICE_WORDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``(id_col, item_id, score, word)``: each pair of a document and a benchmark item that share a seed, or that share any n-gram
    and score at least ``min_score``, with the best local alignment's score (1: the whole item, in order) and the word about
    where it lies.

    Words are runs of letters and digits, compared in lower case. Items shorter than ``n`` words are one n-gram. Null or
    blank texts and null ids match nothing; repeated ids are one document; other columns are ignored. Empty tables
    give an empty result."""
    spark = docs.sparkSession
    docs = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
    size = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0
    slices = blocks_for(int(size), slice_words)
    result = None
    for part in range(slices):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == part).orderBy("item_id", "text").collect()  # about slice_words words
        index = _Index([r["item_id"] for r in rows], [r["text"] for r in rows], n)
        if not len(index.grams):
            continue
        shared = spark.sparkContext.broadcast(index)
        near = Stage(docs.mapInArrow(_matches(shared), "id long, text string, at array<bigint>, found array<bigint>"), "matches").read()
        frequency = np.zeros(len(index.grams), np.int64)
        for r in near.select(F.explode(F.array_distinct("found")).alias("gram")).groupBy("gram").count().collect():  # at most one row per n-gram of the slice
            frequency[r["gram"]] = r["count"]
        count = np.repeat(frequency, np.diff(index.first))
        seed = _rare(index.item, count)
        pairs = near.mapInArrow(_scores(shared, spark.sparkContext.broadcast(seed), min_score), "id long, item_id long, score double, word long")
        result = pairs if result is None else result.unionAll(pairs)
    if result is None:
        result = spark.createDataFrame([], "id long, item_id long, score double, word long")
    best = result.groupBy("id", "item_id").agg(F.max("score").alias("score"), F.max_by("word", "score").alias("word"))
    return best.withColumnRenamed("id", id_col)


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", min_score: float = MIN_SCORE, **options) -> DataFrame:
    """``(id_col, contaminated, n_items, item_id, score)``, one row per row of ``docs``: the number of items with a score of at
    least ``min_score``, and the best of all aligned items (ties to the smaller id; null and 0 without any)."""
    pairs = contaminated(docs, benchmark, id_col, min_score=min_score, **options)
    best = pairs.groupBy(id_col).agg(
        F.count(F.when(F.col("score") >= min_score, 1)).alias("n_items"), F.max(F.struct("score", (-F.col("item_id")).alias("minus"))).alias("top")
    )
    joined = docs.select(F.col(id_col).cast("long").alias(id_col)).join(best, id_col, "left")
    return joined.select(
        id_col,
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("top.minus")).alias("item_id"),
        F.coalesce("top.score", F.lit(0.0)).alias("score"),
    )
