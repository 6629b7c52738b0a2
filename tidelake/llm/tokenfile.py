"""Token-id files: documents to ids, ids to range-coded blocks, and back.

Documents are ranged by id, so ascending ids run through the partitions; each partition is tokenised in a stream and cut
into blocks of about two million ids, which an adaptive context-mixing coder packs (``mixcoder``). A file is a table of (part,
block, ids and counts of the documents or pieces in the block, payload); Spark commits it, so a lost executor leaves
no partial file. Reading needs the file alone: blocks decode independently, and a document's checksum over several blocks is
combined from its pieces'.

Every distinct word of a worker's recent texts, compared byte by byte, goes through the tokenizer once: the vocabulary's pre-tokenizer never joins
what white space parts, so a text's ids are those of its words in order. A word of Latin letters alone is one piece to the pre-tokenizer, so it goes to the
library's BPE model directly, spelt as the byte-level alphabet spells it; all other words take the whole way. A few such words are tried both ways first,
and a vocabulary that treats them otherwise gets the whole way only.
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Stage
from tidelake.llm.mixcoder import decode_block, encode_block
from tidelake.llm.words import SPACE, batches_of, distinct_words, word_bounds

BLOCK_IDS = 1 << 21
BATCH_BYTES = 16 << 20
END_ID = 1
FILE = "part int, block int, doc_ids array<bigint>, counts array<bigint>, first_open boolean, last_open boolean, payload binary"


# The vocabulary's pre-tokenizer parts letters, single digits and runs of other characters; only an apostrophe can bind what is
# on both sides of such a border, and only '<', '|' and '>' occur in special tokens. Bytes from 128 on are of no kind here, but for
# letters of two bytes, the first of which is LEAD.
_KIND = bytes([1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 if 32 < b < 127 and chr(b) not in "'<|>" else 0 for b in range(128)] + [0] * 128)
_LOWER = bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])
_BLANK = bytes(SPACE.view(np.uint8))
# Latin letters of one or two bytes that no normal form changes; byte-level vocabularies write bytes 33-126, 161-172 and 174-255 as
# the characters of those numbers and the rest, in order, as the characters from 256 on. Capitals of two bytes end in 128 to 158.
LEAD = 0xC3
_LETTER_END = np.array([128 <= b < 192 and b not in (0x97, 0xB7) for b in range(256)])
_PLAIN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELT = np.arange(256, dtype="<u4")
_SPELT[[b for b in range(256) if b not in _PLAIN]] = 256 + np.arange(256 - len(_PLAIN))
_TRIAL = [w.encode() for w in ("a", "theory", "zzxqj", "\u00e9t\u00e9", "\u00d1and\u00da", "\u00df\u00fe\u00ff\u00c0\u00d6\u00d8\u00f6\u00f8", "pneumonoultramicroscopic")]


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of binary, and where each value begins (and the end)."""
    _, offsets, data = words.buffers()
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _kinds(data: np.ndarray) -> np.ndarray:
    kind = np.frombuffer(bytearray(data.tobytes().translate(_KIND)), np.uint8)
    lead = np.flatnonzero(data[:-1] == LEAD)
    lead = lead[_LETTER_END[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = 1
    return kind


def _latin(words: pa.Array) -> np.ndarray:
    """Which words are Latin letters alone."""
    data, offsets = _bytes_of(words)
    other = np.concatenate([[0], np.cumsum(_kinds(data) != 1)])[offsets]
    return (other[1:] == other[:-1]) & (offsets[1:] > offsets[:-1])


def _taken(ids: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``n`` ids, those at these places, laid end to end; and where each begins (and the end)."""
    if not len(place):
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    stops = np.concatenate([[0], np.cumsum(4 * n)])
    runs = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(stops), pa.py_buffer(ids)])
    _, offsets, data = runs.take(pa.array(place)).buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(place) + 1] >> 2
    return np.frombuffer(data, np.int32)[: offsets[-1]], offsets


class WordTokenizer:
    """Ids of texts by way of their distinct words (parted at borders that the pre-tokenizer parts too), compared byte by byte; keeps ``most`` words, and those of a batch."""

    def __init__(self, path: str, most: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every word comes once, so the library's own cache of words only costs time
        self.known = pa.array([], pa.binary())
        self.n, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)  # the known words' ids, in order
        trial = pa.array(_TRIAL, pa.binary())
        self.direct = all(map(np.array_equal, self._whole(trial), self._pieces(trial)))

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of Latin letters, and how many each word has."""
        data, offsets = _bytes_of(words)
        low = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
        low = low + ((data >= 128) & (data < 159)).view(np.uint8) * np.uint8(32)
        spelt = _SPELT[low].tobytes().decode("utf-32-le")  # a character a byte
        tokenize, ids, n = self.tokenizer.model.tokenize, [], []
        for a, b in itertools.pairwise(offsets.tolist()):
            found = tokenize(spelt[a:b])
            ids += [t.id for t in found]  # one flat list: many small ones would keep the garbage collector busy
            n.append(len(found))
        return np.array(ids, np.int32), np.array(n, np.int64)

    def _whole(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same of any words, the whole way."""
        texts, ids, n = words.cast(pa.string()).to_pylist(), [], []
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        for at in range(0, len(texts), 8192):
            for e in encode(texts[at : at + 8192], add_special_tokens=False):
                found = e.ids
                ids += found
                n.append(len(found))
        return np.array(ids, np.int32), np.array(n, np.int64)

    def _encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.direct:
            return self._whole(words)
        latin = _latin(words)
        ids, n = zip(self._pieces(words.filter(pa.array(latin))), self._whole(words.filter(pa.array(~latin))), strict=True)
        ids, n = np.concatenate(ids), np.concatenate(n)
        place = np.empty(len(words), np.int64)
        place[latin], place[~latin] = np.arange(latin.sum()), np.arange(latin.sum(), len(words))
        return _taken(ids, n, place)[0], n[place]

    @staticmethod
    @functools.lru_cache(maxsize=2)
    def of_worker(path: str) -> WordTokenizer:
        """One a process: a worker's later tasks meet the same words."""
        return WordTokenizer(path)

    def _learn(self, words: pa.Array) -> None:
        fresh, n = self._encoded(words)
        if len(self.n) + len(n) > self.most:  # words of several batches stay, up to half of the room
            keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.most // 2])
            keep = keep[self.uses[keep] > 1]
            self.pool, self.n, self.uses = _taken(self.pool, self.n, keep)[0], self.n[keep], self.uses[keep] >> 1
            self.known = self.known.take(pa.array(keep))
        self.known = pa.concat_arrays([self.known, words])
        self.n = np.concatenate([self.n, n])
        self.uses = np.concatenate([self.uses, np.zeros(len(n), np.int64)])
        self.pool = np.concatenate([self.pool, fresh])

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of neighbouring texts, and how many each text has."""
        raw, kind = data.tobytes(), _kinds(data)
        low = np.frombuffer(bytearray(raw.translate(_LOWER)), np.uint8)
        blank = np.frombuffer(raw.translate(_BLANK), bool)
        a, b = kind[:-1], kind[1:]
        cuts = np.flatnonzero((a > 0) & (b > 0) & ((a != b) | (a == 2))) + 1
        starts, ends = word_bounds(data, offsets, cuts=cuts, blank=blank)
        # a special token is spelt in one case only, so words with '<' keep theirs; so do words with a capital before a mark, as the normal
        # form comes first and may bind the mark to the small letter alone
        odd = data == 60
        odd[:-1] |= (data[:-1] - np.uint8(65) < 26) & (data[1:] > LEAD)
        odd = np.flatnonzero(odd)
        for w in np.unique(np.searchsorted(starts, odd, side="right") - 1).tolist():
            low[starts[w] : ends[w]] = data[starts[w] : ends[w]]
        words, where = distinct_words(low, starts, ends, blank=blank)
        place = pc.index_in(words, value_set=self.known)
        if place.null_count:
            before, new = len(self.n), place.is_null().to_numpy(zero_copy_only=False)
            self._learn(words.filter(pa.array(new)))
            if len(self.n) == before + int(new.sum()):  # all words stay, and new ones follow
                place = place.fill_null(0).to_numpy().copy()
                place[new] = before + np.arange(int(new.sum()))
                place = pa.array(place)
            else:
                place = pc.index_in(words, value_set=self.known)
            if place.null_count:  # words of this batch had to go
                self.known = self.known.slice(0, 0)
                self.n, self.uses, self.pool = self.n[:0], self.uses[:0], self.pool[:0]
                self._learn(words)
                place = pc.index_in(words, value_set=self.known)
        place = place.to_numpy()
        self.uses[place] += 1
        ids, at = _taken(self.pool, self.n, place[where])
        return ids, np.diff(at[np.searchsorted(starts, offsets)])


def _write(path: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer = WordTokenizer.of_worker(path)
        held: list[np.ndarray] = []
        docs: list[int | None] = []
        counts: list[int] = []
        size, block, first_open = 0, 0, False

        def row(ids: np.ndarray, last_open: bool) -> pa.RecordBatch:
            values = [[part], [block], [docs], [counts], [first_open], [last_open], [encode_block(ids)]]
            kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), pa.binary()]
            names = ["part", "block", "doc_ids", "counts", "first_open", "last_open", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, data, offsets in batches_of(batch.column(1), BATCH_BYTES):
                ids, sizes = tokenizer.ids(data, offsets)
                stops = np.cumsum(sizes)
                every = np.insert(ids, stops, end_id).astype(np.int32)
                at = 0
                for d, n in enumerate((sizes + 1).tolist()):
                    while n:
                        take = min(n, block_ids - size)
                        held.append(every[at : at + take])
                        docs.append(names[i + d])
                        counts.append(take)
                        size, at, n = size + take, at + take, n - take
                        if size == block_ids:
                            yield row(np.concatenate(held), n > 0)
                            held, docs, counts, size, block, first_open = [], [], [], 0, block + 1, n > 0
        if docs:
            yield row(np.concatenate(held), False)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of all documents to the folder ``path``, by ascending id (nulls first, repeated ids by text).

    Null texts are empty: the end id alone. Other columns are ignored. An empty table gives a file without blocks."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ranged.mapInArrow(_write(tokenizer_path, end_id, block_ids), FILE).write.option("compression", "none").parquet(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = decode_block(r["payload"]).astype("<u4")
            stops = np.cumsum(r["counts"])
            raw = ids.tobytes()
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for n, b in zip(r["counts"], stops.tolist(), strict=True)]
            k = len(crc)
            split = np.zeros(k, bool)
            split[0] |= r["first_open"]
            split[-1] |= r["last_open"]
            columns = [pa.array([r["part"]] * k, pa.int32()), pa.array([r["block"]] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["counts"], pa.int64()), pa.array(crc, pa.int64()), pa.array(split)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "block", "row", "id", "n", "crc", "split"])


def crc32_join(a: int, b: int, length: int) -> int:
    """The crc32 of two byte strings together, from theirs and the second's length."""

    def times(matrix: list[int], x: int) -> int:
        out = 0
        for row in matrix:
            if x & 1:
                out ^= row
            x >>= 1
        return out

    power = [0xEDB88320, *(1 << k for k in range(31))]  # one zero bit
    for _ in range(3):  # one zero byte
        power = [times(power, row) for row in power]
    while length:
        if length & 1:
            a = times(power, a)
        length >>= 1
        power = [times(power, row) for row in power]
    return a ^ b


def _join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of split documents, sorted by part and block, to one row each."""
    out, now = [], None
    for batch in batches:
        for r in batch.to_pylist():
            key = (r["part"], r["id"])
            if now and now["key"] == key and r["row"] == 0 and r["block"] == now["last"] + 1:
                now["crc"] = crc32_join(now["crc"], r["crc"], 4 * r["n"])
                now["n"] += r["n"]
                now["last"] = r["block"]
                continue
            if now:
                out.append(now)
            now = {**r, "key": key, "last": r["block"]}
    if now:
        out.append(now)
    kinds = {"part": pa.int32(), "block": pa.int32(), "row": pa.int32(), "id": pa.int64(), "n": pa.int64(), "crc": pa.int64()}
    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in kinds.items()], list(kinds))


def read_index(spark, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents in a file, from its blocks."""
    pieces = Stage(spark.read.schema(FILE).parquet(path).mapInArrow(_read, "part int, block int, row int, id long, n long, crc long, split boolean"), "pieces").read()
    columns = ["part", "block", "row", "id", "n", "crc"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    broken = pieces.where("split").select(*columns).repartition(parts, "part").sortWithinPartitions("part", "block", "row")
    whole = pieces.where("not split").select(*columns).unionAll(broken.mapInArrow(_join_pieces, "part int, block int, row int, id long, n long, crc long"))
    blocks = pieces.groupBy("part", "block").agg(F.sum("n").alias("size"))
    sizes = blocks.withColumn("before", F.sum("size").over(Window.partitionBy("part").orderBy("block")) - F.col("size"))
    totals = blocks.groupBy("part").agg(F.sum("size").alias("total"))  # one row a partition of the file
    starts = totals.withColumn("base", F.sum("total").over(Window.orderBy("part")) - F.col("total"))
    placed = sizes.join(starts, "part").select("part", "block", (F.col("base") + F.col("before")).alias("base"))
    inside = Window.partitionBy("part", "block").orderBy("row")
    local = pieces.select("part", "block", "row", (F.sum("n").over(inside) - F.col("n")).alias("at"))
    found = whole.join(local, ["part", "block", "row"]).join(placed, ["part", "block"])
    return found.select(F.col("id").alias("doc_id"), (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
