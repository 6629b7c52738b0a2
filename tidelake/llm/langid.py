"""Language identification by language-bitmask n-gram filters.

Every slot of a Bloom filter holds a bitmask with one bit per language, in as many words as the languages need. An n-gram's masks at its hash positions, ANDed,
give all languages that contain it. A text's hits per language, less the false positives that the filter's fill for
that language predicts, decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.words import batches_of

GRAM = 4  # bytes of lower-cased UTF-8, everything but letters one blank
SAMPLE_DOCS = 2000  # training documents a language, about
TOP_GRAMS = 20_000  # n-grams kept a language
WORD_LANGUAGES = 63  # languages a mask word
SLOTS, PROBES = 1 << 18, 2
PIECE = 1 << 17  # bytes of text at a time
TALLY = 1 << 18  # counted n-grams before equal ones are added up

_BYTES = np.full(256, 32, np.uint8)
_BYTES[97:123] = np.arange(97, 123)
_BYTES[128:] = np.arange(128, 256)


def _grams(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, n-grams, number up to each text's end) of pieces of at most ``PIECE`` bytes; a longer text comes in several
    pieces, one after the other. Texts are padded with blanks, so no n-gram crosses two."""
    column = column.fill_null("")
    for first, _, bounds in batches_of(column):
        texts = column.slice(first, len(bounds) - 1)
        padded = pc.binary_join_element_wise(pa.scalar(" "), pc.utf8_lower(texts), pa.scalar("   "), "")
        for i, data, offsets in batches_of(padded, PIECE):
            for at in range(0, len(data) - 3, PIECE):
                wide = _BYTES[data[at : at + PIECE + 3]]
                g = np.ndarray(len(wide) - 3, "<u4", wide, strides=(1,))
                use = wide[1:-2] != 32
                ends = np.concatenate([[0], np.cumsum(use)])
                yield first + i, g[use], ends[np.clip(offsets - at, 0, len(g))]


def _probes(grams: np.ndarray) -> list[np.ndarray]:
    h = grams.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return [((h >> np.uint64(20 * k + 8)) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(PROBES)]


def _tally(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all texts, and how often each occurs."""
    grams, counts, held = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0

    def add_up() -> None:
        distinct, of = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, of, np.concatenate(counts))
        grams[:], counts[:] = [distinct], [total]

    for _, g, _ in _grams(column):
        for done, new in zip((grams, counts), np.unique(g, return_counts=True), strict=True):
            done.append(new)
        held += len(grams[-1])
        if held > TALLY:
            add_up()
            held = 0
    add_up()
    return grams[0], counts[0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            grams, counts = _tally(batch.column(1).filter(pa.array(langs == lang)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])


class BitmaskFilter:
    """``languages`` and the slots; picklable."""

    def __init__(self, languages: list[str], grams: dict[str, np.ndarray], common: int = 0):
        self.languages, self.common = languages, common  # the index of the language to name where nothing speaks for any
        self.slots = np.zeros((max(1, -(-len(languages) // WORD_LANGUAGES)), SLOTS), np.uint64)
        self.false_rate = []
        for k, lang in enumerate(languages):
            word, bit = divmod(k, WORD_LANGUAGES)
            for at in _probes(grams.get(lang, np.zeros(0, np.int64))):
                self.slots[word, at] |= np.uint64(1 << bit)
            self.false_rate.append(float(np.mean((self.slots[word] >> np.uint64(bit)) & np.uint64(1))) ** PROBES)

    def languages_of(self, grams: np.ndarray, word: int = 0) -> np.ndarray:
        """The masks of one word: languages 63 * ``word`` and on."""
        slots, masks = self.slots[word], None
        for at in _probes(grams):
            masks = slots[at] if masks is None else masks & slots[at]
        return masks

    def judge(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its share of the corrected hits, per text."""
        total, hits = np.zeros(len(column), np.int64), np.zeros((len(self.languages), len(column)))
        for i, grams, ends in _grams(column):
            rows = slice(i, i + len(ends) - 1)
            total[rows] += np.diff(ends)
            for k in range(len(self.languages)):
                word, bit = divmod(k, WORD_LANGUAGES)
                if not bit:
                    masks = self.languages_of(grams, word)
                seen = np.concatenate([[0], np.cumsum((masks >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
                hits[k, rows] += seen[ends[1:]] - seen[ends[:-1]]
        for k, fp in enumerate(self.false_rate):
            hits[k] = np.maximum((hits[k] - fp * total) / max(1e-9, 1 - fp), 0)
        best = np.where(hits.max(0) > 0, hits.argmax(0), self.common)
        return best, np.clip(hits.max(0) / np.maximum(hits.sum(0), 1e-9), 0, 1)


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS, top_grams: int = TOP_GRAMS) -> BitmaskFilter:
    """The filter from the rows where ``training`` holds and text and language are there.

    Learns every language, from about ``sample_docs`` whole documents of each, chosen row by row by a hash of the id, so that copies of
    one text are no more and no less likely than other rows (null ids share one hash). A language contains an n-gram if the n-gram is one of its ``top_grams`` most frequent, occurs three
    times or more, and at least a quarter as often as in the language where it is most frequent."""
    rows = docs.where(training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return BitmaskFilter([], {})
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, sample_docs / sizes[lang])])
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1_000_000)) < 1_000_000 * F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    counts = chosen.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n >= 3")
    table = counts.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "gram")), asc=False), 1, top_grams).alias("top")).toArrow()
    top = table["top"].combine_chunks()  # at most top_grams rows a language
    flat = top.flatten()
    grams, n = flat.field("gram").to_numpy(), flat.field("n").to_numpy().astype(float)
    of = np.repeat(np.arange(len(top)), top.value_lengths().to_numpy())
    rate = n / np.bincount(of, n, len(top))[of]
    _, place = np.unique(grams, return_inverse=True)
    most = np.zeros(len(grams))
    np.maximum.at(most, place, rate)
    own = rate >= 0.25 * most[place]
    return BitmaskFilter(languages, {lang: grams[own & (of == k)] for k, lang in enumerate(table["lang"].to_pylist())}, languages.index(max(languages, key=sizes.get)))


def identify(docs: DataFrame, model: BitmaskFilter, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and a score in [0, 1]; columns of these names are replaced.

    ``und`` with score 0 if the text is null or has no letter, or nothing was learned. A text with letters but no known
    n-gram gets the language with most training rows and score 0. Rows stay as they are, repeats included."""
    docs = docs.drop(pred_col, score_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS bitmasks, whatever the input
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*shared.value.languages, "und"]
        for batch in batches:
            column = batch.column(at).cast(pa.string())
            spoken = pc.match_substring_regex(column, r"\pL").fill_null(False).to_numpy(zero_copy_only=False) & (len(names) > 1)
            if len(names) > 1:
                best, score = shared.value.judge(column)
            else:
                best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
            pred = pa.array([names[j] for j in np.where(spoken, best, len(names) - 1).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pred, pa.array(np.where(spoken, score, 0.0))], [*batch.schema.names, pred_col, score_col])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold
