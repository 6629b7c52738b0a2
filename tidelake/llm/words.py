"""Vectorised word and shingle hashing over UTF-8 buffers (numpy and Arrow).

Words are maximal runs without space, tab, LF, VT, FF or CR; A-Z are lower-cased. Equal words of a batch are found by
their bytes; a distinct word's hash is the first 64 bits of its BLAKE2b digest, so that words can't be made to share one but by
trying some 2**32 of them; chance collisions have probability 2**-64 a pair. Shingles are sums of such hashes, each times a power.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += np.uint8(32)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE, cuts: np.ndarray | None = None, blank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end; words never cross an offset. ``space``: bytes outside words; ``cuts``:
    places where a word is cut in two; ``blank``: which of ``data`` are spaces, where that is known."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(space[data] if blank is None else blank, out=inside[1:-1])
    cut = np.zeros(len(data) + 1, bool)  # cut[i]: a text ends before byte i
    cut[offsets] = True
    if cuts is not None:
        cut[cuts] = True
    starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1]))
    ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:]))
    return starts, ends


_STEP = [U(pow(0xBEA225F9EB34556D, k + 1, 1 << 64)) for k in range(16)]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams, in order; one of the whole sequence if it is shorter; none of nothing."""
    if not len(words):
        return words
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, U)
    for k in range(size):
        out += words[k : k + len(out)] * _STEP[k]
    return mix(out + U(size))


def batches_of(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of neighbouring texts of about ``limit`` bytes; one text at least. Nulls are empty."""
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def distinct_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, space: np.ndarray = SPACE, blank: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """The distinct words (compared byte by byte), and each word's place among them; the words are all of ``data`` but its spaces
    (``blank``, where that is known)."""
    at = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=at[1:])
    letters = data[~(space[data] if blank is None else blank)]  # the words laid end to end
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy()


def hash_words(distinct: pa.Array) -> np.ndarray:
    """64 bits of each word's digest."""
    digest = hashlib.blake2b
    return np.frombuffer(b"".join([digest(w, digest_size=8).digest() for w in distinct.to_pylist()]), "<u8")


def scan(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, the first word of each text (and the end), and the words' starts and ends."""
    starts, ends = word_bounds(data, offsets, space)
    distinct, where = distinct_words(LOWER[data], starts, ends, space)
    return hash_words(distinct)[where], np.searchsorted(starts, offsets), starts, ends


def exact_shingles(texts: list[str | None], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers for the n-word shingles of a few texts, and where each text's begin (and the end): equal numbers mean equal words,
    byte by byte. A text with fewer words has one, its whole sequence; a text's shingles may repeat."""
    data = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])]).astype(np.int64)
    starts, ends = word_bounds(data, offsets)
    _, words = distinct_words(LOWER[data], starts, ends)
    first = np.searchsorted(starts, offsets)
    words = np.concatenate([words.astype(np.int64) + 1, np.zeros(n, np.int64)])  # 0: none
    code = np.zeros(len(starts), np.int64)
    stop = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(starts))
    for k in range(n):
        next_word = np.where(at + k < stop, words[at + k], 0)
        code = np.unique((code << 31) | next_word, return_inverse=True)[1].astype(np.int64) + 1
    use = (stop - at >= n) | (at == np.repeat(first[:-1], np.diff(first)))
    return code[use], np.concatenate([[0], np.cumsum(use)])[first]


def shingle_sets(column: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; of one with fewer words, the whole sequence."""
    for _, data, offsets in batches_of(column):
        words, first, _, _ = scan(data, offsets)
        all_grams = grams(words, n) if len(words) >= n else words[:0]
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a < n:
                yield grams(words[a:b], n)
                continue
            s = np.sort(all_grams[a : b - n + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
