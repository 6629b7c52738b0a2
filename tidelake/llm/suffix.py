"""Suffix sorting by external induced sorting, with common-prefix values.

A suffix is induced from its successor: sorted S*-suffixes (an S-type suffix after an L-type one) induce the L-type
suffixes in ascending order, and those induce the S-type suffixes in descending order. The work list is a monotone
priority queue on (first character, rank of the successor). Since successors leave the queue in rank order, each
character's entries are already in order, so the queue is one first-in first-out run per character; runs above the
memory budget go to disk. Entries are taken in batches (numpy) and carry position and common-prefix length with the
entry before: 1 + the least value between the two successors, found by a range-minimum table.

S*-suffixes are ordered by naming their substrings and sorting the string of names: recursively while its
alphabet is small, otherwise by doubling ranks. Common-prefix lengths and orders are exact up to ``cap`` characters;
suffixes that agree on more are in any order.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

SMALL_ALPHABET = 1024


class BucketQueue:
    """Runs of (position, common prefix) per character; beyond ``budget`` bytes they are kept in a temporary file."""

    def __init__(self, sigma: int, budget: int):
        self.runs: list[deque] = [deque() for _ in range(sigma)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.budget:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.runs[c].append((at, len(pos)))
        else:
            self.held += size
            self.runs[c].append((pos, lcp))

    def take(self, c: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Entries of a character, about ``most`` at a time, until none is left, those pushed meanwhile included."""
        while self.runs[c]:
            runs, n = [], 0
            while self.runs[c] and n < most:
                a, b = self.runs[c].popleft()
                if isinstance(a, int):
                    self.file.seek(a)
                    a, b = np.frombuffer(self.file.read(8 * b), np.int64), np.frombuffer(self.file.read(b), np.uint8)
                else:
                    self.held -= a.nbytes + b.nbytes
                runs.append((a, b))
                n += len(a)
            yield np.concatenate([a for a, _ in runs]), np.concatenate([b for _, b in runs])

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _types(text: np.ndarray) -> np.ndarray:
    """True where the suffix is S-type; the last one is."""
    n = len(text)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(text[1:].astype(np.int64) - text[:-1])
    rise[-1] = 1
    at = np.flatnonzero(rise)
    return np.repeat(rise[at] > 0, np.diff(at, prepend=-1))  # equal neighbours have the type of what follows them


class _Inducer:
    """One direction's pass: takes batches in order and gives what they induce to the queue."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, sigma: int, cap: int, budget: int):
        self.text, self.wanted, self.cap = text, wanted, cap
        self.queue = BucketQueue(sigma, budget)
        self.least = np.zeros(sigma, np.uint8)  # of the common prefixes since a character's last entry
        self.begun = np.zeros(sigma, bool)

    def feed(self, pos: np.ndarray, lcp: np.ndarray) -> None:
        if not len(pos):
            return
        valid = np.flatnonzero(pos > 0)
        valid = valid[self.wanted[pos[valid] - 1]]
        low = lcp.min()
        if not len(valid):
            np.minimum(self.least, low, out=self.least)
            return
        before = pos[valid] - 1
        chars = self.text[before]
        order = np.argsort(chars, kind="stable")
        chars, idx, before = chars[order], valid[order], before[order]
        head = np.empty(len(chars), bool)
        head[0] = True
        np.not_equal(chars[1:], chars[:-1], out=head[1:])
        table = [lcp]
        width = 1
        while 2 * width <= len(lcp):
            last = table[-1]
            table.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        lo = np.where(head, 0, np.concatenate([[0], idx[:-1] + 1]))
        span = idx - lo + 1
        level = np.frexp(span.astype(np.float64))[1] - 1
        shared = np.empty(len(idx), np.uint8)
        for k in np.unique(level).tolist():
            m = level == k
            shared[m] = np.minimum(table[k][lo[m]], table[k][idx[m] - (1 << k) + 1])
        firsts = np.flatnonzero(head)
        present = chars[firsts].astype(np.int64)
        shared[firsts] = np.minimum(shared[firsts], self.least[present])
        out = np.minimum(shared.astype(np.int16) + 1, self.cap).astype(np.uint8)
        out[firsts[~self.begun[present]]] = 0
        self.begun[present] = True
        stops = np.append(firsts[1:], len(chars))
        np.minimum(self.least, low, out=self.least)
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        after = idx[stops - 1] + 1
        self.least[present] = np.where(after < len(lcp), tail[np.minimum(after, len(lcp) - 1)], 255)
        for c, a, b in zip(present.tolist(), firsts.tolist(), stops.tolist(), strict=True):
            self.queue.push(c, before[a:b], out[a:b])


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefixes, up to ``cap``, of pairs of suffixes, by direct comparison."""
    out = np.zeros(len(a), np.uint8)
    alive = np.arange(len(a))
    for k in range(cap):
        x, y = a[alive] + k, b[alive] + k
        ok = (x < len(text)) & (y < len(text))
        alive, x, y = alive[ok], x[ok], y[ok]
        alive = alive[text[x] == text[y]]
        if not len(alive):
            break
        out[alive] += 1
    return out


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _names(text: np.ndarray, stype: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the S*-substrings (each up to and with the next S* position); characters carry their type."""
    n = len(text)
    code = text.astype(np.int64) * 2 + stype + 1
    ends = np.append(stars[1:], n - 1)
    length = ends - stars + 1
    bits = int(code.max()).bit_length()
    per = max(1, 62 // bits)
    rank = None
    for word in range(0, int(length.max()), per):
        active = np.flatnonzero(length > word) if rank is not None else np.arange(len(stars))
        key = np.zeros(len(active), np.int64)
        for k in range(per):
            at = stars[active] + word + k
            key = (key << bits) | np.where(word + k < length[active], code[np.minimum(at, n - 1)], 0)
        second = _dense(key) + 1
        if rank is None:
            rank = second - 1
        else:
            extra = np.zeros(len(stars), np.int64)
            extra[active] = second
            rank = _dense(rank * (int(second.max()) + 1) + extra)
    return rank


def _doubled(names: np.ndarray, cap: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by doubling, exact on ``cap`` names."""
    rank, depth, n = names, 1, len(names)
    while depth < cap and int(rank.max()) + 1 < n:
        key = np.zeros(n, np.int64)
        key[: max(0, n - depth)] = rank[depth:] + 1
        rank = _dense(rank * (n + 1) + key)
        depth *= 2
    return np.argsort(rank, kind="stable")


def suffix_batches(text: np.ndarray, cap: int = 50, budget: int = 64 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches of (positions, common prefix with the one before), in descending order of the suffixes.

    ``text`` is an array of non-negative integers whose last element is smaller than all others."""
    n = len(text)
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint8)
        return
    sigma = int(text.max()) + 1
    stype = _types(text)
    star = stype.copy()
    star[0] = False
    star[1:] &= ~stype[:-1]
    stars = np.flatnonzero(star)
    names = _names(text, stype, stars)
    if int(names.max()) + 1 == len(names):
        order = np.argsort(names)
    elif int(names.max()) < SMALL_ALPHABET and len(names) > 64:
        order = np.concatenate([p for p, _ in suffix_batches(np.append(names + 1, 0), cap, budget)])[::-1]
        order = order[order < len(names)]
    else:
        order = _doubled(names, cap)
    stars = stars[order]
    close = np.zeros(len(stars), np.uint8)
    close[1:] = _common(text, stars[:-1], stars[1:], cap)
    bounds = np.searchsorted(text[stars], np.arange(sigma + 1))

    def boundary(last: int | None, first: int) -> int:
        return 0 if last is None else int(_common(text, np.array([last]), np.array([first]), cap)[0])

    rising = _Inducer(text, ~stype, sigma, cap, budget)
    kept = BucketQueue(sigma, budget)  # the L-type suffixes of each character, ascending
    for c in range(sigma):
        last = None
        for pos, lcp in rising.queue.take(c):
            kept.push(c, pos, lcp)
            rising.feed(pos, lcp)
            last = int(pos[-1])
        a, b = int(bounds[c]), int(bounds[c + 1])
        if b > a:
            lcp = close[a:b].copy()
            lcp[0] = boundary(last, int(stars[a]))
            rising.feed(stars[a:b], lcp)
    rising.queue.close()

    falling = _Inducer(text, stype, sigma, cap, budget)
    for c in range(sigma - 1, -1, -1):
        last = None
        for pos, lcp in falling.queue.take(c):
            falling.feed(pos, lcp)
            yield pos, lcp
            last = int(pos[-1])
        runs = list(kept.take(c))
        for i in range(len(runs) - 1, -1, -1):
            pos, lcp = runs[i]
            down = np.empty(len(lcp), np.uint8)
            down[1:] = lcp[:0:-1]
            pos = pos[::-1].copy()
            down[0] = boundary(last, int(pos[0])) if i == len(runs) - 1 else runs[i + 1][1][0]
            falling.feed(pos, down)
            yield pos, down
            last = int(pos[-1])
        if c == 0 and n > 1:
            yield np.array([n - 1]), np.zeros(1, np.uint8)
    falling.queue.close()
    kept.close()
