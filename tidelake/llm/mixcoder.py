"""Adaptive context-mixing range coder for token ids, in independently reset, checksummed blocks.

A block's ids are cut into lanes of equal length that are coded in lockstep (numpy) with one shared model. The model counts ids
by themselves (order 0) and by the id before (order 1), and for the two ids before (order 2) keeps the id that followed
most, by majority vote. An id's probability mixes all three:

    P1 = l1 * n1(id) / N1 + (1 - l1) * P0        P = l2 * [id is the order-2 guess] + (1 - l2) * P1

The weights l1 and l2 belong to states (how much a context has seen, and how clearly) and are learned while coding, by the
share of the probability that each side of a mix earned. Counts, guesses and weights change between generations of steps, which
both sides know, and stand still within one; so the encoder prices a generation at once. Cumulative widths are whole numbers in
the order of ids, so a decoder finds an id by the guess's interval, else by the breakpoints of the order-1 list, else in the
order-0 table. The range coder has 64 bits of state and 16-bit output words; carries are settled at the block's end.

Block: magic 'TLB2', then little-endian uint32: number of ids, lanes, crc32 of the ids (uint32 each), crc32 of the rest, size of the
alphabet; the rest: the alphabet (which ids occur, as a deflated bitmap), uint32 word counts of the lanes, then their words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TLB2"
LANES, LANE_LEAST = 4096, 128
ID_BITS, ZERO_BITS = 16, 17  # ids; the total of order 0
SHARES = 64  # l1 and l2 are multiples of 1 / SHARES
ONE_BITS = 13  # counts of a context are halved until their sum has so many bits
EARNED = 256  # the unit in which earnings are summed
EARLY = 32  # steps that the encoder prices with a table of their own
LEARN_STEPS = 4  # weights learn from every fourth step
KEY_SHIFT = 40  # an order-1 breakpoint is below this, its context above it
STATE_BITS = 7  # an order-2 state + 1
PROBES = 4  # keys after a slot's first one that the decoder looks at, before it searches them all
U = np.uint64
I = np.int64


def _generations(steps: int) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < steps:
        to = min(steps, at + max(1, min(at, 128)))
        out.append((at, to))
        at = to
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(I)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over the groups that begin at ``first`` (one entry more than groups)."""
    total = np.zeros(len(x) + 1, I)
    np.cumsum(x, out=total[1:])
    return np.diff(total[first])


def _halved(counts: np.ndarray, first: np.ndarray, bits: int) -> np.ndarray:
    """Counts scaled group by group until no sum has more than ``bits`` bits or so."""
    raw = _sums(counts, first)
    big = np.flatnonzero(raw >> bits)
    if not len(big):
        return counts
    n = counts.copy()
    sizes = first[big + 1] - first[big]
    at = np.repeat(first[big] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    shift = np.repeat(_bits(raw[big]) - bits, sizes)
    n[at] = (n[at] + ((1 << shift) >> 1)) >> shift
    return n


class _Weights:
    """The mixing weight of each state, from what the two sides of a mix earned."""

    def __init__(self, first: np.ndarray):
        self.first = (first * EARNED).astype(I)
        self.earned, self.seen = np.zeros(len(first), I), np.zeros(len(first), I)

    def of(self, state: np.ndarray) -> np.ndarray:
        share = SHARES * (self.earned + 16 * self.first) // (EARNED * (self.seen + 16))
        return np.clip(share, 1, SHARES - 1)[state]

    def learn(self, state: np.ndarray, own: np.ndarray, width: np.ndarray) -> None:
        """own: the part of the interval that one side of the mix gave; earlier generations count half."""
        size = len(self.seen)
        self.earned = (self.earned >> 1) + np.bincount(state, (own * float(EARNED) / width).astype(I), size).astype(I)
        self.seen = (self.seen >> 1) + np.bincount(state, minlength=size)


class _Model:
    """What one generation codes by. Pairs (id before + 1, id) come sorted; ``first`` says where each id before begins."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.zero_counts = np.zeros(alphabet, I)
        ratio = np.arange(16)
        self.weights1 = _Weights(np.tile(2.0**ratio / (2.0**ratio + 1), 16))
        self.weights2 = _Weights(np.tile(np.arange(1, 9) / 12, 8))

    def build(self, raw: np.ndarray, first: np.ndarray) -> None:
        spare = (1 << ZERO_BITS) - self.alphabet
        cum = np.concatenate([[0], np.cumsum(self.zero_counts)])
        self.zero = cum * spare // max(1, cum[-1]) + np.arange(self.alphabet + 1)
        if not cum[-1]:
            self.zero[-1] = 1 << ZERO_BITS
        self.n1 = _halved(raw, first, ONE_BITS)
        self.sums1 = np.concatenate([[0], np.cumsum(self.n1)])
        self.base1 = self.sums1[first]
        total, kinds = np.diff(self.base1), _sums(self.n1 > 0, first)
        self.state1 = _bits(total) * 16 + _bits(total // np.maximum(kinds, 1))
        share = self.weights1.of(self.state1)
        self.some1 = total > 0
        self.a1 = np.where(self.some1, share << ZERO_BITS, 0)
        self.b1 = np.where(self.some1, (SHARES - share) * total, 1)
        self.total1 = np.where(self.some1, SHARES * total, 1) << ZERO_BITS

    def one(self, c: np.ndarray, x: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where an id's order-1 interval starts, its width, and the part of that which the counts give."""
        a, b, low = self.a1[c], self.b1[c], self.zero[x]
        own = a * n
        return a * before + b * low, own + b * (self.zero[x + 1] - low), own

    def learn(self, c: np.ndarray, own1: np.ndarray, width1: np.ndarray, state2: np.ndarray, own2: np.ndarray, width2: np.ndarray) -> None:
        some = np.flatnonzero(self.some1[c])
        self.weights1.learn(self.state1[c[some]], own1[some], width1[some])
        some = np.flatnonzero(state2 >= 0)
        self.weights2.learn(state2[some], own2[some], width2[some])


class _Guesses:
    """For each pair, the id that followed it most: the majority vote of generations."""

    def __init__(self, pairs: int):
        self.guess, self.lead, self.seen = (np.zeros(pairs, I) for _ in range(3))

    def moved(self, places: np.ndarray, pairs: int) -> None:
        for name in ("guess", "lead", "seen"):
            new = np.zeros(pairs, I)
            new[places] = getattr(self, name)
            setattr(self, name, new)

    def vote(self, pair: np.ndarray, x: np.ndarray, names: np.ndarray | None = None) -> None:
        """``pair``: places in the table, or in the sorted ``names`` of its pairs."""
        if not len(pair):
            return
        key = np.sort((pair.astype(I) << ID_BITS) | x)
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n, key = np.diff(np.append(head, len(key))), key[head]
        p = key >> ID_BITS
        group = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        best = np.maximum.reduceat((n << ID_BITS) | (0xFFFF - (key & 0xFFFF)), group)
        p = p[group] if names is None else np.searchsorted(names, p[group])
        total, n, x = np.add.reduceat(n, group), best >> ID_BITS, 0xFFFF - (best & 0xFFFF)
        lead = np.where(self.guess[p] == x, self.lead[p] + n, self.lead[p] - n)
        self.guess[p] = np.where(lead < 0, x, self.guess[p])
        self.lead[p] = np.abs(lead)
        self.seen[p] += total

    def states(self) -> np.ndarray:
        """-1 without a guess."""
        return np.where(self.lead > 0, np.minimum(_bits(self.seen), 8) * 8 - 8 + np.minimum(8 * self.lead // np.maximum(self.seen, 1), 7), -1)


def _layout(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LANE_LEAST))
    return lanes, -(-n // lanes)


class _Writer:
    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, U), np.full(lanes, (1 << 64) - 1, U)
        self.words = np.zeros((3 * steps + 6, lanes), np.int32)  # row 0 takes no word
        self.used = np.zeros(lanes, I)
        self.lanes = np.arange(lanes)

    def code(self, start: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        r = self.range // total
        low = self.low + start * r
        rng = size * r
        over = np.flatnonzero(low < self.low)
        if len(over):
            self.words[self.used[over], over] += 1
        small = np.flatnonzero(rng < U(1 << 48))
        while len(small):
            self.used[small] += 1
            part = low[small]
            self.words[self.used[small], small] = (part >> U(48)).astype(np.int32)
            low[small] = part << U(16)
            part = rng[small] << U(16)
            rng[small] = part
            small = small[part < U(1 << 48)]
        self.low, self.range = low, rng

    def finish(self) -> list[np.ndarray]:
        for shift in (48, 32, 16, 0):
            self.used += 1
            self.words[self.used, self.lanes] = ((self.low >> U(shift)) & U(0xFFFF)).astype(np.int32)
        words = np.ascontiguousarray(self.words[: int(self.used.max()) + 1].T)
        while True:
            carry = words >> 16
            if not carry.any():
                break
            words &= 0xFFFF
            words[:, :-1] += carry[:, 1:]
        return [words[k, 1 : n + 1].astype("<u2") for k, n in enumerate(self.used.tolist())]


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and each key's place among them. Keys and positions share 64 bits, so one plain sort does."""
    bits = max(1, int(keys.size - 1).bit_length())
    mixed = np.sort((keys.ravel() << bits) | np.arange(keys.size))
    key = mixed >> bits
    head = np.empty(len(key), bool)
    head[:1] = True
    np.not_equal(key[1:], key[:-1], out=head[1:])
    place = np.empty(len(key), np.int32)
    place[mixed & ((1 << bits) - 1)] = np.cumsum(head, dtype=np.int32) - 1
    return key[head], place.reshape(keys.shape)


def _pairs(columns: np.ndarray) -> np.ndarray:
    """(id before + 1, id), 0 where a lane has none before."""
    before = np.zeros(columns.shape, I)
    before[1:] = columns[:-1] + 1
    return (before << ID_BITS) | columns


def encode_block(ids: np.ndarray) -> bytes:
    """One block of less than 2**24 ids below 2**16."""
    ids = np.ascontiguousarray(ids, np.int32)
    n = len(ids)
    lanes, steps = _layout(n)
    there = np.bincount(ids, minlength=1 << ID_BITS) > 0
    alphabet = int(there.sum())
    columns = np.zeros(lanes * steps, I)
    columns[:n] = (np.cumsum(there) - 1)[ids]
    columns = columns.reshape(lanes, steps).T.copy()
    out = _Writer(lanes, steps)
    if n:
        model = _Model(alphabet)
        generations = _generations(steps)
        early = [g for g in generations if g[1] <= EARLY]  # their pairs are few
        for some in (early, generations[len(early) :]):
            if some:
                _encode(columns[: some[-1][1]], some, model, out, some[-1][1] == steps)
    words = out.finish()
    rest = zlib.compress(np.packbits(there).tobytes(), 9)
    rest += np.array([len(w) for w in words], "<u4").tobytes() + b"".join(w.tobytes() for w in words)
    return MAGIC + struct.pack("<5I", n, lanes, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest), alphabet) + rest


def _encode(columns: np.ndarray, generations: list[tuple[int, int]], model: _Model, out: _Writer, last: bool) -> None:
    key, place = _ranked(_pairs(columns))
    none = len(key)
    own_of = key >> ID_BITS
    first = np.searchsorted(own_of, np.arange(model.alphabet + 2))
    raw = np.zeros(none, I)
    guesses = _Guesses(none + 1)
    begin = generations[0][0]
    for a, b in _generations(begin):  # what earlier generations taught
        raw += np.bincount(place[a:b].ravel(), minlength=none)
        guesses.vote(place[max(0, a - 1) : b - 1].ravel(), columns[max(1, a) : b].ravel())
    for a, b in generations:
        model.build(raw, first)
        start_of, width_of, part_of = model.one(own_of, key & ((1 << ID_BITS) - 1), model.sums1[:-1] - model.base1[own_of], model.n1)
        state = guesses.states()
        share = np.where(state >= 0, model.weights2.of(np.maximum(state, 0)), 0)
        x, p = columns[a:b], place[a:b]
        c = own_of[p]
        start, width1, own1, total = start_of[p], width_of[p], part_of[p], model.total1[c]
        j = np.full(p.shape, none, np.int32)
        j[1 if a == 0 else 0 :] = place[max(0, a - 1) : b - 1]
        state2 = state[j]
        l2 = share[j]
        gap = l2 * total
        guess = guesses.guess[j]
        m = np.where(l2 > 0, SHARES - l2, 1)
        own2 = np.where(x == guess, gap, 0)
        start = m * start + np.where(x > guess, gap, 0)
        width2 = m * width1 + own2
        total *= np.where(l2 > 0, SHARES, 1)
        for k in range(b - a):
            out.code(start[k].view(U), width2[k].view(U), total[k].view(U))
        if last and b == len(columns):  # nothing is left to learn for
            break
        step = slice(-a % LEARN_STEPS, None, LEARN_STEPS)
        model.learn(c[step].ravel(), own1[step].ravel(), width1[step].ravel(), state2[step].ravel(), own2[step].ravel(), width2[step].ravel())
        model.zero_counts += np.bincount(x.ravel(), minlength=model.alphabet)
        raw += np.bincount(p.ravel(), minlength=none)
        guesses.vote(place[max(0, a - 1) : b - 1].ravel(), columns[max(1, a) : b].ravel())


def _merged(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and counts with more of them, and the new places of the old keys."""
    more = np.sort(more)
    head = np.flatnonzero(np.concatenate([[True], more[1:] != more[:-1]]))
    fresh, n = more[head], np.diff(np.append(head, len(more)))
    at = np.searchsorted(keys, fresh)
    old = np.zeros(len(fresh), bool)
    inside = at < len(keys)
    old[inside] = keys[at[inside]] == fresh[inside]
    counts[at[old]] += n[old]
    where, new = at[~old], fresh[~old]
    moved = np.arange(len(keys)) + np.searchsorted(new, keys)
    out, total = np.empty(len(keys) + len(new), I), np.empty(len(keys) + len(new), I)
    there = where + np.arange(len(new))
    out[moved], total[moved], out[there], total[there] = keys, counts, new, n[~old]
    return out, total, moved


class _Reader:
    """A generation's tables for the decoder."""

    def __init__(self, model: _Model, key: np.ndarray, first: np.ndarray, guesses: _Guesses):
        self.none = len(key)
        self.zero, self.sums1, self.a1, self.b1, self.total1, self.first = model.zero, model.sums1, model.a1, model.b1, model.total1, first
        c, x = key >> ID_BITS, key & ((1 << ID_BITS) - 1)
        start, width, own = model.one(c, x, model.sums1[:-1] - model.base1[c], model.n1)
        self.key = np.append((c << KEY_SHIFT) | start, np.iinfo(I).max)
        # a context's interval is cut into as many equal slots as it has ids; where the keys of each slot begin
        self.slots = np.diff(first)
        slot = first[c] + start * self.slots[c] // model.total1[c]
        self.guide = np.zeros(len(key) + 1, I)
        np.cumsum(np.bincount(slot, minlength=len(key)), out=self.guide[1:])
        # order 1, by the pair: id, begin and end of its interval, the part that the counts give; one row is one line of cache
        self.pairs = np.zeros((len(key) + 1, 4), I)
        for k, v in enumerate((x, start, start + width, own)):
            self.pairs[:-1, k] = v
        # order 2, by its state + 1: the guess's share, order 1's factor, multiple of the total
        shares = model.weights2.of(np.arange(len(model.weights2.seen)))
        self.share, self.factor, self.times = np.append(0, shares), np.append(1, SHARES - shares), np.append(1, np.full(len(shares), SHARES))
        # order 2, by the pair before: begin and end of the guess's interval, its pair and the state + 1; half a line of cache
        state = guesses.states()
        there = np.flatnonzero(state >= 0)
        c2, state = x[there] + 1, state[there] + 1
        g = np.searchsorted(key, (c2 << ID_BITS) | guesses.guess[there])
        begin = self.factor[state] * start[g]
        self.rows = np.full((len(key) + 1, 4), 1 << 62, I)
        self.rows[:, 2] = 0
        self.rows[there, 0], self.rows[there, 2] = begin, (g << STATE_BITS) | state
        self.rows[there, 1] = begin + self.share[state] * model.total1[c2] + self.factor[state] * width[g]

    def find(self, c: np.ndarray, u: np.ndarray) -> np.ndarray:
        """How many keys are at most (c, u): from the slot's first one on, the few that remain after that by a search of all."""
        want = (c << KEY_SHIFT) | u
        q = self.guide[self.first[c] + u * self.slots[c] // self.total1[c]]
        left = np.flatnonzero(self.key[q] <= want)
        for _ in range(PROBES):
            if not len(left):
                return q
            at = q[left] + 1
            q[left] = at
            left = left[self.key[at] <= want[left]]
        q[left] = np.searchsorted(self.key, want[left], side="right")
        return q

    def step(self, c: np.ndarray, j: np.ndarray, code: np.ndarray, rng: np.ndarray, words: np.ndarray, at: np.ndarray, said: list | None) -> tuple[np.ndarray, np.ndarray]:
        """Decodes an id of every lane; returns the next contexts."""
        begin, end, guess = np.ascontiguousarray(self.rows.take(j, axis=0).T)[:3]
        state, total = guess & ((1 << STATE_BITS) - 1), self.total1[c]
        m, gap = self.factor[state], self.share[state] * total
        total *= self.times[state]
        r = rng // total.view(U)
        v = np.minimum((code // r).view(I), total - 1)
        above = v >= end
        hit = (v >= begin) & ~above
        left = np.flatnonzero(~hit)
        cl = c[left]
        ul = (v[left] - np.where(above[left], gap[left], 0)) // m[left]
        pair = guess >> STATE_BITS
        q = self.find(cl, ul)
        if self.none:
            pair[left] = np.maximum(q - 1, 0)
            x, start, end1, own = np.ascontiguousarray(self.pairs.take(pair, axis=0).T)
            miss = np.flatnonzero((q <= self.first[cl]) | (ul >= end1[left]))
            new, cn, un, q = left[miss], cl[miss], ul[miss], q[miss]
            pair[new] = self.none
            width = end1 - start
        else:
            new, cn, un = left, cl, ul
            pair = np.zeros(len(c), I)
            x, start, width, own = (np.zeros(len(c), I) for _ in range(4))
        b1 = self.b1[cn]
        gone = self.a1[cn] * (self.sums1[q] - self.sums1[self.first[cn]])
        ids = np.searchsorted(self.zero, (un - gone) // b1, side="right") - 1
        low = self.zero[ids]
        x[new], own[new] = ids, 0
        start[new] = gone + b1 * low
        width[new] = b1 * (self.zero[ids + 1] - low)
        own2 = np.where(hit, gap, 0)
        start = m * start + np.where(above, gap, 0)
        width2 = m * width + own2
        if said is not None:
            said.append((c, own, width, state - 1, own2, width2))
        code -= start.view(U) * r
        np.multiply(width2.view(U), r, out=rng)
        small = np.flatnonzero(rng < U(1 << 48))
        while len(small):
            w = at[small]
            code[small] = (code[small] << U(16)) | words[np.minimum(w, len(words) - 1)].astype(U)
            at[small] = w + 1
            part = rng[small] << U(16)
            rng[small] = part
            small = small[part < U(1 << 48)]
        return x + 1, pair


def decode_block(block: bytes) -> np.ndarray:
    """The ids; ValueError if the block is damaged."""
    if block[:4] != MAGIC or len(block) < 24:
        raise ValueError("not a block")
    n, lanes, ids_crc, rest_crc, alphabet = struct.unpack("<5I", block[4:24])
    if zlib.crc32(block[24:]) != rest_crc or _layout(n)[0] != lanes:
        raise ValueError("the block is damaged")
    steps = _layout(n)[1]
    bitmap = zlib.decompressobj()
    there = np.unpackbits(np.frombuffer(bitmap.decompress(block[24:]), np.uint8))
    payload = bitmap.unused_data
    sizes = np.frombuffer(payload, "<u4", lanes).astype(I)
    words = np.append(np.frombuffer(payload, "<u2", offset=4 * lanes), np.zeros(8, "<u2"))
    at = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, U)
    for k in range(4):
        code = (code << U(16)) | words[at + k].astype(U)
    at += 4
    rng = np.full(lanes, (1 << 64) - 1, U)
    columns = np.zeros((steps, lanes), I)
    if n:
        model, guesses = _Model(alphabet), _Guesses(1)
        key, raw = np.zeros(0, I), np.zeros(0, I)
    for a, b in _generations(steps) if n else []:
        first = np.searchsorted(key >> ID_BITS, np.arange(alphabet + 2))
        model.build(raw, first)
        reader = _Reader(model, key, first, guesses)
        c, j = np.zeros(lanes, I), np.full(lanes, len(key))
        if a:
            c = columns[a - 1] + 1
            j = np.searchsorted(key, ((columns[a - 2] + 1 if a > 1 else 0) << ID_BITS) | columns[a - 1])
        said: list[tuple] = []
        for step in range(a, b):
            c, j = reader.step(c, j, code, rng, words, at, said if step % LEARN_STEPS == 0 else None)
            columns[step] = c - 1
            if not reader.none:
                j = np.zeros(lanes, I)  # no pair is known yet, so no guess
        if b == steps:  # nothing is left to learn for
            break
        nothing = [np.zeros(0, I)] * 6
        model.learn(*(np.concatenate(part) for part in zip(nothing, *said, strict=True)))
        model.zero_counts += np.bincount(columns[a:b].ravel(), minlength=alphabet)
        pairs = _pairs(columns[max(0, a - 1) : b])
        if a > 1:
            pairs[0] = ((columns[a - 2] + 1) << ID_BITS) | columns[a - 1]
        key, raw, moved = _merged(key, raw, (pairs if a == 0 else pairs[1:]).ravel())
        guesses.moved(np.append(moved, len(key)), len(key) + 1)
        guesses.vote(pairs[:-1].ravel(), columns[max(1, a) : b].ravel(), key)
    ids = np.flatnonzero(there)[columns.T.ravel()[:n]].astype(np.int32) if n else np.zeros(0, np.int32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the block's ids are damaged")
    return ids
