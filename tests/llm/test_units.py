"""Parts without Spark: hashing, suffix sorting, coding, packing, alignment, search, filters."""

import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelake.llm import decontam, langid, mixcoder, packing, suffixdedup, tokenfile, topk, words
from tidelake.llm.minhash import _multipliers, signature, similarity
from tidelake.llm.suffix import suffix_batches

TEXTS = ["a b c", "", None, "  A b\nC d e f ", "x" * 50 + " y", "é ü", "a b c d e f", "a\vb\tc\rd\fe", " ", "ab" * 700_000 + " z"]

settings.register_profile("unhurried", deadline=None)  # the first example pays for imports
settings.load_profile("unhurried")


def tuples(text, n=5):
    w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_shingles_match_tuples():
    found = list(words.shingle_sets(pa.array(TEXTS)))
    assert [len(x) for x in found] == [len(tuples(t)) for t in TEXTS]
    a, b = list(words.shingle_sets(pa.array(["A b C", "a  B\tc"])))
    assert (a == b).all()


@given(st.lists(st.text(alphabet="ab \n", max_size=30), max_size=6))
def test_words_never_cross_texts(texts):
    batch = pa.array(texts)
    got = []
    for _, data, offsets in words.batches_of(batch, 16):
        _, first, _, _ = words.scan(data, offsets)
        got += np.diff(first).tolist()
    assert got == [len(t.split()) for t in texts]


def shared(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.sampled_from([1 << 20, 50]), st.booleans())
def test_suffixes_and_prefixes(symbols, budget, tiled):
    text = np.array((symbols[:5] * 30 if tiled else symbols) + [0])
    batches = list(suffix_batches(text, cap=50, budget=budget))
    order = np.concatenate([p for p, _ in batches])[::-1]
    close = np.concatenate([c for _, c in batches])[::-1]
    plain = [bytes(text[i:].tolist()) for i in order]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all(a[:50] <= b[:50] for a, b in zip(plain, plain[1:]))
    assert [int(c) for c in close[:-1]] == [min(50, shared(a, b)) for a, b in zip(plain, plain[1:])]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=900))
def test_coder_round_trip(ids):
    block = mixcoder.encode_block(np.array(ids, np.int32))
    assert mixcoder.decode_block(block).tolist() == ids


def test_coder_mixes_orders():
    rng = np.random.default_rng(5)
    follow = rng.integers(0, 3000, (3000, 4))  # each id has four followers
    ids = [0]
    for k in rng.integers(0, 4, 60_000):
        ids.append(int(follow[ids[-1], k]))
    block = mixcoder.encode_block(np.array(ids, np.int32))
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    assert 8 * len(block) / len(ids) < 0.7 * -(share * np.log2(share)).sum()  # an order-0 coder can't do better than the entropy
    assert mixcoder.decode_block(block).tolist() == ids
    copied = np.array(ids[:1000] * 60, np.int32)
    assert 8 * len(mixcoder.encode_block(copied)) < 0.4 * 8 * len(block)


def _thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def _texts_ids(tokenizer, texts):
    out = []
    for _, data, offsets in words.batches_of(pa.array(texts, pa.string())):
        ids, n = tokenizer.ids(data, offsets)
        out += np.split(ids, np.cumsum(n)[:-1])
    return [x.tolist() for x in out]


def test_words_are_told_apart_by_their_bytes(vocabulary):
    plain = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    one = _thue_morse(1024)
    rng = np.random.default_rng(7)
    texts = [one, one.translate(str.maketrans("ab", "ba")), *("".join(rng.choice(list("abcdefgh"), 400)) for _ in range(20)), one]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] != want[1] and _texts_ids(tokenfile.WordTokenizer(vocabulary), texts) == want


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(list("aBé1٣.'-,(<|> \n\ts\u0301\u0338") + ["<|endoftext|>", "'ll", "can't", "Ab1.c"])).map("".join), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(vocabulary, texts):
    plain = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    few = tokenfile.WordTokenizer(vocabulary, most=3)  # nearly every batch overflows it
    for _ in range(2):
        assert _texts_ids(few, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_coder_compresses_and_detects_damage():
    ids = np.tile(np.arange(50, dtype=np.int32), 2000)
    block = mixcoder.encode_block(ids)
    assert len(block) < len(ids) / 2 and (mixcoder.decode_block(block) == ids).all()
    for bad in (block[:-1], b"XXXX" + block[4:], block[:40] + bytes([block[40] ^ 1]) + block[41:]):
        with pytest.raises(ValueError):
            mixcoder.decode_block(bad)


@given(st.binary(max_size=40), st.binary(max_size=40))
def test_checksums_join(a, b):
    assert tokenfile.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit(sizes):
    bins, caps = packing.best_fit(sizes, (16, 32, 64))
    used = [0] * len(caps)
    for s, b in zip(sizes, bins):
        used[b] += s
    for u, c in zip(used, caps):
        assert 0 < u <= c and (c == 16 or u > c // 2)  # downsized: the next smaller length wouldn't hold it
    assert len(caps) <= 2 * -(-sum(sizes) // 64) + 1


def _total_cost(caps):
    return sum(packing.length_cost(c) for c in caps)


def test_mixed_lengths_beat_the_longest_alone():
    rng = np.random.default_rng(2)
    chosen = set()
    for sizes in (rng.integers(1, 900, 3000), rng.integers(300, 512, 2000), np.concatenate([rng.integers(1, 200, 3000), rng.integers(1500, 4096, 300)]), rng.zipf(1.3, 4000) % 4096 + 1):
        sizes = sizes.tolist()
        _, mixed = packing.best_fit(sizes, (512, 1024, 2048, 4096))
        _, alone = packing.best_fit(sizes, (4096,))
        assert _total_cost(mixed) < 0.97 * _total_cost(alone) and sum(sizes) / sum(mixed) > 0.9
        chosen |= set(mixed)
    assert chosen == {512, 1024, 2048, 4096}


@given(st.lists(st.integers(1, 12), min_size=1, max_size=7))
def test_packing_is_near_the_cheapest(sizes):
    """Against every way to share out a few pieces."""
    caps = (4, 8, 12)

    def price(used):
        return sum(packing.length_cost(min(c for c in caps if c >= u), 40.0, 1.0) for u in used)

    def best(k, used):
        if k == len(sizes):
            return price(used)
        found = best(k + 1, [*used, sizes[k]])
        for b, u in enumerate(used):
            if u + sizes[k] <= 12:
                found = min(found, best(k + 1, [*used[:b], u + sizes[k], *used[b + 1 :]]))
        return found

    bins, got = packing.best_fit(sizes, caps, 40.0, 1.0)
    used = [0] * len(got)
    for s, b in zip(sizes, bins):
        used[b] += s
    assert got == [min(c for c in caps if c >= u) for u in used]
    assert best(0, []) - 1e-9 <= price(used) <= 1.7 * best(0, [])


def test_alignment():
    w = words.scan(np.frombuffer(b"a b c d e f g h", np.uint8).copy(), np.array([0, 15]))[0]
    gap, swap = np.delete(w, 3), w.copy()
    swap[4] = 1
    got = decontam.align([w, w, w, w], [w, gap, swap, w[:0]])
    assert got.tolist() == [1.0, (7 * 2 - 1) / 16, (7 * 2 - 1) / 16, 0.0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 60), st.integers(1, 5), st.sampled_from([1, 4, 64]))
def test_dual_tree_is_exact(seed, n, k, leaf):
    rng = np.random.default_rng(seed)
    x = rng.integers(-4, 5, (n, 6))
    x[n // 2 :] = x[: n - n // 2]  # ties and copies
    ids = rng.permutation(n)
    rows = np.flatnonzero(ids % 3 == 0)
    if not len(rows):
        return
    tq, tr = topk.CoverTree(ids[rows], x[rows], leaf), topk.CoverTree.load(topk.CoverTree(ids, x, leaf).dump())
    best = topk.Best(len(rows), k)
    topk.search(tq, tr, best)
    for r in range(len(rows)):
        q = int(np.flatnonzero(ids == tq.ids[r])[0])
        want = sorted(((-int(x[q] @ x[j]), int(ids[j])) for j in range(n) if ids[j] != ids[q]))[:k]
        assert [(-int(s), int(i)) for s, i in zip(best.score[best.row == r], best.id[best.row == r])] == want


def _nodes_cover(tree):
    for k in range(len(tree.row)):
        x = tree.points[tree.start[k] : tree.stop[k]].astype(float)
        assert np.sqrt(((x - tree.centre[k]) ** 2).sum(1)).max() <= tree.radius[k] + 1e-9
        for a in tree.children[k]:
            assert tree.radius[a] <= tree.radius[k] / 2 + 1e-9 and tree.start[k] <= tree.start[a] < tree.stop[a] <= tree.stop[k]


def test_search_prunes_clusters():
    rng = np.random.default_rng(6)
    centres = rng.integers(-3000, 3000, (40, 16))
    x = np.repeat(centres, 50, axis=0) + rng.integers(-20, 21, (2000, 16))
    ids = np.arange(2000)
    tree, queries = topk.CoverTree(ids, x), topk.CoverTree(ids[::20], x[::20])
    _nodes_cover(tree)
    assert len(tree.row) > 40 and max(len(c) for c in tree.children) > 1
    best = topk.Best(100, 10)
    scored, bounded = topk.search(queries, tree, best)
    assert scored + bounded < 0.25 * 100 * 2000
    again = topk.Best(100, 10)
    again.floor = best.floor.copy()  # as a later round starts
    later, _ = topk.search(queries, tree, again)
    assert later <= scored and np.array_equal(np.sort(again.id), np.sort(best.id))


def test_large_components_stay_exact():
    """Scores beyond 64 bits, and such that differ in the last digit only."""
    big = np.array([[2**45, 1, 0], [2**45, 2, 0], [2**45, 2, 1], [2**31, 0, 5], [-(2**45), 7, 0]], np.int64)
    tree, best = topk.CoverTree(np.arange(5), big), topk.Best(5, 4)
    topk.search(tree, tree, best)
    for r in range(5):
        q = tree.ids[r]
        want = sorted((-sum(int(a) * int(b) for a, b in zip(big[q], big[j])), j) for j in range(5) if j != q)
        assert [(-int(s), int(i)) for s, i in zip(best.score[best.row == r], best.id[best.row == r])] == want


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64))
    b = np.concatenate([a[:2000], np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))])
    m = _multipliers(400)
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(similarity(signature(a, m), signature(b, m)) - truth) < 0.06
    one = signature(a[:1], m)
    assert (one[0::2] == one[1::2]).all()


def test_filter_decides_as_plain_sets_do():
    rng = np.random.default_rng(8)
    letters = {"x": "abcde", "y": "defgh", "z": "ghiab"}

    def text(lang, n):
        return " ".join("".join(rng.choice(list(letters[lang]), rng.integers(2, 7))) for _ in range(n))

    def grams(t):
        padded = (" " + t + "   ").encode()
        return [int.from_bytes(padded[k : k + 4], "little") for k in range(len(padded) - 3) if padded[k + 1] != 32]

    known = {lang: set(grams(text(lang, 300))) for lang in letters}
    model = langid.BitmaskFilter(list(known), {k: np.array(sorted(v)) for k, v in known.items()})
    texts = [text(lang, n) for lang in letters for n in (1, 3, 30, 300)]
    best, score = model.judge(pa.array(texts))
    for t, b, s in zip(texts, best, score):
        hits = [sum(g in known[k] for g in grams(t)) for k in known]
        assert hits[b] >= max(hits) - 0.02 * len(grams(t)) and abs(s - hits[b] / max(1, sum(hits))) < 0.05


def language_batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(["x"] * len(texts)), pa.array(texts)], ["lang", "text"])


def test_language_arrays_do_not_grow_with_the_batch():
    rng = np.random.default_rng(9)
    text = " ".join(" ".join("".join(w) for w in rng.choice(list("abcdefghi"), (4000, 6))) for _ in range(10))
    model = langid.BitmaskFilter(["x", "y"], {"x": np.arange(500), "y": np.arange(400, 900)})
    for texts in ([text[:2000]] * 8000, [text * 50]):  # 14 MB or more, as many texts and as one
        batch = language_batch(texts)
        for work in (lambda: model.judge(batch.column(1)), lambda: list(langid._count(iter([batch])))):
            tracemalloc.start()
            work()
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert peak < 16e6


def test_language_pieces_change_nothing(monkeypatch):
    texts = ["", None, "a", "Ab cd", "\u00c0 \u00c9t\u00e9 " * 9, "abc, defg; hi " * 40, " ", "x" * 64, "\u00df\u1e9e" * 33]
    batch = language_batch(texts)
    grams, n = langid._tally(batch.column(1))
    model = langid.BitmaskFilter(["x", "y"], {"x": grams[::2], "y": langid._tally(pa.array(texts[-1:]))[0]})
    want = model.judge(batch.column(1))
    assert len(set(want[0].tolist())) == 2 and n.sum() == sum(len((t or "").lower().encode()) for t in texts) - sum((t or "").count(x) for t in texts for x in " ,;")
    for piece, tally in ((1, 1), (2, 5), (7, 100), (64, 1)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "TALLY", tally)
        assert all((a == b).all() for a, b in zip(model.judge(batch.column(1)), want, strict=True))
        assert all((a == b).all() for a, b in zip(langid._tally(batch.column(1)), (grams, n), strict=True))
        [out] = langid._count(iter([batch]))
        assert out.column(1).to_pylist() == grams.tolist() and out.column(2).to_pylist() == n.tolist()


def test_bitmask_filter_answers_all_languages():
    grams = {"x": np.arange(0, 500), "y": np.arange(400, 900)}
    made = langid.BitmaskFilter(["x", "y"], grams)
    masks = made.languages_of(np.arange(0, 900))
    assert (masks[:500] & np.uint64(1)).all() and ((masks[400:] & np.uint64(2)) > 0).all()
    assert np.mean((masks[500:] & np.uint64(1)) > 0) < 0.05


def test_words_sent_to_the_model_directly_have_the_ids_of_whole_texts():
    import public_tokenizers

    from tidelake.llm.tokenfile import WordTokenizer

    tokenizer = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert tokenizer.direct
    letters = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(letters), n)) for n in rng.integers(1, 40, 400)]
    texts = [" ".join(words[:200]), " ".join(f"{a}'s {b}12 e\u0301{a} {b}\u0301 <{a}> \u00aa\u00b5\u00d7{b}" for a, b in zip(words[200:300], words[300:], strict=True)), "x" * 5000]
    raw = [t.encode() for t in texts]
    ids, sizes = tokenizer.ids(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    want = [e.ids for e in tokenizer.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_accented_words_are_parted_from_what_follows(vocabulary):
    plain = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    texts = ["\u00e9t\u00e9. \u00c9T\u00c9, (\u00e9t\u00e912) .\u00d7. \u00d7\u00e9t\u00e9 \u00e9't\u00e9 \u00e9\u0301. =\u0338\u00e9", "\u00e9t\u00e9", "\u00e9"]
    tokenizer = tokenfile.WordTokenizer(vocabulary)
    assert _texts_ids(tokenizer, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    known = {w.decode() for w in tokenizer.known.to_pylist()}
    assert {"\u00e9t\u00e9", "\u00c9t\u00c9", ".\u00d7."} <= known and not {"\u00e9t\u00e9.", "\u00c9t\u00c9,", "\u00e9t\u00e91"} & known


def test_capitals_before_marks_keep_their_case(vocabulary):
    plain = pytest.importorskip("tokenizers").Tokenizer.from_file(vocabulary)
    texts = ["T\u0308 t\u0308 xJ\u030c xj\u030c", "H\u0331W\u0323\u030aY\u030a", "T\u0308", "t\u0308", "I\u0307", "AB\u0416", "TU \u0308"]
    assert _texts_ids(tokenfile.WordTokenizer(vocabulary), texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_the_decoder_finds_keys_without_searching_them_all(monkeypatch):
    rng = np.random.default_rng(9)
    model, alphabet = mixcoder._Model(300), 300
    key = np.unique((rng.integers(0, 40, 3000) << mixcoder.ID_BITS) | rng.integers(0, alphabet, 3000))  # contexts from 40 on have no ids
    first = np.searchsorted(key >> mixcoder.ID_BITS, np.arange(alphabet + 2))
    model.zero_counts += np.bincount(key & 0xFFFF, minlength=alphabet)
    counts = rng.integers(1, 4, len(key))
    counts[first[:40]] = 5000  # one id of each context has most of its interval, so the others lie close together
    model.build(counts, first)
    reader = mixcoder._Reader(model, key, first, mixcoder._Guesses(len(key) + 1))
    c = rng.integers(0, 60, 20_000)
    u = rng.integers(0, model.total1[c])
    near = rng.integers(0, len(key), 5000)  # and the breakpoints themselves
    c, u = np.append(c, reader.key[near] >> mixcoder.KEY_SHIFT), np.append(u, reader.key[near] & ((1 << mixcoder.KEY_SHIFT) - 1))
    want = np.searchsorted(reader.key, (c << mixcoder.KEY_SHIFT) | u, side="right")
    searched = []
    plain = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, **kw: searched.append(len(v)) or plain(a, v, **kw))
    assert (reader.find(c, u) == want).all() and 0 < sum(searched) < len(c) / 2


def test_repeats_sort_only_segments_that_share_a_minimizer(monkeypatch):
    rng = np.random.default_rng(5)
    copy, passage = bytes(rng.integers(97, 123, 4000).astype(np.uint8)), bytes(rng.integers(97, 123, 500).astype(np.uint8))
    rest = [bytes(rng.integers(97, 123, 3000).astype(np.uint8)) for _ in range(2)]
    texts = [copy, rest[0] + passage, copy, passage + rest[1]]
    sorted_bytes = []
    monkeypatch.setattr(suffixdedup, "suffix_batches", lambda text, cap: sorted_bytes.append(len(text)) or suffix_batches(text, cap))
    rows = []
    for k, text in enumerate(texts):
        row = {"pack": k, "ids": np.array([k]).tobytes(), "sizes": np.array([len(text)]).tobytes(), "data": zstandard.compress(text), "n_bytes": len(text)}
        values, docs, first, last = suffixdedup._Pack(row["ids"], row["sizes"], row["data"]).runs(50, 20)
        pieces = [text[a : b + 50] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        rows.append({"pack": k, "bucket": 0, "a": np.arange(len(pieces), dtype=np.int32).tobytes(), "b": np.array([len(x) for x in pieces], np.uint8).tobytes(), "c": np.full(len(pieces), k).tobytes(), "d": zstandard.compress(b"".join(pieces))})
    verdicts = {r["pack"]: r for r in suffixdedup._judge(50, 20)(pa.Table.from_pylist(rows)).to_pylist()}
    assert sum(sorted_bytes) < 500  # the ends of the passage; copies and what surrounds it are known without
    counts = {k: sum(int(x).bit_count() for x in np.frombuffer(r["b"], np.uint64)) for k, r in verdicts.items()}
    assert counts == {2: 4000 - 49, 3: 500 - 49}
