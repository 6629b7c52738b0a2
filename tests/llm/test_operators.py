"""Every operator on a small table with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import decontam, langid, toxicity
from tidelake.llm.components import components
from tidelake.llm.linededup import drop_boilerplate
from tidelake.llm.minhash import near_duplicates
from tidelake.llm.packing import pack
from tidelake.llm.pii import personal_data
from tidelake.llm.suffixdedup import remove_repeats
from tidelake.llm.tokenfile import read_index, write_tokens
from tidelake.llm.topk import quantised, top_k

#: names that operators use inside
CLASH = {"id": "x", "rep": 1, "component": 2, "n": 3, "score": "y", "kept": 4, "pack": 5, "n_removed": "z", "base": 6, "mask": 7}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, rep int, component int, n int, score string, kept int, pack int, n_removed string, base int, mask int"


def docs(spark, *texts, ids=None, sources=None, langs=None):
    rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], f"s{i % 12}" if sources is None else sources[i], None, *CLASH.values()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(n))


BASE = prose(1, 80)
NEAR = " ".join([*BASE.split()[:40], "other", *BASE.split()[41:]])
TEXTS = [BASE, None, "", "   ", NEAR, BASE, prose(2, 9), "one two", "ONE  two", prose(3, 3000), NEAR + " " + prose(4, 2), BASE]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = find(rows[a][0]), find(rows[b][0])
                root[max(u, v)] = min(u, v)
    return [(i, len(s), find(i), i == find(i)) for (i, _), s in zip(rows, sets)]


def test_near_duplicates(spark):
    rows = list(enumerate(TEXTS))
    got = sorted(tuple(r) for r in near_duplicates(docs(spark, *TEXTS)).collect())
    assert got == brute_components(rows)
    many = [" ".join(w if (k * 7 + i) % 23 else f"{w}{i}" for k, w in enumerate(BASE.split())) for i in range(40)] + [BASE] * 20
    rows = list(enumerate(many))
    assert sorted(tuple(r) for r in near_duplicates(docs(spark, *many), block_docs=8).collect()) == brute_components(rows)
    odd = docs(spark, BASE, BASE, BASE, ids=[None, 5, 5])
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in near_duplicates(odd).collect()) == [(0, None, True), (5, 5, True), (5, 5, True)]
    assert near_duplicates(docs(spark, "x").limit(0)).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    other = prose(9, 60)
    close = other + " more"
    for rows in ([(5, BASE), (5, other), (9, close)], [(5, other), (5, BASE), (9, close)]):
        got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs(spark, *[t for _, t in rows], ids=[i for i, _ in rows])).collect())
        assert got == [(5, 5, True), (5, 5, True), (9, 5, False)]


def test_near_duplicates_in_buckets_of_several_groups(spark):
    """Chains and unlike pairs in shared buckets: links that no star confirms must be found in the second step."""
    rng = np.random.default_rng(11)
    base = prose(21, 120).split()
    many = []
    for i in range(70):
        words = list(base)
        for k in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[k] = f"w{i}x{k}"
        many.append(" ".join(words))
    for block in (4, 256):
        assert sorted(tuple(r) for r in near_duplicates(docs(spark, *many), block_docs=block).collect()) == brute_components(list(enumerate(many)))


def test_components_of_random_links_are_those_of_a_union_find(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))]
    least = {x: x for a, b in links if a != b for x in (a, b)}
    for _ in least:
        for a, b in links:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, found)) == sorted(least.items())


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (None, 3)], "x long, y long")
    found = {r["node"]: r["component"] for r in components(links, "x", "y").collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_repeats(rows, length=50):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            least[g] = min(i, least.get(g, i))
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(spark):
    texts = [*TEXTS, "ab" * 400, "x" + "ab" * 300, "é" * 60 + BASE[:49], BASE[100:160] + "é" * 40, "q" * 50, "q" * 49, prose(5, 30) + BASE[:50] + "!"]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in remove_repeats(docs(spark, *texts).repartition(3)).collect()}
    assert got == brute_repeats(list(enumerate(texts)))
    odd = {(r["doc_id"], r["n_removed"]) for r in remove_repeats(docs(spark, BASE, BASE, BASE, ids=[None, 5, 5])).collect()}
    assert odd == {(None, 0), (5, 0)} and remove_repeats(docs(spark, "x").limit(0)).count() == 0


def test_boilerplate(spark):
    texts = [f"own line {i}\n shared here \n\nown {i}" for i in range(12)] + [None, "", "shared here", "shared here\nlast"]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in drop_boilerplate(docs(spark, *texts)).collect()}
    assert out[0] == (texts[0], 4, 0) and out[5] == ("own line 5\n\nown 5", 4, 1) and out[12] == (None, 0, 0) and out[13] == ("", 1, 0) and out[14] == ("", 1, 1) and out[15] == ("last", 2, 1)
    few = drop_boilerplate(docs(spark, *texts[:9]))
    assert few.where("n_removed > 0").count() == 0 and set(few.columns) == set(docs(spark, "x").columns) | {"n_lines"}
    nine = [f"a{i}\nnear" for i in range(9)] + ["b\nnear"]  # nine sites and one without
    assert drop_boilerplate(docs(spark, *nine, sources=[f"s{i}" for i in range(9)] + [None])).where("n_removed > 0").count() == 0
    ten = drop_boilerplate(docs(spark, *nine, sources=[f"s{i}" for i in range(10)]))
    assert ten.where("n_removed = 1").count() == 9
    assert drop_boilerplate(docs(spark, "x").limit(0)).count() == 0
    assert drop_boilerplate(docs(spark, "x", "x", ids=[None, None])).where("n_removed > 0").count() == 0


def test_leaks(spark):
    items = {1: prose(10, 30), 2: prose(11, 16), 3: "just three words", 4: None, 5: ""}
    bench = spark.createDataFrame([(i, t, "x") for i, t in items.items()], "item_id long, text string, id string")
    w = items[1].split()
    edited = " ".join("changed" if k % 6 == 3 else x for k, x in enumerate(w))
    texts = [prose(12, 200) + " " + items[1] + " " + prose(13, 50), prose(14, 20) + " " + edited, items[2].upper() + "!!", "So JUST, three words.", prose(15, 300), None, "", " ".join(w[:5]) + prose(16, 40)]
    out = {r["doc_id"]: (r["contaminated"], r["item_id"], round(r["score"], 2)) for r in decontam.flag(docs(spark, *texts), bench).collect()}
    assert out[0] == (True, 1, 1.0) and out[1][:2] == (True, 1) and out[2] == (True, 2, 1.0) and out[3] == (True, 3, 1.0)
    assert [out[i][0] for i in (4, 5, 6, 7)] == [False] * 4
    sliced = {r["doc_id"]: r["contaminated"] for r in decontam.flag(docs(spark, *texts), bench, slice_words=20).collect()}
    assert sliced == {i: x[0] for i, x in out.items()}
    assert decontam.flag(docs(spark, "x").limit(0), bench).count() == 0 and decontam.flag(docs(spark, "x"), bench.limit(0)).where("contaminated").count() == 0


def test_edited_copies_beside_a_verbatim_one(spark):
    item = prose(30, 37).split()
    edited = [" ".join(f"e{i}x{k}" if k % 5 == 4 else w for k, w in enumerate(item)) for i in range(200)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    stock = [" ".join(item[:4]) + " " + prose(1000 + i, 60) for i in range(20)]
    out = {r["doc_id"]: r for r in decontam.flag(docs(spark, " ".join(item), *edited, *stock), bench).collect()}
    assert all(out[i]["contaminated"] and out[i]["item_id"] == 7 and out[i]["score"] > 0.7 for i in range(201))
    assert not any(out[i]["contaminated"] for i in range(201, 221))


def test_packing(spark):
    texts = [prose(i, n) for i, n in enumerate((5, 100, 700, 9000, 40, 1500))] + [None, ""]
    rows = pack(docs(spark, *texts), group_pieces=4).collect()
    per = collections.Counter()
    bins = collections.Counter()
    for r in rows:
        per[r["doc_id"]] += r["n_tokens"]
        bins[r["bin"]] += r["n_tokens"]
    assert per == {i: len((t or "").split()) + 1 for i, t in enumerate(texts)}
    assert all(r["bin_used"] == bins[r["bin"]] <= r["bin_capacity"] and r["bin_capacity"] in (512, 1024, 2048, 4096) for r in rows)
    assert sorted((r["piece"], r["offset"], r["n_tokens"]) for r in rows if r["doc_id"] == 3) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]
    assert pack(docs(spark, "x").limit(0)).count() == 0
    assert pack(spark.createDataFrame([(1, 0), (2, None), (None, 7)], "doc_id long, n long"), tokens="n").count() == 1


def test_language(spark):
    langs = {"aa": "the of and ing thing other", "bb": "qu é que leçon une très", "cc": "щука рыба вода берег"}
    texts, names = [], []
    for k in range(120):
        lang = list(langs)[k % 3]
        rng = np.random.default_rng(k)
        texts.append(" ".join(rng.choice(langs[lang].split(), 30)))
        names.append(lang)
    table = docs(spark, *texts, None, "", "123 !?", "漢字", "x", langs=[*names, "aa", "aa", "bb", None, None])
    out = F.coalesce(langid.held_out(), F.lit(False))
    model = langid.fit(table, ~out)
    got = {r["doc_id"]: (r["lang_pred"], r["score2"], r["h"]) for r in langid.identify(table, model, score_col="score2").withColumn("h", out).collect()}
    assert all(got[i][0] == names[i] for i in range(120)) and all(got[i][2] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(120))
    assert [got[i][0] for i in (120, 121, 122)] == ["und"] * 3 and got[123][0] in langs and 0 <= got[124][1] <= 1
    nothing = langid.fit(table.limit(0), ~out)
    assert {r["lang_pred"] for r in langid.identify(table, nothing).collect()} == {"und"}
    assert langid.identify(table.limit(0), model).count() == 0


def test_language_learns_from_rows_not_texts(spark):
    """A language whose rows are nearly all copies of one text is learned all the same."""
    copies, words = "the of and ing thing other", "qu é que leçon une très".split()
    rng = np.random.default_rng(4)
    texts = [copies] * 600 + [" ".join(rng.choice(words, 20)) for _ in range(30)]
    table = docs(spark, *texts, "zzzz", langs=["en"] * 600 + ["fr"] * 30 + [None])
    model = langid.fit(table, F.lit(True), sample_docs=40)
    assert min(model.false_rate) > 0
    got = [r["lang_pred"] for r in langid.identify(table, model).orderBy("doc_id").collect()]
    assert got == ["en"] * 600 + ["fr"] * 30 + ["en"]  # the last text holds nothing known


def test_many_languages(spark):
    names = [f"l{k:03d}" for k in range(70)]
    table = docs(spark, *[" ".join([prose(5000 + k, 12)] * 4) for k in range(70)], langs=names)
    model = langid.fit(table, F.lit(True))
    assert model.languages == names
    assert {r["lang"]: r["lang_pred"] for r in langid.identify(table, model).collect()} == {x: x for x in names}


def test_toxicity(spark):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for k in range(200):
        w = prose(k, 60).split()
        bad = k % 5 == 0
        if bad:
            for place in rng.integers(0, 60, 3):
                w[place] = ["idiot", "Moron,", "pathetic", "scum."][place % 4]
        texts.append(" ".join(w))
        labels.append((k, int(bad)))
    table = docs(spark, *texts, None, "", "you idiot")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    _, made = toxicity.fit(table, marks, ~F.coalesce(toxicity.held_out(), F.lit(False)))
    got = {r["doc_id"]: r["p"] for r in toxicity.score(table, made, score_col="p").collect()}
    assert all((got[k] >= 0.5) == bool(y) for k, y in labels) and got[200] == got[201] < 0.5 <= got[202]
    _, blank = toxicity.fit(table, marks.limit(0), F.lit(True))
    assert all(0 <= r["p"] <= 1 for r in toxicity.score(table, blank, score_col="p").collect())
    assert toxicity.score(table.limit(0), made).count() == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    d = re.sub(r"\D", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind != "phone" or 10 <= len(d) <= 15


def test_personal_data(spark):
    texts = [
        None, "", "a@b.c_x@d.e x@@b.c a@b@c.d é 😀 1.2.3.4.5 256.1.1.1 00000255.1.1.1 +1 (017) 555-7713 +12", "4111 1111 1111 1111 or 4111-1111-1111-1112 9" + "9" * 3000, "a." * 2000 + "@x.y", "+1 " * 300 + "1." * 300,
        *[f"please call +1 (555) 010-{k:04d} now" for k in range(12)], "please call 555-010-9999 or (555) 010-9998", "nothing 555-010-9999",
    ]
    got = {r["doc_id"]: r for r in personal_data(docs(spark, *texts)).collect()}
    names = list(PII)
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, n in enumerate(names) for m in re.finditer(PII[n], t or "") if valid(n, m.group()))
        text = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), i
        assert [got[i][f"n_{n}"] for n in names] == [sum(x[1] == k for x in want) for k in range(4)]
        assert set(text.split(",")) - {""} <= set(got[i]["spans"].split(","))
    # "call" precedes twelve seeds: the numbers without a prefix after it are found, the one elsewhere isn't
    assert got[18]["spans"] == "phone:12:24" and got[19]["spans"] == ""
    assert personal_data(docs(spark, "x").limit(0)).count() == 0


def test_personal_data_of_a_second_hop(spark):
    seeds = [f"call +1 555 {200 + i} 0{100 + i}" for i in range(60)]
    shared = [f"{left} 555-{300 + i}-0{100 + i}" for i in range(10) for left in ("call", "mobile")]
    texts = [*seeds, *shared, "mobile 555-999-0199", "parcel 555-999-0198", "parcel 555-999-0197", "parcel 555-999-0196"]
    spans = {r["doc_id"]: r["spans"] for r in personal_data(docs(spark, *texts)).collect()}
    assert all(spans[60 + i] for i in range(20))
    assert spans[80] == "phone:7:19"  # only "mobile" precedes it, and no fixed pattern follows "mobile"
    assert not any(spans[i] for i in (81, 82, 83))


def test_token_files(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    texts = ["a b <|endoftext|> <|ENDOFTEXT|> x<|endoftext|>y " * 60, None, "z", "don't it's 12 ümläut 😀 é " * 90, "", "z"]
    ids = [4, 1, None, 9, 7, 8]
    write_tokens(docs(spark, *texts, ids=ids), f"file://{tmp_path}/t", path, block_ids=100)
    got = {r["doc_id"]: r for r in read_index(spark, f"file://{tmp_path}/t").collect()}
    plain = tokenizers.Tokenizer.from_file(path)
    start = 0
    for i, t in sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0])):
        want = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    write_tokens(docs(spark, "x").limit(0), f"file://{tmp_path}/e", path)
    assert read_index(spark, f"file://{tmp_path}/e").count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in rng.normal(size=5)], "x") for i in range(90)]
    vectors += [(90, None, "x"), (91, [1.0, None], "x"), (92, [float("nan")] * 5, "x"), (93, [float("inf")] * 5, "x"), (None, [1.0] * 5, "x"), (80, vectors[0][1], "x"), (100, [1.0, 2.0], "x"), (101, [2.0, 2.0], "x"), (120, [], "x")]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, id string")
    table = quantised(frame)
    good = []
    for i, v, _ in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(64 * x)) for x in v]))
    want = collections.defaultdict(list)
    for i, q in good:
        if i % 20 == 0:
            want[i] += [(-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q)]
    for shard in (4, 16, 1000):
        got = collections.defaultdict(list)
        for r in top_k(table.where("id % 20 = 0"), table, 7, shard=shard, leaf=2).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((-int(r["score"]), r["vec_id"]))
        assert got == {i: sorted(x)[:7] for i, x in want.items() if x}
    assert top_k(table.limit(0), table).count() == 0 and top_k(table, table.limit(0)).count() == 0
