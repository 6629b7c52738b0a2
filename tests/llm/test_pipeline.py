"""The pipeline's stages against plain versions, on the smallest table."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import brute_components, docs, prose

from tidelake.llm.common import read_table


def test_stages_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    raw = read_table(spark, sf, "documents")
    extra = docs(spark, prose(1, 50), "123 456", None, langs=["en", "en", None], ids=[10_001, 10_002, 10_003]).select(*raw.columns)
    table = raw.unionByName(extra)
    kept = corpus_pipeline.language(spark, table, sf).cache()
    assert kept.columns == table.columns and {r["doc_id"] for r in table.select("doc_id").collect()} - {r["doc_id"] for r in kept.select("doc_id").collect()} >= {10_002, 10_003}
    assert kept.join(raw, "doc_id", "left_semi").count() == raw.count()

    cut = corpus_pipeline.lines(spark, kept, sf).cache()
    before, after = ({r["doc_id"]: r["text"] for r in x.select("doc_id", "text").collect()} for x in (kept, cut))
    where = {}
    for i, t in before.items():
        for line in set(x.strip(" ") for x in t.split("\n")) - {""}:
            where.setdefault(line, []).append(i)
    source = {r["doc_id"]: r["source"] for r in kept.select("doc_id", "source").collect()}
    gone = {line: min(ids) for line, ids in where.items() if len({source[i] for i in ids}) >= 10}
    for i, t in before.items():
        want = "\n".join(x for x in t.split("\n") if not (x.strip(" ") in gone and gone[x.strip(" ")] != i))
        assert after.get(i, want if not want.strip() else None) == want

    single = corpus_pipeline.near_copies(spark, cut, sf).cache()
    rows = sorted((i, t) for i, t in after.items())
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == {i for i, _, _, k in brute_components(rows) if k}

    clean = corpus_pipeline.benchmark_leaks(spark, single, sf).cache()
    plain = lambda t: " ".join(re.findall(r"[^\W_]+", (t or "").lower()))
    items = [plain(r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    held = {r["doc_id"] for r in single.collect() if any(x in plain(r["text"]) for x in items)}
    assert {r["doc_id"] for r in single.select("doc_id").collect()} - {r["doc_id"] for r in clean.select("doc_id").collect()} >= held
    assert clean.count() >= single.count() - len(held) - 1

    packed = corpus_pipeline.sequences(spark, clean, sf)
    assert packed.select("doc_id").distinct().count() == clean.count() and packed.where(F.col("bin_used") > F.col("bin_capacity")).count() == 0


def test_empty_table(spark):
    table = docs(spark, "x").limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table, "/root/testdata/sf0.001").count() == 0
