"""From raw documents to packed training sequences: language, boilerplate, near-duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import decontam, langid
from tidelake.llm.common import read_table, ship_code, staged
from tidelake.llm.linededup import drop_boilerplate
from tidelake.llm.minhash import near_duplicates
from tidelake.llm.packing import pack

MIN_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognised language: no letter, or a score below ``MIN_LANGUAGE_SCORE``. A null lang is filled in."""
    ship_code(spark)
    model = langid.fit(docs, ~F.coalesce(langid.held_out(), F.lit(False)))
    judged = langid.identify(docs, model, pred_col="_lang_pred", score_col="_lang_score")
    kept = judged.where((F.col("_lang_pred") != "und") & (F.col("_lang_score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.coalesce("lang", "_lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts cross-site boilerplate lines; documents that had nothing else go."""
    ship_code(spark)
    cut = drop_boilerplate(docs)
    kept = cut.where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return kept.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates."""
    ship_code(spark)
    gone = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or most of one."""
    ship_code(spark)
    pairs = decontam.contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    leaks = pairs.where(F.col("score") >= decontam.MIN_SCORE).select("doc_id").distinct()
    return docs.join(leaks.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences."""
    ship_code(spark)
    return pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("sequences", sequences)]

#: The stages hash, align and pack; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
