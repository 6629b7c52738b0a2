"""The registered ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm.common import read_table, scratch_path
from tidelake.llm import decontam, langid, toxicity
from tidelake.llm.linededup import drop_boilerplate
from tidelake.llm.minhash import near_duplicates
from tidelake.llm.packing import pack
from tidelake.llm.pii import personal_data
from tidelake.llm.suffixdedup import remove_repeats
from tidelake.llm.tokenfile import read_index, write_tokens
from tidelake.llm.topk import quantised, top_k


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(read_table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where("id % 20 = 0"), vectors).withColumn("score", F.col("score").cast("long"))


OP1_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(r.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(toxicity.held_out(), F.lit(False))
    _, classifier = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~out)
    scored = toxicity.score(docs, classifier)
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(langid.held_out(), F.lit(False))
    model = langid.fit(docs, ~out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents")).drop("base", "added")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_boilerplate(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = """
WITH lines AS (
  SELECT doc_id, source, i - 1 AS pos, parts[i] AS line, trim(parts[i]) AS k
  FROM (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL))
), boiler AS (
  SELECT k, min(doc_id) AS first FROM lines WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (b.k IS NOT NULL AND l.doc_id <> b.first) AS gone FROM lines l LEFT JOIN boiler b ON l.k = b.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.flag(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_index(spark, path)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_topk": op1_topk, "op2_toxicity": op2_toxicity, "op3_langid": op3_langid, "op4_pii": op4_pii, "op5_suffix_dedup": op5_suffix_dedup, "op6_line_dedup": op6_line_dedup, "op7_decontamination": op7_decontamination, "op8_token_files": op8_token_files, "op9_minhash": op9_minhash, "op10_packing": op10_packing}

ORACLE_SQL: dict[str, str] = {"op1_topk": OP1_SQL, "op6_line_dedup": OP6_SQL}
