"""Cross-site boilerplate removal: lines by the number of distinct sites they occur on (DataFrame functions only).

Every line is hashed to 128 bits; one aggregation merges a HyperLogLog sketch of sites per hash (sketches combine before
the shuffle, so a line in a third of all documents is one small row per task). Lines whose estimate is well
clear of the threshold are decided by it; those near it get an exact distinct count of sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage

MIN_SITES = 10
LG_K = 10
MARGIN = 0.2  # six standard errors of a sketch with 2**10 registers


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with the text cut, and ``n_lines``, ``n_removed`` (replacing columns of these names), one row per input row.

    A line (split at LF, compared without outer spaces) that occurs on at least ``min_sites`` distinct sites goes from every
    document but the one with the smallest id, which keeps it. Blank lines stay and are counted. A null site is
    no site; a null text stays null (0 lines); a row with a null id neither counts nor loses anything. Rows that
    repeat an id lose the same lines. An empty table gives an empty result."""
    docs = docs.drop("n_lines", "n_removed")
    exploded = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(site_col).cast("string")).alias("site_hash"), F.col(site_col).isNotNull().alias("sited"), F.posexplode(_lines(F.col(text_col))).alias("pos", "line")
    )
    key = F.trim("line")
    lines = Stage(
        exploded.where(key != "").select("id", "pos", F.when(F.col("sited"), F.col("site_hash")).alias("site"), F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(7)).alias("h2")), "lines"
    ).read()
    spread = Stage(
        lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min("id").alias("first")).select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - MARGIN)), "spread"
    ).read()
    close = spread.where(F.col("sites") <= min_sites * (1 + MARGIN))
    exact = lines.join(close.select("h1", "h2"), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    decided = spread.where(F.col("sites") > min_sites * (1 + MARGIN)).select("h1", "h2", "first").unionAll(close.join(exact, ["h1", "h2"]).select("h1", "h2", "first"))
    gone = Stage(lines.join(decided, ["h1", "h2"]).where("id <> first").select("id", "pos").distinct().groupBy("id").agg(F.collect_list("pos").alias("_gone")), "gone").read()

    # a merge join at every size: the texts move once, and the table of cut lines may grow as they do
    joined = docs.join(gone.withColumnRenamed("id", "_id").hint("merge"), F.col(id_col).cast("long") == F.col("_id"), "left").drop("_id")
    parts = _lines(F.col(text_col))
    kept = F.filter(parts, lambda x, i: ~F.array_contains("_gone", i))
    cut = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.select(
        *[(cut.alias(c) if c == text_col else F.col(c)) for c in docs.columns],
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
