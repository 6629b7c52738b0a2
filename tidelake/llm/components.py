"""Connected components of a link table by alternating large-star and small-star steps.

Each step is one aggregation (the least neighbour of each node) and one salted join;
each result is a table in the shared folder, so lineage stays short and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage

SALTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has u > v. Large star: neighbours above a node move to its least neighbour; small star: those below."""
    if large:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))  # a node may have a third of all links
    linked = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(least.withColumn("salt", salts), ["u", "salt"])
    if large:
        moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _open(edges: DataFrame) -> bool:
    """Whether a node has two links to lesser nodes, or a chain of links is left; else each link is a star's point and its least node."""
    again = edges.groupBy("u").count().where("count > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return bool(again.unionAll(chained).take(1))


def components(links: DataFrame, a: str, b: str, label: str = "cc") -> DataFrame:
    """(node, component): for every node of a link, the least node it reaches. Nulls and self-links give no row.

    Repeated links count once. An empty table gives an empty result. The number of rounds grows with the
    logarithm of the longest chain."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and {a} <> {b}").distinct()
    table = Stage(edges, label)
    while _open(table.read()):
        larger = Stage(_star(table.read(), True), label)
        smaller = Stage(_star(larger.read(), False), label)
        table.drop()
        larger.drop()
        table = smaller
    stars = table.read()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
