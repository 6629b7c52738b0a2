"""MinHash near-duplicates by min-max hashing.

One pass hashes each text's set of word shingles under a number of permutations and keeps both the least and the
greatest value of each: two signature values for one hash evaluation. Bands of the signature are the candidate keys; texts with
equal sets are one class, and only classes go on. Links are confirmed on full sets, word by word, in three steps:

1. Every class meets the least class of its buckets, once. Confirmed links make the first groups.
2. Groups that still share a bucket make a cluster. Its classes in such buckets that are outside of its largest group meet
   all others, in blocks of bounded size, each pair of blocks being one unit of work; pairs that share no bucket aren't
   compared. Pairs within a group are linked already, so no link is lost.
3. The links of step 2 join groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import Stage
from tidelake.llm.components import components
from tidelake.llm.words import U, exact_shingles, mix, shingle_sets

BANDS, ROWS = 50, 5  # a pair at similarity 0.75 shares no band with probability 1.3e-6
BLOCK_DOCS = 256
SALTS = 16


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def signature(shingles: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minima and maxima, side by side, of a non-empty set under each permutation."""
    low = high = None
    for i in range(0, len(shingles), 2048):
        x = shingles[i : i + 2048, None] * multipliers
        a, b = x.min(0), x.max(0)
        low = a if low is None else np.minimum(low, a)
        high = b if high is None else np.maximum(high, b)
    out = np.empty(2 * len(multipliers), U)
    out[0::2], out[1::2] = low, high
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The unbiased estimate of Jaccard similarity from two signatures."""
    return float(np.mean(a == b))


def _print(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _features(n: int, bands: int, rows: int):
    step = [U(pow(0xBEA225F9EB34556D, 2 * k + 1, 1 << 64)) for k in range(rows)]
    salt = mix(np.arange(1, bands + 1, dtype=U))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers(-(-bands * rows // 2))
        for batch in batches:
            counts, prints, keys, ends = [], [], [], [0]
            for s in shingle_sets(batch.column(1), n):
                counts.append(len(s))
                prints.append(_print(s))
                if len(s):
                    x = signature(s, multipliers)[: bands * rows].reshape(bands, rows)
                    h = salt.copy()
                    for k in range(rows):
                        h = mix(h + x[:, k] * step[k])
                    keys.append(h)
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()), lists], ["id", "n_shingles", "print", "keys"])

    return run


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(_print, shingle_sets(batch.column(1), n)), pa.binary())], ["id", "text", "print"])

    return run


def _links(n: int, percent: int):
    """Confirmed links within the units, which come sorted: side 0 against side 1, or side 0 within itself if it is alone. At most
    a spanning forest of each unit's links, and none between rows of one group."""

    def links_of(nodes: list, groups: list, texts: list, sides: list, keys: list) -> list[tuple]:
        order = sorted(range(len(nodes)), key=lambda i: sides[i])
        cut = sides.count(0)
        two = cut < len(nodes)
        if cut == 0 or len(set(groups)) == 1:
            return []
        nodes, groups = [nodes[i] for i in order], [groups[i] for i in order]
        codes, first = exact_shingles([texts[i] for i in order], n)
        of = np.repeat(np.arange(len(nodes)), np.diff(first))
        pair = np.unique(np.stack([of, np.unique(codes, return_inverse=True)[1]]), axis=1)  # each text's set
        of, flat = pair
        sizes = np.bincount(of, minlength=len(nodes))
        at = np.concatenate([[0], np.cumsum(sizes)])
        root = np.unique(np.array(groups), return_inverse=True)[1]  # of each row, kept flat
        members: dict[int, list[int]] = {}  # rows by bucket
        for i, k in enumerate(order):
            for key in keys[k] or ():
                members.setdefault(key, []).append(i)
        out, mark = [], np.zeros(int(flat.max()) + 1, np.int32)
        for i in range(cut if two else len(nodes) - 1):
            j0 = cut if two else i + 1
            own = keys[order[i]]
            near = np.arange(j0, len(nodes)) if own is None else np.unique(np.array([j for key in own for j in members[key] if j >= j0], np.int64))
            near = near[root[near] != root[i]]
            if not len(near):
                continue
            mine = flat[at[i] : at[i + 1]]
            mark[mine] = 1
            size = sizes[near]
            starts = np.cumsum(size) - size
            theirs = np.repeat(at[near] - starts, size) + np.arange(int(size.sum()))
            both = np.add.reduceat(mark[flat[theirs]], starts)
            mark[mine] = 0
            for j in near[100 * both >= percent * (sizes[i] + size - both)].tolist():
                if root[i] != root[j]:
                    root[root == root[j]] = root[i]
                    out.append((nodes[i], nodes[j]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, ([], [], [], [], [])

        def result() -> pa.RecordBatch:
            found = links_of(*rows)
            for column in rows:
                column.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            units = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for u, *row in zip(units, *(batch.column(k).to_pylist() for k in range(4, 9)), strict=True):
                if u != unit and rows[0]:
                    yield result()
                unit = u
                for column, value in zip(rows, row, strict=True):
                    column.append(value)
        if rows[0]:
            yield result()

    return run


_UNIT = ["u1", "u2", "u3", "u4"]


def _confirmed(units: DataFrame, texts: DataFrame, shingle: int, percent: int, label: str) -> DataFrame:
    """``units``: the four parts of a unit's name, node, group, side and keys (null: meets all). Returns (a, b)."""
    rows = units.join(texts, "node").select(*_UNIT, "node", "group", "text", "side", "keys")
    rows = rows.repartition(*_UNIT).sortWithinPartitions(*_UNIT)
    return Stage(rows.mapInArrow(_links(shingle, percent), "a long, b long"), label).read()


def _renamed(groups: DataFrame, names: DataFrame) -> DataFrame:
    """(node, group) with groups renamed by ``names`` (group, to), salted, as one group may hold a third of all nodes."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    salted = groups.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    return salted.join(names.withColumn("salt", salts), ["group", "salt"], "left").select("node", F.coalesce("to", "group").alias("group"))


def _joined(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups after ``edges`` (a, b) between their names joined them."""
    return _renamed(groups, components(edges, "a", "b", "groups").select(F.col("node").alias("group"), F.col("component").alias("to")))


def _second_units(buckets: DataFrame, groups: DataFrame, block_docs: int) -> DataFrame:
    """Units of step 2 from (key, node) of buckets with several classes. Groups that share a bucket make a cluster; blocks of the
    cluster's lesser groups meet each other and blocks of its largest group. ``keys`` are a class's open buckets."""
    named = Stage(buckets.join(groups, "node", "left").withColumn("group", F.coalesce("group", "node")), "named").read()
    ends = named.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")).where("least < most").select("key", "least")
    open_ = Stage(named.join(ends, "key"), "open").read()
    clusters = components(open_.where("group <> least").select("group", "least").distinct(), "group", "least", "clusters").select(F.col("node").alias("group"), F.col("component").alias("cluster"))
    clusters = Stage(clusters, "cluster-of-group").read()
    keyed = open_.groupBy("node", "group").agg(F.collect_list("key").alias("keys"))  # at most one a band
    sizes = keyed.groupBy("group").agg(F.count(F.lit(1)).alias("n")).join(clusters, "group").groupBy("cluster").agg(F.max(F.struct("n", "group")).alias("top"), F.sum("n").alias("n"))
    sizes = sizes.select("cluster", F.col("top.group").alias("top"), F.ceil(F.col("top.n") / block_docs).cast("int").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / block_docs).cast("int").alias("minor"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    shapes = clusters.join(sizes, "cluster").withColumn("salt", salts)
    dealt = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(shapes, ["group", "salt"]).withColumn("is_top", F.col("group") == F.col("top"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.when(F.col("is_top"), F.col("major")).otherwise(F.col("minor"))).cast("int"))
    # (kind, block, block, side); kind 0: within the lesser groups, 1: with the largest group
    with_minor = F.transform(F.sequence(F.lit(0), F.col("minor") - 1), lambda o: F.struct(F.lit(0).alias("u2"), F.least("own", o).alias("u3"), F.greatest("own", o).alias("u4"), (F.col("own") > o).cast("int").alias("side")))
    with_major = F.transform(F.sequence(F.lit(0), F.col("major") - 1), lambda o: F.struct(F.lit(1).alias("u2"), F.col("own").alias("u3"), o.alias("u4"), F.lit(0).alias("side")))
    of_major = F.transform(F.sequence(F.lit(0), F.col("minor") - 1), lambda o: F.struct(F.lit(1).alias("u2"), o.alias("u3"), F.col("own").alias("u4"), F.lit(1).alias("side")))
    parts = F.when(F.col("is_top"), of_major).otherwise(F.concat(with_minor, with_major))
    return dealt.select(F.col("cluster").alias("u1"), "node", "group", "keys", F.explode(parts).alias("p")).select("u1", "p.u2", "p.u3", "p.u4", "node", "group", "p.side", "keys")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 75, bands: int = BANDS, rows: int = ROWS, block_docs: int = BLOCK_DOCS
) -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)``, one row per input row.

    Two rows are linked if 100 * |A n B| >= percent * |A u B| of their shingle sets. Null, empty and blank texts have an
    empty set and are linked with nothing (their component is their own id). Texts with fewer words than a shingle have
    one shingle, the whole sequence. Rows with equal sets are one class. Rows that repeat an id with other texts are rows of their
    own; each has its own links. A row with a null id joins no class: its component is null and it is kept. Other columns of
    ``docs`` are ignored. An empty table gives an empty result. ``id_col`` must be integral."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    features = Stage(docs.mapInArrow(_features(shingle, bands, rows), "id long, n_shingles long, print binary, keys array<bigint>"), "minhash")
    found = features.read()
    named = found.where("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    classes = Stage(named.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so that names stay

    members = classes.read().select(F.explode("keys").alias("key"), "node")
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("key", "hub")
    buckets = Stage(members.join(hubs, "key"), "buckets")
    several = buckets.read()
    wanted = several.select("node").distinct().join(classes.read().select("node", "print", F.col("rep").alias("id")), "node")
    chosen = docs.where("id is not null").join(wanted.select("id").distinct(), "id", "left_semi").mapInArrow(_prints(shingle), "id long, text string, print binary")
    texts = Stage(chosen.join(wanted, ["id", "print"]).groupBy("node").agg(F.first("text").alias("text")), "texts")

    stars = several.where("node <> hub").groupBy("node").agg(F.min("hub").alias("hub"))
    sizes = stars.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block_docs).cast("int").alias("blocks"))
    unit = [F.col("hub").alias("u1"), F.lit(0).alias("u2"), F.lit(0).alias("u3"), "u4"]
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    points = stars.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(spread, ["hub", "salt"]).withColumn("u4", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    points = points.select(*unit, "node", F.col("node").alias("group"), F.lit(1).alias("side"))
    centres = sizes.withColumn("u4", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*unit, F.col("hub").alias("node"), F.col("hub").alias("group"), F.lit(0).alias("side"))
    tree = _confirmed(points.unionAll(centres).withColumn("keys", F.lit(None).cast("array<bigint>")), texts.read(), shingle, percent, "star-links")  # a: centre, b: point

    centres = tree.select("a").distinct()
    first = tree.select(F.col("b").alias("node"), F.col("a").alias("group")).unionAll(centres.select(F.col("a").alias("node"), F.col("a").alias("group")))
    chains = tree.join(centres.select(F.col("a").alias("b")), "b", "left_semi")  # stars whose centre is a point of another
    groups = Stage(_joined(first, chains).distinct(), "groups")
    more = _confirmed(_second_units(several.select("key", "node"), groups.read(), block_docs), texts.read(), shingle, percent, "bucket-links")
    ends = more.join(groups.read().toDF("a", "ga"), "a", "left").join(groups.read().toDF("b", "gb"), "b", "left").select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b"))
    fresh = more.select(F.col("a").alias("node")).unionAll(more.select(F.col("b").alias("node"))).distinct().join(groups.read(), "node", "left_anti")
    last = Stage(_joined(groups.read().unionAll(fresh.select("node", F.col("node").alias("group"))), ends.distinct()), "near")

    final = last.read()
    reps = final.join(classes.read().select("node", "rep"), "node")
    named = _renamed(final, reps.groupBy("group").agg(F.min("rep").alias("to"))).select("node", F.col("group").alias("component"))
    of_print = classes.read().select("print", "node", "rep").join(named, "node", "left").select("print", F.coalesce("component", "rep").alias("component"))
    answer = found.select("id", "n_shingles", "print").join(of_print, "print", "left")
    answer = answer.withColumn("component_id", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")))
    return answer.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
