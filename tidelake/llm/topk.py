"""Exact top-k inner-product search by dual-tree traversal of cover trees.

Both tables are dealt to the nearest of a bounded number of pivots, and each pivot's vectors into shards of bounded size; every
shard is indexed once by a cover tree: a node covers its rows within a radius, its children are a net of half that radius,
further apart from each other than they reach. Nodes whose net would be mostly single rows aren't divided, so data without
clusters cost one matrix product. Trees are tables in the shared folder.

A pair of nodes is pruned if q.r + |q| rad(R) + |r| rad(Q) + rad(Q) rad(R) is below the worst kth score of the query
node's group. Round one lets every query shard meet its most promising candidate shard; the kth scores that this gives prune
pairs of whole shards before round two, and pairs of nodes within it. Within a round a query shard's kth scores go on from one
candidate shard to the next of the same task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import Stage, blocks_for

SHARD, LEAF = 2048, 32
PIVOT_SAMPLE, PIVOTS = 4096, 512
RUN = 8  # candidate shards that a task takes one after the other for a query shard
SCORE = pa.decimal128(38, 0)


class CoverTree:
    """``ids`` and integer ``points`` in the order of the tree; per node its centre's row, radius, rows [start, stop) and children."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.row: list[int] = []
        self.radius: list[float] = []
        self.start: list[int] = []
        self.stop: list[int] = []
        self.parent: list[int] = []
        self._order: list[np.ndarray] = []
        self._x = points.astype(np.float64)
        self._placed = 0
        if len(ids):
            self._grow(np.arange(len(ids)), -1)
            order = np.concatenate(self._order)
            self.ids, self.points = ids[order], points[order]
        else:
            self.ids, self.points = ids, points
        del self._x, self._order
        self._finish()

    def _grow(self, rows: np.ndarray, parent: int) -> None:
        """A node over ``rows`` centred on the first, and the nodes of its net below it."""
        x = self._x[rows]
        away = np.sqrt(((x - x[0]) ** 2).sum(1))
        radius = float(away.max()) * (1 + 1e-12)
        me = len(self.row)
        self.row.append(self._placed)  # the centre is the first row
        self.radius.append(radius)
        self.start.append(self._placed)
        self.stop.append(self._placed + len(rows))
        self.parent.append(parent)
        groups = self._net(x, away, radius / 2) if len(rows) > self.leaf and radius > 0 else None
        if groups is None:
            self._order.append(rows)
            self._placed += len(rows)
            return
        for group in groups:
            self._grow(rows[group], me)

    @staticmethod
    def _net(x: np.ndarray, away: np.ndarray, reach: float) -> list[np.ndarray] | None:
        """Rows by the first point of a greedy net within ``reach``; None if the net is mostly single rows."""
        left, groups = np.arange(len(x)), []
        while len(left):
            if 2 * len(groups) > len(x):
                return None
            near = away <= reach
            groups.append(left[near])
            left = left[~near]
            if len(left):
                away = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1))
        return groups

    def _finish(self) -> None:
        self.children: list[list[int]] = [[] for _ in self.row]
        for k, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(k)
        x = self.points[self.row].astype(np.float64) if len(self.row) else np.zeros((0, 0))
        self.centre, self.rad = x, np.array(self.radius)
        self.norm = np.sqrt((x**2).sum(1)) if len(self.row) else np.zeros(0)

    def dump(self) -> bytes:
        out = io.BytesIO()
        most = int(np.abs(self.points).max(initial=0))
        kind = np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64
        np.savez(out, ids=self.ids, points=self.points.astype(kind), row=self.row, radius=self.radius, start=self.start, stop=self.stop, parent=self.parent)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> CoverTree:
        self = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            self.ids, self.points = z["ids"], z["points"].astype(np.int64)
            self.row, self.start, self.stop, self.parent = (z[c].tolist() for c in ("row", "start", "stop", "parent"))
            self.radius = z["radius"].tolist()
        self._finish()
        return self


def _exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Are all sums of the products of ``a`` and ``b`` whole numbers that a double holds?"""
    width = max(1, a.shape[1])
    return max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * width < 2**53


class Best:
    """The k best candidates so far of each row of a query shard; ``floor`` is what a score must reach to matter."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.floor = np.full(rows, -np.inf)
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def offer(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        if score.dtype == object:  # beyond what a double holds: by Python's whole numbers
            order = np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])))
        else:
            order = np.lexsort((ids, -score, row))
        row = row[order]
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        last = place == self.k - 1
        self.floor[row[last]] = np.maximum(self.floor[row[last]], _low(score[order[last]]))
        order, row = order[place < self.k], row[place < self.k]
        self.row, self.score, self.id = row, score[order], ids[order]


def _low(score: np.ndarray) -> np.ndarray:
    """Doubles not above the scores."""
    x = score.astype(np.float64)
    return np.where(np.abs(x) < 2**53, x, x - np.abs(x) * 2.0**-50)


def search(tq: CoverTree, tr: CoverTree, best: Best) -> tuple[int, int]:
    """Offers all candidates of ``tr`` that matter to ``best``; a query is never its own candidate. Returns how many pairs of rows
    were scored and how many pairs of nodes were bounded."""
    if not tq.row or not tr.row:
        return 0, 0
    scored = bounded = 0
    exact = _exact(tq.points, tr.points)
    kind = np.float64 if exact else object
    qx, rx = tq.points.astype(kind), tr.points.astype(kind)
    slack = 1e-10 * (tq.norm.max() + tq.rad.max()) * (tr.norm.max() + tr.rad.max()) + 1e-3

    def bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (tq.centre[a] * tr.centre[b]).sum(1) + tq.norm[a] * tr.rad[b] + tr.norm[b] * tq.rad[a] + tq.rad[a] * tr.rad[b] + slack

    stack = [(np.inf, 0, 0)]
    while stack:
        bound, a, b = stack.pop()
        mine = slice(tq.start[a], tq.stop[a])
        if bound < best.floor[mine].min():
            continue
        ca, cb = tq.children[a], tr.children[b]
        if not ca and not cb:
            theirs = slice(tr.start[b], tr.stop[b])
            s = qx[mine] @ rx[theirs].T
            scored += s.size
            ids, own = tr.ids[theirs], tq.ids[mine]
            shared = np.flatnonzero(np.isin(ids, own))
            if len(shared):
                s[:, shared] = np.where(ids[shared][None, :] == own[:, None], -np.inf, s[:, shared])
            floor = best.floor[mine]
            if s.shape[1] > best.k:  # k candidates of this block are at least as good as its kth
                top = np.sort(s, axis=1)[:, -best.k] if kind is object else np.partition(s, -best.k, axis=1)[:, -best.k]
                floor = np.maximum(floor, _low(top))
            row, col = np.nonzero((s >= floor[:, None]) & (s > -np.inf))
            best.offer(row + tq.start[a], s[row, col], ids[col])
            continue
        if ca and (not cb or tq.radius[a] >= tr.radius[b]):
            pairs = [(c, b) for c in ca]
        else:
            pairs = [(a, c) for c in cb]
        bounded += len(pairs)
        found = bounds(np.array([x for x, _ in pairs]), np.array([y for _, y in pairs]))
        stack += [(float(found[i]), *pairs[i]) for i in np.argsort(found, kind="stable")]  # the best is on top
    return scored, bounded


def _vectors(column: pa.Array) -> np.ndarray:
    """Equally long lists of whole numbers as rows."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(n, len(flat) // max(1, n))


def _nearest(pivots):
    """Rows (width, id, v), sorted by width, to (width, pivot, id, v); -1 where no vector of this width is a pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pivots.value
        for batch in batches:
            width = batch.column(0).to_numpy()
            out = np.full(len(width), -1, np.int32)
            for w in np.unique(width).tolist():
                if w in known:
                    at = np.flatnonzero(width == w)
                    p = known[w]
                    x = _vectors(batch.column(2).take(pa.array(at))).astype(np.float64)
                    out[at] = ((p**2).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), batch.column(1), batch.column(2)], ["width", "pivot", "id", "v"])

    return run


def _choose_pivots(sample: list, most: int) -> dict[int, np.ndarray]:
    """Per width, points of the sample that are far from each other, each the farthest from those before."""
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for width, rows in by_width.items():
        x = np.array(rows, np.float64).reshape(len(rows), width)
        chosen, away = [0], ((x - x[0]) ** 2).sum(1)
        for _ in range(min(most, len(x) // 8)):
            far = int(away.argmax())
            if away[far] == 0:
                break
            chosen.append(far)
            away = np.minimum(away, ((x - x[far]) ** 2).sum(1))
        out[width] = x[chosen]
    return out


def _grown(leaf: int):
    """Rows (width, pivot, part, id, v), sorted by the first three, to one tree each."""
    names = ["width", "pivot", "part", "centre", "radius", "n", "tree"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []

        def result() -> pa.RecordBatch:
            tree = CoverTree(np.concatenate(ids), np.concatenate(vectors), leaf)
            values = [*now, tree.centre[0], tree.radius[0], len(tree.ids), tree.dump()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, [batch.num_rows]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                key = tuple(keys[:, a].tolist())
                if key != now and ids:
                    yield result()
                    ids, vectors = [], []
                now = key
                part = batch.slice(a, b - a)
                ids.append(part.column(3).to_numpy())
                vectors.append(_vectors(part.column(4)))
        if ids:
            yield result()

    return run


def _trees(rows: DataFrame, pivots, shard: int, leaf: int, label: str) -> DataFrame:
    """(shard, width, centre, radius, n, tree) of (id, v); a pivot with many vectors has several shards."""
    wide = rows.select(F.size("v").alias("width"), "id", "v")
    near = Stage(wide.mapInArrow(_nearest(pivots), "width int, pivot int, id long, v array<bigint>"), label).read()
    sizes = near.groupBy("width", "pivot").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    listed = sizes.where("pivot >= 0").collect()  # at most PIVOT_SAMPLE rows: pivots are rows of the sample
    table = rows.sparkSession.createDataFrame([tuple(r) for r in listed], "width int, pivot int, parts int")
    rest = blocks_for(near.where("pivot < 0").count(), shard)
    dealt = near.join(F.broadcast(table), ["width", "pivot"], "left")
    dealt = dealt.select("width", "pivot", F.pmod(F.xxhash64("id", "v"), F.coalesce("parts", F.lit(rest))).cast("int").alias("part"), "id", "v")
    dealt = dealt.repartition("width", "pivot", "part").sortWithinPartitions("width", "pivot", "part")
    grown = dealt.mapInArrow(_grown(leaf), "width int, pivot int, part int, centre array<double>, radius double, n long, tree binary")
    return Stage(grown.withColumn("shard", F.monotonically_increasing_id()), label).read()


_FOUND = "q long, row int, query_id long, vec_id long, score decimal(38,0)"


def _meet(k: int):
    """Rows (q, part, q_tree, r_tree, floors), those of one q and part together, best first, to what they find."""

    def result(q: int, tree: CoverTree, best: Best) -> pa.RecordBatch:
        scores = pa.array(best.score.astype(np.int64)).cast(SCORE) if best.score.dtype != object else pa.array([int(x) for x in best.score], SCORE)
        columns = [pa.array(np.full(len(best.row), q)), pa.array(best.row.astype(np.int32)), pa.array(tree.ids[best.row]), pa.array(best.id), scores]
        return pa.RecordBatch.from_arrays(columns, ["q", "row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, best = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != now:
                    if best is not None and len(best.row):
                        yield result(now[0], tree, best)
                    now, tree = key, CoverTree.load(batch.column(2)[i].as_py())
                    best = Best(len(tree.ids), k)
                    for f in batch.column(4)[i].as_py() or ():
                        best.floor[f["row"]] = f["floor"]
                search(tree, CoverTree.load(batch.column(3)[i].as_py()), best)
        if best is not None and len(best.row):
            yield result(now[0], tree, best)

    return run


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component. Null ids and vectors, and vectors with null or non-finite components, go; rows that
    repeat an id all stay."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long")).alias("v"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20, shard: int = SHARD, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` from two tables (id, v array<bigint>), ranks from 1, ties to the smaller id.

    Only vectors of one length are compared, and none with one of its own id. A query with fewer than k candidates gets them all;
    empty tables give none. Rows that repeat an id are candidates each; repeated queries share their id's k ranks. Scores are exact
    as decimal(38,0). Pairs of shards are a table of (shards of queries) x (shards of candidates) rows without vectors, which
    the bounds cut before any tree moves."""
    spark = candidates.sparkSession
    queries, candidates = Stage(queries.select("id", "v"), "queries").read(), Stage(candidates.select("id", "v"), "candidates").read()
    total = candidates.count()
    chosen = candidates.where(F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000)) < 1_000_000 * min(1.0, PIVOT_SAMPLE / max(1, total))).select("v").orderBy(F.xxhash64("v")).limit(PIVOT_SAMPLE).collect()
    shared = spark.sparkContext.broadcast(_choose_pivots(chosen, min(pivots, blocks_for(total, shard))))  # at most PIVOT_SAMPLE vectors
    tq, tr = _trees(queries, shared, shard, leaf, "query-trees"), _trees(candidates, shared, shard, leaf, "candidate-trees")

    q = tq.select(F.col("shard").alias("q"), "width", F.col("centre").alias("qc"), F.col("radius").alias("qr"))
    r = tr.select(F.col("shard").alias("r"), "width", F.col("centre").alias("rc"), F.col("radius").alias("rr"))
    zero = F.lit(0.0)

    def dot(a: str, b: str) -> F.Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda s, x: s + x)

    qn, rn = F.sqrt(dot("qc", "qc")), F.sqrt(dot("rc", "rc"))
    bound = dot("qc", "rc") + qn * F.col("rr") + rn * F.col("qr") + F.col("qr") * F.col("rr")
    slack = F.lit(1e-10) * (qn + F.col("qr")) * (rn + F.col("rr")) + F.lit(1e-3)
    pairs = Stage(q.join(r, "width").select("q", "r", bound.alias("promise"), (bound + slack).alias("bound")), "shard-pairs").read()

    def meeting(chosen_pairs: DataFrame, floors: DataFrame | None, label: str) -> DataFrame:
        rows = chosen_pairs.join(tq.select(F.col("shard").alias("q"), F.col("tree").alias("q_tree")), "q").join(tr.select(F.col("shard").alias("r"), F.col("tree").alias("r_tree")), "r")
        rows = rows.withColumn("floors", F.lit(None).cast("array<struct<row:int,floor:double>>")) if floors is None else rows.join(floors, "q", "left")
        rows = rows.select("q", "part", "q_tree", "r_tree", "floors", "bound").repartition("q", "part").sortWithinPartitions("q", "part", F.desc("bound"))
        return Stage(rows.drop("bound").mapInArrow(_meet(k), _FOUND), label).read()

    first = pairs.groupBy("q").agg(F.max_by("r", "promise").alias("r"), F.lit(0).cast("long").alias("part"), F.lit(0.0).alias("bound"))
    found = meeting(first, None, "first-round")
    low = F.when(F.abs(F.min("score").cast("double")) < 2.0**53, F.min("score").cast("double")).otherwise(F.min("score").cast("double") - F.abs(F.min("score").cast("double")) * 2.0**-50)
    kth = found.groupBy("q", "row").agg(F.when(F.count(F.lit(1)) >= k, low).alias("floor")).where("floor is not null")
    floors = Stage(kth.groupBy("q").agg(F.collect_list(F.struct("row", "floor")).alias("floors"), F.count(F.lit(1)).alias("n"), F.min("floor").alias("worst")), "floors").read()  # a shard's rows at most
    worst = floors.join(tq.select(F.col("shard").alias("q"), F.col("n").alias("rows")), "q").where("n = rows").select("q", "worst")
    shards = tr.count()
    rest = pairs.join(first.select("q", "r"), ["q", "r"], "left_anti").join(worst, "q", "left").where("worst is null or bound >= worst")
    rest = rest.select("q", "r", F.pmod(F.xxhash64("r"), F.lit(blocks_for(shards, RUN))).alias("part"), "bound")
    more = meeting(rest, floors.select("q", "floors"), "second-round")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.unionAll(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
