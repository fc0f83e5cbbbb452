"""Approximate nearest neighbours by stable projections and a kd-tree.

Largest inner product becomes smallest distance by one more coordinate that gives all vectors one length. Vectors
are projected on ``PROJECTIONS`` Gaussian directions; a projected squared distance over the true one then follows a
chi-square law. A kd-tree over the projections, its upper levels from a bounded sample, its lower levels in each
cell, gives projected neighbours in growing distance. Each is verified on the whole vectors, until the chi-square
test holds: that a neighbour nearer than the k-th best would have shown up by now with probability ``CONFIDENCE``.
A query first searches its own cell; the k-th distance found there bounds the cells it still has to visit.

Equal vectors form one class that keeps its ``k + 1`` smallest ids, which is all an answer can show; a class is
searched for once however many queries share it. All rows are indexed; no cell or bin is capped.

Vectors that are null, empty, zero or hold null or non-finite components, rows with a null id, and vectors of
another than the most frequent length take no part, as queries or as candidates. Repeated rows count once. With
fewer than ``k`` candidates all are returned. Empty tables give empty tables; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskweave.llm.ship import shipped
from riskweave.session import cut_lineage

#: Directions (an even number, for the closed form of the chi-square law) and the stopping test's confidence.
PROJECTIONS, CONFIDENCE = 10, 0.95
#: Classes that shape the tree's upper levels; classes in a cell and in a leaf; cells at most; queries in a block.
SAMPLE, CELL, LEAF, MOST_CELLS, BLOCK = 20_000, 4_000, 256, 1 << 16, 10_000


def chi_square(x: float, m: int = PROJECTIONS) -> float:
    """Distribution function for an even number of degrees."""
    half, term, total = x / 2, 1.0, 1.0
    for j in range(1, m // 2):
        term *= half / j
        total += term
    return 1 - math.exp(-half) * total


def chi_square_quantile(p: float, m: int = PROJECTIONS) -> float:
    lo, hi = 0.0, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, m) < p else (lo, mid)
    return hi


class Space:
    """Lengthened vectors, their projections and the tree's upper levels."""

    def __init__(self, size: int, longest: float, sample: np.ndarray, depth: int, seed: int = 5):
        self.size, self.longest, self.depth = size, longest, depth
        self.directions = np.random.default_rng(seed).standard_normal((size + 1, PROJECTIONS))
        inner = (1 << depth) - 1
        self.axis, self.cut = np.zeros(inner, dtype=np.int64), np.zeros(inner)
        held = {0: self.points(sample)}
        for node in range(inner):
            x = held.pop(node)
            axis = int(np.argmax(x.max(axis=0) - x.min(axis=0))) if len(x) else 0
            cut = float(np.median(x[:, axis])) if len(x) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            if 2 * node + 1 < inner:
                right = x[:, axis] >= cut if len(x) else np.zeros(0, dtype=bool)
                held[2 * node + 1], held[2 * node + 2] = x[~right], x[right]

    def points(self, x: np.ndarray) -> np.ndarray:
        """Projections of candidates, with the coordinate that makes them equally long."""
        rest = np.sqrt(np.maximum(self.longest**2 - (x * x).sum(axis=1), 0))
        return x @ self.directions[:-1] + rest[:, None] * self.directions[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        """Projections of queries, brought to the common length."""
        return self.lengthened(q) @ self.directions[:-1]

    def lengthened(self, q: np.ndarray) -> np.ndarray:
        return q * (self.longest / np.sqrt((q * q).sum(axis=1)))[:, None]

    def cells(self, projected: np.ndarray) -> np.ndarray:
        node = np.zeros(len(projected), dtype=np.int64)
        for _ in range(self.depth):
            right = projected[np.arange(len(projected)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def reachable(self, point: np.ndarray, radius2: float) -> list[int]:
        """Cells within a projected radius of one point."""
        found, inner = [], (1 << self.depth) - 1
        stack: list[tuple[int, float, dict[int, float]]] = [(0, 0.0, {})]
        while stack:
            node, away, offsets = stack.pop()
            if node >= inner:
                found.append(node - inner)
                continue
            axis = int(self.axis[node])
            gap = float(point[axis] - self.cut[node])
            near, far = (2 * node + 2, 2 * node + 1) if gap >= 0 else (2 * node + 1, 2 * node + 2)
            stack.append((near, away, offsets))
            further = away - offsets.get(axis, 0.0) + max(offsets.get(axis, 0.0), gap * gap)
            if further <= radius2:
                stack.append((far, further, {**offsets, axis: max(offsets.get(axis, 0.0), gap * gap)}))
        return found


def _leaves(p: np.ndarray) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree over one cell."""
    out, stack = [], [np.arange(len(p))]
    while stack:
        rows = stack.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        x = p[rows]
        order = rows[np.argsort(x[:, np.argmax(x.max(axis=0) - x.min(axis=0))], kind="stable")]
        stack += [order[: len(order) // 2], order[len(order) // 2 :]]
    return out


def _search(space: Space, x: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int):
    """(query, row, score) of up to k verified neighbours of each query in one cell, and each k-th squared distance.

    Leaves are visited in growing projected distance; a query stops once the test holds for what lies ahead."""
    reach = chi_square_quantile(CONFIDENCE)
    p, pq, long = space.points(x), space.queries(q), space.lengthened(q)
    leaves = _leaves(p)
    away = np.stack(
        [(np.maximum(np.maximum(p[r].min(axis=0) - pq, pq - p[r].max(axis=0)), 0) ** 2).sum(axis=1) for r in leaves], axis=1
    )
    order = np.argsort(away, axis=1)
    scores = np.full((len(q), k), -np.inf)
    rows = np.full((len(q), k), -1, dtype=np.int64)
    kth = bound.copy()
    base = 2 * space.longest**2
    active = np.arange(len(q))
    for step in range(len(leaves)):
        ahead = away[active, order[active, step]]
        active = active[ahead <= kth[active] * reach]
        if not len(active):
            break
        leaf_of = order[active, step]
        for leaf in np.unique(leaf_of):
            mine, those = active[leaf_of == leaf], leaves[leaf]
            s = q[mine] @ x[those].T
            both = np.concatenate([scores[mine], s], axis=1)
            names = np.concatenate([rows[mine], np.broadcast_to(those, s.shape)], axis=1)
            best = np.argpartition(-both, k - 1, axis=1)[:, :k]
            scores[mine] = np.take_along_axis(both, best, 1)
            rows[mine] = np.take_along_axis(names, best, 1)
            lowest = scores[mine].min(axis=1) * (space.longest / np.sqrt((q[mine] ** 2).sum(axis=1)))
            kth[mine] = np.minimum(kth[mine], np.where(np.isfinite(lowest), base - 2 * lowest, np.inf))
    query, place = np.nonzero(rows >= 0)
    return query, rows[query, place], kth


def _matrix(column, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, size)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component to the last in double precision."""
    return np.cumsum(a * b, axis=1)[:, -1] if len(a) else np.zeros(0)


def clean_vectors(rows: DataFrame, row_id: str, vector: str) -> DataFrame:
    """(vec_id, vec, norm): usable vectors as bytes of doubles."""
    used = rows.select(rows[row_id].alias("vec_id"), rows[vector].cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND size(v) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)  # null components are not numbers
            keep, blobs, norms = [], [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                x = flat[a:b]
                with np.errstate(over="ignore"):
                    square = float(x @ x)
                if np.isfinite(x).all() and np.isfinite(square) and square > 0:
                    keep.append(i)
                    blobs.append((x + 0.0).tobytes())  # no negative zero: equal vectors have equal bytes
                    norms.append(math.sqrt(square))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int64())), pa.array(blobs, pa.binary()), pa.array(norms, pa.float64())],
                ["vec_id", "vec", "norm"],
            )

    kind = used.schema["vec_id"].dataType.simpleString()
    return used.mapInArrow(run, f"vec_id {kind}, vec binary, norm double")


def nearest_neighbours(
    rows: DataFrame, is_query: Column, k: int = 20, *, row_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row for whose ``vec_id`` the condition
    ``is_query`` holds, nearest first, ties to the smaller id; nearness is the largest inner product."""
    vectors = cut_lineage(clean_vectors(shipped(rows), row_id, vector).distinct())
    kind = vectors.schema["vec_id"].dataType.simpleString()
    sizes = vectors.groupBy(F.octet_length("vec").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top"))
    common = sizes.orderBy(F.desc("n"), "b").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    size, longest = common["b"] // 8, common["top"]
    vectors = vectors.filter(F.octet_length("vec") == common["b"])
    # the rank limit also works before the shuffle, so a vector with very many copies is cut to k + 1 rows a task
    by_id = Window.partitionBy("vec").orderBy("vec_id")
    few = vectors.select("vec", "vec_id").withColumn("_r", F.row_number().over(by_id)).filter(F.col("_r") <= k + 1)
    classes = cut_lineage(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cid"), "vec", "ids"))
    sample = _matrix(classes.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).select("vec").toArrow().column(0), size)
    n_classes = classes.count()
    depth = min(int(math.log2(MOST_CELLS)), max(0, math.ceil(math.log2(max(1, n_classes / CELL)))))
    space = Space(size, longest, sample, depth)
    asked = cut_lineage(
        vectors.filter(is_query).select(F.col("vec_id").alias("query_id"), "vec").join(classes.select("vec", "cid"), "vec")
        .select("query_id", F.col("cid").alias("qid"), "vec")
    )
    distinct = asked.groupBy("qid").agg(F.first("vec").alias("vec"))
    blocks = max(1, -(-asked.count() // BLOCK))
    block = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
    wanted = k + 1  # the query's own class may have no other row

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = space.cells(space.points(_matrix(batch.column(1), size)))
                yield pa.RecordBatch.from_arrays([pa.array(home), *batch.columns], ["cell", "cid", "vec"])

    placed = cut_lineage(classes.select("cid", "vec").mapInArrow(place, f"cell long, cid {kind}, vec binary"))
    dealt = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("cell", "block")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = space.cells(space.queries(_matrix(batch.column(1), size)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), *batch.columns, pa.array(np.full(batch.num_rows, np.inf))], ["cell", "qid", "vec", "block", "bound"]
                )

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = chi_square_quantile(CONFIDENCE)
        for batch in batches:
            if not batch.num_rows:
                continue
            projected = space.queries(_matrix(batch.column(1), size))
            own = space.cells(projected)
            bound = batch.column(3).to_numpy()
            targets = [[c for c in space.reachable(pq, b * reach) if c != o] for pq, b, o in zip(projected, bound, own)]
            take = pa.array(np.repeat(np.arange(len(targets)), [len(t) for t in targets]))
            cells = pa.array(np.concatenate([np.array(t, dtype=np.int64) for t in targets]))
            yield pa.RecordBatch.from_arrays([cells, *[c.take(take) for c in batch.columns]], ["cell", "qid", "vec", "block", "bound"])

    def search(points: pa.Table, queries: pa.Table) -> pa.Table:
        if not points.num_rows or not queries.num_rows:
            return pa.table({"qid": queries.column("qid").slice(0, 0), "cid": points.column("cid").slice(0, 0), "score": pa.array([], pa.float64()), "kth": pa.array([], pa.float64())})
        x, q = _matrix(points.column("vec"), size), _matrix(queries.column("vec"), size)
        query, row, kth = _search(space, x, q, queries.column("bound").to_numpy(), wanted)
        take_q, take_x = pa.array(query), pa.array(row)
        return pa.table(
            {
                "qid": queries.column("qid").combine_chunks().take(take_q), "cid": points.column("cid").combine_chunks().take(take_x),
                "score": pa.array(_exact(q[query], x[row])), "kth": pa.array(kth[query]),
            }
        )

    def searched(queries: DataFrame) -> DataFrame:
        found = dealt.cogroup(queries.groupBy("cell", "block")).applyInArrow(search, f"qid {kind}, cid {kind}, score double, kth double")
        return cut_lineage(found)

    task = f"cell long, qid {kind}, vec binary, block int, bound double"
    first = searched(distinct.select("qid", "vec", block.alias("block")).mapInArrow(home, task))
    bounds = first.groupBy("qid").agg(F.min("kth").alias("bound"))
    still = distinct.join(bounds, "qid", "left").select("qid", "vec", block.alias("block"), F.coalesce("bound", F.lit(math.inf)).alias("bound"))
    second = searched(still.mapInArrow(onward, task))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "cid")
    found = first.unionByName(second).select("qid", "cid", "score").withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= wanted)
    named = found.join(classes.select("cid", "ids"), "cid").select("qid", "score", F.explode("ids").alias("vec_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select("query_id", "qid").join(named, "qid").filter("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )
