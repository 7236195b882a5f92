"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The top of the tree is fitted on a bounded, documented sample of unit vectors: each node's points are split into clusters
until a node has few points. Every row is put into the leaf that it reaches by the nearest centre of each level. Leaves
that hold many rows are split further where they lie, each on a bounded sample of its rows, so that a leaf's size doesn't grow
with the table. A query walks the top best bin first: a priority queue holds branches by their centre's distance, the nearest
is opened, leaves are visited in the order in which they come out; below, the nearest of the visited leaves' children go
on. How many are visited is widened, level by level, until on a sample of rows that aren't queries, whose true neighbours
come from one exact pass over all rows, the recall reaches the target.

Rows lie in blocks by leaf (a large leaf is dealt to several tasks by a hash of the id); queries in blocks by the
leaves that they visit. One equi-join on the leaf brings them together; a leaf that holds a large part of all rows is
many blocks, which Spark's skew join splits. Scores are exact cosines of the original vectors in double precision.

Nulls and edge cases: vectors that are null, zero, hold null or non-finite components, have no id, or whose length
isn't the most frequent one take no part. Repeated rows are candidates each; a query's own row is every row with its
id; queries that share an id count once (the least vector). A query always visits enough leaves for k candidates of the
fitting sample; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, save
from tessera.llm.vectors import matrix, packed, top, unpacked

FOUND = "query_id long, vec_id long, score double"
PLACED = "id long, v array<double>, leaf long"
BEAM = "id long, v array<double>, leaf long, far double"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled before, so that squares neither overflow nor vanish."""
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), 1e-308)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Centres and the cluster of each point, by cosine; no cluster is empty."""
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        of = np.argmax(x @ centres.T, 1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    of = np.argmax(x @ centres.T, 1)
    used = np.unique(of)
    return centres[used], np.searchsorted(used, of)


@dataclass
class Tree:
    """Nodes in order: centres of the children, children (a node's number, or -1 - leaf)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # of leaves, in the fitting sample

    def leaf(self, points: int) -> int:
        self.sizes.append(points)
        return -len(self.sizes)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row of unit vectors."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))] if self.centres else []
        while todo:
            node, rows = todo.pop()
            way = np.argmax(x[rows] @ self.centres[node].T, 1)
            for j, child in enumerate(self.children[node]):
                own = rows[way == j]
                if len(own) and child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def visit(self, q: np.ndarray, most: int, least_points: int = 0) -> list[int]:
        """Leaves in best-bin-first order: `most`, or more until they held `least_points` points of the sample."""
        if not self.centres:
            return [0]
        queue, out, points = [(0.0, 0)], [], 0
        while queue and (len(out) < most or points < least_points):
            _, node = heapq.heappop(queue)
            if node < 0:
                out.append(-1 - node)
                points += self.sizes[-1 - node]
                continue
            far = 1 - self.centres[node] @ q
            for d, child in zip(far.tolist(), self.children[node], strict=True):
                heapq.heappush(queue, (d, child))
        return out


def fit(x: np.ndarray, branch: int = 12, points: int = 100, seed: int = 3) -> Tree:
    """x: unit vectors; a node of at most `points` of them, or of equal ones, is a leaf."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def build(rows: np.ndarray) -> int:
        if len(rows) <= points:
            return tree.leaf(len(rows))
        centres, of = k_means(x[rows], min(branch, max(2, len(rows) // (points // 2))), rng)
        if len(centres) < 2:
            return tree.leaf(len(rows))
        node = len(tree.centres)
        tree.centres.append(centres)
        tree.children.append([])
        tree.children[node] = [build(rows[of == j]) for j in range(len(centres))]
        return node

    root = build(np.arange(len(x)))
    if root < 0:
        tree.centres, tree.children = [], []
    return tree


def best_of_block(ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    """The best k of a block for each query, with cosines that are the same numbers wherever a row lies."""
    sx, sq = (2.0 ** np.floor(np.log2(np.maximum(np.abs(v).max(1, keepdims=True), 5e-324))) for v in (x, q))
    plain = ((sx > 1e-100) & (sx < 1e100)).all() and ((sq > 1e-100) & (sq < 1e100)).all()
    if not plain:  # powers of two change no digit of a cosine
        x, q = x / sx, q / sq
    nx, nq = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    near = (q @ x.T) / nq[:, None] / nx[None, :]
    near[own[:, None] == ids[None, :]] = -np.inf
    if len(ids) > k:
        near[near < np.partition(near, len(ids) - k, axis=1)[:, [len(ids) - k]] - 1e-9] = -np.inf
    i, j = np.nonzero(near > -np.inf)
    exact = (x[j] * q[i]).sum(1) / (nx[j] * nq[i])
    order = np.lexsort((ids[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)  # within a query
    keep = place < k
    return pa.record_batch([pa.array(own[i[keep]], pa.int64()), pa.array(ids[j[keep]], pa.int64()), pa.array(exact[keep], pa.float64())], ["query_id", "vec_id", "score"])


def exact_top(rows: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """True neighbours of a bounded set of queries, by one pass over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, v = b.column(0).to_numpy(), matrix(b.column(1))
                for at in range(0, len(x), 2048):
                    yield best_of_block(x[at : at + 2048], v[at : at + 2048], ids, q, k)

    return top(rows.select("id", "v").mapInArrow(run, FOUND), k, "double")


def at_share(places: list[int], share: float) -> int:
    """How many visits reach this share of the neighbours whose places in the order of visits are given."""
    places = sorted(places)
    return places[min(len(places) - 1, int(np.ceil(share * len(places))) - 1)] if places else 1


def split_leaves(placed: DataFrame, leaf_rows: int, branch: int, sample: int) -> DataFrame | None:
    """leaf, centres (a row for each child) of the leaves that hold more than `leaf_rows` rows; None if there are none.

    Each is fitted in one task on about `sample` of its rows at most twice as many; a leaf of equal vectors stays.
    """
    sizes = placed.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows)
    large = save(sizes, "ann-large")
    if large.isEmpty():
        return None
    some = placed.join(large, "leaf").filter(F.pmod(F.xxhash64("id", F.lit(13)), F.ceil(F.col("n") / sample)) == 0).select("leaf", "n", "v")

    def centres(group: pa.Table) -> pa.Table:
        x = unit(matrix(group["v"].combine_chunks()))[: 2 * sample]
        k = int(min(branch, -(-group["n"][0].as_py() // leaf_rows), len(x)))
        found = np.unique(k_means(x, k, np.random.default_rng(5))[0], axis=0) if k > 1 else x[:1]
        rows = [found.tolist()] if len(found) > 1 else []
        return pa.table({"leaf": pa.array([group["leaf"][0].as_py()] * len(rows), pa.int64()), "centres": pa.array(rows, pa.list_(pa.list_(pa.float64())))})

    fitted = save(some.groupBy("leaf").applyInArrow(centres, "leaf long, centres array<array<double>>"), "ann-centres")
    return None if fitted.isEmpty() else fitted


def child(leaf: np.ndarray, j: np.ndarray, branch: int) -> np.ndarray:
    """The number of a leaf's child."""
    return leaf * (branch + 1) + 1 + j


def _down(rows: DataFrame, centres: DataFrame, branch: int, all_children: bool) -> DataFrame:
    """id, v, leaf, far one level down: in the nearest child of each row's leaf, or in all of its children; rows of leaves
    without children are left out. Rows meet a leaf's centres in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for leaf, i, body, own in zip(*(b.column(c) for c in range(4)), strict=True):
                ids, x = unpacked(i.as_py(), body.as_py())
                far = 1 - unit(x) @ np.array(own.as_py()).T
                at, j = np.nonzero(np.ones_like(far)) if all_children else (np.arange(len(ids)), np.argmin(far, 1))
                yield pa.record_batch([pa.array(ids[at]), pa.array(list(x[at]), pa.list_(pa.float64())), pa.array(child(np.int64(leaf.as_py()), j, branch)), pa.array(far[at, j])], ["id", "v", "leaf", "far"])

    inside = rows.join(centres.select("leaf"), "leaf", "left_semi").select("id", "v", "leaf")
    met = packed(inside, 1024, "leaf").join(centres.withColumnRenamed("leaf", "key"), "key")
    return met.select("key", "ids", "body", "centres").mapInArrow(run, BEAM)


def descend(placed: DataFrame, centres: DataFrame, branch: int) -> DataFrame:
    """`placed` (id, v, leaf) one level down: each row in the nearest child of its leaf, if that has any."""
    return _down(placed, centres, branch, False).select("id", "v", "leaf").unionByName(placed.join(centres.select("leaf"), "leaf", "left_anti").select("id", "v", "leaf"))


def widen(beam: DataFrame, centres: DataFrame, branch: int) -> DataFrame:
    """`beam` (id, v, leaf, far) one level down: all children of the leaves in it, by their centres' distance; leaves
    without children stay."""
    return _down(beam, centres, branch, True).unionByName(beam.join(centres.select("leaf"), "leaf", "left_anti").select("id", "v", "leaf", "far"))


def in_order(beam: DataFrame) -> DataFrame:
    return beam.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("far", "leaf")))


def search(rows: DataFrame, queries: DataFrame, k: int = 5, target: float = 0.94, fit_sample: int = 20_000, calibration: int = 200, block: int = 2048, query_block: int = 512, leaf_rows: int = 16_384, branch: int = 64, leaf_sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score. rows, queries: id, v (array of double, of one length).

    The top of the tree is fitted on about `fit_sample` rows. Leaves of more than `leaf_rows` rows are split further, each on
    about `leaf_sample` of its rows into `branch` children at most, until none is left: the number of leaves follows the rows'.
    `calibration`: how many rows that aren't queries, about, the numbers of visits are found with.
    """
    spark = rows.sparkSession
    rows = save(rows.filter(F.exists("v", lambda x: x != 0)), "ann-rows")
    own = save(queries.filter(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v")), "ann-queries")
    sample = bounded_sample(rows, "id", fit_sample, seed=5).select("v").collect() or rows.select("v").limit(fit_sample).collect()
    n = own.count()
    if not sample or not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = fit(unit(np.array([r.v for r in sample], float)))
    del sample

    # rows that stand in for queries, their true neighbours, and at which visit the neighbours' leaves come
    asked = bounded_sample(rows.join(own.select("id"), "id", "left_anti"), "id", calibration, seed=11).collect() or own.limit(calibration).collect()
    tried, q = np.array([r.id for r in asked]), np.array([r.v for r in asked], float)
    found = exact_top(rows, tried, q, k).select("query_id", "vec_id")
    near = rows.join(F.broadcast(found), F.col("id") == F.col("vec_id")).select("query_id", "v")  # about k rows a query

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(tree.assign(unit(matrix(b.column(1)))).astype(np.int64))], ["id", "v", "leaf"])

    def walk(visits: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for start in range(0, b.num_rows, 256):
                    ids, vs = b.column(0).slice(start, 256), b.column(1).slice(start, 256)
                    leaves = [tree.visit(v, visits, 4 * (k + 1)) for v in unit(matrix(vs))]
                    at = pa.array(np.repeat(np.arange(len(ids)), [len(x) for x in leaves]))
                    far = np.concatenate([np.arange(len(x), dtype=float) for x in leaves])  # the order of visits
                    yield pa.record_batch([ids.take(at), vs.take(at), pa.array(np.concatenate(leaves).astype(np.int64)), pa.array(far)], ["id", "v", "leaf", "far"])

        return run

    placed = save(rows.select("id", "v").mapInArrow(place, PLACED), "ann-placed")
    truth = save(near.select(F.col("query_id").alias("id"), "v").mapInArrow(place, PLACED), "ann-truth")
    order = {i: {leaf: at for at, leaf in enumerate(tree.visit(v, len(tree.sizes) or 1), 1)} for i, v in zip(tried.tolist(), unit(q), strict=True)}
    visits = at_share([order[r.id][r.leaf] for r in truth.select("id", "leaf").collect() if r.id in order], target)
    beam = save(own.repartition(max(1, n // query_block)).select("id", "v").mapInArrow(walk(visits), BEAM), "ann-beam")
    trial = save(spark.createDataFrame(asked, own.schema).dropDuplicates(["id"]).mapInArrow(walk(visits), BEAM), "ann-trial")
    while (centres := split_leaves(placed, leaf_rows, branch, leaf_sample)) is not None:
        placed, truth = save(descend(placed, centres, branch), "ann-placed"), save(descend(truth, centres, branch), "ann-truth")
        trial = save(in_order(widen(trial, centres, branch)), "ann-trial")
        places = trial.join(truth.select("id", "leaf"), ["id", "leaf"]).select("place").collect()  # about k rows a query
        visits = at_share([r.place for r in places], 1 - (1 - target) / 4)
        trial = trial.filter(F.col("place") <= visits).drop("place")
        beam = save(in_order(widen(beam, centres, branch)).filter(F.col("place") <= visits).drop("place"), "ann-beam")

    # rows are dealt by leaf, large leaves (of equal vectors) to several tasks, so that blocks are full
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * block)).alias("shares"))
    dealt = placed.join(sizes, "leaf").withColumn("share", F.pmod(F.xxhash64("id"), "shares")).repartition("leaf", "share").select("id", "v", "leaf")
    file = save(packed(dealt, block, "leaf"), "ann-file", "none")
    asks = packed(beam.select("id", "v", "leaf"), query_block, "leaf")
    asks = save(asks.select("key", F.col("ids").alias("q_ids"), F.col("body").alias("q_body")), "ann-asked", "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x, qi, q in zip(*(b.column(j) for j in range(4)), strict=True):
                yield best_of_block(*unpacked(i.as_py(), x.as_py()), *unpacked(qi.as_py(), q.as_py()), k)

    met = file.join(asks, "key").select("ids", "body", "q_ids", "q_body").mapInArrow(run, FOUND)
    return top(met, k, "double")
