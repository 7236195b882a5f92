"""Exact top-k search by inner product with a vector-approximation file.

Each component of a vector of whole numbers is replaced by the number of its cell: `bits` bits a component, with cell
bounds at quantiles of a bounded sample (any bounds give right results) and the component's least and largest value outside.
A block of the file holds cells and, in columns of their own, exact vectors and ids; vectors that a block holds several
times are one entry with their ids. Rows are dealt by a hash of their vector and lie in its order, so that equal ones
share a block or a few.

1. Cells tell which entries can matter. For a cell of centre c and half width h, q . x lies within q . c +- |q| . h. Those
   are left whose upper bound gets to the query's least score: at first its k-th among the sampled rows, found before, later
   its k-th exact score so far. A product in single precision, with a margin for its rounding, rules out most. Where that
   tells too little, those are left that get to the k-th lower bound of 4,096 entries.
2. Exact vectors are read of the entries that are left. No other can be among the k best, ties included: the result is
   certain.

Queries come in blocks, too. Blocks of rows are dealt to groups, a partition each, and every group gets a copy of all
queries by the shuffle. A task holds its group (up to some `group` blocks), passes the queries along it and gives k
scores a query. There are as many copies as groups, not as blocks, and nothing that grows with the rows is broadcast.

Scores are exact integers, whatever the size of the components; beyond 64 bits they count as the largest (least) such
number. Vectors whose bounds overflow a double are read exactly instead.

Nulls and edge cases: vectors that are null, hold null or non-finite components, have no id, or whose length isn't
the most frequent one take no part. Repeated rows are candidates each; a query's own row is every row with its id;
queries that share an id count once (the least vector). Fewer than k candidates give them all. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_sample, save
from tessera.llm.vectors import packed, top, unpacked

MOST = (1 << 63) - 1
#: Queries that a task passes along its group at a time, entries that they meet at a time, exact vectors read at a time.
TOGETHER, STRETCH, READ = 1024, 4096, 1 << 15
FILE = "block long, cells binary, exact binary, ids binary, starts binary"
FOUND = "query_id long, vec_id long, score long"


def whole_numbers(rows: DataFrame, scale: float) -> DataFrame:
    """id, v: floor(scale * x) of each component, as doubles; past 2^52 they are whole already, past all doubles the largest."""

    def whole(x: Column) -> Column:
        y = F.greatest(F.least(x * scale, F.lit(1.7976931348623157e308)), F.lit(-1.7976931348623157e308))
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return rows.select("id", F.transform("v", whole).alias("v"))


def bounds_of(rows: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each component: one aggregation over all rows."""
    r = rows.agg(*[f(F.col("v")[i]).alias(f"{n}{i}") for i in range(dims) for n, f in (("a", F.min), ("b", F.max))]).first()
    return np.array([r[f"a{i}"] for i in range(dims)]), np.array([r[f"b{i}"] for i in range(dims)])


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """(dims, cells + 1) bounds: inner ones at quantiles of the sample, outer ones at the extremes of all rows."""
    inner = np.quantile(sample, np.arange(1, 2**bits) / 2**bits, axis=0, method="lower").T
    return np.concatenate([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None]], 1)


def cells_of(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of each component: that of the last inner bound which it gets to."""
    return np.stack([np.searchsorted(edges[j, 1:-1], x[:, j], "right") for j in range(x.shape[1])], 1).astype("u1")


def score_bounds(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(queries, entries) lower and upper bounds of the inner products; rounding is on the safe side."""
    at = np.arange(cells.shape[1])[None, :]
    low, high = edges[at, cells], edges[at, cells.astype(np.int64) + 1]
    with np.errstate(over="ignore", invalid="ignore"):
        half = (high - low) / 2
        mid, size = queries @ (low + half).T, np.abs(queries)
        slack = size @ half.T * (1 + 1e-9) + size @ (np.maximum(np.abs(low), np.abs(high)) * 1e-12).T + 1e-9
        lower, upper = mid - slack, mid + slack
    bad = ~np.isfinite(lower) | ~np.isfinite(upper)
    lower, upper = np.clip(lower, -(2.0**63), 2.0**63), np.clip(upper, -(2.0**63), 2.0**63)  # as scores are
    lower[bad], upper[bad] = -np.inf, np.inf
    return lower, upper


def least_scores(ids: np.ndarray, x: np.ndarray, asker: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """What each query's k-th score is at least, by the rows (ids, x) but its own; -inf if they don't tell."""
    if len(ids) < k:
        return np.full(len(asker), -np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ x.T
        unknown = ~np.isfinite(scores).all(1)
        scores[ids[None, :] == asker[:, None]] = -np.inf
        kth = np.partition(scores, -k, axis=1)[:, -k] - np.abs(q) @ np.abs(x).max(0) * x.shape[1] * 2.0**-50
    return np.where(unknown | ~np.isfinite(kth), -np.inf, np.clip(kth, -(2.0**63), 2.0**63))


def sides(cells: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Entries in single precision: the centres of their cells, the half widths, and 1."""
    at = np.arange(cells.shape[1])[None, :]
    parts = [((edges[:, 1:] + sign * edges[:, :-1]) / 2).astype("f4")[at, cells] for sign in (1, -1)]
    return np.concatenate([*parts, np.ones((len(cells), 1), "f4")], 1)


def reaching(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """query, entry of those whose upper bound gets to `least`, for moderate values.

    One product in single precision gives how far upper bounds are above `least`; the margin is over twice what rounding can come to.
    """
    size = np.abs(queries)
    margin = (size @ np.abs(edges).max(1) + np.abs(least)) * (4 * queries.shape[1] + 64) * 2.0**-23 + 1e-6
    above = np.concatenate([queries, size, (margin - least)[:, None]], 1).astype("f4") @ sides(cells, edges).T
    return np.divmod(np.flatnonzero(above.ravel() >= 0), len(cells))


def left(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int, mine: Callable[[slice], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """query, entry of those that can matter, whatever the values. mine: which entries are no candidates of a stretch of queries."""
    most, largest = float(np.abs(queries).max()), float(np.abs(edges).max())
    if max(most, largest) < 1e15 and most * largest * queries.shape[1] < 2.0**62 and np.isfinite(least).all():
        return reaching(cells, edges, queries, least)
    found = []
    for n in range(0, len(queries), 256):
        some = slice(n, n + 256)
        lower, upper = score_bounds(cells, edges, queries[some])
        own = mine(some)
        lower[own] = upper[own] = -np.inf
        kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(lower), -np.inf)
        i, j = np.nonzero((upper >= np.maximum(kth, least[some])[:, None]) & (upper > -np.inf))
        found.append((i + n, j))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Group:
    """Blocks of rows as one: cells, exact vectors and ids of their entries."""

    def __init__(self, blocks: list[tuple[np.ndarray, ...]], edges: np.ndarray):
        cells, exact, ids, starts = zip(*blocks, strict=True)
        self.cells, self.exact, self.ids, self.edges = np.concatenate(cells), np.concatenate(exact), np.concatenate(ids), edges
        before = np.cumsum([0, *(len(i) for i in ids)])
        self.begin = np.concatenate([s[:-1] + n for s, n in zip(starts, before[:-1], strict=True)])
        self.count = np.concatenate([np.diff(s) for s in starts])
        self.single = self.ids[self.begin] == self.ids[self.begin + self.count - 1]

    def best(self, asker: np.ndarray, queries: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, id, score of each query's k best; `least`: what scores get to at least."""
        least, of, ids, scores = least.copy(), *(np.zeros(0, np.int64) for _ in range(3))
        for n in range(0, len(self.cells), STRETCH):
            single, first = self.single[n : n + STRETCH], self.ids[self.begin[n : n + STRETCH]]
            i, j = left(self.cells[n : n + STRETCH], self.edges, queries, least, k, lambda some, single=single, first=first: single & (first == asker[some, None]))
            for m in range(0, len(i), READ):
                a, b = i[m : m + READ], j[m : m + READ] + n
                score = inner_products(self.exact[b].astype(float), queries[a])
                good = score >= least[a]
                a, b, score = a[good], b[good], score[good]
                count = self.count[b]
                at = np.repeat(self.begin[b] - np.cumsum(count) + count, count) + np.arange(count.sum())
                a, score, own = np.repeat(a, count), np.repeat(score, count), self.ids[at]
                other = own != asker[a]
                of, ids, scores = np.concatenate([of, a[other]]), np.concatenate([ids, own[other]]), np.concatenate([scores, score[other]])
                order = np.lexsort((ids, -scores, of))
                of, ids, scores = of[order], ids[order], scores[order]
                nth = np.arange(len(of)) - np.searchsorted(of, of)
                of, ids, scores, nth = of[nth < k], ids[nth < k], scores[nth < k], nth[nth < k]
                least[of[nth == k - 1]] = np.maximum(least[of[nth == k - 1]], scores[nth == k - 1])
        return of, ids, scores


def entries_of(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, ids, and where each vector's ids start; of a vector only the ids that can be needed.

    Those are its k + 1 least ids, each at most k times: one of them may be the query's own.
    """
    whole = np.ascontiguousarray(x + 0.0).view(f"V{8 * x.shape[1]}").ravel()  # -0.0 is 0.0
    _, first, of = np.unique(whole, return_index=True, return_inverse=True)
    order = np.lexsort((ids, of))
    ids, of = ids[order], of[order]
    new_vector = np.concatenate([[True], of[1:] != of[:-1]])
    new_id = new_vector | np.concatenate([[True], ids[1:] != ids[:-1]])
    begins = np.flatnonzero(new_vector)
    nth_id = np.cumsum(new_id) - np.cumsum(new_id)[begins][of]
    repeat = np.arange(len(ids)) - np.flatnonzero(new_id)[np.cumsum(new_id) - 1]
    keep = (nth_id <= k) & (repeat < k)
    starts = np.concatenate([[0], np.cumsum(np.bincount(of[keep], minlength=len(first)))])
    return x[first], ids[keep], starts


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each, where all of a block fit, else as doubles."""
    return (x.astype("<i2") if np.abs(x).max(initial=0) < 1 << 15 else x.astype("<f8")).tobytes()


def vectors_of(body: bytes, n: int, dims: int) -> np.ndarray:
    """n vectors of narrow()."""
    return np.frombuffer(body, "<i2" if len(body) == 2 * n * dims else "<f8").reshape(n, dims)


def inner_products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 2**53:
        return (x * q).sum(1).astype(np.int64)
    if most < 2**62 and max(np.abs(x).max(), np.abs(q).max()) < 2**62:
        return (x.astype(np.int64) * q.astype(np.int64)).sum(1)
    return np.array([max(-MOST, min(MOST, sum(int(a) * int(b) for a, b in zip(r.tolist(), s.tolist(), strict=True)))) for r, s in zip(x, q, strict=True)], np.int64)


def search(rows: DataFrame, queries: DataFrame, k: int = 5, bits: int = 6, block: int = 4096, query_block: int = 256, sample: int = 4096, group: int = 128) -> DataFrame:
    """query_id, rank, vec_id, score. rows, queries: id, v (whole numbers as doubles, of one length).

    sample: how many rows, about, the bounds of the cells and each query's first least score are taken from.
    group: how many blocks of rows a task holds, about, if there are more of them than tasks.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    some = bounded_sample(rows, "id", sample, seed=9).select("id", "v").collect() or rows.select("id", "v").limit(1).collect()
    if not some:
        return empty
    some_ids, some_x = np.array([r.id for r in some]), np.array([r.v for r in some], float)
    dims, tasks = some_x.shape[1], 3 * spark.sparkContext.defaultParallelism
    low, high = bounds_of(rows, dims)
    edges = cell_edges(some_x, low, high, bits)

    asked = save(queries.groupBy("id").agg(F.min("v").alias("v")).withColumnRenamed("id", "query_id"), "va-asked")
    n = asked.count()
    if not n:
        return empty
    by_block = packed(asked.withColumnRenamed("query_id", "id").repartition(max(1, min(n // query_block, tasks))), query_block)

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, body in zip(b.column(0), b.column(1), strict=True):
                asker, q = unpacked(ids.as_py(), body.as_py())
                parts = [asker.tobytes(), narrow(q), least_scores(some_ids, some_x, asker, q, k).tobytes()]
                yield pa.record_batch([pa.array([p], pa.binary()) for p in parts], ["ids", "body", "more"])

    query_blocks = save(by_block.select("ids", "body").mapInArrow(started, "ids binary, body binary, more binary"), "va-queries", "snappy")

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for ids, body in zip(b.column(0), b.column(1), strict=True):
                x, own, starts = entries_of(*unpacked(ids.as_py(), body.as_py()), k)
                parts = [cells_of(x, edges).tobytes(), narrow(x), own.astype("<i8").tobytes(), starts.astype("<i4").tobytes()]
                yield pa.record_batch([pa.array([number], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], ["block", "cells", "exact", "ids", "starts"])
                number += 1

    dealt = rows.select("id", "v", F.xxhash64("v").alias("h")).hint("rebalance", F.col("h")).sortWithinPartitions("h")
    file = save(packed(dealt, block).select("ids", "body").mapInArrow(approximate, FILE), "va-file", "snappy")
    blocks = file.count()
    groups = max(1, -(-blocks // group), min(blocks, tasks))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A group's blocks of rows come first, then blocks of queries, which have no cells."""
        held: list[tuple[np.ndarray, ...]] = []
        waiting: list[tuple[np.ndarray, ...]] = []
        whole: Group | None = None

        def passed() -> pa.RecordBatch:
            nonlocal whole
            whole = whole or Group(held, edges)
            held.clear()
            asker, q, least = (np.concatenate(x) for x in zip(*waiting, strict=True))
            waiting.clear()
            of, ids, scores = whole.best(asker, q.astype(float), least, k)
            return pa.record_batch([pa.array(asker[of]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

        for b in batches:
            for cells, ids, body, more in zip(*(b.column(i) for i in range(4)), strict=True):
                own, body = np.frombuffer(ids.as_py(), "<i8"), body.as_py()
                if cells.is_valid:
                    starts = np.frombuffer(more.as_py(), "<i4").astype(np.int64)
                    n = len(starts) - 1
                    held.append((np.frombuffer(cells.as_py(), "u1").reshape(n, -1), vectors_of(body, n, dims), own, starts))
                elif held or whole:
                    waiting.append((own, vectors_of(body, len(own), dims), np.frombuffer(more.as_py(), "<f8")))
                    if sum(len(w[0]) for w in waiting) >= TOGETHER:
                        yield passed()
        if waiting:
            yield passed()

    per_block = file.select("cells", "ids", F.col("exact").alias("body"), F.col("starts").alias("more"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"))
    copies = query_blocks.select(F.lit(None).cast("binary").alias("cells"), "ids", "body", "more", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    met = per_block.unionByName(copies).repartitionById(groups, F.col("g")).sortWithinPartitions(F.col("cells").isNull())
    return top(save(met.select("cells", "ids", "body", "more").mapInArrow(scan, FOUND), "va-bounds"), k, "long")
