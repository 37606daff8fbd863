"""Approximate nearest neighbours by cosine: a forest of random-projection trees and a shared priority queue.

The trees are grown on a bounded sample; every vector is indexed: it is dealt to its leaf of each tree. A search keeps
one queue for all trees, ordered by how near the query is to the border of the part not yet seen, and opens leaves in
that order. How many leaves a search opens is calibrated: for a sample of queries the true neighbours are found by
comparison with every vector, and the budget is the least at which the wanted share of them lies in opened leaves.
Queries and vectors meet leaf by leaf, where cosines are computed exactly, in blocks; a task gives a few rows for each
query that reached it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NEAREST, EVERY = 5, 50
#: Numbers that a block of comparisons holds.
PAIRS = 1 << 21


@dataclass
class Tree:
    """planes and cuts by inner node, in heap order; leaf k is node k + len(planes). All trees have one depth."""

    planes: np.ndarray
    cuts: np.ndarray


def grow(x: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
    """Split unit vectors by the median along the line between two of them, drawn at random, to the depth."""
    inner = (1 << depth) - 1
    planes, cuts = np.zeros((inner, x.shape[1]), np.float32), np.zeros(inner, np.float32)
    parts = {0: np.arange(len(x))}
    for node in range(inner):
        rows = parts.pop(node, np.zeros(0, np.int64))
        if len(rows) >= 2:
            a, b = x[rng.choice(rows, 2, replace=False)]
            plane = a - b
        else:
            plane = rng.standard_normal(x.shape[1])
        norm = np.linalg.norm(plane)
        planes[node] = plane / norm if norm > 0 else rng.standard_normal(x.shape[1]) / np.sqrt(x.shape[1])
        p = x[rows] @ planes[node]
        cuts[node] = np.median(p) if len(p) else 0.0
        parts[2 * node + 1], parts[2 * node + 2] = rows[p < cuts[node]], rows[p >= cuts[node]]
    return Tree(planes, cuts)


def leaves(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector."""
    at = np.zeros(len(x), np.int64)
    for _ in range((len(tree.planes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", x, tree.planes[at]) >= tree.cuts[at])
    return at - len(tree.planes)


def opened(trees: list[Tree], q: np.ndarray, budget: int) -> list[tuple[int, int]]:
    """(tree, leaf) in the order in which one queue over all trees opens them for a unit vector, budget at most."""
    margins = [t.planes @ q - t.cuts for t in trees]
    queue: list[tuple[float, int, int]] = [(-np.inf, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    out = []
    while queue and len(out) < budget:
        bound, t, node = heapq.heappop(queue)
        inner = len(margins[t])
        while node < inner:  # go to the near side at once; the far side waits at its distance
            d = float(margins[t][node])
            near = 2 * node + 1 + (d >= 0)
            heapq.heappush(queue, (max(bound, abs(d)), t, 4 * node + 3 - near))
            node = near
        out.append((t, node - inner))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def best(queries: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query, the k nearest rows of x: place of the query, id, cosine.

    Products in single precision only propose: every row that their error may hide among the k nearest is compared in
    double precision, in blocks of PAIRS numbers.
    """
    u, none = _unit(x), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    out, k = [none], min(k, len(x))
    if not k:
        return none
    slack = np.float32(2 * (x.shape[1] + 4) * 2.0**-24)  # of a sum of so many products, for a row and the k-th one
    block, pairs = max(1, min(block, PAIRS // len(x))), max(1, PAIRS // x.shape[1])
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        s = _unit(q) @ u.T
        least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
        place, row = np.nonzero(s >= (least - slack)[:, None])
        held = none
        for lo in range(0, len(place), pairs):
            p, r = place[lo : lo + pairs], row[lo : lo + pairs]
            held = _cut(*(np.concatenate(c) for c in zip(held, (at + p, ids[r], cosines(q[p], x[r])), strict=True)), k)
        out.append(held)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _cut(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, once each."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    fresh = np.r_[True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])] if len(query) else np.zeros(0, bool)
    query, ids, score = query[fresh], ids[fresh], score[fresh]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[rank < k], ids[rank < k], score[rank < k]


def usable(vector: Column, dim: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)


def fit(distinct: DataFrame, dim: int, n: int, trees: int, leaf: int, most_rows: int, seed: int) -> list[Tree]:
    """Grow trees on at most most_rows distinct vectors, those of least hash; leaves hold about leaf of all n vectors.

    A tree has at most one leaf for 16 rows of the sample, so that the forest stays small; beyond that leaves grow.
    """
    rows = common.least(distinct, F.xxhash64("id", F.lit(seed)), most_rows).select("id", "vector").toPandas().sort_values("id")
    x = _unit(np.array(rows["vector"].tolist(), np.float32).reshape(-1, dim))
    depth = max(0, int(np.ceil(np.log2(max(n / leaf, 1)))))
    depth = min(depth, int(np.log2(max(len(x) // 16, 1))))
    rng = np.random.default_rng(seed)
    return [grow(x, depth, rng) for _ in range(trees)]


def calibrate(distinct: DataFrame, queries: DataFrame, forest: list[Tree], k: int, target: float, most_queries: int, seed: int) -> int:
    """The number of leaves a search must open so that, over a bounded sample of queries, a share target of the true
    neighbours is found. The truth comes from comparing the sample with every vector."""
    picked = common.least(queries, F.xxhash64("id", F.lit(seed)), most_queries).toPandas().sort_values("id")
    every = len(forest) * (len(forest[0].planes) + 1)
    if not len(picked):
        return every
    q, own = np.array(picked["vector"].tolist(), np.float32), picked["id"].to_numpy()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            held = list(_cut(*(np.concatenate(c) for c in zip(held, best(q, b.column(0).to_numpy(), _matrix(b.column(1)), k + 1), strict=True)), k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["q", "id", "score"])

    near = distinct.select("id", "vector").transform(common.in_arrow, compare, "q long, id long, score double")
    top = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("r") <= k + 1)
    truth = top.join(distinct, "id").select("q", "id", "vector").toPandas()  # most_queries * (k + 1) rows
    truth = truth[truth["id"].to_numpy() != own[truth["q"].to_numpy(int)]]
    if not len(truth):
        return every
    home = np.column_stack([leaves(t, _unit(np.array(truth["vector"].tolist(), np.float32))) for t in forest])
    units, need = _unit(q), []
    for i in range(len(q)):
        when = {at: rank for rank, at in enumerate(opened(forest, units[i], every))}
        need += [min(when[t, int(leaf)] for t, leaf in enumerate(row)) for row in home[truth["q"].to_numpy(int) == i]]
    return int(np.sort(need)[min(int(np.ceil(target * len(need))), len(need) - 1)]) + 1


def search(vectors: DataFrame, queries: Column, k: int = NEAREST, trees: int = 10, leaf: int = 256, most_rows: int = 16_384, target: float = 0.95, most_queries: int = 128, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by largest cosine, ties to the smaller vec_id.

    vectors needs vec_id and embedding; other columns are ignored, whatever their names. queries is a condition on
    vec_id that chooses the queries; candidates are all rows but the query's own. Rows take no part if vec_id or
    embedding is null, the embedding is zero or holds a null or a non-finite component, or its length is not the
    table's most frequent one (the longer of two equally frequent). Rows that repeat a vec_id with an equal embedding
    count once; equal embeddings under other ids are all candidates, and are compared once. With fewer than k
    candidates all are returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    sizes = vectors.filter("vec_id is not null and embedding is not null").groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if sizes is None or sizes["n"] < 1:
        return spark.createDataFrame([], shape)
    dim = sizes["n"]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector")).filter(F.col("vec_id").isNotNull() & usable(F.col("vector"), dim))
    # at most k + 1 ids of equal vectors can be wanted, the least ones; the limit holds before the shuffle as well
    few = rows.distinct().withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    classes = common.saved(few.groupBy("vector").agg(F.min("vec_id").alias("id"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "neighbour-classes")
    n = classes.count()
    asked = rows.filter(queries).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = common.saved(asked.join(classes.select("vector", "id"), "vector"), "neighbour-queries")
    points = asked.select("id", "vector").distinct()
    if not n or asked.isEmpty():
        return spark.createDataFrame([], shape)
    distinct = classes.select("id", "vector")
    forest = fit(distinct, dim, n, trees, leaf, most_rows, seed)
    budget = calibrate(distinct, points, forest, k, target, most_queries, seed)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = _unit(_matrix(b.column(1)))
            for t, tree in enumerate(forest):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), t, np.int32)), pa.array(leaves(tree, u).astype(np.int32)), pa.array(np.ones(len(u), np.int32)), *b.columns], names=["tree", "leaf", "kind", "id", "vector"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 32):
                b = batch.slice(at, 32)
                ways = [opened(forest, u, budget) for u in _unit(_matrix(b.column(1)))]
                place = pa.array(np.repeat(np.arange(len(ways)), [len(w) for w in ways]))
                tree, where = (pa.array([x[i] for w in ways for x in w], pa.int32()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([tree, where, pa.array(np.zeros(len(place), np.int32)), *(c.take(place) for c in b.columns)], names=["tree", "leaf", "kind", "id", "vector"])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for part in common.runs(batches, ["tree", "leaf"], 4096):
            tree, where, kind = (part.column(c).to_numpy() for c in ("tree", "leaf", "kind"))
            ids, x = part.column("id").to_numpy(), _matrix(part.column("vector"))
            edge = np.r_[0, np.flatnonzero((tree[1:] != tree[:-1]) | (where[1:] != where[:-1])) + 1, len(ids)]
            made = [held]
            for lo, hi in zip(edge, edge[1:], strict=False):
                mid = lo + int(np.searchsorted(kind[lo:hi], 1))
                if lo < mid < hi:
                    q, i, s = best(x[lo:mid], ids[mid:hi], x[mid:hi], k + 1)
                    made.append([ids[lo:mid][q], i, s])
            held = list(_cut(*(np.concatenate(c) for c in zip(*made, strict=True)), k + 1))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query", "id", "score"])

    stream = "tree int, leaf int, kind int, id long, vector array<float>"
    both = distinct.transform(common.in_arrow, index, stream).unionByName(points.repartition("id").transform(common.in_arrow, visit, stream))
    dealt = both.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "kind")

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a query's own vector, scored as every other
            x = _matrix(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(0), pa.array(cosines(x, x))], names=["query", "id", "score"])

    self_ = points.transform(common.in_arrow, alone, "query long, id long, score double")
    near = dealt.transform(common.in_arrow, rerank, "query long, id long, score double").unionByName(self_)
    near = near.groupBy("query", "id").agg(F.max("score").alias("score"))
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = near.withColumn("r", F.row_number().over(by_query)).filter(F.col("r") <= k + 1)
    listed = near.join(classes.select("id", "ids"), "id").select(F.col("query").alias("id"), "ids", "score")
    pairs = asked.select("query_id", "id").join(listed, "id").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
