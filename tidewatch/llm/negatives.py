"""Hard negatives by a vector-approximation file.

Every vector is approximated by the cell that each of its dimensions lies in. For an anchor, one table holds the least and
the greatest product that each cell allows, so that the bounds of a score are sums looked up by cell; two dimensions
share a table. Only a row whose bounds still let it enter the answer is scored exactly, in integers.

Rows are dealt to blocks of a bounded size and anchors meet every block, as each is asked against all rows. A task holds
the block and lets the anchors stream past; it answers for each with the few best of its block. The first pass finds
positives: the block holds only rows of the anchor's label. The second finds negatives: for each positive a window of
scores, entered by rows of other labels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 50, 5, 3
#: A negative's score lies between these shares of the positive's, as (numerator, denominator).
LEAST_SHARE, MOST_SHARE = (1, 2), (19, 20)
CELLS = 16
#: Rows of a block, and anchors that are compared with it at once.
BLOCK, AT_ONCE = 8192, 64
#: Vectors, of least hash, from which the borders of cells are taken; the outermost cells reach to the table's extremes.
SAMPLE = 16_384


class Cells:
    """Borders of the cells of each dimension: cell c of dimension j holds integers from low[j, c] to high[j, c]."""

    def __init__(self, sample: np.ndarray, least: np.ndarray, most: np.ndarray):
        inner = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="nearest").astype(np.int64).T
        self.starts = np.sort(np.maximum(inner, least[:, None]), axis=1)
        self.low = np.concatenate([least[:, None], self.starts], axis=1)
        self.high = np.maximum(np.concatenate([self.starts - 1, most[:, None]], axis=1), self.low)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cells of vectors, two dimensions in a byte: a row for each two dimensions, a column for each vector."""
        cell = np.zeros((x.shape[1] + x.shape[1] % 2, len(x)), np.uint8)
        for j, starts in enumerate(self.starts):
            cell[j] = np.searchsorted(starts, x[:, j], "right")
        return cell[::2] * np.uint8(CELLS) + cell[1::2]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each anchor and two dimensions, the least and greatest sum of products for each two cells."""
        a, b = q[:, :, None] * self.low, q[:, :, None] * self.high
        both = np.stack([np.minimum(a, b), np.maximum(a, b)], axis=-1)
        if both.shape[1] % 2:
            both = np.concatenate([both, np.zeros((len(q), 1, CELLS, 2), np.int64)], axis=1)
        return np.ascontiguousarray(both[:, ::2, :, None] + both[:, 1::2, None, :]).reshape(len(q), -1, CELLS * CELLS, 2)

    def bounds(self, table: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each vector with the anchor whose table this is."""
        total = np.zeros((cells.shape[1], 2), np.int64)
        both = table.view(np.complex128)[..., 0]  # two integers move as one value of 16 bytes
        for t, c in zip(both, cells, strict=True):
            total += t.take(c).view(np.int64).reshape(-1, 2)
        return total[:, 0], total[:, 1]


def _kth(x: np.ndarray, k: int) -> int:
    """The k-th greatest value, or one below all of them where there are fewer."""
    return int(np.partition(x, len(x) - k)[len(x) - k]) if len(x) >= k else np.iinfo(np.int64).min


def nearest(low: np.ndarray, high: np.ndarray, score: Callable[[np.ndarray], np.ndarray], ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the k best scores, ties to the smaller id, and those scores: only rows whose upper bound reaches the
    k-th best lower bound are scored."""
    rows = np.flatnonzero(high >= _kth(low, k))
    s = score(rows)
    first = np.lexsort((ids[rows], -s))[:k]
    return rows[first], s[first]


def in_window(low: np.ndarray, high: np.ndarray, score: Callable[[np.ndarray], np.ndarray], ids: np.ndarray, k: int, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """nearest() among rows whose score lies between least and most. Rows whose bounds both lie there are sure to enter;
    only rows that the k-th best of these does not keep out are scored."""
    sure = (low >= least) & (high <= most)
    rows = np.flatnonzero((low <= most) & (high >= max(least, _kth(low[sure], k))))
    s = score(rows)
    inside = (s >= least) & (s <= most)
    rows, s = rows[inside], s[inside]
    first = np.lexsort((ids[rows], -s))[:k]
    return rows[first], s[first]


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], pa.RecordBatch]]:
    """For batches sorted by part, block and kind, where a block's rows (kind 0) come before its anchors: the block's rows and
    some of its anchors, again and again. Only a block's rows are held."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        part, block, kind = (batch.column(c).to_numpy() for c in ("part", "block", "kind"))
        edge = np.r_[0, np.flatnonzero((part[1:] != part[:-1]) | (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])) + 1, len(block)]
        for lo, hi in zip(edge, edge[1:], strict=False):
            if (part[lo], block[lo]) != now:
                now, held = (part[lo], block[lo]), []
            if kind[lo] == 0:
                held.append(batch.slice(lo, hi - lo))
            elif held:
                for at in range(lo, hi, AT_ONCE):
                    yield held, batch.slice(at, min(AT_ONCE, hi - at))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


MEET = "part long, block long, kind int, id long, least long, label long, vector array<int>, scores array<long>"
FOUND = "anchor long, positive_score long, id long, least long, score long"


def _answers(rows: DataFrame, cells: Cells, positive: bool, k: int) -> DataFrame:
    """FOUND: of each block, the k best rows of each anchor (or of each of its positive scores), for rows as MEET says."""
    names = ["anchor", "positive_score", "id", "least", "score"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, made = None, [[] for _ in names]
        for parts, anchors in _streams(batches):
            if held is not parts:
                held, block = parts, pa.Table.from_batches(parts)
                ids, least, labels, x = *(block.column(c).to_numpy() for c in ("id", "least", "label")), _matrix(block.column("vector"))
                near = cells.of(x)
            q = _matrix(anchors.column("vector"))
            tables, asked = cells.tables(q), anchors.column("scores").to_pylist()
            for i, (own, label) in enumerate(zip(anchors.column("id").to_pylist(), anchors.column("label").to_pylist(), strict=True)):
                low, high = cells.bounds(tables[i], near)
                if positive:
                    answers = [(None, *nearest(low, high, lambda r, i=i: x[r] @ q[i], least, k))]
                else:
                    other = np.flatnonzero(labels != label)
                    low, high, order = low[other], high[other], least[other]
                    score = lambda r, i=i, other=other: x[other[r]] @ q[i]
                    answers = [(s, other[r], v) for s in asked[i] for r, v in [in_window(low, high, score, order, k, *window(s))]]
                for s, r, v in answers:
                    for column, values in zip(made, ([own] * len(r), [s] * len(r), ids[r].tolist(), least[r].tolist(), v.tolist()), strict=True):
                        column += values
            if len(made[0]) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=names)
                made = [[] for _ in names]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in made], names=names)

    dealt = rows.repartition("part", "block").sortWithinPartitions("part", "block", "kind")
    return dealt.transform(common.in_arrow, answer, FOUND)


def window(positive_score: int) -> tuple[int, int]:
    """Least and greatest score of a negative."""
    (a, b), (c, d) = LEAST_SHARE, MOST_SHARE
    return -(-a * positive_score // b), c * positive_score // d


def _best(found: DataFrame, classes: DataFrame, by: list[str], k: int) -> DataFrame:
    """by and best: the k best of each group of by, as an array of (less, vec_id, id) in order, where less is -score."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "least", "id"))
    few = found.withColumn("r", rank).filter(F.col("r") <= k).join(classes.select("id", "ids"), "id")
    one = few.select(*by, "id", "score", F.explode("ids").alias("vec_id"))
    one = one.withColumn("one", F.struct((-F.col("score")).alias("less"), "vec_id", "id"))
    return one.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list("one")), 1, k).alias("best"))


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of each anchor's positives.

    vectors needs vec_id, label and embedding; other columns are ignored, whatever their names. anchors is a condition on
    vec_id. A component becomes floor(SCALE * x), a score is an integer inner product, and ties go to the smaller vec_id.
    An anchor's positives are the best other rows of its label; for each, the best rows of other labels
    whose score lies between LEAST_SHARE and MOST_SHARE of the positive's are its negatives, ranked from 1. Fewer rows
    give fewer answers. Rows take no part if vec_id, label or embedding is null, the embedding is empty, holds a null or a
    non-finite component, its length is not the table's most frequent one (the longer of two equally frequent), or a
    component is so great that scores need not fit 64 bits (millions, at usual lengths). Rows equal in id, label and
    integers count once; rows that share only the id are rows of their own. Equal vectors of a label are scored once,
    whatever their number, and answer by their ids. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = vectors.filter("vec_id is not null and label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.filter(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    dim = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if dim is None or dim["n"] < 1:
        return spark.createDataFrame([], shape)
    dim = dim["n"]
    most = min(math.isqrt(((1 << 63) - 1) // dim), (1 << 31) - 1)  # so that every score fits 64 bits
    rows = rows.filter((F.size("x") == dim) & F.forall("x", lambda v: F.abs(v) * SCALE < most - 1))
    rows = rows.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("vector")).distinct()
    # an answer can want only the least ids of equal vectors; the limit holds before the shuffle as well
    wanted = max(positives + 1, negatives)
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("label", "vector").orderBy("vec_id"))).filter(F.col("r") <= wanted)
    classes = few.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = common.saved(classes.withColumn("id", F.monotonically_increasing_id()), "negative-classes")
    asked = rows.filter(anchors).join(classes.select("label", "vector", "id"), ["label", "vector"]).select(F.col("vec_id").alias("anchor_id"), "id")
    asked = common.saved(asked, "negative-anchors")
    points = common.saved(asked.select("id").distinct().join(classes.select("id", "label", "vector"), "id"), "negative-points")
    if points.isEmpty():
        return spark.createDataFrame([], shape)
    cells = _cells(classes, dim, sample)

    labels = common.saved(classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n")), "negative-labels")
    in_label = lambda df: common.meet(df, labels, ["label"], "inner", 16).withColumn("part", F.col("label"))
    n = -(-classes.count() // block)
    in_all = lambda df: df.withColumns({"n": F.lit(n).cast("long"), "part": F.lit(0).cast("long")})

    def meeting(asking: DataFrame, dealt: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of each block, and the anchors that meet it, as MEET says."""
        own = dealt(classes).select("part", F.pmod(F.xxhash64("id"), "n").alias("block"), F.lit(0).alias("kind"), "id", "least", "label", "vector", F.lit(None).cast("array<long>").alias("scores"))
        return own.unionByName(dealt(asking).select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("block"), F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias("least"), "label", "vector", "scores"))

    same = _answers(meeting(points.withColumn("scores", F.lit(None).cast("array<long>")), in_label), cells, True, positives + 1)
    near = common.saved(_best(same, classes, ["anchor"], positives + 1).withColumnRenamed("anchor", "id"), "negative-near")
    others = F.slice(F.filter("best", lambda x: ~((x["id"] == F.col("id")) & (x["vec_id"] == F.col("anchor_id")))), 1, positives)
    pairs = asked.join(near, "id").select("id", "anchor_id", F.explode(others).alias("x"))
    pairs = common.saved(pairs.select("id", "anchor_id", F.col("x.vec_id").alias("positive_id"), (-F.col("x.less")).alias("positive_score")), "negative-pairs")
    asking = points.join(pairs.groupBy("id").agg(F.collect_set("positive_score").alias("scores")), "id")
    found = _answers(meeting(asking, in_all), cells, False, negatives)
    found = _best(found, classes, ["anchor", "positive_score"], negatives).withColumnRenamed("anchor", "id")
    out = pairs.join(found, ["id", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("at", "x"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("negative_id"), "positive_score", (-F.col("x.less")).alias("negative_score"))


def _cells(classes: DataFrame, dim: int, sample: int) -> Cells:
    """Borders from a bounded sample, with the extremes of all vectors."""
    ends = classes.agg(*(f(F.get("vector", j)).alias(f"{name}{j}") for name, f in (("a", F.min), ("b", F.max)) for j in range(dim))).first()
    some = common.least(classes, F.xxhash64("id", F.lit(7)), sample).select("vector").toPandas()["vector"]
    return Cells(np.array(some.tolist(), np.int64).reshape(-1, dim), *(np.array([ends[f"{name}{j}"] for j in range(dim)], np.int64) for name in ("a", "b")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's labels: that of every seventh vec_id is moved by one, modulo 10."""
    rows = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), F.col("vec_id") % EVERY == 0)
