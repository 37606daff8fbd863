"""Quality rules judged by an isolation forest.

Each document gets statistics such as rules are made of: length of words, symbols, repeated words, lines and windows.
Fixed base rules reject short and very repetitive texts. For the rest, a forest of random splits is grown on a bounded
sample of labelled rows; a document that few splits isolate is anomalous. The scale of each statistic is that of the good
rows of that sample; how anomalous a document may be is calibrated on all labelled rows.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
WINDOW = 8

#: What a tree may split on: shares of words (of lines for same_lines), as rules state them, and the mean length of a
#: word. A share of a short text is drawn towards 0 by BLANK more words. Each is read as its distance from the median of
#: good rows in steps, MOST_STEPS at most; a step is what all but a few good rows stay within, LEAST_STEP at least.
FEATURES = ("symbols", "capitals", "shouted", "odd_ends", "no_letters", "long_words", "doubled", "used_again", "in_repeats", "same_lines", "word_length")
BLANK, LONG = 20, 24
LEAST_STEP, MOST_STEPS = 0.05, 4
#: Words of a block in which words used again are counted, so that the share does not grow with the text.
BLOCK = 50
ENDS = frozenset("#*$%&|<>@^~=")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = T.StructType(
    [T.StructField("doc_id", T.LongType())] + [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in FEATURES]
)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that is found twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    if len(ids) == len(words):
        return 0
    mixed = (a + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[bytes, int] = {}
    hit = np.zeros(len(words) + 1, np.int64)
    for at in np.flatnonzero(maybe):  # equal hashes only propose; the windows themselves are compared
        key = a[at : at + window].tobytes()
        first = seen.setdefault(key, at)
        if first != at:
            for s in (first, at):
                hit[s] += 1
                hit[s + window] -= 1
    return int((np.cumsum(hit) > 0).sum())


def _measure(text: str) -> tuple[list[int], list[float]]:
    words = WORD.findall(text)
    n, symbols = len(words), len(SYMBOL.findall(text))
    chars = sum(map(len, words))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup, rep = len(lines) - len(set(lines)), repeated_words(words)
    found = (
        symbols,
        sum(len(w) > 1 and w.isupper() for w in words),
        sum(w[-1] in "!?" for w in words),
        sum(w[-1] in ENDS for w in words),
        sum(not any(map(str.isalpha, w)) for w in words),
        sum(len(w) > LONG for w in words),
        sum(map(operator.eq, words, words[1:])),
        n - sum(len(set(words[k : k + BLOCK])) for k in range(0, n, BLOCK)),
        rep,
    )
    shares = [min(x / (n + BLANK), 1.0) for x in found]
    return [n, chars, symbols, dup, rep], [*shares, dup / (len(lines) + BLANK), chars / max(n, 1)]


def statistics(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """The counts and features of every row, from its whole text; if keyed, with text_key, which names the text.

    A null text counts as empty: all counts 0.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_measure(t or "") for t in batch.column(1).to_pylist()]
            counts = np.array([m[0] for m in made], np.int64).reshape(-1, len(COUNTS))
            shares = np.array([m[1] for m in made], np.float64).reshape(-1, len(FEATURES))
            cols = [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), *(pa.array(shares[:, i]) for i in range(len(FEATURES)))]
            yield pa.RecordBatch.from_arrays(cols + batch.columns[2:], names=shape.names)

    key = [common.text_key(F.col("text")).alias("text_key")] if keyed else []
    shape = T.StructType(STATS.fields + [T.StructField("text_key", T.BinaryType())] * keyed)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *key).transform(common.in_arrow, measure, shape)


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _average_path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points, which stands for the part of a path below a leaf."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: at node k, feature[k] < 0 marks a leaf whose path length is value[k]."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, value, left child (right = left + 1)
    sample: int
    threshold: float = 1.0
    middle: np.ndarray | None = None
    step: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for what few splits isolate, under 0.5 for the ordinary."""
        x = x if self.step is None else stepped(x, self.middle, self.step)
        total = np.zeros(len(x))
        for feature, value, left in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                k = at[inner]
                at[inner] = left[k] + (x[inner, f[inner]] >= value[k])
            total += value[at]
        return 2.0 ** (-total / len(self.trees) / max(_average_path(self.sample), 1e-9)) if self.trees else np.zeros(len(x))


def stepped(x: np.ndarray, middle: np.ndarray, step: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(x - middle) / step, MOST_STEPS)


def steps(good: np.ndarray, most_lost: float) -> tuple[np.ndarray, np.ndarray]:
    """The middle and the step of each feature, from those of good rows."""
    if not len(good):
        return np.zeros(len(FEATURES)), np.full(len(FEATURES), LEAST_STEP)
    middle = np.median(good, 0)
    return middle, np.maximum(np.quantile(np.abs(good - middle), 1 - most_lost, axis=0), LEAST_STEP)


def grow(x: np.ndarray, n_trees: int, sample: int, seed: int) -> Forest:
    """Each tree splits its own draw of rows at a random value of a random feature, to the depth log2(sample).

    A value is drawn from what the splits above leave of 0 to MOST_STEPS, not from the range of the node's rows: anomalous
    rows are alone after few splits even where several are alike, and ordinary ones are not parted for being the last of
    a dense node.
    """
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    trees = []
    for _ in range(n_trees if sample > 1 else 0):
        feature, value, left = [-1], [0.0], [0]
        todo = [(0, x[rng.choice(len(x), sample, replace=False)], 0, np.zeros(x.shape[1]), np.full(x.shape[1], float(MOST_STEPS)))]
        while todo:
            node, rows, depth, lo, hi = todo.pop()
            if depth >= np.ceil(np.log2(sample)) or len(rows) <= 1:
                value[node] = depth + _average_path(len(rows))
                continue
            f = int(rng.integers(x.shape[1]))
            v = rng.uniform(lo[f], hi[f])
            go = rows[:, f] >= v
            feature[node], value[node], left[node] = f, v, len(feature)
            under, over = hi.copy(), lo.copy()
            under[f] = over[f] = v
            todo += [(len(feature), rows[~go], depth + 1, lo, under), (len(feature) + 1, rows[go], depth + 1, over, hi)]
            feature += [-1, -1]
            value += [0.0, 0.0]
            left += [0, 0]
        trees.append((np.array(feature), np.array(value), np.array(left)))
    return Forest(trees, sample)


def fit(stats: DataFrame, labels: DataFrame, n_trees: int = 100, sample: int = 256, most_rows: int = 8192, seed: int = 7, most_good_lost: float = 0.0005) -> Forest:
    """Grow a forest on labelled rows and set its threshold by all labelled rows.

    The forest is fitted on at most most_rows rows (a documented bound), those with the least hash of their doc_id
    among labelled rows that pass the base rules; the good ones among them set the steps of the features. The threshold looks at every labelled row, by way of a histogram of
    scores with 1000 bins: the least score that at most the share most_good_lost of the good rows reaches and at which
    rejected rows are mostly bad, moved half way to the least bad score above it. Where there is none, nothing is
    rejected.
    """
    labelled = stats.filter(~base_failed()).join(
        labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")), "doc_id"
    )
    picked = common.least(labelled, F.xxhash64("doc_id", F.lit(seed)), most_rows)
    picked = picked.groupBy("doc_id").agg(F.min(F.struct(*FEATURES, "quality")).alias("x")).select("doc_id", "x.*").toPandas()  # one row of an id
    rows = picked.sort_values("doc_id")[[*FEATURES, "quality"]].to_numpy(np.float64)
    middle, step = steps(rows[rows[:, -1] == 1, :-1], most_good_lost)
    forest = grow(stepped(rows[:, :-1], middle, step), n_trees, sample, seed)
    forest.middle, forest.step = middle, step
    bins = scored(labelled, forest, keep=("quality",)).groupBy(F.floor(F.col("anomaly") * 1000).cast("int").alias("bin"), "quality").agg(F.count(F.lit(1)).alias("n")).toPandas()
    forest.threshold = _threshold(bins, most_good_lost)
    return forest


def _threshold(bins: pd.DataFrame, most_good_lost: float) -> float:
    good, bad = np.zeros(1002), np.zeros(1002)
    np.add.at(good, bins.loc[bins.quality == 1, "bin"].to_numpy(int), bins.loc[bins.quality == 1, "n"].to_numpy(float))
    np.add.at(bad, bins.loc[bins.quality == 0, "bin"].to_numpy(int), bins.loc[bins.quality == 0, "n"].to_numpy(float))
    above_good, above_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    fine = (above_good <= most_good_lost * max(good.sum(), 1)) & (above_bad > above_good)
    if not fine.any():
        return 1.001
    least = int(np.flatnonzero(fine)[0])
    return (least + int(np.flatnonzero(bad[least:])[0]) / 2) / 1000


def scored(stats: DataFrame, forest: Forest, keep: tuple[str, ...] = ()) -> DataFrame:
    """stats with its anomaly; the forest is a fixed number of small trees, sent with the function."""
    names = [*STATS.names, *keep]
    part = stats.select(*names)
    schema = T.StructType([*part.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in FEATURES])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.score(x))], names=[*names, "anomaly"])

    return part.transform(common.in_arrow, add, schema)


def judge(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """One row for each row of docs: doc_id, the five counts, base_failed, anomaly, kept.

    docs needs doc_id and text, labels doc_id and quality (1 good, 0 bad); other columns are ignored. A null text counts
    as empty and fails the base rules. Repeated rows are each judged, with equal results. A doc_id labelled twice is bad
    if either says so; labels that are null are passed over. Without labels no forest is grown, and the base rules
    alone decide. An empty table gives no rows.
    """
    stats = common.saved(statistics(docs), "quality-stats")
    forest = fit(stats, labels, **params)
    out = scored(stats, forest)
    failed = base_failed()
    return out.select("doc_id", *COUNTS, failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") < F.lit(forest.threshold))).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are.

    A verdict is a function of the text, so that it is the text's key by which rejected rows are taken out: rows
    without a doc_id and rows that repeat are judged like any other.
    """
    stats = common.saved(statistics(docs, keyed=True), "quality-stats")
    forest = fit(stats, labels, **params)
    bad = scored(stats, forest, keep=("text_key",)).filter(base_failed() | (F.col("anomaly") >= F.lit(forest.threshold)))
    bad = common.saved(bad.select("text_key").distinct(), "quality-rejected")
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), common.text_key(F.col("text")).alias("text_key"))
    return common.join_small(inner, bad, ["text_key"], "left_anti", bad.count(), 64).select("row.*")


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
