"""Similarity join on word n-grams: Bayesian pruning of candidates, then exact Jaccard similarities.

1. Each text becomes its set of shingles of five words, and the set a MinHash signature. Texts with equal sets are one
   class from here on, so that copies are compared once.
2. Classes meet where a band of their signatures agrees. Within a bucket, signatures are compared a few values at a
   time: as soon as the posterior probability that a pair reaches the threshold falls below the tolerance, the pair is
   dropped. Surviving pairs only say which classes belong together, so that a bucket gives at most as many rows as it
   has members, not pairs.
3. In each connected group of survivors the same comparison runs over all pairs, and pairs that survive are verified
   on their sets. Large buckets and groups are cut into blocks, and every two blocks meet in a task of their own.
4. Verified links make the classes' components; what is counted is links, and no pair is ever written.

Two classes of similarity 0.8 agree in no band with probability 3e-6; a Bayesian round drops such a pair with about the
tolerance, 1e-6.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

WORDS, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS = 32, 5
VALUES = BANDS * ROWS
STEP = 16
#: Members of a block; larger buckets and groups are cut into blocks of about so many.
BLOCK = 512

_FACTORS = np.random.default_rng(5).integers(0, 1 << 31, VALUES, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.random.default_rng(6).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def minhash(sets: np.ndarray) -> np.ndarray:
    """VALUES least hashes of a set of 64-bit shingles."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * _FACTORS).min(0), out=low)
    return low


def bands(signature: np.ndarray) -> np.ndarray:
    h = (signature.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    return (h * hashing.ODD).view(np.int64)


@functools.cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 * STEP, ... compared values: the fewest matches with which a pair may still reach the threshold.

    With a uniform prior, the posterior of the rate at which values match, after m of n matched, is Beta(m + 1, n - m +
    1); that it reaches r has the probability that a binomial of n + 1 trials at r is at most m. Signatures are compared
    by 8 bits, so that a similarity s shows as the rate s + (1 - s) / 256.
    """
    r = threshold + (1 - threshold) / 256
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(n + 1, m) * r**m * (1 - r) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survive(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which rows of a and b, signatures of 8-bit values, are still a candidate pair after all values."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(k * STEP, (k + 1) * STEP)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


SIGNATURES = "doc_id long, text_key binary, key binary, size int, bands array<long>, signature binary"


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each row: its text's key, its set's key and size, and the set's bands and 8-bit signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, sizes, banded, signed = [], [], [], []
                for text in part.column(2):
                    x = hashing.shingles(np.frombuffer(text.as_buffer(), np.uint8), words)
                    low = minhash(x)
                    keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    sizes.append(len(x))
                    banded.append(bands(low))
                    signed.append(low.astype(np.uint8).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(banded)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(signed, pa.binary())],
                    names=["doc_id", "text_key", "key", "size", "bands", "signature"],
                )

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(text).alias("text_key"), text.cast("binary").alias("text")).transform(common.in_arrow, sign, SIGNATURES)


def in_blocks(rows: DataFrame, group: str, size: str, block: int = BLOCK) -> DataFrame:
    """rows with i, j and mine: every two blocks of a group meet once; mine is the block that the row belongs to.

    A group of n rows gives n times as many rows as it has blocks.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), n).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")


def _signature_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, VALUES)


def _bounds(part: pa.Table, names: list[str]) -> np.ndarray:
    """Where groups of equal names begin, and the end."""
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for name in names:
        column = part.column(name).combine_chunks()
        x = np.array(column.to_pylist(), object) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), part.num_rows]


def _union(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each member's component, for n members."""
    root = np.arange(n)
    for a, b in links:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def _survivors(sig: np.ndarray, mine: np.ndarray | None, threshold: float, tolerance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group that survive; only pairs of different blocks where two blocks meet."""
    for i in range(len(sig) - 1):
        j = np.arange(i + 1, len(sig))
        if mine is not None and mine[0] != mine[-1]:
            j = j[mine[j] != mine[i]]
        if len(j):
            j = j[survive(np.broadcast_to(sig[i], (len(j), VALUES)), sig[j], threshold, tolerance)]
            if len(j):
                yield np.full(len(j), i), j


def candidate_links(rows: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """a and b: links that span the survivors of each bucket, for rows of bucket, i, j, mine, key, signature."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["bucket", "i", "j"], 20_000):
            sig, mine = _signature_rows(part.column("signature")), part.column("mine").to_numpy()
            edge = _bounds(part, ["bucket", "i", "j"])
            first = np.repeat(edge[:-1], np.diff(edge))
            near = survive(sig[1:], sig[:-1], threshold, tolerance)
            inner = np.ones(part.num_rows, bool)
            inner[1:] = near
            inner[edge[:-1]] = True
            whole = np.logical_and.reduceat(inner, edge[:-1])  # neighbours all survive: the group hangs together
            to = first.copy()
            for g in np.flatnonzero(~whole):
                s = slice(edge[g], edge[g + 1])
                to[s] = edge[g] + _union(edge[g + 1] - edge[g], _survivors(sig[s], mine[s], threshold, tolerance))
            at = np.flatnonzero(to != np.arange(len(to)))
            keys = part.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(to[at])), keys.take(pa.array(at))], names=["a", "b"])

    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "mine", "key")
    return dealt.select("bucket", "i", "j", "mine", "key", "signature").transform(common.in_arrow, link, "a binary, b binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many members every two sets share, as a matrix."""
    every = np.concatenate(sets)
    values, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    column = np.full(len(values), -1)
    column[count > 1] = np.arange((count > 1).sum())
    column = column[inverse]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, column = row[column >= 0], column[column >= 0]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, [at, at + 2048])
        m = np.zeros((len(sets), 2048), np.float32)
        m[row[i:j], column[i:j] - at] = 1
        out += m @ m.T
    return out.astype(np.int64)


def verified_links(rows: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """key, links and to: how many documents a class links to in a group, and a member of its component there.

    For rows of root, i, j, mine, key, signature, n_docs, text (binary).
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["root", "i", "j"], 256):
            edge = _bounds(part, ["root", "i", "j"])
            every, block, docs = _signature_rows(part.column("signature")), part.column("mine").to_numpy(), part.column("n_docs").to_numpy()
            texts, links, to = part.column("text"), np.zeros(part.num_rows, np.int64), np.arange(part.num_rows)
            for lo, hi in zip(edge, edge[1:], strict=False):
                sig, mine = every[lo:hi], block[lo:hi]
                pairs = list(_survivors(sig, mine, threshold, tolerance))
                if not pairs:
                    continue
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                sets = [hashing.shingles(np.frombuffer(texts[int(k)].as_buffer(), np.uint8), words) for k in range(lo, hi)]
                size = np.array([len(s) for s in sets])
                both = shared_counts(sets)[a, b]
                sure = both / (size[a] + size[b] - both) >= threshold
                a, b = a[sure], b[sure]
                np.add.at(links, lo + a, docs[lo + b])
                np.add.at(links, lo + b, docs[lo + a])
                to[lo:hi] = lo + _union(hi - lo, iter([(a, b)]))
            keys = part.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, pa.array(links), keys.take(pa.array(to))], names=["key", "links", "to"])

    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "mine", "key")
    return dealt.select("root", "i", "j", "mine", "key", "signature", "n_docs", "text").transform(common.in_arrow, verify, "key binary, links long, to binary")


def classed(docs: DataFrame, words: int, threshold: float, tolerance: float, block: int) -> DataFrame:
    """The rows of join() with text_key, which names the row's text, and root, which names its component."""
    if not THRESHOLD <= threshold <= 1:
        raise ValueError("threshold must be between 0.8 and 1")
    signed = common.saved(signatures(docs, words), "join-signatures")
    classes = common.saved(
        signed.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("least_doc"), F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature")),
        "join-classes",
    )
    slots = classes.filter("size > 0").select("key", F.explode("bands").alias("bucket"))
    counts = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    shared = common.saved(slots.join(counts, "bucket"), "join-buckets")
    rows = in_blocks(shared.join(classes.select("key", "signature"), "key"), "bucket", "members", block)
    groups = components(candidate_links(rows, threshold, tolerance)).withColumnRenamed("node", "key")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    members = common.saved(groups.join(sizes, "root").join(classes.select("key", "n_docs", "text_key", "signature"), "key"), "join-groups")
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(common.text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    wanted = common.join_small(texts, members.select("text_key"), ["text_key"], "left_semi", members.count(), 64)
    met = members.join(wanted.groupBy("text_key").agg(F.first("text").alias("text")), "text_key")
    found = common.saved(verified_links(in_blocks(met, "root", "members", block), words, threshold, tolerance), "join-links")
    roots = components(found.select(F.col("key").alias("a"), F.col("to").alias("b")))
    linked = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = classes.select("key", "n_docs", "least_doc", "size").join(roots.withColumnRenamed("node", "key"), "key", "left").join(linked, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("least_doc").alias("class_id"))
    named = named.join(least, "root").select("key", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.col("size").cast("long").alias("n_shingles"))
    return signed.select("doc_id", "text_key", "key").join(named, "key").select("doc_id", "text_key", "root", "class_id", "n_links", "n_shingles")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, class_id, n_links and n_shingles.

    n_links counts the other rows whose set of shingles has a Jaccard similarity of at least threshold with the row's
    own; class_id is the least doc_id among the rows that links connect. docs needs doc_id and text; other columns are
    ignored, whatever their names. A word is a run of characters other than ASCII white space, as it is written. A
    text of fewer words than a shingle is one shingle; null and empty texts have none, equal each other, and link to no
    other. Repeated rows are copies of each other. The class_id of rows that have no doc_id among them is null. Long
    texts are read whole. An empty table gives no rows. The threshold must be at least 0.8, for which the bands are cut.
    """
    return classed(docs, words, threshold, tolerance, block).select("doc_id", "class_id", "n_links", "n_shingles")


def keep_one(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class of join(): that of least doc_id, and of least text key where that leaves several.

    Rows without a doc_id come last in this order. Columns stay as they are. Null and empty texts are one class.
    Repeated rows leave one of them. An empty table gives no rows.
    """
    rows = classed(docs, words, threshold, tolerance, block).groupBy("root", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("n"))
    rows = common.saved(rows, "join-classed")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("first"))
    ranked = rows.join(first, "root").select("doc_id", "text_key", "n", (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))).alias("stays"))
    ranked = common.saved(ranked, "join-ranked")
    gone = ranked.filter(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    repeated = ranked.filter("stays and n > 1").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"))
    inner = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), common.text_key(F.col("text")).alias("key"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("key") == F.col("gone_key"))
    left = common.join_small(inner, gone, same, "left_anti", gone.count(), 80)
    if not repeated.isEmpty():
        few = common.join_small(left, repeated, same, "left_semi", repeated.count(), 80).groupBy("id", "key").agg(F.first("row").alias("row"))
        left = common.join_small(left, repeated, same, "left_anti", repeated.count(), 80).select("row").unionByName(few.select("row"))
    return left.select("row.*")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))
