"""Near-duplicate documents by min-max hashing.

1. Each text becomes its set of shingles, and the set a signature: under every permutation both the least and the greatest
   hash are kept. Either agrees between two sets with a probability equal to their Jaccard similarity, so that a
   signature of so many values takes half the hash evaluations, and as least and greatest rarely come from one shingle,
   the share of agreeing values varies less. Texts with equal sets are one class from here on.
2. Classes meet where a band of their signatures agrees. In a bucket of up to BLOCK classes signatures are compared, and
   what may be near enough hangs together; a larger bucket hangs together as it is, without comparison. This only says
   which classes are compared on their full sets: groups may be too large, never too small.
3. Groups are dealt to blocks. In a block two classes are compared on their sets unless links found before already join
   them. One class of each set that hangs together goes on to the next round, until a group is one block or no longer
   shrinks.
4. What then remains are groups of many classes that do not all hang together. Only there every two blocks meet: first by
   signature, which finds the classes that may still link to another component, then on the sets of these.

Two sets of similarity 0.85 agree in no band with a probability of 2e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing
from .components import components

WORDS, SHARE = 3, 85
BANDS, ROWS = 28, 6
VALUES = BANDS * ROWS
BLOCK = 512
#: Of VALUES values, so many fewer than expected at the threshold agree with a probability below 1e-6.
SLACK = 5

_FACTORS = np.random.default_rng(12).integers(0, 1 << 31, VALUES // 2, np.uint32) * np.uint32(2) + np.uint32(1)
_MIX = np.random.default_rng(13).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(text: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles of a text's bytes, in order; A-Z count as a-z."""
    return hashing.shingles(_LOWER[text], words)


def min_max(sets: np.ndarray) -> np.ndarray:
    """The least and the greatest hash of a set under each permutation, in turn."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(VALUES // 2, 0xFFFFFFFF, np.uint32), np.zeros(VALUES // 2, np.uint32)
    for at in range(0, len(x), 512):
        y = x[at : at + 512, None] * _FACTORS
        np.minimum(low, y.min(0), out=low)
        np.maximum(high, y.max(0), out=high)
    return np.column_stack([low, high]).ravel()


def bands(signature: np.ndarray) -> np.ndarray:
    h = (signature.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(1, dtype=np.uint64)
    h ^= h >> np.uint64(29)
    return (h * hashing.ODD).view(np.int64)


def least_agreeing(share: int) -> int:
    """How many values of two signatures, cut to 8 bits, agree at least where the similarity is share percent."""
    s = share / 100
    return int(VALUES * s - SLACK * (VALUES * s * (1 - s)) ** 0.5)


SIGNED = "doc_id long, text_key binary, key binary, size int, bands array<long>, signature binary"


def signed(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For each row: its text's key, its set's key and size, and the set's bands and 8-bit signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for text in part.column(2):
                    x = shingles(np.frombuffer(text.as_buffer(), np.uint8), words)
                    values = min_max(x)
                    rows.append((hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), bands(values), values.astype(np.uint8).tobytes()))
                keys, sizes, banded, signatures = zip(*rows, strict=True)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(np.concatenate(banded)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), lists, pa.array(signatures, pa.binary())], names=["doc_id", "text_key", "key", "size", "bands", "signature"])

    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_key(text).alias("text_key"), text.cast("binary").alias("text")).transform(common.in_arrow, sign, SIGNED)


def _values(part: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, VALUES)


def _edges(part: pa.Table, names: list[str]) -> np.ndarray:
    """Where groups of equal names begin, and the end."""
    new = np.zeros(part.num_rows, bool)
    new[0] = True
    for name in names:
        column = part.column(name).combine_chunks()
        x = np.array(column.to_pylist(), object) if pa.types.is_binary(column.type) else column.to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), part.num_rows]


def _may_link(values: np.ndarray, sizes: np.ndarray, i: int, rest: np.ndarray, share: int) -> np.ndarray:
    """Which of the rows rest may be near enough to row i, by size and signature."""
    small, large = np.minimum(sizes[rest], sizes[i]), np.maximum(sizes[rest], sizes[i])
    rest = rest[100 * small >= share * large]
    return rest[(values[rest] == values[i]).sum(1) >= least_agreeing(share)] if len(rest) else rest


class _Joined:
    """Which of n rows links join so far: of[i] is the least row of i's component."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, i: int, rest: np.ndarray) -> None:
        names = np.unique(self.of[np.r_[i, rest]])
        self.of[np.isin(self.of, names[1:])] = names[0]


def near_in_bucket(rows: DataFrame, share: int) -> DataFrame:
    """a and b: links that span what may hang together in each bucket, for rows of bucket, key, size and signature."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["bucket"], 20_000):
            values, sizes = _values(part), part.column("size").to_numpy().astype(np.int64)
            edges = _edges(part, ["bucket"])
            first = np.repeat(edges[:-1], np.diff(edges))
            near = np.ones(part.num_rows, bool)
            near[1:] = (values[1:] == values[:-1]).sum(1) >= least_agreeing(share)
            near[1:] &= 100 * np.minimum(sizes[1:], sizes[:-1]) >= share * np.maximum(sizes[1:], sizes[:-1])
            near[edges[:-1]] = True
            whole = np.logical_and.reduceat(near, edges[:-1])  # neighbours are all near: the bucket hangs together
            alone = ~whole & (np.diff(edges) == 2)
            to = np.where(np.repeat(alone, np.diff(edges)), np.arange(part.num_rows), first)
            for g in np.flatnonzero(~whole & ~alone):
                lo, hi = edges[g], edges[g + 1]
                joined = _Joined(hi - lo)
                for i in range(hi - lo - 1):
                    apart = lo + i + 1 + np.flatnonzero(joined.of[i + 1 :] != joined.of[i])
                    if len(apart):
                        joined.link(i, _may_link(values, sizes, lo + i, apart, share) - lo)
                to[lo:hi] = lo + joined.of
            at = np.flatnonzero(to != np.arange(len(to)))
            keys = part.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(to[at])), keys.take(pa.array(at))], names=["a", "b"])

    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "key")
    return dealt.select("bucket", "key", "size", "signature").transform(common.in_arrow, link, "a binary, b binary")


def linked(rows: DataFrame, by: list[str], words: int, share: int, mine: str | None = None) -> DataFrame:
    """key and to: each class, and the least class of its block that verified links join it to.

    For rows of by, key, signature, text (binary) and comp, classes of one comp being joined already. mine, where given,
    names the block of a row where two blocks meet: rows of one block are not compared with each other.
    """
    names = [*by, "key", "comp", "signature", "text", *([mine] if mine else [])]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, by, 256):
            edges, values = _edges(part, by), _values(part)
            comps = np.unique(np.array(part.column("comp").to_pylist(), object), return_inverse=True)[1]
            block = part.column(mine).to_numpy() if mine else None
            texts, to = part.column("text"), np.arange(part.num_rows)
            for lo, hi in zip(edges, edges[1:], strict=False):
                if hi - lo < 2:
                    continue
                sets = [shingles(np.frombuffer(texts[k].as_buffer(), np.uint8), words) for k in range(lo, hi)]
                sizes = np.array([len(x) for x in sets])
                joined = _Joined(hi - lo)
                for comp in np.unique(comps[lo:hi]):
                    same = np.flatnonzero(comps[lo:hi] == comp)
                    joined.link(same[0], same[1:])
                for i in range(hi - lo - 1):
                    apart = i + 1 + np.flatnonzero(joined.of[i + 1 :] != joined.of[i])
                    if block is not None and block[lo] != block[hi - 1]:
                        apart = apart[block[lo + apart] != block[lo + i]]
                    near = _may_link(values[lo:hi], sizes, i, apart, share) if len(apart) else apart
                    while len(near):  # one link joins all of a component at once
                        j = int(near[0])
                        both = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
                        if 100 * both >= share * (sizes[i] + sizes[j] - both):
                            joined.link(i, np.array([j]))
                            near = near[joined.of[near] != joined.of[i]]
                        else:
                            near = near[1:]
                to[lo:hi] = lo + joined.of
            keys = part.column("key").combine_chunks()
            yield pa.RecordBatch.from_arrays([keys, keys.take(pa.array(to))], names=["key", "to"])

    dealt = rows.repartition(*by).sortWithinPartitions(*by, *([mine] if mine else []), "key")
    return dealt.select(*names).transform(common.in_arrow, verify, "key binary, to binary")


def may_still_link(rows: DataFrame, share: int) -> DataFrame:
    """key: classes that by signature may link to one of another comp, for rows of root, i, j, mine, key, comp, size and
    signature."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["root", "i", "j"], 2048):
            edges, values = _edges(part, ["root", "i", "j"]), _values(part)
            sizes, mine = part.column("size").to_numpy().astype(np.int64), part.column("mine").to_numpy()
            comps = np.unique(np.array(part.column("comp").to_pylist(), object), return_inverse=True)[1]
            hit = np.zeros(part.num_rows, bool)
            for lo, hi in zip(edges, edges[1:], strict=False):
                two = mine[lo] != mine[hi - 1]
                for i in range(lo, hi - 1):
                    rest = np.arange(i + 1, hi)
                    rest = rest[(comps[rest] != comps[i]) & ((mine[rest] != mine[i]) | (not two))]
                    near = _may_link(values, sizes, i, rest, share) if len(rest) else rest
                    hit[near] = True
                    hit[i] |= bool(len(near))
            yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks().filter(pa.array(hit))], names=["key"])

    dealt = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "mine", "key")
    return dealt.select("root", "i", "j", "mine", "key", "comp", "size", "signature").transform(common.in_arrow, find, "key binary").distinct()


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows with i, j and mine: every two blocks of a root's rows meet once; mine is the row's own block."""
    n = F.ceil(F.col("members") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("key", F.lit(3)), n).cast("int")
    dealt = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).drop("other")


def _sized(groups: DataFrame) -> DataFrame:
    return groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("members")), "root")


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """key and comp, after links (key, to) between classes of those comps."""
    ends = comps.select(F.col("key").alias("to"), F.col("comp").alias("b"))
    edges = links.filter("key <> to").join(comps, "key").select(F.col("comp").alias("a"), "to").join(ends, "to").select("a", "b")
    over = components(edges).withColumnRenamed("node", "comp")
    return comps.join(over, "comp", "left").select("key", F.coalesce("root", "comp").alias("comp"))


def grouped(classes: DataFrame, share: int, block: int) -> DataFrame:
    """root and key: which classes may hang together. Classes that share no bucket with another are not there."""
    slots = classes.filter("size > 0").select("key", F.explode("bands").alias("bucket"))
    counts = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least")).filter("n > 1")
    met = common.saved(slots.join(counts, "bucket"), "near-buckets")
    few = met.filter(F.col("n") <= block).select("bucket", "key").join(classes.select("key", "size", "signature"), "key")
    many = met.filter((F.col("n") > block) & (F.col("key") != F.col("least"))).select(F.col("least").alias("a"), F.col("key").alias("b")).distinct()
    return components(near_in_bucket(few, share).unionByName(many)).withColumnRenamed("node", "key")


def found(docs: DataFrame, words: int = WORDS, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, text_key, size and comp for each row of docs: comp names what verified links join the row's set to."""
    if not 80 <= share <= 100:
        raise ValueError("share must be between 80 and 100")
    rows = common.saved(signed(docs, words), "near-signed")
    classes = rows.groupBy("key").agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = common.saved(classes, "near-classes")
    groups = common.saved(_sized(grouped(classes, share, block)).join(classes.select("key", "text_key", "size", "signature"), "key"), "near-groups")
    n_grouped = groups.count()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(common.text_key(F.col("text")).alias("text_key"), F.col("text").cast("binary").alias("text"))
    wanted = common.join_small(texts, groups.select("text_key"), ["text_key"], "left_semi", n_grouped, 64)
    with_text = common.saved(groups.join(wanted.groupBy("text_key").agg(F.first("text").alias("text")), "text_key").drop("text_key"), "near-texts")

    comps = groups.select("key", F.col("key").alias("comp"))
    left, turn = with_text, 0
    while True:
        part = left.withColumns({"part": F.pmod(F.xxhash64("key", F.lit(turn)), F.ceil(F.col("members") / block)), "comp": F.col("key")})
        links = common.saved(linked(part, ["root", "part"], words, share), "near-links")
        comps = common.saved(_merged(comps, links), "near-comps")
        # one class of each component of a group of several blocks goes on, as long as there are fewer of them
        one = left.select("key", "root", "members").filter(F.col("members") > block).join(comps, "key").groupBy("root", "comp", "members").agg(F.min("key").alias("key"))
        now = one.groupBy("root").agg(F.count(F.lit(1)).alias("now"))
        left = one.join(now, "root").filter("now > 1 and 2 * now <= members").select("key", "root", F.col("now").alias("members"))
        left = common.saved(left, "near-left")
        if left.isEmpty():
            break
        left, turn = left.join(with_text.drop("root", "members"), "key"), turn + 1

    several = groups.filter(F.col("members") > block).join(comps, "key")
    mixed = several.groupBy("root").agg((F.min("comp") != F.max("comp")).alias("mixed")).filter("mixed").select("root")
    several = common.saved(several.join(mixed, "root", "left_semi"), "near-several")
    if not several.isEmpty():
        may = common.saved(may_still_link(_in_blocks(several, block), share), "near-may")
        again = _sized(several.join(may, "key").select("root", "key", "comp")).join(with_text.select("key", "signature", "text"), "key")
        links = common.saved(linked(_in_blocks(again, block), ["root", "i", "j"], words, share, "mine"), "near-links")
        comps = common.saved(_merged(comps, links), "near-comps")
    return rows.select("doc_id", "text_key", "key", "size").join(comps, "key", "left").select("doc_id", "text_key", "size", F.coalesce("comp", "key").alias("comp"))


def near_copies(docs: DataFrame, words: int = WORDS, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id and kept.

    Rows are linked whose sets of shingles share at least `share` percent of their union; component_id is the least
    doc_id that links lead to, the row's own included, and kept says that it is the row's own. docs needs doc_id and text;
    other columns are ignored, whatever their names. A-Z count as a-z, and a word is a run of characters other than ASCII
    white space. A text of fewer words than a shingle is one shingle; null and empty texts have none and link to nothing,
    each other included. Repeated rows are copies of each other. Rows without a doc_id have a null component_id and are
    not kept where no row that they link to has one. Long texts are read whole. An empty table gives no rows. The share
    must be at least 80, for which the bands are cut.
    """
    rows = common.saved(found(docs, words, share, block), "near-found")
    least = rows.filter("size > 0").groupBy("comp").agg(F.min("doc_id").alias("least"))
    out = rows.join(least, "comp", "left").withColumn("component_id", F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("size").cast("long").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12_min_max_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(common.table(spark, sf_dir, "documents"))
