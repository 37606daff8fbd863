"""The prefix trie of conversations, as succinct level-order tries of shards.

1. Turns are put in order, and one pass along each conversation chains their digests: a node of the trie is named by the
   digest of the turns that lead to it. Equal prefixes have equal names, so members are counted by a grouping.
2. Nodes with one member are tails: nothing branches there, and their rows follow from the node alone. The rest is cut in
   shards: a node of many members is heavy, and every highest node that is not heavy begins a shard, which so has a
   bounded number of members however large a part of the corpus shares its first turns.
3. A task holds a few shards as one LOUDS trie: nodes by level, a bit vector with a one for each child and a zero after
   each node, and arrays of labels beside it. Walking the levels backwards, add.at rolls leaves and savings up.
4. The heavy nodes form a small trie above the shards, which takes the sums of their first nodes as its own. They are
   rolled up in the same way, apart from the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A node of more members is heavy; so it is, beyond some millions of conversations, with more than their share in PARTS.
MEMBERS, PARTS = 1024, 1 << 14
#: Members of a node whose ids are joined to one text at a time.
IDS = 4096
#: The digest of no turns.
ROOT = hashlib.blake2b(b"", digest_size=16).digest()


class Louds:
    """A forest in level order. bits holds, for each node in turn, a one for each child and a zero; the children of the
    k-th node are the nodes of the k-th run of ones, after the roots. up[k] is the parent of node k, or -1."""

    def __init__(self, depth: np.ndarray, name: np.ndarray, parent: np.ndarray):
        """Of nodes with names of 16 bytes, those of their parents and depths; a node whose parent is not there is a root."""
        order = np.argsort(depth, kind="stable")
        names = name[order]
        by_name = np.argsort(names)
        at = np.minimum(np.searchsorted(names, parent, sorter=by_name), len(names) - 1)
        found = names[by_name[at]] == parent
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        above = np.where(found, order[by_name[at]], -1)  # by row
        # level by level, children in the order of their parents
        rank = np.zeros(len(order), np.int64)
        edges = np.flatnonzero(np.r_[True, np.diff(depth[order]) > 0, True])
        rows = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            level = order[lo:hi]
            level = level[np.lexsort((name[level], np.where(above[level] >= 0, rank[above[level]], -1)))]
            rank[level] = np.arange(lo, hi)
            rows.append(level)
        self.rows = np.concatenate(rows) if rows else order
        self.edges = edges
        self.up = np.where(above[self.rows] >= 0, rank[above[self.rows]], -1)
        self.children = np.bincount(self.up[self.up >= 0], minlength=len(self.rows))
        self.bits = np.ones(len(self.rows) + self.children.sum(), bool)
        self.bits[np.cumsum(self.children + 1) - 1] = False

    def rolled(self, *labels: np.ndarray) -> list[np.ndarray]:
        """Sums over subtrees of labels given in level order."""
        out = [x.copy() for x in labels]
        for lo, hi in zip(self.edges[-2::-1], self.edges[:0:-1], strict=True):
            up = self.up[lo:hi]
            inner = up >= 0
            for x in out:
                np.add.at(x, up[inner], x[lo:hi][inner])
        return out


def chained(turns: DataFrame) -> DataFrame:
    """conv, depth, node, parent, words, ends: a row for each turn of each conversation, and one of depth 0 before them.

    For rows of conv, at (null and first for the row of depth 0), digest (of role and text) and words. A conversation is
    read along, so that only its last row is held.
    """
    names = ["conv", "depth", "node", "parent", "words", "ends"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, depth, node, held = None, 0, ROOT, None
        for batch in batches:
            rows: list[tuple] = []
            for c, digest, words in zip(*(batch.column(k).to_pylist() for k in ("conv", "digest", "words")), strict=True):
                if held is not None:
                    rows.append((*held, c != conv))
                if c != conv:
                    conv, depth, node = c, 0, ROOT
                    held = (c, 0, ROOT, None, 0)
                else:
                    above, depth = node, depth + 1
                    node = hashlib.blake2b(above + digest, digest_size=16).digest()
                    held = (c, depth, node, above, words)
            if rows:
                yield _batch(rows, names)
        if held is not None:
            yield _batch([(*held, True)], names)

    dealt = turns.repartition("conv").sortWithinPartitions("conv", "at")
    return dealt.select("conv", "digest", "words").transform(common.in_arrow, chain, "conv long, depth int, node binary, parent binary, words long, ends boolean")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"conv": pa.int64(), "depth": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "words": pa.int64(), "ends": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(zip(*rows, strict=True), names, strict=True)], names=names)


ROLLED = "node binary, parent binary, depth int, conv_id long, above long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def rolled(nodes: DataFrame) -> DataFrame:
    """ROLLED: nodes with what their subtrees hold, and above, the conv_id of their parent where it stands in the same shard.

    For rows of shard, node, parent, depth, conv_id, n_convs, words, and what hangs below a node outside its shard:
    n_below children with leaves_below leaves and saved_below saved tokens.
    """

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["shard"], 50_000):
            # names are hashes: that of a node differs from any other's, so that shards make one forest
            trie = Louds(part.column("depth").to_numpy(), _name_array(part, "node"), _name_array(part, "parent"))
            part = part.take(pa.array(trie.rows))
            n, words, below, leaves, saved = (part.column(c).to_numpy() for c in ("n_convs", "words", "n_below", "leaves_below", "saved_below"))
            children = trie.children + below
            leaves, saved = trie.rolled(np.where(children == 0, 1, leaves), saved + (n - 1) * words)
            conv = part.column("conv_id").to_numpy()
            above = pa.array(np.where(trie.up >= 0, conv[trie.up], 0), mask=trie.up < 0)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).combine_chunks() for c in ("node", "parent", "depth", "conv_id")), above, *(pa.array(x, pa.int64()) for x in (n, children, leaves, saved))],
                names=["node", "parent", "depth", "conv_id", "above", "n_convs", "n_children", "n_leaves", "saved_tokens"],
            )

    dealt = nodes.repartition("shard").sortWithinPartitions("shard")
    return dealt.select("shard", "node", "parent", "depth", "conv_id", "n_convs", "words", "n_below", "leaves_below", "saved_below").transform(common.in_arrow, roll, ROLLED)


def _name_array(part: pa.Table, column: str) -> np.ndarray:
    """Names of 16 bytes as an array that sorts; no name reads as 16 zeros."""
    return np.frombuffer(b"".join(x or bytes(16) for x in part.column(column).to_pylist()), "S16")


def endings(ends: DataFrame) -> DataFrame:
    """node and ends_sha256, for rows of node and conv, each pair once: of the conv in order, joined by commas.

    The conv of a node are joined in pieces of IDS values' range first, so that the task of a node where very many end
    reads few rows; it hashes them piece by piece.
    """
    pieces = ends.groupBy("node", F.floor(F.col("conv") / IDS).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key == node:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([h for _, h in done])], names=["node", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    dealt = pieces.repartition("node").sortWithinPartitions("node", "piece")
    return dealt.select("node", "ids").transform(common.in_arrow, hashed, "node binary, ends_sha256 string")


def trie(turns: DataFrame, members: int = MEMBERS, parts: int = PARTS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns has conv (long), at (any order; null for one row of each conversation, which stands for no turn yet), digest
    and words, as turns_of() makes them.
    """
    paths = common.saved(chained(turns), "trie-paths")
    nodes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.first("ends").alias("ends"))
    nodes = common.saved(nodes, "trie-nodes")
    total = nodes.filter("depth = 0").agg(F.coalesce(F.max("n_convs"), F.lit(0))).first()[0]
    most = max(members, total // parts)
    is_heavy = (F.col("n_convs") > most) | (F.col("depth") == 0)

    # tails: one member, no branch; what hangs below shared nodes by them is counted there
    alone = nodes.filter("n_convs = 1 and depth > 0")
    shared = nodes.filter("n_convs > 1 or depth = 0")
    heads = alone.join(shared.select(F.col("node").alias("parent")), "parent", "left_semi").groupBy("parent").agg(F.count(F.lit(1)).alias("n_tails"))
    shared = shared.join(heads.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_below", F.coalesce("n_tails", F.lit(0).cast("long")))
    shared = common.saved(shared.drop("n_tails", "ends"), "trie-shared")

    heavy = shared.filter(is_heavy)
    n_heavy = heavy.count()
    # the shard of a light node: the first light node on the way to it, of any member
    marked = common.join_small(paths.select("conv", "depth", "node"), heavy.select("node", F.lit(True).alias("heavy")), ["node"], "left", n_heavy, 32)
    along = Window.partitionBy("conv").orderBy("depth")
    first = F.first(F.when(F.col("heavy").isNull(), F.col("node")), ignorenulls=True).over(along)
    of = marked.withColumn("shard", first).filter("heavy is null").groupBy("node").agg(F.first("shard").alias("shard"))
    light = shared.filter(~is_heavy).join(of, "node").withColumns({"leaves_below": F.col("n_below"), "saved_below": F.lit(0).cast("long")})
    low = common.saved(rolled(light), "trie-low")

    below = low.filter("above is null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    top = heavy.join(below.withColumnRenamed("parent", "node"), "node", "left").select(F.lit(0).alias("shard"), "node", "parent", "depth", "conv_id", "n_convs", "words", (F.col("n_below") + F.coalesce("n", F.lit(0))).alias("n_below"), (F.col("n_below") + F.coalesce("leaves", F.lit(0))).alias("leaves_below"), F.coalesce("saved", F.lit(0)).alias("saved_below"))
    top = common.saved(rolled(top), "trie-top")

    ends = common.join_small(paths.filter("ends").select("node", "conv"), shared.select("node"), ["node"], "left_semi", shared.count(), 32)
    joined = low.join(top.select(F.col("node").alias("parent"), F.col("conv_id").alias("over")), "parent", "left").withColumn("above", F.coalesce("above", "over"))
    every = joined.select(*top.columns).unionByName(top).join(endings(ends), "node", "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    high = every.withColumn("ends_sha256", F.coalesce("ends_sha256", none)).select(*columns)
    hung = alone.join(shared.select(F.col("node").alias("parent"), F.col("conv_id").alias("over")), "parent", "left").withColumns(
        {"above": F.coalesce("over", "conv_id"), "n_children": F.when(F.col("ends"), 0).otherwise(1).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.lit(0).cast("long"), "ends_sha256": F.when(F.col("ends"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(none)}
    )
    return high.unionByName(hung.select(*columns))


def digest(role: Column, text: Column) -> Column:
    """16 bytes that name a turn by role and text; null is as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def n_words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def turns_of(rows: DataFrame, heads: int = 4, every: int = 20) -> DataFrame:
    """conv, at, digest, words of rebuilt conversations: each gets the first turns of a neighbour's in place of its own.

    rows needs conv_id, turn, role and text. A conversation c takes the first h turns of conversation c - c % every, as
    many as there are, and its own turns after its first h; h is the CRC-32 of c in decimal, modulo heads. With heads 1
    conversations stay as they are. Turns are ordered by turn, null first, then by role and text. Every conversation has
    one more row, with a null at.
    """
    base = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", "role", digest(F.col("role"), F.col("text")).alias("digest"), n_words(F.col("text")).alias("words"))
    by = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), F.coalesce("role", F.lit("")), "digest")
    placed = common.saved(base.withColumn("place", F.row_number().over(by)).select("conv", "place", "digest", "words"), "trie-turns")
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    own = placed.filter(F.col("place") > h).select("conv", F.struct(F.lit(1).alias("own"), "place").alias("at"), "digest", "words")
    convs = placed.filter("place = 1").select("conv")
    first = placed.filter((F.col("place") < heads) & (F.col("conv") % every == 0)).select(F.col("conv").alias("from"), "place", "digest", "words")
    lent = convs.withColumn("from", F.col("conv") - F.col("conv") % every).join(first, "from").filter(F.col("place") <= h)
    lent = lent.select("conv", F.struct(F.lit(0).alias("own"), "place").alias("at"), "digest", "words")
    none = convs.select("conv", F.lit(None).cast(own.schema["at"].dataType).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return own.unionByName(lent).unionByName(none)


def conversation_trie(rows: DataFrame, heads: int = 1, every: int = 20, members: int = MEMBERS, parts: int = PARTS) -> DataFrame:
    """The nodes of the prefix trie of conversations: each sequence of first turns that any has, and the root of none.

    rows needs conv_id, turn, role and text; other columns are ignored, whatever their names. A row of the result has
    conv_id, the smallest member, depth, parent_conv_id (null at the root), n_convs, the members: conversations that
    begin so, n_children, n_leaves, the childless nodes of its subtree, itself included, saved_tokens, the words of last
    turns that need no second encoding: over the subtree, one less than the members times the words; and ends_sha256, of
    the members that end here. Null roles and texts count as empty, a null turn comes first, equal turns stand in the
    order of role and of the text's digest, and rows that repeat are turns of their own. Rows without a conv_id take no
    part. Long texts are digested whole, and conversations of any length are read along. Without conversations there are
    no rows. turns_of() says what heads and every do.
    """
    return trie(turns_of(rows, heads, every), members, parts)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(common.table(spark, sf_dir, "conversations"), heads=4, every=20)
