"""Repeated byte strings across a corpus, by merging the Burrows-Wheeler transforms of shards.

Asked for is every byte that a string of `length` bytes covers which starts anywhere else too. Such a string is called
a window. The work has four steps, none of which holds more than a bounded piece of the corpus in a task:

1. Every window is dealt to the place of its minimizer: of the `span` positions from its start, the one whose next few
   bytes have the least hash. Equal windows have it at equal distance, and hold the `length - span + 1` bytes that
   follow it, its seed. Windows of a document that share a minimizer are neighbours and make up a unit.
2. Units meet by seed. A seed met once has no repeated window. All windows of a unit whose text is met twice are
   repeated: equal units, the insides of repeats, are settled here by their hashes. Seeds that a sample of the texts
   shows to be frequent are counted in partial counts instead, which then join back, so that no task gets all units of
   one; what comes out is the same. Units that share a seed but differ beside it are cut into a few slices of
   neighbouring windows, whose seeds are longer, and these are counted and settled in the same way.
3. What is left are slices that share a seed but differ beside it: the ends of repeats. The seed is one symbol then,
   so that a slice is a short string: bytes, seed, bytes. Shards of such strings are suffix-sorted on their own, and
   their transforms are merged by refining the interleave of the shards symbol by symbol. The rounds at which
   neighbours part are their common prefixes; neighbours that have not parted after as many symbols as a window has
   form the repeated intervals. No suffix is sorted twice. Where one seed has more slices than a merge takes, they are
   cut into narrower ones first, with longer seeds, which part them and let equal ones collapse again.
4. The windows found are joined to their documents by the texts' keys, and the bytes that they cover are removed.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, hashing

LENGTH = 400
#: A passage for training data: bytes that prose of PASSAGE_WORDS words has more of; runs of fewer words stay.
PASSAGE, PASSAGE_WORDS = 200, 50
#: Bytes that are taken at once; a longer text is taken in pieces of so many window starts.
PIECE = 1 << 18
#: Symbols of a shard, and of the shards that are merged at once (more only where one seed has more).
SHARD, MERGE = 1 << 17, 1 << 19
#: Slices of one seed beyond which they are cut into narrower ones.
CROWD = 4096
#: One text in SAMPLED is looked at for seeds that more than OFTEN units share.
SAMPLED, OFTEN = 64, 8

def geometry(length: int) -> tuple[int, int, int]:
    """span: window starts that may share a minimizer; k: bytes hashed at a position; seed: bytes after a minimizer."""
    span = max(length * 2 // 5, 1)
    return span, min(8, length - span + 1), length - span + 1


def _sliding_min(x: np.ndarray, span: int) -> np.ndarray:
    """The least of each span values in a row."""
    width = 1
    while width * 2 <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :]) if span > width else x


def cut_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """seed, unit, minimizer, first and last window start (places in data) of every unit of texts in data."""
    span, k, seed = geometry(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    n = len(data) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h << np.uint64(8)) | data[j : j + n]
    h *= hashing.ODD
    h ^= h >> np.uint64(29)
    h *= hashing.BASES[0]
    h = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(n, dtype=np.uint64)
    least = _sliding_min(h, span) & np.uint64(0xFFFFFFFF)
    edge = np.zeros(len(data) + 1, np.int32)
    ok = ends - starts >= length
    np.add.at(edge, starts[ok], 1)
    np.add.at(edge, ends[ok] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    if not len(at):
        return none, none, none, none, none
    m = least[at].astype(np.int64)
    new = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
    m, lo, hi = m[new], at[new], at[np.r_[new[1:] - 1, len(at) - 1]]
    return hashing.Prefix(data, 0).of(m, m + seed), hashing.Prefix(data, 1).of(lo, hi + length), m, lo, hi


def _pieces(column: pa.BinaryArray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a column in pieces of bounded size: data, starts, ends, row and place in the row of each."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = row + 1
        while end < len(column) and offsets[end + 1] - offsets[row] <= PIECE:
            end += 1
        lo, hi = offsets[row], offsets[end]
        if end > row + 1 or hi - lo <= PIECE + length:
            yield data[lo:hi], offsets[row:end] - lo, offsets[row + 1 : end + 1] - lo, np.arange(row, end), np.zeros(end - row, np.int64)
        else:
            for at in range(0, hi - lo - length + 1, PIECE):
                part = data[lo + at : min(lo + at + PIECE + length - 1, hi)]
                yield part, np.zeros(1, np.int64), np.array([len(part)]), np.array([row]), np.array([at])
        row = end


UNITS = "key binary, seed long, unit long, m int, lo int, hi int, count int, more array<int>"


def _once(of: np.ndarray, seed: np.ndarray, unit: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Which units to keep so that a text has each unit once, how often it has it, and where else: lo, hi, lo, hi, ..."""
    h = (seed.view(np.uint64) * hashing.ODD + unit.view(np.uint64)) * hashing.BASES[0] + of.astype(np.uint64)
    order = np.argsort(h, kind="stable")
    x = order[1:], order[:-1]
    same = (h[x[0]] == h[x[1]]) & (unit[x[0]] == unit[x[1]]) & (seed[x[0]] == seed[x[1]]) & (of[x[0]] == of[x[1]])
    first = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[first, len(order)])
    more: list = [None] * len(first)
    for g in np.flatnonzero(size > 1):
        rest = order[first[g] + 1 : first[g] + size[g]]
        a, b = lo[rest], hi[rest]
        new = np.flatnonzero(np.r_[True, a[1:] > b[:-1] + 1])
        more[g] = np.column_stack([a[new], b[np.r_[new[1:] - 1, len(b) - 1]]]).ravel().tolist()
    return order[first], size, more


def units(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The units of every text, for rows of key and text (binary, not null).

    A unit that a text has more than once, as periodic texts do, is one row with a count and the other places in more.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for data, starts, ends, rows, places in _pieces(batch.column(1), length):
                seed, unit, m, lo, hi = cut_units(data, starts, ends, length)
                if not len(m):
                    continue
                of = np.searchsorted(starts, lo, "right") - 1
                shift = places[of] - starts[of]
                m, lo, hi = m + shift, lo + shift, hi + shift
                kept, count, more = _once(of, seed, unit, lo, hi)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(rows[of[kept]])),
                        *(pa.array(x[kept]) for x in (seed, unit)),
                        *(pa.array(x.astype(np.int32)) for x in (m[kept], lo[kept], hi[kept], count)),
                        pa.array(more, pa.list_(pa.int32())),
                    ],
                    names=["key", "seed", "unit", "m", "lo", "hi", "count", "more"],
                )

    return texts.transform(common.in_arrow, cut, UNITS)


def slices(length: int) -> int:
    """Window starts of a slice."""
    return -(-geometry(length)[0] // 4)


SLICES = "key binary, count long, seed long, unit long, lo int, hi int, left binary, right binary"


def cut_slices(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """The slices of chosen units, for rows of key, text (binary) and picked: an array of (m, lo, hi, count)."""
    width = slices(length)
    core = length - width + 1

    def digest(b: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.binary()), ("count", pa.int64()), ("seed", pa.int64()), ("unit", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.binary()), ("right", pa.binary())])
        rows: list[tuple] = []
        for batch in batches:
            for key, text, picked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                view = memoryview(text.as_buffer())
                for x in picked:
                    m = x["m"]
                    for c in range((m - x["hi"]) // width, (m - x["lo"]) // width + 1):
                        start = m - c * width
                        lo, hi = max(x["lo"], start - width + 1), min(x["hi"], start)
                        rows.append((key, x["count"], digest(view[start : start + core]), digest(view[lo : hi + length]), lo, hi, bytes(view[lo:start]), bytes(view[start + core : hi + length])))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return texts.transform(common.in_arrow, cut, SLICES)


def shard_transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and Burrows-Wheeler transform of a shard, read as a circle and sorted by depth symbols at least."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for j in range(4):
        key = (key << np.uint64(16)) | np.roll(symbols, -j).astype(np.uint64)
    known = 4
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order, symbols[order - 1]
        ranked = key[order]
        rank = np.zeros(n, np.uint64)
        rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        key = (rank << np.uint64(32)) | np.roll(rank, -known)
        known *= 2


def merge_transforms(transforms: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge shards' transforms by refining their interleave, one symbol a round.

    Returns, for each place in the merged order: the shard that it comes from (a shard's own places keep their order),
    the common prefix with the place before it, up to depth, and the block of places whose first depth symbols agree.
    """
    n = sum(map(len, transforms))
    column = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint16), [len(t) for t in transforms])
    prefix = np.full(n, depth, np.int32)
    block = np.zeros(n, np.int32)
    for done in range(depth):
        symbol = np.empty_like(column)
        symbol[np.argsort(shard, kind="stable")] = column
        order = np.argsort(symbol, kind="stable")
        shard, was, symbol = shard[order], block[order], symbol[order]
        parted = np.r_[True, (symbol[1:] != symbol[:-1]) | (was[1:] != was[:-1])]
        prefix[parted & (prefix == depth)] = done
        block = np.cumsum(parted, dtype=np.int32) - 1
    return shard, prefix, block


def repeated_windows(left: list[bytes], right: list[bytes], seed: np.ndarray, width: np.ndarray, count: np.ndarray, symbols: int, shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of slices are repeated: slice and start in the slice.

    A slice is left, its seed and right; its first `width` starts are windows of so many symbols. count says how many
    times its text occurs.
    """
    a, b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    size = a + b + 2
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    text = np.zeros(size.sum(), np.uint16)  # 0 ends a slice
    for data, at, n in ((left, start, a), (right, start + a + 1, b)):
        place = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        text[place] = np.frombuffer(b"".join(data), np.uint8).astype(np.uint16) + 1
    text[start + a] = 257 + np.r_[0, np.cumsum(seed[1:] != seed[:-1])]
    goal = min(shard, max(len(text) // 2, 1))
    cuts = np.unique(np.r_[0, start[np.searchsorted(start, np.arange(goal, len(text), goal), "right") - 1], len(text)])
    orders, transforms = zip(*(shard_transform(text[i:j], symbols) for i, j in zip(cuts, cuts[1:], strict=False)), strict=True)
    of, _, block = merge_transforms(list(transforms), symbols)
    place = np.empty(len(text), np.int64)
    place[np.argsort(of, kind="stable")] = np.concatenate([o + i for o, i in zip(orders, cuts, strict=False)])
    row = np.searchsorted(start, place, "right") - 1
    at = place - start[row]
    window = at < width[row]
    total = np.bincount(block[window], weights=count[row[window]], minlength=len(text))
    hit = window & (total[block] >= 2)
    return row[hit], at[hit]


def merge_slices(rows: DataFrame, width: int) -> DataFrame:
    """key, lo, hi: the repeated windows of slices that occur once, for rows as cut_slices() gives them.

    A window has width symbols: those beside the seed, and the seed.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.runs(batches, ["seed"], MERGE // (2 * width + 2)):
            lo, hi, count = (part.column(c).to_numpy() for c in ("lo", "hi", "count"))
            row, at = repeated_windows(part.column("left").to_pylist(), part.column("right").to_pylist(), part.column("seed").to_numpy(), hi - lo + 1, count, width)
            once = count[row] == 1
            row, at = row[once], at[once]
            order = np.lexsort((at, row))
            row, at = row[order], at[order]
            if not len(row):
                continue
            new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)])
            end = np.r_[new[1:] - 1, len(row) - 1]
            keys = part.column("key").combine_chunks().take(pa.array(row[new]))
            yield pa.RecordBatch.from_arrays([keys, pa.array((lo[row[new]] + at[new]).astype(np.int32)), pa.array((lo[row[new]] + at[end]).astype(np.int32))], names=["key", "lo", "hi"])

    return rows.transform(common.in_arrow, merge, "key binary, lo int, hi int")


def narrow(length: int) -> int:
    """Windows of the slices into which those of a crowded seed are cut: at most 4, in equal parts."""
    return max(n for n in range(1, 5) if slices(length) % n == 0)


def _narrower(ends: DataFrame, length: int) -> DataFrame:
    """Slices cut into slices of narrow() windows: key, count, seed, unit, lo, hi, left, right, as cut_slices() gives them.

    Slice c holds the windows whose start is c * n to c * n + n - 1 bytes before the seed; what all of these hold of left
    and right becomes part of its seed.
    """
    width, n = slices(length), narrow(length)
    a, last = F.octet_length("left"), F.col("hi") - F.col("lo")
    cut = ends.withColumn("c", F.explode(F.sequence(F.floor((a - last) / n).cast("int"), F.floor(a / n).cast("int"))))
    cut = cut.withColumn("e", a - F.col("c") * n).withColumns({"first": F.greatest(F.col("e") - n + 1, F.lit(0)), "last": F.least(F.col("e"), last)})
    part = lambda side, start, end: F.substring(F.col(side), start + 1, end - start)
    shared = F.lit(width) - (F.col("c") + 1) * n  # bytes of right that all windows of the slice hold
    seed = F.xxhash64("seed", "c", part("left", F.col("e"), a), part("right", F.lit(0), shared))
    cut = cut.select("key", "count", seed.alias("seed"), (F.col("lo") + F.col("first")).alias("lo"), (F.col("lo") + F.col("last")).alias("hi"), part("left", F.col("first"), F.col("e")).alias("left"), part("right", shared, F.lit(width - 1) - a + F.col("last")).alias("right"))
    return cut.withColumn("unit", F.xxhash64("seed", F.octet_length("left"), "left", "right"))


def _frequent(texts: DataFrame, length: int) -> DataFrame:
    """The seeds that more than OFTEN units of one text in SAMPLED have. They only decide how units are counted."""
    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(SAMPLED)) == 0)
    return common.saved(units(some, length).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > OFTEN).select("seed"), "repeat-frequent")


def repeated_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key and ranges: the byte ranges of each distinct text that repeated strings cover, in order and apart."""
    texts = docs.select(common.text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") >= length)
    every, frequent = units(texts, length), _frequent(texts, length)
    met = common.saved(_met(common.meet(every, frequent.withColumn("often", F.lit(True)), ["seed"], "left", 17)), "repeat-units")
    rare, often = met.filter("often is null"), met.filter("often")
    sure, first = rare.filter("n_unit > 1").select("key", "lo", "hi", "more"), F.min(F.struct("key", "m", "lo", "hi")).alias("first")
    unsure = rare.filter("n_unit < n_seed").groupBy("seed", "unit").agg(F.first("n_unit").alias("n"), first)
    if not frequent.isEmpty():
        same, alike, found = _settled(often, "repeat-often", F.struct("key", "m", "lo", "hi"))
        sure = sure.unionByName(same.unionByName(alike).select("key", "lo", "hi", "more"))
        unsure = unsure.unionByName(found)
    places = F.concat(F.array("lo", "hi"), F.coalesce("more", F.array().cast("array<int>")))
    ranges = [sure.select("key", F.explode(_pairs(places)).alias("x")).select("key", "x.lo", "x.hi")]
    picked = common.saved(unsure.groupBy("first.key").agg(F.collect_list(F.struct("first.m", "first.lo", "first.hi", F.col("n").alias("count"))).alias("picked")), "repeat-picked")
    n = picked.agg(F.coalesce(F.sum(F.size("picked") + 1), F.lit(0))).first()[0]
    parts = common.saved(cut_slices(common.join_small(texts, picked, ["key"], "inner", n, 64, 96 << 20).select("key", "text", "picked"), length), "repeat-slices")
    ends = _ends(parts, "repeat-slices", ranges)
    crowded = common.saved(ends.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("seed"), "repeat-crowded")
    n_crowded = crowded.count()
    wide = common.join_small(ends, crowded, ["seed"], "left_anti", n_crowded, 16) if n_crowded else ends
    ranges.append(merge_slices(wide.repartition("seed").sortWithinPartitions("seed"), slices(length)))
    if n_crowded:
        thin = common.saved(_narrower(common.join_small(ends, crowded, ["seed"], "left_semi", n_crowded, 16), length), "repeat-narrow")
        ends = _ends(thin, "repeat-narrow", ranges)
        ranges.append(merge_slices(ends.repartition("seed").sortWithinPartitions("seed"), narrow(length)))
    sets = functools.reduce(DataFrame.unionByName, ranges).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("starts"))
    return sets.transform(common.in_arrow, lambda batches: _joined(batches, length), "key binary, ranges array<int>")


def _met(rows: DataFrame) -> DataFrame:
    """Rows whose seed is met more than once, with n_seed and n_unit: how often the seed and the unit's text occur.

    Rows of frequent seeds (often) all stay, dealt to several tasks, and their two counts say nothing.
    """
    dealt = rows.withColumn("part", F.when(F.col("often"), F.pmod(F.xxhash64("key"), F.lit(SAMPLED))).otherwise(0))
    by_seed = dealt.withColumn("n_seed", F.sum("count").over(Window.partitionBy("seed", "part"))).filter("n_seed > 1 or often")
    return by_seed.withColumn("n_unit", F.sum("count").over(Window.partitionBy("seed", "part", "unit"))).drop("part")


def _settled(rows: DataFrame, name: str, best: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of seeds met more than once with one text only; those of other seeds whose own text is met more than once;
    and each text of the latter seeds: seed, unit, n (how often it is met) and first, the least of best.

    Seeds and texts are counted in partial counts, and the counts join back: no task gets all rows of one.
    """
    seeds = rows.groupBy("seed").agg(F.sum("count").alias("n_seed"), (F.min("unit") != F.max("unit")).alias("mixed")).filter("n_seed > 1")
    seeds = common.saved(seeds.select("seed", "mixed"), f"{name}-seeds")
    with_others = common.meet(rows, seeds.filter("mixed").select("seed"), ["seed"], "left_semi", 16)
    texts = common.saved(with_others.groupBy("seed", "unit").agg(F.sum("count").alias("n"), F.min(best).alias("first")), f"{name}-texts")
    same = common.meet(rows, seeds.filter("not mixed").select("seed"), ["seed"], "left_semi", 16)
    alike = common.meet(rows, texts.filter("n > 1").select("seed", "unit"), ["seed", "unit"], "left_semi", 24)
    return same, alike, texts


def _ends(parts: DataFrame, name: str, ranges: list[DataFrame]) -> DataFrame:
    """The distinct slices of seeds with several, one of each text, with its count. To ranges go the slices that stand
    for text met once but whose own text is met again."""
    same, alike, texts = _settled(parts, name, F.struct("key", "lo", "hi", "left", "right"))
    ranges.append(same.unionByName(alike).filter("count = 1").select("key", "lo", "hi"))
    return texts.select("seed", "unit", F.col("n").alias("count"), "first.*")


def _pairs(flat: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / 2 - 1).cast("int")), lambda i: F.struct(F.get(flat, 2 * i).alias("lo"), F.get(flat, 2 * i + 1).alias("hi")))


def _joined(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Window starts to byte ranges that neither touch nor overlap, as start, end, start, end, ..."""
    for batch in batches:
        out = []
        for starts in batch.column(1).to_pylist():
            ranges: list[int] = []
            for x in starts:
                if ranges and x["lo"] <= ranges[-1]:
                    ranges[-1] = max(ranges[-1], x["hi"] + length)
                else:
                    ranges += [x["lo"], x["hi"] + length]
            out.append(ranges)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int32()))], names=["key", "ranges"])


def _with_ranges(docs: DataFrame, found: DataFrame, added: tuple[str, ...]) -> DataFrame:
    """row (docs without the columns added), bytes and the ranges found for its text, or null."""
    n = found.agg(F.coalesce(F.sum(F.size("ranges") + 6), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added)).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("row", common.text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("bytes"))
    return common.join_small(rows, found, ["key"], "left", n, 8).select("row", "bytes", "ranges")


def _wordy(data: bytes, ranges: list[int], least: int) -> list[int]:
    """The ranges in which at least so many words, or parts of them, stand."""
    return [x for i, j in zip(ranges[::2], ranges[1::2], strict=True) if len(data[i:j].split()) >= least for x in (i, j)]


def remove_repeats(docs: DataFrame, length: int = LENGTH, found: DataFrame | None = None, least_words: int = 0) -> DataFrame:
    """docs with four more columns: n_bytes, n_removed, n_spans and kept, the bytes that remain.

    Removed is each byte of a text's UTF-8 form that a string of `length` bytes covers which also starts anywhere else,
    in the same text too; all occurrences go. docs needs text; its other columns stay (those four would be replaced),
    whatever their names. A null text counts as empty; texts shorter than length stay whole. Repeated rows repeat each
    other. Long texts are read whole. An empty table gives no rows. found are the ranges of repeated_ranges() for the
    same docs and length, where they are known. Runs of removed bytes with fewer than least_words words stay.
    """
    added = ("n_bytes", "n_removed", "n_spans", "kept")
    if found is None:
        found = common.saved(repeated_ranges(docs.select(F.coalesce("text", F.lit("")).alias("text")), length), "repeat-ranges")
    rows = _with_ranges(docs, found, added)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for data, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ranges = _wordy(data, ranges, least_words) if ranges and least_words else ranges or []
                cuts = [0, *ranges, len(data)]
                left = b"".join(data[i:j] for i, j in zip(cuts[::2], cuts[1::2], strict=True)) if ranges else data
                sizes.append(len(data))
                removed.append(len(data) - len(left))
                spans.append(len(ranges) // 2)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(kept, pa.binary())], names=["row", *added])

    shape = rows.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")
    return rows.transform(common.in_arrow, remove, shape).select("row.*", *added)


def kept_text() -> Column:
    """kept as text; where a cut parts a character, its bytes become U+FFFD."""
    return F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("text"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and what is left of each text when repeated passages are cut out of it.

    A byte that a repeated string of LENGTH bytes covers lies in a run of as many bytes that repeated strings of PASSAGE
    bytes cover, and so do the string's other occurrences. So the longer strings are sought only in texts that have such
    a run.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    short = common.saved(repeated_ranges(docs, PASSAGE), "repeat-ranges")
    runs = F.zip_with(F.filter("ranges", lambda x, i: i % 2 == 0), F.filter("ranges", lambda x, i: i % 2 == 1), lambda a, b: b - a)
    maybe = common.saved(short.filter(F.array_max(runs) >= LENGTH).select("key"), "repeat-maybe")
    some = common.meet(docs.withColumn("key", common.text_key(F.col("text"))), maybe, ["key"], "left_semi", 64).select("text")
    cut = remove_repeats(docs, LENGTH, common.saved(repeated_ranges(some, LENGTH), "repeat-ranges"))
    digest = cut.select("doc_id", "text", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    passages = remove_repeats(digest.select(*(F.col(c).alias(f"c_{c}") if c.startswith("n_") else F.col(c) for c in digest.columns)), PASSAGE, short, PASSAGE_WORDS)
    return passages.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f"c_{c}").alias(c) for c in ("n_bytes", "n_removed", "n_spans")), "kept_sha256", kept_text().alias("text"))
