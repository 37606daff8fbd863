"""What the operators of this subpackage share: tables, the shared folder, sorted groups."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; a word is a maximal run of other characters.
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that a worker takes at once (more only where one text has more).
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark runs on
    this machine alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, and lost executors cost no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """16 bytes that name a text by its content; equal texts share it, so results join back to every copy."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def small(df: DataFrame, most_bytes: int, row_bytes: int) -> bool:
    """Whether df, a saved table, is proven to hold at most most_bytes at row_bytes a row."""
    return df.count() * row_bytes <= most_bytes


def least(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows of df with the least `most` values of key, a number: only keys are sorted, rows stay where they are."""
    bound = df.select(key.alias("k")).orderBy("k").limit(most).agg(F.max("k")).first()[0]
    return df.filter(key <= bound) if bound is not None else df.limit(0)


def join_small(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str, right_rows: int, row_bytes: int, most_bytes: int = 48 << 20) -> DataFrame:
    """Join with a broadcast where right's size is known to be under the bound, else by a shuffle of both sides."""
    return left.join(F.broadcast(right) if right_rows * row_bytes <= most_bytes else right, on, how)


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str, row_bytes: int, most_bytes: int = 16 << 20) -> DataFrame:
    """join_small() with right's rows counted here; right is a saved table or a cheap part of one."""
    return join_small(left, right, on, how, right.count(), row_bytes, most_bytes)


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose texts have about as many bytes as a worker takes at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def gather(found: list[bytes], which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, from those of their distinct words (little-endian 32-bit), which word stands where, and where
    each text's words begin; with the bounds of each text's ids."""
    size = np.fromiter(map(len, found), np.int32, len(found)) // 4
    n = size[which]
    end = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=end[1:])
    kind = np.int32 if end[-1] < 1 << 31 else np.int64  # half the memory where it does
    place = np.arange(end[-1], dtype=kind)
    place += np.repeat((np.cumsum(size, dtype=np.int64) - size)[which].astype(kind) - end[:-1].astype(kind), n)
    return np.frombuffer(b"".join(found), "<u4")[place], end[bounds]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys, about most_rows each (more only where one group has more)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < most_rows:
            continue
        whole = pa.Table.from_batches(held)
        cut = n - 1
        last = [whole.column(k)[n - 1] for k in keys]
        while cut and all(whole.column(k)[cut - 1] == v for k, v in zip(keys, last, strict=True)):
            cut -= 1
        if cut:
            yield whole.slice(0, cut)
            rest = whole.slice(cut)
            held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held)


@functools.cache
def _trim():
    """The C library's call that gives freed memory back to the system, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() with batches bounded by bytes as well as rows, so that neither the executor nor its worker holds many
    long texts; and a worker gives freed memory back, as it stays for later tasks.

    The bound is a setting of the session, read when the job runs, and so stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in function(batches):
                yield batch
                del batch
                _release()
        finally:
            _release()

    return df.mapInArrow(run, schema)
