"""Token counts from an exact histogram of document lengths.

Documents are encoded once and counted by encoded length. Everything else follows from suffix sums over the
histogram, which has at most as many rows as there are distinct lengths: totals, quantiles, and what remains of the
corpus when every document is cut at a context limit, for every limit at once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters of a text encoded at once. The pattern never joins a letter to a space that follows it, so that cutting
#: before a space between two letters changes no token.
PART = 200_000


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        cut = at + PART
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isascii() and text[cut - 1].isalpha() and text[cut + 1].isascii() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def with_token_count(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row, by byte-level BPE ranks in the file at path.

    docs needs doc_id and the text column; other columns are ignored, whatever their names. A null or empty text has 0
    tokens. Repeated rows are each counted. Long texts are counted whole, in parts cut where no token crosses. An empty
    table gives no rows.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoding(path)
        for b in batches:
            n = [sum(len(enc.encode_ordinary(p)) for p in _parts(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("text")).transform(common.in_arrow, count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens and n_docs: the counts meet as one partial row for each length and task.

    lengths needs n_tokens; other columns are ignored, whatever their names. Null lengths count as 0, repeated rows each
    count, and an empty table gives no rows. A length that a third of all documents have is one partial row of a task
    like any other.
    """
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """One row per length L that occurs, read as a context limit.

    n_docs: documents of that length. docs_over: longer ones. tokens_total: all tokens of the corpus. tokens_kept: their
    number when each document is cut after L tokens. rank_to: documents of at most L tokens, from which any quantile is
    read as the least L whose rank_to reaches it. histogram has one row for each length; other columns than n_tokens and
    n_docs are ignored. An empty histogram gives no rows. The rows are distinct lengths, not
    documents; what their windows gather is bounded by the longest document.
    """
    up = Window.orderBy("n_tokens")
    upto, all_ = up.rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    over = up.rowsBetween(1, Window.unboundedFollowing)
    mass: Column = F.col("n_tokens") * F.col("n_docs")
    return histogram.select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        F.coalesce(F.sum("n_docs").over(over), F.lit(0)).alias("docs_over"),
        F.sum("n_docs").over(upto).alias("rank_to"),
        F.sum(mass).over(all_).alias("tokens_total"),
        (F.sum(mass).over(upto) + F.col("n_tokens") * F.coalesce(F.sum("n_docs").over(over), F.lit(0))).alias("tokens_kept"),
    )


def tokens_kept_at(limit_rows: DataFrame, limit: int) -> DataFrame:
    """tokens_kept for a limit that need not occur as a length, from the rows of limits().

    One row, also of an empty table: 0. Null and empty texts count with the length that the histogram gives them, repeated
    documents each, and long ones with their whole length; other columns are ignored.
    """
    at = limit_rows.filter(F.col("context_limit") <= limit).agg(F.max_by(F.struct("tokens_kept", "context_limit", "docs_over"), "context_limit").alias("x"), F.count(F.lit(1)).alias("n"))
    docs = limit_rows.agg(F.sum("n_docs").alias("docs"))
    return at.crossJoin(F.broadcast(docs)).select(  # one row each
        F.when(F.col("n") > 0, F.col("x.tokens_kept") + F.col("x.docs_over") * (F.lit(limit) - F.col("x.context_limit"))).otherwise(F.coalesce("docs", F.lit(0)) * limit).cast("long").alias("tokens_kept")
    )


def quantile(limit_rows: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents do not exceed (q > 0), from the rows of limits().

    One row; null for an empty table. Documents of one length are ties and count each, so that the result is a length that
    occurs. Null and empty texts count with the length that the histogram gives them.
    """
    return limit_rows.filter(F.col("rank_to") >= F.ceil(F.lit(q) * (F.col("rank_to") + F.col("docs_over")))).agg(F.min("context_limit").alias("n_tokens"))


def op8_token_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits(length_histogram(with_token_count(common.table(spark, sf_dir, "documents"))))
