"""Packing by power-of-two decomposition: a document's tokens are cut into pieces whose lengths are powers of two.

A piece is a whole training sequence, so no sequence holds tokens of two documents and none needs padding. Pieces of
one length form a bucket, from which batches of equal shape are drawn. The work is one pass over the texts without a
shuffle; a hot source or a long document costs its own tokens and nothing else.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LIMIT = 2048
END_ID = 1
#: Words whose ids a worker remembers; when more have been seen, it starts afresh.
MEMORY = 1_000_000
#: Characters of a word that is not remembered.
LONG = 100


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _lower(text: str) -> str:
    """Lower case, where that is sure to be the tokenizer's own: not by context, and no special token arises."""
    return text if "<|" in text or "\u03a3" in text or "\u0130" in text else text.lower()


@functools.cache
def word_encoder(path: str) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """Encode texts to little-endian 32-bit ids, with the bounds of each text's among them, for tokenizers that lower the case, drop white space and mark word ends.

    Such a tokenizer never joins what a space or a line feed parts, nor a letter to the full stop or comma after it, so
    that the ids of a text are those of its words in turn, and each distinct word is encoded once. Words of letters
    alone are encoded many at a time and told apart by the ids that end a word.
    """
    tok, known = _tokenizer(path), {}
    ends = np.zeros(tok.get_vocab_size(), bool)
    ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
    tails = {t: np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ".,"}

    def learn(new: set[str]) -> None:
        tailed = [w for w in new if w[-1:] in tails and w[:-1].isalpha()]
        alone = (new.difference(tailed) | {w[:-1] for w in tailed}) - known.keys()
        letters = [w for w in alone if w.isalpha()]
        others = [w for w in alone if not w.isalpha()]
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            ids = np.array(tok.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()]
            data = ids.tobytes()
            if len(cuts) - 1 == len(part):
                known.update((w, data[4 * i : 4 * j]) for w, i, j in zip(part, cuts, cuts[1:], strict=False))
            else:  # a letter that the tokenizer's normal form takes apart
                others += part
        for at in range(0, len(others), 4096):
            part = others[at : at + 4096]
            for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, "<u4").tobytes()
        known.update((w, known[w[:-1]] + tails[w[-1]]) for w in tailed)

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pa.array([_lower(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        bounds = split.offsets.to_numpy()
        words = split.flatten().dictionary_encode()
        distinct, which = words.dictionary.to_pylist(), words.indices.to_numpy()
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = distinct
        learn(set(new))
        found = [known[w] for w in distinct]
        for w in new:
            if len(w) > LONG:  # such words seldom come back, and a few could fill the memory
                del known[w]
        return common.gather(found, which, bounds)

    return encode


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of a document's pieces in order: as many of limit as fit, then the binary digits of what is left."""
    whole, rest = divmod(n, limit)
    return [limit] * whole + [1 << b for b in range(limit.bit_length() - 1, -1, -1) if rest >> b & 1]


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ]
)


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, with_ids: bool = True, slice_bytes: int = common.SLICE_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset and, if asked, ids.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text counts as empty, and an
    empty text is the end id alone: one piece of length 1. Repeated rows and repeated or null doc_ids are documents of
    their own: each row gives its own pieces. Long texts are tokenized whole. An empty table gives no rows.
    limit is a power of two; slice_bytes is how much text a worker encodes at once. sequence_id holds the bucket (log2 of the length) in its top bits, so that a bucket's
    sequences are neighbours, and below it the row's place in its partition.
    """
    if limit < 1 or limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    path = path or tokenizer_path()
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path)
        for batch in batches:
            for part in common.slices(batch, 1, slice_bytes):
                out: list[list] = [[] for _ in schema]
                every, bounds = encode([t or "" for t in part.column(1).to_pylist()])
                for doc, i, j in zip(part.column(0).to_pylist(), bounds, bounds[1:], strict=False):
                    ids = every[i:j].tobytes() + end
                    n, start = len(ids) // 4, 0
                    for length in piece_lengths(n, limit):
                        piece = ids[4 * start : 4 * (start + length)]
                        row = [doc, start, length, zlib.crc32(piece), n, np.frombuffer(piece, "<i4") if with_ids else None]
                        for column, value in zip(out, row, strict=False):
                            column.append(value)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(out, schema, strict=True)], schema=schema)

    fields = PIECES if with_ids else T.StructType(PIECES.fields[:5])
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.in_arrow, cut, fields)
    bucket = F.log2(F.col("length").cast("double")).cast("int")
    return pieces.withColumns(
        {
            "bucket": bucket,
            "sequence_id": F.shiftleft(bucket.cast("long"), 58) + F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def op3_pack_power_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), with_ids=False)
