"""SentencePiece encoding and decoding: Viterbi over a double-array trie of pieces, or merges by rank.

The pieces and their scores are read from a model file, which says what the scores are. Those of a unigram model are log
probabilities: the best segmentation of a text is the one whose scores have the greatest sum. Those of a BPE model, such
as the default one, are ranks. It can be read in two ways: as a unigram model, the piece of rank r having a probability in
proportion to 1 / (r + 1), as Zipf's law has it; or as what it is: neighbours are merged, of all pairs the one of best rank
first and of equal ones the leftmost. Characters without a piece fall back to byte pieces. A space is written as the marker U+2581,
and one stands before the text. Where no piece crosses into a marker, a text falls into words that are segmented on
their own, each distinct one once.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: What a character without a piece costs beyond the worst piece.
UNKNOWN_COST = 10.0
#: Bytes of a word that is segmented side by side with others; longer ones are taken one by one.
SHORT = 48
#: Characters of a word whose pairs are looked through for each merge; longer ones keep a queue of pairs.
FEW = 64
#: Words that a worker remembers.
MEMORY = 600_000
_WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass
class DoubleArray:
    """A trie in two arrays: from state s, byte c leads to base[s] + c if check there is s; value is a piece's id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def of(cls, keys: dict[bytes, int]) -> DoubleArray:
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 1 << 12
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], free = 0, 1
        todo = [(0, root)]
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            chars = np.array(sorted(c for c in node if c >= 0))
            if not len(chars):
                continue
            at = free
            while True:
                while at + 4096 + 256 > len(base):
                    base, check, value = (np.concatenate([a, np.full(len(a), f, np.int32)]) for a, f in ((base, 0), (check, -1), (value, -1)))
                start = at + np.flatnonzero(check[at : at + 4096] < 0) - int(chars[0])
                start = start[start > 0]
                fits = np.flatnonzero((check[start[:, None] + chars] < 0).all(1))
                if len(fits):
                    break
                at += 4096
            b = int(start[fits[0]])
            base[state] = b
            check[b + chars] = state
            while check[free] >= 0:
                free += 1
            todo += [(b + int(c), node[int(c)]) for c in chars]
        return cls(base, check, value)

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """End and id of every piece that text holds at start."""
        state = 0
        for end in range(start, len(text)):
            to = int(self.base[state]) + text[end]
            if self.check[to] != state or to == 0:
                return
            state = to
            if (found := int(self.value[state])) >= 0:
                yield end + 1, found


@dataclass
class Pieces:
    """A model: what each id stands for in bytes, its score, the trie, the ids of the byte pieces and of the others by
    piece, and whether scores are ranks of merges."""

    texts: list[bytes]
    scores: np.ndarray
    trie: DoubleArray
    bytes_: np.ndarray
    unknown: float
    ids: dict[str, int]
    ranked: bool

    @classmethod
    def load(cls, path: str, unigram: bool = False) -> Pieces:
        """Read a model file, unigram or BPE; unigram says to read the latter as the former. It must not normalise texts,
        and must have all byte pieces."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        spec = proto.trainer_spec
        if spec.model_type not in (spec.UNIGRAM, spec.BPE):
            raise ValueError("the model is neither unigram nor BPE")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        keys, ids, texts, scores, bytes_ = {}, {}, [], [], np.full(256, -1, np.int32)
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            scores.append(sp.get_score(i))
            if sp.is_byte(i):
                bytes_[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                texts.append(b"")
            else:
                if "\n" in piece or re.search(f"[^{MARK}]{MARK}", piece):
                    raise ValueError(f"piece {piece!r} crosses words")
                keys[piece.encode()] = ids[piece] = i
                texts.append(piece.replace(MARK, " ").encode())
        if (bytes_ < 0).any():
            raise ValueError("the model has no byte pieces")
        ranked = spec.model_type == spec.BPE and not unigram
        if spec.model_type == spec.BPE and unigram:
            scores = zipf(-np.array(scores))
        used = np.array(scores)[list(keys.values())]
        return cls(texts, np.array(scores), DoubleArray.of(keys), bytes_, float(used.min()) - UNKNOWN_COST, ids, ranked)

    @functools.cached_property
    def ranks(self) -> dict[str, float]:
        return {piece: float(self.scores[i]) for piece, i in self.ids.items()}

    def merge(self, word: str) -> list[int]:
        """Ids of one word by merges."""
        parts = self._merge_few(list(word)) if len(word) <= FEW else self._merge_many(list(word))
        out: list[int] = []
        for part in parts:
            found = self.ids.get(part)
            out += [found] if found is not None else self.bytes_[np.frombuffer(part.encode("utf-8", "replace"), np.uint8)].tolist()
        return out

    def _merge_few(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, -np.inf
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (top := max(pairs)) > none:
            i = pairs.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def _merge_many(self, parts: list[str]) -> list[str]:
        """The same with a queue, in n log n steps; a part that was merged into the one before it is empty."""
        rank, n = self.ranks.get, len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(-r, i, i + 1, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(a + b)) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, j, both = heapq.heappop(queue)
            if not parts[i] or not parts[j] or len(parts[i]) + len(parts[j]) != len(both):
                continue  # one of them was merged since
            parts[i], parts[j], after[i] = both, "", after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(parts[a] + parts[b])) is not None:
                    heapq.heappush(queue, (-r, a, b, parts[a] + parts[b]))
        return [x for x in parts if x]

    def segment(self, text: bytes) -> list[int]:
        """Ids of the best segmentation of one word; of equal ones, the one whose last piece starts first."""
        n = len(text)
        best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] == -np.inf:
                continue
            width, single = _width(text[at]), False
            for end, piece in self.trie.prefixes(text, at):
                single |= end == at + width
                score = best[at] + self.scores[piece]
                if score > best[end]:
                    best[end], back[end] = score, (at, piece)
            if not single and best[at] + self.unknown > best[at + width]:
                best[at + width], back[at + width] = best[at] + self.unknown, (at, -1)
        out: list[int] = []
        while n:
            at, piece = back[n]
            out += [piece] if piece >= 0 else self.bytes_[np.frombuffer(text[at:n], np.uint8)][::-1].tolist()
            n = at
        return out[::-1]

    def segment_all(self, words: list[bytes]) -> list[list[int]]:
        """The same for many words at once, place by place."""
        if not words:
            return []
        size = np.array([len(w) for w in words])
        width = int(size.max())
        text = np.zeros((len(words), width + 1), np.uint8)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[np.repeat(np.arange(len(words)), size), place] = np.frombuffer(b"".join(words), np.uint8)
        best = np.full((len(words), width + 4), -np.inf)
        best[:, 0] = 0.0
        back, with_ = np.zeros((len(words), width + 4), np.int16), np.full((len(words), width + 4), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for at in range(width):
            rows = np.flatnonzero((size > at) & (best[:, at] > -np.inf))
            if not len(rows):
                continue
            chars, single = _WIDTHS[text[rows, at]], np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for end in range(at, width):
                inside = size[rows[live]] > end
                live, state = live[inside], state[inside]
                to = base[state] + text[rows[live], end]
                go = (check[to] == state) & (to > 0)
                live, state = live[go], to[go]
                if not len(live):
                    break
                piece = value[state]
                hit = piece >= 0
                w, r, p = live[hit], rows[live[hit]], piece[hit]
                single[w] |= chars[w] == end + 1 - at
                score = best[r, at] + self.scores[p]
                more = score > best[r, end + 1]
                r = r[more]
                best[r, end + 1], back[r, end + 1], with_[r, end + 1] = score[more], at, p[more]
            lone = np.flatnonzero(~single)
            r, end = rows[lone], at + chars[lone]
            more = best[r, at] + self.unknown > best[r, end]
            r, end = r[more], end[more]
            best[r, end], back[r, end], with_[r, end] = best[r, at] + self.unknown, at, -1
        at, rows, steps = size.copy(), np.arange(len(words)), []
        while len(rows):
            e = at[rows]
            steps.append((rows, back[rows, e], e, with_[rows, e]))
            at[rows] = back[rows, e]
            rows = rows[at[rows] > 0]
        out: list[list[int]] = [[] for _ in words]
        for rows, start, end, piece in reversed(steps):
            for w, a, b, p in zip(rows.tolist(), start.tolist(), end.tolist(), piece.tolist(), strict=True):
                out[w] += [p] if p >= 0 else self.bytes_[text[w, a:b]].tolist()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and fallback bytes in turn, without the space of the first marker."""
        data = b"".join(map(self.texts.__getitem__, ids.tolist()))
        return data.removeprefix(b" ").decode("utf-8", "replace")


def zipf(ranks: np.ndarray) -> np.ndarray:
    """Log probabilities of pieces by rank, in single precision, as model files have them."""
    weight = 1.0 / (np.maximum(ranks, 0) + 1)
    return np.log(weight / weight.sum()).astype(np.float32).astype(np.float64)


def _width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


_WIDTHS = np.array([_width(c) for c in range(256)])


@functools.cache
def load(path: str, unigram: bool = False) -> Pieces:
    return Pieces.load(path, unigram)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def _encoder(path: str, unigram: bool = False):
    """Encode texts to ids, with the bounds of each text's among them."""
    model, known = load(path, unigram), {}

    def learn(words: list[str]) -> None:
        if model.ranked:
            known.update((w, np.array(model.merge(w), "<u4").tobytes()) for w in words)
            return
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(-(-len(w.encode("utf-8", "replace")) // 8), []).append(w)
        for size, group in by_size.items():
            data = [w.encode("utf-8", "replace") for w in group]
            found = model.segment_all(data) if 8 * size <= SHORT else map(model.segment, data)
            known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(group, found, strict=True))

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = [_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        bounds = np.cumsum([0, *map(len, words)])
        coded = pa.array([w for ws in words for w in ws], pa.large_string()).dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(known) > MEMORY:
            known.clear()
        new = [w for w in distinct if w not in known]
        learn(new)
        out = common.gather([known[w] for w in distinct], which, bounds)
        for w in new:
            if len(w) > SHORT:
                del known[w]
        return out

    return encode


def encode(docs: DataFrame, path: str | None = None, unigram: bool = False) -> DataFrame:
    """doc_id and ids of each row's text; unigram says to read a BPE model as a unigram model.

    docs needs doc_id and text; other columns are ignored, whatever their names. Null and empty texts have no ids.
    Repeated rows are encoded each. Long texts are encoded whole. An empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_ = _encoder(path, unigram)
        for batch in batches:
            for part in common.slices(batch, 1):
                ids, bounds = encode_([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.in_arrow, run, "doc_id long, ids array<int>")


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text from doc_id and ids. Null or empty ids give an empty text; bytes that are no UTF-8 are replaced."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            texts = [model.decode(x.values.to_numpy()) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(common.in_arrow, run, "doc_id long, text string")


CHECKED = "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, decoded boolean"


def round_trip(docs: DataFrame, path: str | None = None, unigram: bool = False) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text.

    docs, and what of it is read, are as encode() says: null and empty texts have no ids and decode to themselves, repeated
    rows are encoded each, long texts whole, other columns ignored, and an empty table gives no rows.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_, model = _encoder(path, unigram), load(path, unigram)
        fallback = np.zeros(len(model.texts), bool)
        fallback[model.bytes_] = True
        for batch in batches:
            for part in common.slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, bounds = encode_(texts)
                spans = [ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]
                cols = [[len(x) for x in spans], [int(fallback[x].sum()) for x in spans], [zlib.crc32(x.tobytes()) for x in spans], [model.decode(x) == t for x, t in zip(spans, texts, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True))], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(common.in_arrow, run, CHECKED)


def op9_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default model read as a unigram model: every id comes from the Viterbi search over the trie."""
    return round_trip(common.table(spark, sf_dir, "documents"), unigram=True)
