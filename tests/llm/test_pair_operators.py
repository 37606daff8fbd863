"""Joins, searches and repeats against brute force on small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import components, hashing, neighbours, ngram_join, suffix_dedup

DOCS = "doc_id long, text string, key string, row string, words int, bucket string, root string, text_key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", 1, "b", "o", "t") for i, t in rows], DOCS)


# n-gram Jaccard join ---------------------------------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def plain_join(rows):
    sets = [shingles(t) for _, t in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i + 1, n):
            a, b = sets[i], sets[j]
            if a == b or a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((rows[i][0], least.get(find(i)), links[i], len(sets[i])) for i in range(n))


def corpus(rng, n=60):
    words = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        base = list(rng.choice(words, int(rng.integers(1, 120))))
        rows.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            near = list(base)
            for _ in range(int(rng.integers(0, 4))):
                near[int(rng.integers(len(near)))] = str(rng.choice(words))
            rows.append(" ".join(near))
    return rows


@pytest.mark.parametrize("block", [4, 512])
def test_join_finds_the_links_of_brute_force(spark, block):
    texts = corpus(np.random.default_rng(1)) + [None, "", " \n", "a b", "a  b", "a b c d e", "x " * 3000, "x " * 2000]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = sorted(tuple(r) for r in ngram_join.join(docs_of(spark, rows), block=block).collect())
    assert got == plain_join(rows)


def test_keep_one_leaves_a_row_of_each_class(spark):
    texts = corpus(np.random.default_rng(2), 25) + [None, "", "one"]
    rows = list(enumerate(texts)) + [(5, texts[5]), (5, texts[5])]
    docs = docs_of(spark, rows)
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c, _, _ in plain_join(rows)})
    assert ngram_join.keep_one(docs.limit(0)).collect() == []


def test_rows_without_ids_are_kept_and_joined(spark):
    a, b = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    docs = docs_of(spark, [(None, a), (None, a), (None, b), (7, b)])
    assert sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in ngram_join.join(docs).collect()) == [(-1, -1, 1), (-1, -1, 1), (-1, 7, 1), (7, 7, 1)]
    assert sorted(((r.doc_id or -1), r.text) for r in ngram_join.keep_one(docs).collect()) == sorted([(-1, a), (7, b)])


def test_pruning_drops_far_pairs_and_keeps_near_ones():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    near, far = base.copy(), base.copy()
    near[:50] = rng.integers(0, 1 << 62, 50)
    far[:700] = rng.integers(0, 1 << 62, 700)
    a, b, c = (ngram_join.minhash(np.unique(x)).astype(np.uint8) for x in (base, near, far))
    assert list(ngram_join.survive(np.stack([a, a]), np.stack([b, c]))) == [True, False]
    least = ngram_join.least_matches(0.8, 1e-6)
    assert list(least) == sorted(least)


def test_empty_join_and_bad_threshold(spark):
    docs = docs_of(spark, [(1, "a")])
    assert ngram_join.join(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        ngram_join.join(docs, threshold=0.5)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[101] != got[0]
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_shingles_count_words():
    assert len(hashing.shingles(np.frombuffer(b"a b c d e f", np.uint8), 5)) == 2
    assert len(hashing.shingles(np.frombuffer(b"a b", np.uint8), 5)) == 1
    assert len(hashing.shingles(np.frombuffer(b" ", np.uint8), 5)) == 0


# repeats ---------------------------------------------------------------------------------------------------------------


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    hit = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                hit[d][i : i + length] = True
    out = []
    for b, h in zip(data, hit):
        spans = int(h[0]) + int((h[1:] & ~h[:-1]).sum()) if len(h) else 0
        out.append((len(b), int(h.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~h])).hexdigest()))
    return out


def repeated_texts(rng, length):
    letters = list("abcdé ")
    passages = ["".join(rng.choice(letters, int(rng.integers(length // 2, length * 4)))) for _ in range(8)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(int(rng.integers(1, 5))):
            parts.append("".join(rng.choice(letters, int(rng.integers(0, length * 2)))))
            if rng.random() < 0.6:
                p = passages[int(rng.integers(len(passages)))]
                i = int(rng.integers(0, len(p) // 2))
                parts.append(p[i : i + int(rng.integers(length // 2, len(p)))])
        texts.append("".join(parts))
    return texts + texts[:3] + [None, "", "ab" * length * 3, "a" * (length + 1), "a" * length, passages[0]]


@pytest.mark.parametrize("length", [10, 50, 400])
def test_repeats_are_those_of_brute_force(spark, length):
    texts = repeated_texts(np.random.default_rng(length), length)
    out = suffix_dedup.remove_repeats(docs_of(spark, list(enumerate(texts))), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    expected = plain_repeats(texts, length)
    assert any(x[1] for x in expected)
    for i, x in enumerate(expected):
        assert got[i] == x, (i, texts[i])


@pytest.mark.parametrize("length", [40, 100])
def test_frequent_seeds_and_crowded_slices_give_the_same(spark, monkeypatch, length):
    monkeypatch.setattr(suffix_dedup, "SAMPLED", 1)
    monkeypatch.setattr(suffix_dedup, "OFTEN", 1)
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    rng = np.random.default_rng(length)
    texts = repeated_texts(rng, length)
    shared = "".join(rng.choice(list("abcdé"), 2 * length))
    for k in range(40):  # one passage, cut off at many places, in differing surroundings
        i, j = rng.integers(0, length // 2), rng.integers(3 * length // 2, 2 * length)
        texts.append("".join(rng.choice(list("xyz "), 60)) + shared[i:j] + "".join(rng.choice(list("uvw "), 60)))
    out = suffix_dedup.remove_repeats(docs_of(spark, list(enumerate(texts))), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    expected = plain_repeats(texts, length)
    for i, t in enumerate(texts):
        assert got[i] == expected[i], (i, t)


def test_passages_of_fifty_one_words_leave_the_text(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in "nrst"]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(12)]
    passage, long_one = " ".join(rng.choice(words, 51)), " ".join(rng.choice(words, 130))
    for i in (1, 2, 3):
        texts[i] += " " + passage + " " + texts[i + 4][:100]
    texts[8], texts[9] = long_one + texts[8], texts[9] + long_one
    few = "-".join(rng.choice(words, 70)) + " " + " ".join(rng.choice(words, 20))  # long, but of few words
    texts[10], texts[11] = few + " " + texts[10], texts[11] + " " + few
    docs_of(spark, list(enumerate([*texts, None, ""]))).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in suffix_dedup.op7_suffix_dedup(spark, str(tmp_path)).collect()}
    expected = plain_repeats([*texts, "", ""], 400)
    for i in range(len(texts) + 2):
        n_bytes, n_removed, n_spans, kept = expected[i]
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (n_bytes, n_removed, n_spans, kept)
    assert all(passage not in got[i].text and got[i].n_removed == 0 for i in (1, 2, 3))
    assert all(long_one not in got[i].text and got[i].n_removed >= 400 for i in (8, 9))
    assert all(got[i].text == texts[i] for i in (0, 4, 10, 11))


def test_a_long_text_is_cut_into_pieces_that_share_no_window(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng, length = np.random.default_rng(9), 40
    texts = [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (0, 30, 40, 499, 500, 539, 540, 541, 5000, 1, 300)]
    seen = []
    for data, starts, ends, rows, places in suffix_dedup._pieces(pa.array(texts, pa.binary()), length):
        _, _, m, lo, hi = suffix_dedup.cut_units(data, starts, ends, length)
        of = np.searchsorted(starts, lo, "right") - 1
        for row, shift, i, j in zip(rows[of], places[of] - starts[of], lo, hi):
            seen += [(int(row), int(k + shift)) for k in range(i, j + 1)]
    assert sorted(seen) == [(row, k) for row, t in enumerate(texts) for k in range(len(t) - length + 1)]


def test_merge_orders_suffixes_as_sorting_them_would():
    rng = np.random.default_rng(4)
    parts = [rng.integers(1, 4, n).astype(np.uint16) for n in (30, 50, 20)]
    depth = 8
    orders, transforms = zip(*(suffix_dedup.shard_transform(p, depth) for p in parts))
    shard, prefix, block = suffix_dedup.merge_transforms(list(transforms), depth)
    at = [iter(o) for o in orders]
    strings = []
    for s in shard:
        p, i = parts[s], int(next(at[s]))
        strings.append(tuple(np.resize(np.roll(p, -i), depth)))
    assert strings == sorted(strings)
    for k in range(1, len(strings)):
        same = next((j for j in range(depth) if strings[k][j] != strings[k - 1][j]), depth)
        assert prefix[k] == same and (block[k] == block[k - 1]) == (same == depth)


def test_no_rows_no_repeats(spark):
    assert suffix_dedup.remove_repeats(docs_of(spark, [(1, "a")]).limit(0)).collect() == []


# neighbours ------------------------------------------------------------------------------------------------------------


def vectors(spark, x, ids=None, more=()):
    rows = [(int(i), [float(v) for v in r], 1, "x") for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows + list(more), "vec_id long, embedding array<float>, label int, leaf string")


def plain_nearest(x, ids, queries, k):
    x = x.astype(np.float32).astype(np.float64)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in queries:
        s = x @ x[q] / (n * n[q])
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
        out[int(ids[q])] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 16)).repeat(75, 0) + rng.normal(size=(3000, 16)) * 0.6
    got = {}
    for r in neighbours.search(vectors(spark, x), F.col("vec_id") % 50 == 0, leaf=64).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    truth = plain_nearest(x, np.arange(3000), range(0, 3000, 50), 5)
    assert got.keys() == truth.keys() and all(len(v) == 5 for v in got.values())
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert found >= 0.9 * 5 * len(truth)
    for q, rows in got.items():
        assert [s for _, s in rows] == sorted((s for _, s in rows), reverse=True)
        exact = dict(plain_nearest(x, np.arange(3000), [q], 2999)[q])
        assert all(abs(exact[i] - s) < 1e-9 for i, s in rows)


def test_ties_copies_and_unusable_vectors(spark):
    x = np.array([[1.0, 0]] * 9 + [[0, 1.0], [1.0, 1.0]])
    bad = [(100, None, 1, "x"), (150, [0.0, 0.0], 1, "x"), (200, [None, 1.0], 1, "x"), (250, [float("nan"), 1.0], 1, "x"), (300, [1.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), (3, [1.0, 0.0], 1, "x")]
    out = neighbours.search(vectors(spark, x, more=bad), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in out] == [(0, k, k) for k in range(1, 6)]
    few = neighbours.search(vectors(spark, x[7:10], ids=[0, 1, 2]), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, round(r.score, 6)) for r in few] == [(1, 1.0), (2, 0.0)]


def test_copies_of_a_query_are_ties_with_its_multiples(spark):
    """Each query has three doubles under smaller ids and three copies under larger ones: all have one cosine."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for q in range(40):
        x = rng.standard_normal(64).astype(np.float32)
        base = 1000 * q
        rows += [(base + k, (x * np.float32(2)).tolist()) for k in (190, 191, 192)] + [(base + 200, x.tolist())] + [(base + k, x.tolist()) for k in (201, 202, 203)]
        want[base + 200] = [base + k for k in (190, 191, 192, 201, 202)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 1000 == 200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == want


def test_parallel_vectors_are_ties(spark, monkeypatch):
    rng = np.random.default_rng(6)
    one, ids = rng.normal(size=8).astype(np.float32), rng.permutation(100)
    x = np.array([one * np.float32(2.0) ** int(e) for e in rng.permutation(100) - 50])
    for pairs in (1 << 21, 64):
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        q, near, score = neighbours.best(x[:3], ids, x, 5)
        assert q.tolist() == [0] * 5 + [1] * 5 + [2] * 5 and near.tolist() == [0, 1, 2, 3, 4] * 3 and len(set(score)) == 1
    monkeypatch.undo()
    out = neighbours.search(vectors(spark, x, ids), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in out] == [(0, k) for k in range(1, 6)] + [(50, k) for k in range(5)]


def test_no_vectors(spark):
    none = vectors(spark, np.zeros((0, 2)))
    assert neighbours.search(none, F.col("vec_id") % 50 == 0).collect() == []
    assert neighbours.search(vectors(spark, np.ones((3, 2)), ids=[1, 2, 3]), F.col("vec_id") % 50 == 0).collect() == []


def test_the_queue_opens_every_leaf_once():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    forest = [neighbours.grow(x, 3, rng) for _ in range(3)]
    way = neighbours.opened(forest, x[0], 1000)
    assert len(way) == len(set(way)) == 3 * 8
    assert {(t, int(neighbours.leaves(tree, x[:1])[0])) for t, tree in enumerate(forest)} <= set(way[:6])
