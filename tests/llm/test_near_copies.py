"""Min-max near copies against brute force on small tables."""

from __future__ import annotations

import re

import numpy as np
import pytest

from tidewatch.llm import near_copies

DOCS = "doc_id long, text string, key string, root string, comp int, bucket string, members string, text_key string, kept int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "k", "r", 1, "b", "m", "t", 2) for i, t in rows], DOCS)


def plain(rows, words=3, share=85):
    sets = []
    for _, t in rows:
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)), doc is not None and doc == least[find(i)]) for i, (doc, _) in enumerate(rows)), key=str)


def result(spark, rows, **kw):
    return sorted((tuple(r) for r in near_copies.near_copies(docs_of(spark, rows), **kw).collect()), key=str)


def corpus(rng, groups, size):
    """Groups of texts near each other: some are one edit from the first, some drift from copy to copy, so that links
    join texts that are not near, and some lie about the threshold."""
    words = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(groups):
        base = list(rng.choice(words, int(rng.integers(1, 150))))
        text = list(base)
        for _ in range(int(rng.integers(1, size))):
            text = list(text if g % 2 else base)
            for _ in range(int(rng.integers(0, 5))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(words))
            texts.append(" ".join(text))
            if rng.random() < 0.3:
                texts.append(" ".join(text).upper())
    order = rng.permutation(len(texts))
    return [(int(i) * 3, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("groups", "size", "block"), [(30, 8, 512), (4, 60, 512), (4, 60, 6), (2, 80, 3)])
def test_as_brute_force(spark, groups, size, block):
    """Large groups in one block, and cut into many, where links are found in rounds and between blocks."""
    rows = corpus(np.random.default_rng(groups * size + block), groups, size)
    assert result(spark, rows, block=block) == plain(rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\x0b"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (7, "one two three"), (None, "One two Three"), (None, "alone here now"), (9, long), (8, long + " end"), (10, "É one two"), (11, "é one two"), (12, "one two\x85three"), (-5, "a b c")]
    assert result(spark, rows) == plain(rows)
    assert result(spark, []) == []
    assert result(spark, [(1, None)]) == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        near_copies.near_copies(docs_of(spark, rows), share=50)


def test_least_and_greatest_agree_as_the_sets_do():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85):
        hits = []
        for _ in range(60):
            pool = rng.integers(0, 1 << 63, 400, np.uint64)
            n = int(400 * share)
            rest = (400 - n) // 2
            a, b = np.r_[pool[:n], pool[n : n + rest]], np.r_[pool[:n], pool[n + rest :]]
            hits.append((near_copies.min_max(a) == near_copies.min_max(b)).mean())
        assert abs(np.mean(hits) - share) < 0.02
        assert np.std(hits) < (share * (1 - share) / near_copies.VALUES) ** 0.5 * 1.3
