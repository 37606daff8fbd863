"""The trie of conversations against plain dictionaries."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewatch.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, conv long, node string, depth int, words string, shard int"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", 2, "w", 3) for r in rows], TURNS)


def plain(rows, heads, every):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    own = {c: [(r, t) for *_, r, _, t in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2], x[3]))] for c, v in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, every))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * words
    key = lambda x: tuple(map(str, x))
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items()), key=key)


def built(spark, rows, **kw):
    return sorted((tuple(r) for r in prefix_trie.conversation_trie(turns_of(spark, rows), **kw).collect()), key=lambda x: tuple(map(str, x)))


def chats(rng, n, hot=0.3):
    """Conversations over few texts, so that many prefixes are shared; some are the same one over and over."""
    common, rows = [("user", "a b"), ("assistant", "c d  e"), ("user", "f")], []
    for c in rng.choice(4 * n, n, replace=False).tolist():
        turns = common if rng.random() < hot else [(str(rng.choice(["user", "assistant", ""])), " ".join(rng.choice(list("xyz"), int(rng.integers(0, 4))))) for _ in range(int(rng.integers(1, 7)))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    return rows


@pytest.mark.parametrize(("members", "parts"), [(1024, 1 << 14), (1, 1 << 14), (7, 1 << 14), (0, 10)])
def test_as_dictionaries(spark, members, parts):
    """With no heavy node but the root, with all shared ones heavy, and with some."""
    rng = np.random.default_rng(members)
    rows = chats(rng, 150)
    rng.shuffle(rows)
    rows = [(int(c), int(i), str(r), str(t)) for c, i, r, t in rows]
    assert built(spark, rows, heads=4, members=members, parts=parts) == plain(rows, 4, 20)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"),
        (1, None, "user", "first"), (1, 0, None, None), (1, 0, "", "\x0b \t"), (1, 0, "", "\x0b \t"),
        (2, 0, None, ""), (3, 0, "", None), (-41, 0, "user", "negative"), (-40, 0, "user", "base"), (-40, 1, "user", "of negative"),
        (7, 5, "user", "w " * 200_000), (20, 0, "user", "x"), (27, 0, "user", "own"),
    ]
    for heads in (1, 2, 4, 9):
        assert built(spark, rows, heads=heads) == plain(rows, heads, 20)
    assert built(spark, []) == []
    assert built(spark, [(None, 1, "user", "x")]) == []


def test_a_long_conversation_and_many_ends(spark):
    rows = [(5, i, "user", f"t{i % 3}") for i in range(150)] + [(c, 0, "user", "t0") for c in range(100, 9000, 2)]
    assert built(spark, rows, members=50) == plain(rows, 1, 20)


def test_louds():
    rng = np.random.default_rng(0)
    names = [bytes([0xFF, *rng.integers(1, 255, 15).tolist()]) for _ in range(300)]
    up = [-1, -1] + [int(rng.integers(0, i)) for i in range(2, 300)]
    depth = []
    for p in up:
        depth.append(3 if p < 0 else depth[p] + 1)
    shuffled = rng.permutation(300)
    array = lambda x: np.array(x, "S16")
    t = prefix_trie.Louds(np.array(depth)[shuffled], array(names)[shuffled], array([names[p] if p >= 0 else b"none" for p in up])[shuffled])
    who = shuffled[t.rows]
    assert [int(who[p]) if p >= 0 else -1 for p in t.up] == [up[k] for k in who]
    ones = np.split(t.bits, np.flatnonzero(~t.bits) + 1)[:-1]
    assert [len(x) - 1 for x in ones] == t.children.tolist() == [up.count(int(k)) for k in who]
    # the children of node k are the nodes of the k-th run of ones
    nodes = np.cumsum(t.children) - t.children + 2
    for k in range(300):
        assert {up[j] for j in who[nodes[k] : nodes[k] + t.children[k]]} <= {who[k]}
    (size,) = t.rolled(np.ones(300, np.int64))
    want = np.ones(300, np.int64)
    for i in range(299, 1, -1):
        want[up[i]] += want[i]
    assert size.tolist() == want[who].tolist()
