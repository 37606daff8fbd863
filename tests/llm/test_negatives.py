"""Hard negatives against brute force on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import negatives

VECTORS = "vec_id long, label int, embedding array<float>, id long, part int, block string, vector string, scores int, n int"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, label, x, 1, 2, "b", "v", 3, 4) for i, label, x in rows], VECTORS)


def plain(rows, every):
    fine = [(i, label, x) for i, label, x in rows if i is not None and label is not None and x and all(v is not None and np.isfinite(v) for v in x)]
    lengths = [len(x) for *_, x in fine]
    dim = max(set(lengths), key=lambda n: (lengths.count(n), n), default=0)
    fine = sorted({(i, label, tuple(int(np.floor(256 * float(np.float32(v)))) for v in x)) for i, label, x in fine if len(x) == dim})
    out = []
    for a in fine:
        if a[0] % every:
            continue
        by = sorted(((-sum(p * q for p, q in zip(a[2], b[2], strict=True)), b[0], b) for b in fine if b != a), key=lambda t: t[:2])
        for ps, pid, _ in [t for t in by if t[2][1] == a[1]][:5]:
            good = [t for t in by if t[2][1] != a[1] and 50 * -ps <= 100 * -t[0] <= 95 * -ps][:3]
            out += [(a[0], pid, k + 1, t[1], -ps, -t[0]) for k, t in enumerate(good)]
    return sorted(out)


def mined(spark, rows, every=3, **kw):
    return sorted(tuple(r) for r in negatives.mine(vectors_of(spark, rows), F.col("vec_id") % every == 0, **kw).collect())


@pytest.mark.parametrize(("seed", "dim", "spread"), [(0, 8, 1.0), (1, 5, 0.02), (2, 1, 0.3), (3, 16, 40.0)])
def test_as_brute_force(spark, seed, dim, spread):
    """Small spreads give many ties; seven of ten rows share a label, and a third of them their vector."""
    rng = np.random.default_rng(seed)
    x = (rng.standard_normal((150, dim)) * spread).astype(np.float32)
    x[rng.random(150) < 0.3] = x[0]
    labels = np.where(rng.random(150) < 0.7, 0, rng.integers(1, 4, 150))
    rows = [(int(i), int(label), v.tolist()) for i, label, v in zip(rng.permutation(150) * 2 - 30, labels, x, strict=True)]
    want = plain(rows, 3)
    assert len(want) > 50
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=16, sample=32) == want


def test_odd_rows(spark):
    rows = [(i, i % 2, [1.0, 0.1 * i]) for i in range(12)]
    odd = [(None, 0, [1.0, 1.0]), (12, None, [1.0, 1.0]), (15, 0, None), (18, 0, []), (21, 1, [1.0, None]), (24, 1, [float("nan"), 1.0]), (27, 0, [float("inf"), 1.0]), (30, 0, [1.0, 1.0, 1.0]), rows[0], rows[3]]
    assert mined(spark, rows + odd) == plain(rows, 3)
    other = [(3, 0, [1.0, 0.9]), (3, 1, [1.0, 0.8])]  # the id of another row: rows of their own
    assert mined(spark, rows + other) == plain(rows + other, 3)
    assert mined(spark, rows[:1]) == []
    assert mined(spark, []) == []
    assert mined(spark, [(3, 0, None)]) == []
    great = (33, 0, [1e30, 1.0])  # its scores do not fit 64 bits
    assert mined(spark, [*rows, great]) == plain(rows, 3)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.standard_normal((2000, 33))).astype(np.int64)
    cells = negatives.Cells(x[:500], x.min(0), x.max(0))
    q = x[:4]
    near = cells.of(x)
    for i, table in enumerate(cells.tables(q)):
        low, high = cells.bounds(table, near)
        s = x @ q[i]
        assert (low <= s).all() and (s <= high).all()
        asked = []
        rows, best = negatives.nearest(low, high, lambda r, s=s: asked.append(len(r)) or s[r], np.arange(2000), 6)
        assert sorted(best.tolist(), reverse=True) == sorted(s.tolist(), reverse=True)[:6]
        assert asked[0] < 600  # of 2000 rows
        assert s[rows].tolist() == best.tolist()


def test_window_is_exact():
    for s in range(-200, 200):
        least, most = negatives.window(s)
        assert [n for n in range(-400, 400) if 50 * s <= 100 * n <= 95 * s] == list(range(least, most + 1))
