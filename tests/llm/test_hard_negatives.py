"""Hard negatives against plain scores; intervals; rows that ask for care."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x int, block long"


def plain(rows, positives=5, negatives=10, low=30, high=90, every=100):
    v = [(i, [math.floor(256 * x) for x in e], y) for i, e, y in rows
         if i is not None and e is not None and y is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, e, y in v:
        if i % every:
            continue
        s = [(max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(e, f)))), j, z) for j, f, z in v if j != i and len(f) == len(e)]
        near = sorted((-t, j) for t, j, z in s if z == y)[:positives]
        for p, pj in near:
            far = sorted((-t, j) for t, j, z in s if z != y and low * -p <= 100 * t <= high * -p)[:negatives]
            out += [(i, pj, rank, j, -p, -t) for rank, (t, j) in enumerate(far, 1)]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA)


def mined(spark, rows, **how):
    every = how.pop("every", 100)
    return Counter(map(tuple, H.mine(frame(spark, rows).repartition(4), F.col("vec_id") % every == 0, **how).collect()))


def vectors(n, dims, seed, spread=0.5):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((6, dims))
    x = centres[r.integers(6, size=n)] * spread + r.standard_normal((n, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(np.float32(c)) for c in row], int(y)) for i, (row, y) in enumerate(zip(x, r.integers(4, size=n)))]


def test_small_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(H, "ANCHORS_PER_PART", 7)
    rows = vectors(700, 48, 1)
    want = plain(rows, every=20)
    assert want and mined(spark, rows, every=20) == want
    assert mined(spark, rows, every=20, positives=2, negatives=3, low=50, high=100) == plain(rows, 2, 3, 50, 100, 20)


def test_odd_rows(spark):
    rows = vectors(150, 5, 2)
    rows += [(200, [0.1] * 5, None), (300, None, 1), (400, [0.1, None, 0.2, 0.3, 0.4], 1), (500, [math.nan] * 5, 1), (600, [math.inf] + [0.0] * 4, 1),
             (None, [0.5] * 5, 1), (700, [], 1), (701, [], 1), (702, [], 2), (800, [0.5], 1), (801, [0.4], 1), (802, [0.3], 2), (803, [-0.3], 2),
             (900, [0.0] * 5, 1), (901, [0.0] * 5, 1), (902, [0.0] * 5, 2), *[(100, [0.3] * 5, 1)] * 2, *[(17, [0.2] * 5, 0)] * 3, *[(i, [0.25] * 5, 3) for i in range(1000, 1040)]]
    assert mined(spark, rows) == plain(rows)


def test_large_components(spark):
    """Scores beyond doubles, and beyond 64 bits, are exact or count as the nearest 64-bit number."""
    rows = [(i, [float(np.float32(s * 10.0**e)), 1.0, float(i)], i % 3) for i, (s, e) in enumerate((s, e) for e in (0, 6, 9, 14, 20, 30, 37) for s in (1, -1, 3, 2))]
    assert mined(spark, rows, every=4) == plain(rows, every=4)


def test_few_rows_and_empty_tables(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(100, [1.0], 1)])
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.5], 2)]) == Counter([(0, 1, 1, 2, 65536, 32768)])


@pytest.mark.parametrize("dims", [1, 3, 64, 100, 300])
def test_intervals_hold_the_scores(dims):
    r = np.random.default_rng(dims)
    v = np.floor(256 * r.standard_normal((300, dims)) / math.sqrt(dims))
    v[0], v[1] = 0, 10**6
    codes = H.Codes.of(v)
    for q in (v[5], v[0], v[1], -v[7]):
        lower, upper = codes.intervals(H.Asked(q), slice(None))
        assert (lower <= v @ q).all() and (v @ q <= upper).all()


def test_intervals_leave_most_rows_out():
    """The bounds are worth their while: few of the other rows can reach a near neighbour's score."""
    v = np.floor(256 * np.array([e for _, e, _ in vectors(3000, 64, 3)]))
    lower, upper = H.Codes.of(v).intervals(H.Asked(v[0]), slice(1, None))
    assert (upper >= np.sort(v[1:] @ v[0])[-5]).mean() < 0.25
