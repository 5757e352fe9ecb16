"""Bit-sliced search against plain sums."""

import numpy as np
import pytest

from pitlane.llm import bit_sliced


def brute(rows, queries, k):
    def v(x):
        ok = x is not None and all(c is not None and np.isfinite(c) for c in x)
        return [int(np.floor(256.0 * c)) for c in x] if ok else None
    out = []
    for q, x in queries:
        if q is None or v(x) is None:
            continue
        scored = [(-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v(x), v(y))))), i) for i, y in rows if i is not None and i != q and v(y) is not None and len(y) == len(x)]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_block_search(seed):
    r = np.random.default_rng(seed)
    n, d = int(r.integers(1, 700)), int(r.integers(1, 9))
    values = r.integers(-300, 300, (n, d)) if seed % 2 else r.integers(-1, 2, (n, d))
    ids = r.permutation(2 * n)[:n]
    index = bit_sliced.BlockIndex.build(ids, values)
    for j in range(min(n, 10)):
        want = sorted(((int(i), int(s)) for i, s in zip(ids, values @ values[j]) if i != ids[j]), key=lambda x: (-x[1], x[0]))[:5]
        assert bit_sliced.best_of_block(index, int(ids[j]), values[j], 5) == want


def test_search_with_odd_rows(spark, monkeypatch):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.normal(size=4)]) for i in range(120)]
    rows += [(200, [0.5, 0.5, 0.5, 0.5])] * 3 + [(201, None), (None, [1.0, 0.0, 0.0, 0.0]), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4),
             (204, [float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0]), (206, []), (207, []), (350, []), (250, [0.0] * 4), (300, [3.0, -3.0]),
             (100, [0.1, 0.9, -0.5, 0.0]), (100, [0.0, -0.2, 0.5, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, score double, ids string").repartition(3)
    monkeypatch.setattr(bit_sliced, "ROWS_PER_BLOCK", 50)
    monkeypatch.setattr(bit_sliced, "QUERIES_PER_PART", 2)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries = df.where("vec_id % 50 = 0")
    got = sorted(map(tuple, bit_sliced.search(df, queries, 5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute(f32, [(i, v) for i, v in f32 if i is not None and i % 50 == 0], 5)


def test_components_of_any_size(spark):
    """Whole scores beyond doubles and beyond 64 bits, in the same block as small ones."""
    rows = [(i, [s * 10.0**e, -1.0, float(i)]) for i, (s, e) in enumerate((s, e) for e in (0, 4, 9, 14, 19, 40, 150) for s in (1, -1, 3))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(map(tuple, bit_sliced.search(df, df.where("vec_id % 2 = 0"), 4).collect()))
    assert got == brute(rows, [r for r in rows if r[0] % 2 == 0], 4)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert bit_sliced.search(none, none, 5).count() == 0
