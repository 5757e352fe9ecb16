"""The model solvers against plain versions: forest, exact tree, batched k-means, margin machines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlane.plans import cart, forest, lloyd, margins


def plain_tree(x, y, w, rows):
    if y[rows].max() == y[rows].min():
        return float(np.average(y[rows], weights=w[rows]))
    best = None
    for f in range(x.shape[1]):
        u = np.unique(x[rows, f])
        for a, b in zip(u, u[1:]):
            left = x[rows, f] <= a
            gain = sum((w[rows][s] * y[rows][s]).sum() ** 2 / w[rows][s].sum() for s in (left, ~left))
            if best is None or gain > best[0] + 1e-10 * abs(best[0]):
                best = (gain, f, (np.float32(a) + np.float32(b)) / 2)
    if best is None:
        return float(np.average(y[rows], weights=w[rows]))
    left = x[rows, best[1]] <= best[2]
    return best[1], best[2], plain_tree(x, y, w, rows[left]), plain_tree(x, y, w, rows[~left])


def plain_predict(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("seed,values", [(0, 9), (1, 3), (2, 1000)])
def test_subtree_equals_plain_growth(seed, values):
    r = np.random.default_rng(seed)
    x, w = r.integers(0, values, (110, 3)).astype(np.float32), r.integers(1, 4, 110).astype(float)
    y = r.standard_normal(110)
    y -= np.average(y, weights=w)
    want, got = plain_tree(x, y, w, np.arange(110)), forest.grow(x, y, w)
    z = r.uniform(0, values, (400, 3)).astype(np.float32)
    assert np.allclose(forest.descend(got, z), [plain_predict(want, row) for row in z])
    assert forest.grow(x, y, w, 2)["depth"] <= 2


def laps_like(spark, n, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 3)).round(3)
    y = np.where(x[:, 0] > 0, 2.0, -1.0) + np.abs(x[:, 1]) + 0.1 * r.standard_normal(n)
    return spark.createDataFrame([(f"k{i}", *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))], "row_key string, a double, b double, c double, y double")


def test_forest_of_all_rows(spark):
    """Trees end in pure leaves: a row that a tree has drawn gets its own target from it."""
    df, names = laps_like(spark, 1500), ["a", "b", "c"]
    cols = [F.col(c) for c in names]
    f = forest.fit_forest(df, names, cols, "y", trees=12)
    keys = np.array([r[0] for r in df.select(F.xxhash64("row_key")).collect()])
    rows = df.collect()
    x, y = np.array([[r[c] for c in names] for r in rows], np.float32), np.array([r["y"] for r in rows])
    trees = {r["tree"]: forest.opened(r.asDict()) for r in f.subtrees.collect()}
    for t, tree in trees.items():
        drawn = forest.bootstrap(keys, t, 42) > 0
        assert 0.55 < drawn.mean() < 0.71
        assert np.allclose(forest.descend(tree, x)[drawn], y[drawn])
    scored = {r["row_key"]: r["p"] for r in f.predict(df, cols, "p").collect()}
    mean = np.mean([forest.descend(t, x) for t in trees.values()], axis=0)
    assert np.allclose([scored[r["row_key"]] for r in rows], mean)
    nodes = f.nodes()
    assert nodes.count() == f.n_nodes and nodes.where("feature is null").count() * 2 == f.n_nodes + 12


def test_large_nodes_are_split_by_histograms(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(forest, "NODE_ROWS", 400)
    df, names = laps_like(spark, 1500), ["a", "b", "c"]
    cols = [F.col(c) for c in names]
    f = forest.fit_forest(df.repartition(5), names, cols, "y", trees=4)
    assert f.levels and f.subtrees.count() > 8
    err = f.predict(df, cols, "p").agg(F.avg((F.col("p") - F.col("y")) ** 2)).first()[0]
    assert err < 0.05 and f.depth > 5
    f.save(str(tmp_path))
    again = forest.Forest.load(spark, str(tmp_path)).predict(df, cols, "p")
    assert {r["row_key"]: r["p"] for r in again.collect()} == pytest.approx({r["row_key"]: r["p"] for r in f.predict(df, cols, "p").collect()})


def test_forest_odd_tables(spark):
    one = spark.createDataFrame([("k", 1.0, 2.0)] * 40, "row_key string, a double, y double")
    f = forest.fit_forest(one, ["a"], [F.col("a")], "y", trees=30)
    assert f.depth == 0 and {r["p"] for r in f.predict(one, [F.col("a")], "p").collect()} <= {2.0, 2.0 * f.subtrees.count() / 30}


def test_tree_equals_plain_cart(spark):
    """Exact thresholds on a tie-free table, whatever the partitions are."""
    r = np.random.default_rng(4)
    x = r.permutation(900).reshape(300, 3) + r.uniform(0, 0.5, (300, 3)).round(4)
    label = np.where(x[:, 0] > 500, "B", np.where(x[:, 1] + 0.3 * x[:, 2] > 600, "C", "A"))
    label[::17] = "A"
    df = spark.createDataFrame([(*map(float, row), str(t)) for row, t in zip(x, label)], "a double, b double, c double, t string").repartition(7)
    got = cart.fit_cart(df, ["a", "b", "c"], "t", 4)

    def gini(rows):
        return 1 - sum((np.mean(label[rows] == k)) ** 2 for k in "ABC")

    def grow(rows, node, depth):
        counts = [int((label[rows] == k).sum()) for k in "ABC"]
        assert got.nodes[node].counts == counts
        best = None
        if depth < 4 and sum(c > 0 for c in counts) > 1:
            for f in range(3):
                u = np.sort(x[rows, f])
                for a, b in zip(u, u[1:]):
                    left = x[rows, f] <= a
                    g = (left.sum() * gini(rows[left]) + (~left).sum() * gini(rows[~left])) / len(rows)
                    if best is None or g < best[0] - 1e-12:
                        best = (g, f, a / 2 + b / 2)
        if best is None:
            assert got.nodes[node].feature is None
            return
        assert (got.nodes[node].feature, got.nodes[node].threshold) == (best[1], pytest.approx(best[2]))
        assert got.nodes[node].gain == pytest.approx(gini(rows) - best[0])
        left = x[rows, best[1]] <= best[2]
        grow(rows[left], 2 * node, depth + 1)
        grow(rows[~left], 2 * node + 1, depth + 1)

    grow(np.arange(300), 1, 0)
    out = df.withColumn("o", got.outcome())
    assert out.where("o.prediction = t").count() / 300 > 0.85
    assert cart.Cart.from_dict(got.to_dict()).rows() == got.rows() == [tuple(r) for r in got.table(spark).orderBy("id").collect()]


def test_all_fits_share_their_passes(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(c, 0.3, (80, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame([(f"k{i}", row.tolist()) for i, row in enumerate(x)], "row_key string, x array<double>")
    df = df.select("row_key", array_to_vector("x").alias("features"))
    passes, real = [], lloyd.one_pass
    monkeypatch.setattr(lloyd, "one_pass", lambda *a: passes.append(len(a[1])) or real(*a))
    begun = lloyd.drawn(df, [2, 3, 4], 5, 42)
    fits = lloyd.fit_all(df, begun, 100)
    assert len(fits) == 15 and passes[0] == 15 and len(passes) < 40
    for f, start in zip(fits, begun):
        c = start.centres
        for _ in range(f.iterations):
            own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[own == k].mean(0) if (own == k).any() else c[k] for k in range(f.k)])
        assert np.allclose(c, f.centres) and f.cost == pytest.approx(((x[:, None] - c[None]) ** 2).sum(2).min(1).sum())
    best = lloyd.best_of(fits)
    assert best[3].cost < 0.2 * best[2].cost and best[4].cost <= best[3].cost


def two_classes(n, seed=6):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 2))
    y = np.where(x[:, 0] ** 2 + x[:, 1] ** 2 + 0.4 * r.standard_normal(n) > 1.8, 1.0, -1.0)
    w = np.where(y > 0, n / 2 / (y > 0).sum(), n / 2 / (y < 0).sum())
    return x, y, w, np.arange(n) % 3


def rows_of(spark, x, y, w, fold):
    return spark.createDataFrame([(a.tolist(), float(b), float(c), int(d)) for a, b, c, d in zip(x, y, w, fold)], "x array<double>, y double, weight double, fold int")


def test_cascade_equals_one_dense_solution(spark, monkeypatch):
    monkeypatch.setattr(margins, "GROUP_ROWS", 120)
    x, y, w, fold = two_classes(500)
    fits = margins.fit_cascade(rows_of(spark, x, y, w, fold), [0, 1, 2], 0.5)
    for f, m in fits.items():
        on = fold != f
        alpha, bias = margins.solve_dual(x[on], y[on], w[on], 0.5, np.zeros(on.sum()))
        dense = margins.rbf(x, x[on], 0.5) @ (alpha * y[on]) + bias
        k = margins.rbf(m.x, m.x, 0.5)
        value = np.abs(m.coef).sum() - 0.5 * m.coef @ k @ m.coef
        kd = margins.rbf(x[on], x[on], 0.5)
        assert value == pytest.approx(alpha.sum() - 0.5 * (alpha * y[on]) @ kd @ (alpha * y[on]), rel=1e-3)
        assert np.abs(m.margins(x) - dense).max() < 0.05
        assert ((m.margins(x) > 0) == (y > 0)).mean() > 0.85
    again = margins.SupportVectors.from_dict(fits[-1].to_dict())
    df = rows_of(spark, x, y, w, fold).union(spark.createDataFrame([(None, 1.0, 1.0, 0)], "x array<double>, y double, weight double, fold int"))
    got = [r[0] for r in df.select(again.column(F.col("x"))).collect()]
    assert np.allclose(got[:-1], fits[-1].margins(x)) and got[-1] is None


def test_primal_machine_is_optimal(spark):
    """No small change of the weights lowers the hinge loss by more than the smoothing allows, for every fit."""
    x, y, w, fold = two_classes(400)
    x = np.concatenate([x, x[:, :1] ** 2, x[:, 1:] ** 2], 1)
    fits = margins.fit_newton(rows_of(spark, x, y, w, fold), 4, [0, 1, 2])

    def loss(beta, on):
        return 0.5 * beta[:-1] @ beta[:-1] + (w * np.maximum(0, 1 - y * (x @ beta[:-1] + beta[-1])))[on].sum()

    r = np.random.default_rng(7)
    for f, beta in fits.items():
        on, here = fold != f, loss(beta, fold != f)
        assert all(loss(beta + size * r.standard_normal(5), on) > here - 1e-3 * here for size in (1e-3, 1e-2, 0.1) for _ in range(50))


@pytest.mark.parametrize("local_rows", [1 << 15, 0])
def test_large_machine_equals_the_dual_solution(spark, monkeypatch, local_rows):
    """beyond a cascade's rows the kernel machine is that of all rows too, whatever rows the first guess has seen."""
    monkeypatch.setattr(margins, "START_ROWS", 400)
    monkeypatch.setattr(margins, "LOCAL_ROWS", local_rows)
    if not local_rows:
        monkeypatch.setattr(margins, "NEAR_WIDTHS", margins.WIDTHS[4:6])
        monkeypatch.setattr(margins, "LAST_WIDTHS", margins.WIDTHS[5:6])
    x, y, w, fold = two_classes(900)
    x[:5] += 40  # far from all others: only the check of every row can find them
    rows = rows_of(spark, x, y, w, fold)
    span = margins.span_rows(rows, rows.where("x[0] < 20").limit(30), 0.5)
    assert span.residuals(x).max() <= margins.SPANNED and len(span.pivots) < 500
    fits = margins.fit_large(rows, [0, 1, 2], 0.5)
    for f, m in fits.items():
        on = fold != f
        alpha, bias = margins.solve_dual(x[on], y[on], w[on], 0.5, np.zeros(on.sum()))
        dense = margins.rbf(x, x[on], 0.5) @ (alpha * y[on]) + bias
        kd = margins.rbf(x[on], x[on], 0.5)
        loss = 0.5 * m.coef @ margins.rbf(m.x, m.x, 0.5) @ m.coef + (w * np.maximum(0, 1 - y * m.margins(x)))[on].sum()
        assert loss == pytest.approx(alpha.sum() - 0.5 * (alpha * y[on]) @ kd @ (alpha * y[on]), rel=5e-3)
        assert np.abs(m.margins(x) - dense).max() < 0.1
    assert fits[-1].support_rows() >= (y * fits[-1].margins(x) < 1 - 1e-6).sum()


def test_large_linear_machine_is_optimal(spark, monkeypatch):
    """the same for the linear machine, beside the passes over all rows of fit_newton."""
    monkeypatch.setattr(margins, "START_ROWS", 60)
    x, y, w, fold = two_classes(900)
    x = np.concatenate([x, x[:, :1] ** 2, x[:, 1:] ** 2], 1)
    rows = rows_of(spark, x, y, w, fold)
    got, plain = margins.fit_large(rows, [0, 1, 2], None), margins.fit_newton(rows, 4, [0, 1, 2])
    for f, beta in got.items():
        on = fold != f
        loss = [0.5 * b[:-1] @ b[:-1] + (w * np.maximum(0, 1 - y * (x @ b[:-1] + b[-1])))[on].sum() for b in (beta, plain[f])]
        assert loss[0] == pytest.approx(loss[1], rel=1e-3)


def test_training_takes_all_rows(spark, sf_small, monkeypatch):
    """no sample, however few rows a cascade takes."""
    from pitlane import schemas as S
    from pitlane.plans import safety
    from pitlane.plans.catalog import prepared
    monkeypatch.setattr(safety, "DENSE_ROWS", 100)
    seen = []
    whole = safety.fit_large
    monkeypatch.setattr(safety, "fit_large", lambda rows, *a: seen.append(rows.count()) or whole(rows, *a))
    m = safety.train_safety(prepared(spark, sf_small)).metrics
    assert seen == [m["n_train"]] * 2 and m["n_train"] == m["n_total"] - m["n_test"] > 100
    assert m["kernels"]["rbf"]["recall"] >= 0.8 and S.SAFETY_TARGET == m["target"]


def test_query_training_has_no_cap(spark, sf_small, monkeypatch):
    """the queries' training run passes no cap on."""
    from pitlane.plans import train_all
    from pitlane.plans.catalog import laps, prepared

    class Stop(Exception):
        pass

    def train(rows, cap=None, **more):
        raise Stop(cap)

    monkeypatch.setattr(train_all, "train_safety", train)
    with pytest.raises(Stop) as stop:
        train_all.run_training(laps(spark, sf_small), which=("safety",), prepared=prepared(spark, sf_small))
    assert stop.value.args == (None,)


def test_platt_is_finite_and_rises(spark):
    rows = spark.createDataFrame([(float(m), int(m > 0)) for m in np.linspace(-3, 3, 40)], "margin double, label int")
    p = margins.fit_platt(rows)
    assert 0 < p.a < 50 and abs(p.b) < 1
    assert margins.fit_platt(rows.where("label = 1")) is None
