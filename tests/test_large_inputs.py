"""What keeps the lap queries within their limits on large tables: rows shuffled once, little written, few rows compared."""

import re
import tracemalloc

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from pitlane.operators import dims, sampling as SM
from pitlane.plans import lloyd
from pitlane.plans.margins import SupportVectors, rbf


def test_lineitem_is_joined_last(spark, sf_small, monkeypatch):
    """In large tables the small sides meet first, so that rows of lineitem are shuffled for one join only."""
    from pitlane.sources import laps as L
    small = L.laps_from_testdata(spark, sf_small)
    monkeypatch.setattr(L, "MANY_PARTS", 1)
    large = L.laps_from_testdata(spark, sf_small)
    assert large.count() > 0 and large.exceptAll(small).isEmpty() and small.exceptAll(large).isEmpty()
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" in re.search(r"Join Inner, (.*)", plan).group(1)


def test_parts_of_the_lap_join_hold_few_rows(spark, tmp_path, monkeypatch):
    """a part's rows are bounded too, since its sorts hold rows and files may compress to little."""
    from pitlane.sources import laps as L
    n, sf = spark.range(5000), str(tmp_path)
    n.selectExpr("id div 4 as l_orderkey", "id % 7 as l_partkey", "id % 5 as l_suppkey", "int(id % 4) as l_linenumber", "1D as l_quantity", "2D as l_extendedprice",
                 "0D as l_discount", "'A' as l_returnflag", "'F' as l_linestatus").write.parquet(f"{sf}/lineitem.parquet")
    n.where("id < 1250").selectExpr("id as o_orderkey", "id % 9 as o_custkey", "timestamp'2024-01-01' as o_orderdate").write.parquet(f"{sf}/orders.parquet")
    n.where("id < 9").selectExpr("id as c_custkey", "int(id % 3) as c_nationkey").write.parquet(f"{sf}/customer.parquet")
    n.where("id < 3").selectExpr("int(id) as n_nationkey", "concat('NATION_', id) as n_name").write.parquet(f"{sf}/nation.parquet")
    monkeypatch.setattr(L, "MANY_PARTS", 1)
    monkeypatch.setattr(L, "PART_ROWS", 300, raising=False)
    laps = L.laps_from_testdata(spark, sf)
    assert laps.count() == 5000
    parts = re.findall(r"RepartitionByExpression \[\w+_orderkey#\d+L?\], (\d+)", laps._jdf.queryExecution().optimizedPlan().toString())
    assert [int(p) for p in parts] == [17, 17]


def test_cleaned_laps_are_no_second_copy(spark, sf_small):
    """Of the cleaned laps only the trim's threshold is stored."""
    from pitlane.operators import clean as CL, stored
    from pitlane.plans.catalog import cleaned, laps
    rows = cleaned(spark, sf_small)
    assert "cleaned" not in {name for _, _, name in stored._TABLES}
    plain = CL.clean_rows(laps(spark, sf_small))
    assert rows.count() == plain.count() > 0 and rows.exceptAll(plain).isEmpty()


def test_selection_writes_hashes_without_keys(spark, monkeypatch):
    """the passes read the class and the hash; keys are read for the last hash only."""
    written, real = [], dims.materialize
    monkeypatch.setattr(dims, "materialize", lambda df: written.append(dict(df.dtypes)) or real(df))
    df = spark.createDataFrame([(f"k{i % 300}", i % 3 if i % 7 else None) for i in range(1000)], "row_key string, c int")
    rows = df.withColumn("h", SM.hash_rank()).collect()
    assert sorted(r["row_key"] for r in SM.hash_sample(df, 101).collect()) == sorted(r["row_key"] for r in sorted(rows, key=lambda r: (r["h"], r["row_key"]))[:101])
    test = {(r["row_key"], r["c"]) for r in SM.mark_stratified(df, "c").where("is_test").collect()}
    for c in (0, 1, 2, None):
        own = sorted((r["h"], r["row_key"]) for r in rows if r["c"] == c)
        last = own[int(np.ceil(0.2 * len(own))) - 1]
        assert {k for k, x in test if x == c} == {k for h, k in own if (h, k) <= last}
    assert written and all("_k" not in w and w["_h"] == "int" for w in written)


def _points(spark, n=20_000):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(n, 3)) * [1, 1, 0.2], np.zeros((n // 4, 3)), rng.normal(size=(20, 3)) * 50])
    return x, spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")


def test_packs_hold_every_row_and_give_the_same_pass(spark, monkeypatch):
    """A pass over packs is a pass over all rows, of which few are held against the centres."""
    monkeypatch.setattr(lloyd, "PACK_ROWS", 16)
    x, rows = _points(spark)
    packs = lloyd.pack(rows, x[::9])
    kept = np.concatenate([np.frombuffer(r["x"]).reshape(-1, 3) for r in packs.collect()])
    assert np.array_equal(kept[np.lexsort(kept.T)], x[np.lexsort(x.T)])
    assert max(r["n"] for r in packs.collect()) <= lloyd.PACK_MOST
    rng = np.random.default_rng(6)
    fits = {0: rng.normal(size=(2, 3)), 4: rng.normal(size=(8, 3)), 7: np.array([[1.0, 0, 0], [-1.0, 0, 0], [1.0, 0, 0]])}
    for f, (n, sums, cost) in lloyd.one_pass(rows, fits, 3).items():
        got = lloyd.one_pass(packs, fits, 3, True)[f]
        assert np.array_equal(got[0], n) and np.allclose(got[1], sums, atol=1e-8) and np.isclose(got[2], cost, rtol=1e-9)
    low, high, size = (np.array([r[c] for r in packs.collect()]) for c in ("low", "high", "n"))
    assert size[~lloyd.settled(low, high, fits[0])[1]].sum() < len(x) / 2


def test_a_packed_fit_reads_the_rows_for_its_packs_only(spark, monkeypatch):
    """neither a sample for the cuts nor the variance takes a pass of its own; the fits stay those of plain passes."""
    monkeypatch.setattr(lloyd, "PACK_ROWS", 16)
    x, rows = _points(spark)
    assert np.isclose(lloyd.mean_variance(lloyd.pack(rows, x[::9]), 3), x.var(0).mean(), rtol=1e-9)
    assert np.isclose(lloyd.mean_variance(lloyd.pack(spark.createDataFrame([((v + 1e6).tolist(),) for v in x], "x array<double>"), x[::9] + 1e6), 3), x.var(0).mean(), rtol=1e-6)
    data = rows.select(array_to_vector("x").alias("features"))
    begun = [lloyd.Fit(k, x[i:i + 40 * k:40]) for k in (2, 4) for i in (0, 7)]
    plain = lloyd.fit_all(data, begun, 30)
    monkeypatch.setattr(lloyd, "hash_sample", None)
    monkeypatch.setattr(F, "var_pop", None)
    for a, b in zip(plain, lloyd.fit_all(data, begun, 30, packed=True, points=x[::9])):
        assert a.iterations == b.iterations and np.allclose(a.centres, b.centres, atol=1e-8) and np.isclose(a.cost, b.cost, rtol=1e-9)


def test_margins_stay_in_small_squares():
    """rows meet the support vectors in squares of bounded size."""
    rng = np.random.default_rng(1)
    m = SupportVectors(rng.normal(size=(4000, 4)), rng.normal(size=4000), 0.3, 0.25)
    z = np.concatenate([rng.normal(size=(2000, 4)), m.x[:5], [[1e6, 0, 0, 0]]])
    tracemalloc.start()
    got = m.margins(z)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    assert np.allclose(got, rbf(z, m.x, m.gamma) @ m.coef + m.bias, atol=1e-9)


def test_scoring_queries_fit_their_own_family(spark, monkeypatch):
    """a query that scores with one family does not fit the others."""
    from pitlane.plans import model_queries as MQ, scoring
    asked = []
    monkeypatch.setattr(MQ, "family", lambda spark, sf, name: asked.append(name))
    monkeypatch.setattr(MQ, "scoring_context", lambda **runs: sorted(runs))
    monkeypatch.setattr(MQ, "laps", lambda spark, sf: None)
    for query, own in (("score_risk_class", "tree"), ("score_clusters", "clusters"), ("score_safety", "safety")):
        monkeypatch.setattr(scoring, query, lambda ctx, laps: ctx)
        asked.clear()
        assert getattr(MQ, f"q_{query}")(spark, f"/none/{query}") == [own] == asked


def test_families_are_fitted_side_by_side(spark, monkeypatch):
    """A query that scores with three families does not fit one after the other."""
    import threading
    from pitlane.plans import model_queries as MQ
    all_at_it = threading.Barrier(3, timeout=20)
    monkeypatch.setattr(MQ, "family", lambda spark, sf, name: all_at_it.wait() is not None and name)
    monkeypatch.setattr(MQ, "scoring_context", lambda **runs: runs)
    assert MQ.context(spark, "/none/side") == {n: n for n in ("tree", "clusters", "safety")}


def test_cluster_profiles_are_read_not_computed_again(spark):
    """The labels and profiles of a fitted model come from k written rows, not from a pass over all rows."""
    from pitlane.plans.clusters import train_clusters
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(f"r{i}", float(a), float(b), float(c), i % 3, 1) for i, (a, b, c) in enumerate(rng.normal(size=(300, 3)))],
                               "row_key string, cumulative_degradation double, tyre_life double, laptime_normalized double, compound_encoded int, lap_number int")
    c = train_clusters(df, n_init=1, k_range=[2, 3], sample_size=200, with_pca=False)
    assert "Aggregate" not in c.labels._jdf.queryExecution().optimizedPlan().toString()
    assert c.assigned.count() == 300 == sum(r["count"] for r in c.profiles.collect())


def test_forest_levels_write_no_rows(spark, monkeypatch):
    """large nodes are split by passes over the rows themselves; the sets of all trees are written for no level, only where
    the splits are too many for the tasks, and then the trees are the same."""
    from pyspark.sql import functions as F
    from pitlane.plans import forest
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3)).round(3)
    df = spark.createDataFrame([(f"k{i}", *map(float, v), float(v[0] > 0) + abs(float(v[1]))) for i, v in enumerate(x)], "row_key string, a double, b double, c double, y double")
    monkeypatch.setattr(forest, "NODE_ROWS", 300)
    written, real, real_counted = [], forest.materialize, forest.materialize_counted
    monkeypatch.setattr(forest, "materialize", lambda df: written.append(df.columns) or real(df))
    monkeypatch.setattr(forest, "materialize_counted", lambda df: written.append(df.columns) or real_counted(df))
    f = forest.fit_forest(df, ["a", "b", "c"], [F.col(c) for c in "abc"], "y", trees=4)
    assert f.levels and all("w" not in columns for columns in written)
    want = {r["row_key"]: r["p"] for r in f.predict(df, [F.col(c) for c in "abc"], "p").collect()}
    for most in (0, 6):
        monkeypatch.setattr(forest, "MAX_TOP", most)
        again = forest.fit_forest(df, ["a", "b", "c"], [F.col(c) for c in "abc"], "y", trees=4)
        assert again.n_nodes == f.n_nodes and again.depth == f.depth
        got = {r["row_key"]: r["p"] for r in again.predict(df, [F.col(c) for c in "abc"], "p").collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_tree_levels_shuffle_few_values(spark, monkeypatch):
    """a level counts ranges of values; the values of the few ranges that may hold the best threshold are shuffled,
    and the tree is the one that all values give."""
    from pyspark.sql import functions as F
    from pitlane.plans import cart
    rng = np.random.default_rng(9)
    x = np.stack([rng.normal(size=12_000), rng.integers(0, 9, 12_000) / 2, rng.exponential(size=12_000)], 1)
    label = np.where(x[:, 0] + 0.3 * rng.normal(size=12_000) > 0.4, "B", np.where(x[:, 1] > 2, "C", "A"))
    df = spark.createDataFrame([(*map(float, v), str(t)) for v, t in zip(x, label)], "a double, b double, c double, t string").repartition(5)
    names, written, real = ["a", "b", "c"], [], cart.materialize
    monkeypatch.setattr(cart, "materialize", lambda d: written.append(real(d)) or written[-1])
    tree = cart.fit_cart(df, names, "t", 3)
    assert sum(w.count() for w in written) < 0.25 * 3 * 12_000
    for node in (n for n in tree.nodes.values() if n.feature is not None):
        at = tree.walk(lambda leaf: F.lit(True), node.id) if node.id > 1 else F.lit(True)
        here = F.lit(True)
        i = node.id
        while i > 1:
            up = tree.nodes[i // 2]
            side = F.col(names[up.feature]) <= up.threshold
            here, i = here & (side if i % 2 == 0 else ~side), i // 2
        all_ = cart.split_scores(df, names, "t", tree.classes, F.when(here & at, F.lit(1)).cast("long"))
        s = all_.agg(F.max(F.struct("score", (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "threshold", "left_0", "left_1", "left_2")).alias("s")).first()["s"]
        assert (node.feature, node.threshold, tree.nodes[2 * node.id].counts) == (-s["f"], s["threshold"], list(s)[4:])


def test_tree_does_not_depend_on_its_ranges(spark, monkeypatch):
    """without bounds, with few or uneven ones, and with ties between features the tree is the same."""
    from pitlane.plans import cart
    rng = np.random.default_rng(10)
    x = rng.integers(0, 40, (900, 2)) / 4
    df = spark.createDataFrame([(float(a), float(b), float(a) * 2, "XYZ"[int(rng.integers(0, 3))]) for a, b in x], "a double, b double, c double, t string")
    want = cart.fit_cart(df, ["a", "b", "c"], "t", 3).rows()
    assert len(want) > 5 and all(r[1] != "c" for r in want)
    for bounds in ([[], [], []], [[5.0], [0.0], [3.0, 3.5]], [[20.0], [-1.0, 2.0], [0.1]]):
        monkeypatch.setattr(cart, "bounds_of", lambda *a: [np.array(b, np.float64) for b in bounds])
        assert cart.fit_cart(df, ["a", "b", "c"], "t", 3).rows() == want
