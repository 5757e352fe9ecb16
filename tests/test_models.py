"""Model families on the smallest folder with light settings: shapes, floors and batch/stream agreement."""

import pytest
from pyspark.sql import functions as F

from pitlane import schemas as S


@pytest.fixture(scope="module")
def run(spark, sf_small):
    from pitlane.plans.catalog import laps
    from pitlane.plans.train_all import run_training

    return run_training(laps(spark, sf_small), run_id="pytest", forest_trees=5, forest_depth=5, kmeans_starts=1)


def test_regression_metrics_shape(run):
    m = run.regression.metrics
    assert m["n_train"] + m["n_test"] == m["n_total"] and m["n_test"] > 0
    assert set(m["comparison"]) == {"linear_regression", "random_forest"}
    assert m["best_model"] in ("Random Forest", "Linear Regression")


def test_tree_accuracy_floor(run):
    # the status is a deterministic function of the features, so a depth-5 tree must learn it well
    assert run.tree.metrics["accuracy"] >= 0.85
    assert run.tree.classes == sorted(run.tree.classes)


def test_tree_probabilities_sum_to_one(run):
    df = run.tree.test_scored.select((F.col("prob_normal") + F.col("prob_alerta") + F.col("prob_critico")).alias("s"))
    assert all(abs(r["s"] - 1.0) < 2e-4 for r in df.collect())


def test_kmeans_sweep(run):
    c = run.clusters
    assert sorted(c.silhouettes) == list(range(2, 9))
    assert c.optimal_k == max(sorted(c.silhouettes), key=lambda k: (c.silhouettes[k], -k))
    n = c.assigned.count()
    assert sum(r["count"] for r in c.profiles.collect()) == n


def test_svm_recall_floor_and_probability(run):
    s = run.safety
    assert s.metrics["best_kernel"] in ("linear", "rbf")
    assert s.metrics["best_recall"] >= 0.8
    probs = s.test_scored.select("margin", "probability_critical").collect()
    assert all(0.0 <= r["probability_critical"] <= 1.0 for r in probs)
    pairs = sorted((r["margin"], r["probability_critical"]) for r in probs)
    assert all(b[1] >= a[1] - 1e-12 for a, b in zip(pairs, pairs[1:]))  # monotone in the margin


def test_every_lap_is_scored_once(spark, run, sf_small):
    from pitlane.plans.catalog import laps
    from pitlane.plans.scoring import score_clusters, score_risk_class, score_safety, scoring_inputs

    lp = laps(spark, sf_small)
    n = lp.count()
    missing = {r["row_key"]: r.asDict() for r in scoring_inputs(lp).collect()}
    assert len(missing) == n
    for score, pred, name, mode in ((score_risk_class, "ers_status_predicted", "missing_risk_class", {}),
                                    (score_clusters, "cluster_id", "missing_clusters", {}),
                                    (score_safety, "is_critical", "missing_safety", {}),
                                    (score_clusters, "cluster_id", None, {"mode": "train"}),
                                    (score_safety, "is_critical", None, {"mode": "train"})):
        rows = score(run.context, lp, **mode).collect()
        assert len(rows) == n and len({r["row_key"] for r in rows}) == n
        assert all((r[pred] is None) == (r["missing"] is not None) for r in rows)
        if name:
            assert all(r["missing"] == missing[r["row_key"]][name] for r in rows)
    tyre = {r["row_key"]: r["tyre_life"] for r in lp.select("row_key", "tyre_life").collect()}
    assert all(r["tyre_life"] == tyre[r["row_key"]] for r in score_clusters(run.context, lp).collect())


def test_two_streams_keep_their_rows(spark, run, sf_small, tmp_path):
    from pitlane.plans.catalog import laps
    from pitlane.plans.scoring import score_safety
    from pitlane.sinks import history as H
    from pitlane.streaming.lap_stream import score_batch

    lp = laps(spark, sf_small)
    base = f"file://{tmp_path}/history"  # a path with a scheme gets its tables like any other
    one, two = lp.filter("lap_number <= 10"), lp.filter("lap_number > 70")
    assert score_batch(run.context, one, 0, base, "a") == ["risk_class", "clusters", "safety"]
    score_batch(run.context, two, 0, base, "b")
    score_batch(run.context, one, 0, base, "a")  # a replay
    for t, n in (("safety_events", one.count() + two.count()), ("superclipping_predictions", one.count() + two.count())):
        assert H.read_table(spark, base, t).count() == n
    rows = H.read_table(spark, base, "safety_events")
    assert rows.select("timestamp").distinct().count() == 2
    assert rows.filter("is_critical is null").count() == score_safety(run.context, one.unionByName(two)).filter("missing is not null").count()
    today = rows.agg(F.max("event_date")).first()[0]
    assert H.read_table(spark, base, "safety_events", since=str(today)).count() > 0


def test_stream_scores_equal_batch(spark, run, sf_small, tmp_path):
    from pitlane.plans.catalog import laps
    from pitlane.plans.scoring import score_safety
    from pitlane.sinks import history as H
    from pitlane.streaming import lap_stream as LS

    lp = laps(spark, sf_small)
    base = str(tmp_path)
    LS.write_lap_files(lp, f"{base}/in", files=3)
    q = LS.start_scoring(run.context, LS.lap_stream(spark, f"{base}/in", max_files_per_trigger=1),
                         f"{base}/history", f"{base}/ckpt", available_now=True)
    q.awaitTermination()
    streamed = H.read_table(spark, f"{base}/history", "safety_events")
    batch = H.history_rows(score_safety(run.context, lp), "safety_events", F.col("row_key"))
    cols = ["id", "is_critical", "kernel", "lap"]
    assert sorted(map(tuple, streamed.select(cols).collect())) == sorted(map(tuple, batch.select(cols).collect()))
    # replaying from the checkpoint adds nothing
    q2 = LS.start_scoring(run.context, LS.lap_stream(spark, f"{base}/in"), f"{base}/history", f"{base}/ckpt",
                          available_now=True)
    q2.awaitTermination()
    assert H.read_table(spark, f"{base}/history", "safety_events").count() == streamed.count()


def test_dashboard_stream_matches_batch(spark, run, sf_small, tmp_path):
    from pitlane.operators import clean as CL
    from pitlane.plans.catalog import laps
    from pitlane.streaming import lap_stream as LS

    lp = laps(spark, sf_small)
    rows = CL.clean_rows(lp)
    base = str(tmp_path)
    LS.write_lap_files(rows, f"{base}/in", files=2)
    agg = LS.dashboard_stream(LS.lap_stream(spark, f"{base}/in", max_files_per_trigger=1), run.ers_bounds)
    got = {}
    q = (agg["ers_distribution"].writeStream.outputMode("complete")
         .foreachBatch(lambda df, bid: got.update({r["ers_status"]: r["n"] for r in df.collect()}))
         .option("checkpointLocation", f"{base}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    batch = CL.dashboard_fields(rows, run.ers_bounds).filter(F.col("ers_status").isNotNull()).groupBy(
        "ers_status").count().collect()
    assert got == {r["ers_status"]: r["count"] for r in batch}


def test_context_save_load_and_missing_model(spark, run, sf_small, tmp_path):
    import shutil

    from pitlane.plans.persist import load_context, save_context
    from pitlane.plans.scoring import demo_lap_frame, score_clusters, score_risk_class, score_safety

    p = str(tmp_path / "ctx")
    save_context(run.context, p)
    loaded = load_context(spark, p)
    assert loaded.missing == {}
    demo = demo_lap_frame(spark)
    a = score_safety(run.context, demo).collect()
    b = score_safety(loaded.context, demo).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]
    assert score_clusters(loaded.context, demo).count() == 1
    shutil.rmtree(tmp_path / "ctx" / "tree")
    partial = load_context(spark, p)
    assert "risk_class" in partial.missing
    with pytest.raises(RuntimeError):
        score_risk_class(partial.context, demo)
    assert score_safety(partial.context, demo).count() == 1


def test_save_run_writes_documents_and_models(spark, run, tmp_path):
    from pitlane.plans.train_all import save_run
    from pitlane.sinks.results import read_json_document

    out = str(tmp_path / "run")
    reg = save_run(run, out)
    assert set(reg) == {"regression", "decision_tree", "kmeans", "svm"}
    assert all(v["run_id"] == run.run_id and v["trained_at"] for v in reg.values())
    doc = read_json_document(spark, f"{out}/ml/metrics_svm")
    assert doc["best_kernel"] == run.safety.metrics["best_kernel"] and doc["run_id"] == run.run_id
    dash = read_json_document(spark, f"{out}/data/dashboard")
    assert set(dash) == {"telemetry_history", "ers_distribution", "avg_superclipping_by_compound",
                         "avg_ers_risk_by_lap"}
    assert 0 < len(dash["telemetry_history"]) <= 200
    laps_sorted = [r["lap"] for r in dash["telemetry_history"]]
    assert laps_sorted == sorted(laps_sorted)
    assert set(dash["ers_distribution"]) == {"NORMAL", "ALERTA", "CRÍTICO"}
    res = spark.read.option("header", True).csv(f"{out}/data/results")
    from pitlane.sinks.results import RESULT_COLUMNS, read_results_head
    assert set(RESULT_COLUMNS) <= set(res.columns)
    head = read_results_head(spark, f"{out}/data/results", ", ".join(f"`{c}` string" for c in res.columns), 5)
    assert [r["row_key"] for r in head.collect()] == [r["row_key"] for r in res.orderBy("row_key").limit(5).collect()]
    assert res.count() == run.regression.metrics["n_test"]
    assert run.regression.metrics["forest"]["depth_reached"] <= 5
    from pitlane.plans.forest import Forest
    loaded = Forest.load(spark, f"{out}/ml/forest")
    assert loaded.features == S.REGRESSION_FEATURES and loaded.subtrees.count() == run.regression.forest.subtrees.count()
    assert spark.read.parquet(f"{out}/ml/decision_tree").count() == len(run.tree.model.nodes)
    long = spark.read.parquet(f"{out}/ml/metrics_long")
    assert {r["model"] for r in long.select("model").distinct().collect()} == set(reg)
    best = {r["model"]: r for r in spark.read.parquet(f"{out}/ml/provenance").collect()}
    assert {m: b["metric"] for m, b in best.items()} == {m: float(v["metric"]) for m, v in reg.items()}
    assert read_json_document(spark, f"{out}/ml/regression_scaler")["features"] == S.REGRESSION_FEATURES
    assert spark.read.parquet(f"{out}/ml/race_codes").count() > 1
    from pitlane.plans.regression import LapTimeModel
    model = LapTimeModel.load(spark, f"{out}/ml")
    lp = run.prepared.select("row_key", "driver", "race", "year", *[c for c in S.REGRESSION_FEATURES if "encoded" not in c], "compound")
    some = lp.limit(200)
    odd = some.withColumns({"race": F.lit("A new race"), "row_key": F.concat(F.lit("n"), "row_key")}).unionByName(
        some.withColumns({"stint": F.lit(None).cast("int"), "row_key": F.concat(F.lit("m"), "row_key")}))
    scored = {r["row_key"]: r for r in model.predict(some.unionByName(odd)).collect()}
    assert len(scored) == 600
    assert all(r["race_unseen"] == k.startswith("n") and (r["predicted"] is None) == (r["missing"] is not None) for k, r in scored.items())
    assert all("stint" in r["missing"].split(",") for k, r in scored.items() if k.startswith("m"))
    assert sum(r["predicted"] is not None for k, r in scored.items() if k.startswith("n")) > 50
    known = {r["row_key"]: r["pred_rf"] for r in run.regression.test_scored.select("row_key", "pred_rf").collect()}
    assert all(abs(scored[k]["predicted"] - v) < 1e-9 for k, v in known.items() if k in scored)
    from pyspark.ml.feature import PCAModel
    assert PCAModel.load(f"{out}/ml/pca").getK() == 2


def test_live_mode_scoring_uses_row_local_definitions(spark, run):
    from pitlane.plans.scoring import demo_lap_frame, score_clusters, score_safety

    demo = demo_lap_frame(spark)
    live = score_safety(run.context, demo, mode="live").first()
    assert live["ers_risk"] == round(min(10.0, max(0.0, (0.65 * 2 + 0.54 * 1.5 - 0.12) * 0.65 + 2.5)), 2)
    trained = score_safety(run.context, demo, mode="train").first()
    lo, hi = run.ers_bounds
    raw = 0.65 * 2 + 0.54 * 1.5 - 0.12
    assert abs(trained["ers_risk"] - (raw - lo) / (hi - lo) * 10) < 1e-9
    assert score_clusters(run.context, demo, mode="live").count() == 1


def test_batch_score_job_is_rerunnable(spark, run, sf_small, tmp_path):
    from pitlane.plans.catalog import laps
    from pitlane.plans.persist import save_context
    from pitlane.plans.score_job import score_laps
    from pitlane.sinks import history as H

    ctx_dir, hist = str(tmp_path / "ctx"), str(tmp_path / "hist")
    save_context(run.context, ctx_dir)
    lp = laps(spark, sf_small)
    score_laps(spark, ctx_dir, lp, hist, "r1")
    n1 = H.read_table(spark, hist, "classification_results").count()
    score_laps(spark, ctx_dir, lp, hist, "r1")  # rerun of the same run replaces its rows
    assert H.read_table(spark, hist, "classification_results").count() == n1 > 0


def test_each_query_fits_its_own_family(spark, sf_small, monkeypatch):
    """No query waits for a family that it does not use, and forests are asked for without a depth limit."""
    import inspect

    from pitlane.plans import model_queries
    from pitlane.plans.train_all import run_training

    asked = []
    monkeypatch.setattr(model_queries, "_RUNS", {})
    monkeypatch.setattr(model_queries, "stored", lambda *_: "frame")
    monkeypatch.setattr(model_queries, "laps", lambda *_: None)
    monkeypatch.setattr(model_queries, "run_training", lambda *a, **k: asked.append(inspect.signature(run_training).bind(*a, **k)) or k["which"])
    for name in ("tree", "forest", "tree"):
        assert model_queries.family(spark, sf_small, name) == (name,)
    assert [a.arguments["which"] for a in asked] == [("tree",), ("forest",)]
    asked[1].apply_defaults()
    assert asked[1].arguments["forest_depth"] is None and asked[1].arguments["prepared"] == "frame"
