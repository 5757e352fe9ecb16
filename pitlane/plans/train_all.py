"""Train-all job (ML16): clean once, then regression, tree, clusters and SVM in order under one run id,
then the provenance registry (U01), metric documents (K03), long metrics (K14), results (K01) and the
dashboard document (K02).

    spark-submit pitlane/plans/train_all.py --laps PATH --output DIR [--format csv|parquet]

The cleaned frame is written once as Parquet below the shared checkpoint
folder (lineage cut; survives executor loss) and all four trainings read it.
"""

from __future__ import annotations

import argparse
import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane.operators import clean as CL
from pitlane.operators import dashboards as DB
from pitlane.plans.clusters import ClusterResult, train_clusters
from pitlane.plans.regression import RegressionResult, train_regression
from pitlane.plans.safety import SafetyResult, train_safety
from pitlane.plans.scoring import ScoringContext
from pitlane.plans.tree import TreeResult, train_tree
from pitlane.session import ensure_checkpoint_dir, scratch_path


@dataclass
class TrainingRun:
    run_id: str
    prepared: DataFrame
    regression: RegressionResult | None
    tree: TreeResult | None
    clusters: ClusterResult | None
    safety: SafetyResult | None
    context: ScoringContext | None
    ers_bounds: tuple[float, float]


def materialize_prepared(laps: DataFrame, run_id: str) -> DataFrame:
    """Clean + encode + dashboard fields, written once to the shared folder and read back."""
    spark = laps.sparkSession
    path = scratch_path(spark, f"prepared-{run_id}")
    CL.prepare(laps).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_training(laps: DataFrame, run_id: str | None = None, forest_trees: int = 100, forest_depth: int | None = None,
                 kmeans_starts: int = 10, svm_cap: int | None = None, which=("linear", "forest", "tree", "clusters", "safety"),
                 prepared: DataFrame | None = None) -> TrainingRun:
    """The families named in `which`; prepared: the cleaned and encoded laps, if they are already written."""
    spark = laps.sparkSession
    ensure_checkpoint_dir(spark)
    run_id = run_id or uuid.uuid4().hex
    prepared = materialize_prepared(laps, run_id) if prepared is None else prepared
    n_removed = laps.count() - prepared.count()
    b = prepared.agg(F.min(CL.risk.ers_raw()).alias("lo"), F.max(CL.risk.ers_raw()).alias("hi")).first()
    bounds = (float(b["lo"]), float(b["hi"]))
    models = tuple(m for m in ("linear", "forest") if m in which)
    reg = train_regression(prepared, forest_trees, forest_depth, models=models) if models else None
    tree = train_tree(prepared) if "tree" in which else None
    clus = train_clusters(prepared, n_init=kmeans_starts) if "clusters" in which else None
    safe = train_safety(prepared, cap=svm_cap) if "safety" in which else None
    for res in (reg, tree, clus, safe):
        if res is not None:
            res.metrics["n_removed"] = n_removed
    run = TrainingRun(run_id, prepared, reg, tree, clus, safe, None, bounds)
    if tree and clus and safe:
        run.context = scoring_context(run, run, run)
    return run


def scoring_context(tree: TrainingRun | None = None, clusters: TrainingRun | None = None, safety: TrainingRun | None = None) -> ScoringContext:
    """What scores laps, from one run of all families or a run of each; a scorer whose family is left out is not loaded."""
    run = next(r for r in (tree, clusters, safety) if r is not None)
    medians = CL.race_medians(run.prepared).filter(F.col("race").isNotNull())
    return ScoringContext(tree and tree.tree.model, tree.tree.classes if tree else [], clusters and clusters.clusters,
                          safety and safety.safety.best, run.ers_bounds, medians)


def save_run(run: TrainingRun, output: str, source: str = "local") -> dict:
    """Documents and tables of one run."""
    from pitlane.plans.registry import METRIC_FIELD, document_rows, provenance
    from pitlane.sinks.results import results_projection, write_json_document, write_results
    spark = run.prepared.sparkSession
    docs = {}
    for name, res in (("regression", run.regression), ("decision_tree", run.tree), ("kmeans", run.clusters),
                      ("svm", run.safety)):
        if res is None:
            continue
        m = dict(res.metrics, training_source=source, run_id=run.run_id)
        m["trained_at"] = spark.sql("SELECT current_timestamp() AS t").first()["t"].isoformat()
        docs[name] = m
        write_json_document(spark, m, os.path.join(output, "ml", f"metrics_{name}"))
    registry = {n: {"source": d["training_source"], "trained_at": d["trained_at"], "metric": d.get(METRIC_FIELD[n]),
                    "run_id": run.run_id} for n, d in docs.items()}
    write_json_document(spark, registry, os.path.join(output, "ml", "models_source"))
    if run.regression is not None:
        if run.regression.forest is not None:
            run.regression.forest.save(os.path.join(output, "ml", "forest"))
        if run.regression.linear is not None:
            run.regression.linear.write().overwrite().save(os.path.join(output, "ml", "linear"))
        codes = run.prepared.select(CL.race_text().alias("race_text"), "race_encoded", F.lit(1).alias("version")).distinct()
        base = run.prepared.agg(F.min(F.col("year").cast("int"))).first()[0]
        write_json_document(spark, run.regression.scaler.to_dict() | {"codes_version": 1, "year_base": base}, os.path.join(output, "ml", "regression_scaler"))
        codes.coalesce(1).write.mode("overwrite").parquet(os.path.join(output, "ml", "race_codes"))
        res = results_projection(run.regression.test_scored, "laptime_normalized", "pred_rf" if run.regression.forest is not None else "pred_lr")
        write_results(res, os.path.join(output, "data", "results"))
    if run.tree is not None:
        run.tree.model.table(spark).write.mode("overwrite").parquet(os.path.join(output, "ml", "decision_tree"))
    if run.clusters is not None and run.clusters.pca is not None:
        run.clusters.pca.write().overwrite().save(os.path.join(output, "ml", "pca"))
    document_rows(spark, docs, run.run_id).coalesce(1).write.mode("overwrite").parquet(os.path.join(output, "ml", "metrics_long"))
    provenance(spark, output).coalesce(1).write.mode("overwrite").parquet(os.path.join(output, "ml", "provenance"))
    if run.context is not None:
        from pitlane.plans.persist import save_context
        save_context(run.context, os.path.join(output, "ml", "scoring_context"))
    write_json_document(spark, DB.dashboard_document(run.prepared), os.path.join(output, "data", "dashboard"))
    return registry


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--laps", required=True)
    ap.add_argument("--output", required=True)
    ap.add_argument("--format", default="csv", choices=["csv", "parquet"])
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("pitlane-train-all").getOrCreate()
    from pitlane.sources.laps import read_laps_csv, read_laps_parquet
    laps = read_laps_csv(spark, a.laps) if a.format == "csv" else read_laps_parquet(spark, a.laps)
    run = run_training(laps)
    print(json.dumps(save_run(run, a.output), default=str))


if __name__ == "__main__":
    main()
