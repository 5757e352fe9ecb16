"""Model provenance registry and long-form metric rows."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane.functions.lookup import sanitize_label

# model family -> the metric field its document carries
METRIC_FIELD = {
    "regression": "r2",
    "decision_tree": "accuracy",
    "kmeans": "silhouette_score",
    "svm": "best_recall",
}


def provenance_union(docs: dict[str, DataFrame], source: str = "local", run_id: str | None = None) -> DataFrame:
    """One row per model document; each document has its own metric field.

    The four projections are combined with unionByName(allowMissingColumns=True)
    and the metric is the one non-null field.
    """
    parts = []
    for model, d in docs.items():
        fld = METRIC_FIELD[model]
        cols = [F.lit(model).alias("model"), F.lit(fld).alias("metric_name"), F.col(fld)]
        cols.append(F.col("source") if "source" in d.columns else F.lit(source).alias("source"))
        cols.append(F.col("trained_at") if "trained_at" in d.columns
                    else F.lit(None).cast("timestamp").alias("trained_at"))
        cols.append(F.col("run_id") if "run_id" in d.columns else F.lit(run_id).cast("string").alias("run_id"))
        parts.append(d.select(*cols))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    metric = F.coalesce(*[F.col(f).cast("double") for f in dict.fromkeys(METRIC_FIELD.values()) if f in u.columns])
    return u.select("model", "source", "trained_at", "run_id", "metric_name", metric.alias("metric"))


def resolve_provenance(candidates: DataFrame) -> DataFrame:
    """Per model the candidate with the best priority (consolidated 0 < per-model 1 < legacy 2)."""
    best = F.min_by(F.struct("source", "trained_at", "metric", "run_id"), F.col("priority"))
    return candidates.groupBy("model").agg(best.alias("b")).select("model", "b.*")


def metrics_long(report: DataFrame, params: DataFrame, run_id: str, prefix: str = "dt") -> DataFrame:
    """Classification report and parameters as (run_id, kind, name, value) rows; labels sanitised."""
    name = F.when(F.col("label") == "accuracy", F.lit(f"{prefix}_accuracy")).otherwise(
        F.concat(F.lit(f"{prefix}_f1_"), sanitize_label("label")))
    metric_rows = report.select(F.lit(run_id).alias("run_id"), F.lit("metric").alias("kind"), name.alias("name"),
                                F.col("f1").cast("double").alias("value"))
    pcols = params.columns
    stacked = params.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(c) for c in pcols]), F.array(*[F.col(c).cast("double") for c in pcols]))).alias("name", "value"))
    param_rows = stacked.select(F.lit(run_id).alias("run_id"), F.lit("param").alias("kind"), "name", "value")
    return metric_rows.unionByName(param_rows)


def document_rows(spark: SparkSession, docs: dict[str, dict], run_id: str) -> DataFrame:
    """The numbers of all models' metric documents as (run_id, model, kind, name, value) rows; nested names are
    joined by dots. A document has some hundred numbers at most."""
    rows = []

    def walk(model: str, value, name: str) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(model, v, f"{name}.{k}" if name else str(k))
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            kind = "param" if name.split(".")[0] in ("n_total", "n_train", "n_test", "n_removed", "max_depth", "optimal_k", "forest", "rbf") else "metric"
            rows.append((run_id, model, kind, name, float(value)))

    for model, doc in docs.items():
        walk(model, doc, "")
    return spark.createDataFrame(rows, "run_id string, model string, kind string, name string, value double")


def provenance(spark: SparkSession, output: str) -> DataFrame:
    """U02 from what a run has written below output: per model the consolidated registry's entry, else that of the
    model's own document."""
    from pitlane.sinks.results import read_json_document
    rows = []
    registry = read_json_document(spark, os.path.join(output, "ml", "models_source")) or {}
    for model, field in METRIC_FIELD.items():
        if model in registry:
            e = registry[model]
            rows.append((model, 0, e.get("source"), e.get("trained_at"), _number(e.get("metric")), e.get("run_id")))
        doc = read_json_document(spark, os.path.join(output, "ml", f"metrics_{model}"))
        if doc:
            rows.append((model, 1, doc.get("training_source"), doc.get("trained_at"), _number(doc.get(field)), doc.get("run_id")))
    return resolve_provenance(spark.createDataFrame(
        rows, "model string, priority int, source string, trained_at string, metric double, run_id string"))


def _number(x) -> float | None:
    return None if x is None else float(x)
