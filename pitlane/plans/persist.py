"""Saving and loading the fitted scoring context.

Each model is saved as a document or table in its own folder; small metadata
goes to one JSON document. Loading is per model: a missing or broken model disables
only its own scorer, and the reason is reported.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from pitlane.plans.cart import Cart
from pitlane.plans.clusters import Centroids, ClusterResult
from pitlane.plans.margins import Platt, SupportVectors
from pitlane.plans.models import Standardizer
from pitlane.plans.safety import FourierMap, SvmModel
from pitlane.plans.scoring import ScoringContext
from pitlane.session import path_exists
from pitlane.sinks.results import read_json_document, write_json_document


def save_context(ctx: ScoringContext, path: str) -> None:
    spark = ctx.race_medians.sparkSession
    write_json_document(spark, ctx.tree_model.to_dict(), os.path.join(path, "tree"))
    c = ctx.clusters
    c.profiles.join(c.labels, "cluster").write.mode("overwrite").parquet(os.path.join(path, "cluster_profiles"))
    s = ctx.safety
    write_json_document(spark, {
        "kernel": s.kernel, "scaler": s.scaler.to_dict(), "weights": s.weights,
        "vectors": s.vectors.to_dict() if s.vectors is not None else None,
        "platt": [s.platt.a, s.platt.b] if s.platt is not None else None,
        "rff": {"w": s.rff.w, "b": s.rff.b} if s.rff is not None else None,
    }, os.path.join(path, "svm"))
    ctx.race_medians.write.mode("overwrite").parquet(os.path.join(path, "race_medians"))
    meta = {
        "tree_classes": ctx.tree_classes,
        "cluster_scaler": c.scaler.to_dict(), "cluster_mapping": {str(k): v for k, v in c.mapping.items()},
        "cluster_centres": c.model.centres,
        "optimal_k": c.optimal_k,
        "ers_bounds": list(ctx.ers_bounds),
    }
    write_json_document(spark, meta, os.path.join(path, "meta"))


@dataclass
class LoadedContext:
    context: ScoringContext
    missing: dict = field(default_factory=dict)  # scorer -> reason


def _safe(spark: SparkSession, loader, p: str, label: str, missing: dict):
    try:
        if not path_exists(spark, p):
            missing[label] = f"not found: {p}"
            return None
        return loader(p)
    except Exception as e:  # noqa: BLE001 -- a broken model disables only its scorer
        missing[label] = f"{type(e).__name__}: {str(e)[:200]}"
        return None


def load_context(spark: SparkSession, path: str) -> LoadedContext:
    missing: dict = {}
    meta = read_json_document(spark, os.path.join(path, "meta"))
    if meta is None:
        raise FileNotFoundError(f"no scoring metadata under {path}")
    def document(p):
        return read_json_document(spark, p)

    tree = _safe(spark, lambda p: Cart.from_dict(document(p)), os.path.join(path, "tree"), "risk_class", missing)
    km = Centroids(meta["cluster_centres"]) if meta.get("cluster_centres") else None
    if km is None:
        missing["clusters"] = "no cluster centres"
    prof = _safe(spark, spark.read.parquet, os.path.join(path, "cluster_profiles"), "clusters", missing)
    safety = _safe(spark, lambda p: _svm(document(p)), os.path.join(path, "svm"), "safety", missing)
    medians = spark.read.parquet(os.path.join(path, "race_medians"))
    clusters = None
    if km is not None and prof is not None:
        mapping = {int(k): int(v) for k, v in meta["cluster_mapping"].items()}
        clusters = ClusterResult(Standardizer.from_dict(meta["cluster_scaler"]), km, mapping, meta["optimal_k"],
                                 {}, {}, None, prof.drop("cluster_label"), prof.select("cluster", "cluster_label"))
    ctx = ScoringContext(tree, meta["tree_classes"], clusters, safety, tuple(meta["ers_bounds"]), medians)
    return LoadedContext(ctx, missing)


def _svm(d: dict) -> SvmModel:
    return SvmModel(d["kernel"], Standardizer.from_dict(d["scaler"]), d["weights"],
                    SupportVectors.from_dict(d["vectors"]) if d["vectors"] else None,
                    Platt(*d["platt"]) if d["platt"] else None, FourierMap(d["rff"]["w"], d["rff"]["b"]) if d["rff"] else None)
