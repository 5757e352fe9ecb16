"""ERS status classification tree (ML04, ML12, ML15, E02-E04, F22)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.functions.lookup import status_color
from pitlane.functions.numeric import round_even
from pitlane.operators.dims import materialize
from pitlane.operators.evaluate import classification_report, confusion_matrix
from pitlane.operators.sampling import mark_stratified
from pitlane.plans.cart import Cart, fit_cart


@dataclass
class TreeResult:
    model: Cart
    classes: list[str]
    test_scored: DataFrame
    report: DataFrame
    confusion: DataFrame
    metrics: dict = field(default_factory=dict)


def tree_frame(prepared: DataFrame) -> DataFrame:
    return prepared.na.drop(subset=S.TREE_FEATURES + [S.TREE_TARGET])


def train_tree(prepared: DataFrame, max_depth: int = C.DT_MAX_DEPTH) -> TreeResult:
    """ML04: classes in alphabetical order, gini, depth 5, exact thresholds; stratified hash split."""
    marked = materialize(mark_stratified(tree_frame(prepared), S.TREE_TARGET).select(*S.TREE_FEATURES, S.TREE_TARGET, "row_key", "is_test"))
    train, test = marked.filter(~F.col("is_test")), marked.filter(F.col("is_test"))
    model = fit_cart(train, S.TREE_FEATURES, S.TREE_TARGET, max_depth)
    classes = model.classes
    scored = predict_status(model, classes, test)
    report = classification_report(scored, S.TREE_TARGET, "predicted_status")
    rep_rows = {r["label"]: r.asDict() for r in report.collect()}  # classes + 3 summary rows
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("n_test")).first()
    metrics = {
        "algorithm": "DecisionTreeClassifier", "target": S.TREE_TARGET, "features": S.TREE_FEATURES,
        "max_depth": max_depth, "accuracy": round(rep_rows["accuracy"]["f1"], 4),
        "classification_report": {k: {"precision": v["precision"], "recall": v["recall"], "f1-score": v["f1"],
                                      "support": v["support"]} for k, v in rep_rows.items()},
        "classes": classes, "n_total": int(counts["n"]), "n_train": int(counts["n"] - counts["n_test"]),
        "n_test": int(counts["n_test"]),
    }
    return TreeResult(model, classes, scored, report, confusion_matrix(scored, S.TREE_TARGET, "predicted_status"),
                      metrics)


def predict_status(model: Cart, classes: list[str], df: DataFrame) -> DataFrame:
    """ML12 core: class, per-class probabilities (F22: 4 decimals, 0 for an unseen class) and colour (F16)."""
    out = df.withColumn("_outcome", model.outcome())
    named = {"prob_normal": C.STATUS_NORMAL, "prob_alerta": C.STATUS_ALERT, "prob_critico": C.STATUS_CRITICAL}
    probs = {col: round_even(F.col("_outcome.probabilities")[classes.index(cls)], 4) if cls in classes else F.lit(0.0) for col, cls in named.items()}
    out = out.withColumns({"predicted_status": F.col("_outcome.prediction"), **probs})
    return out.withColumn("color", status_color("predicted_status")).drop("_outcome")


def tree_nodes(spark: SparkSession, model: Cart) -> DataFrame:
    """ML15: the fitted tree as a node table."""
    return model.table(spark)
