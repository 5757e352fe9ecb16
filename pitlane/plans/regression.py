"""Lap-time regression: least squares and random forest on standardised features (ML01-ML03, E01, E07, K01)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.operators.dims import materialize
from pitlane.functions import lookup
from pitlane.operators.codes import attach_codes, extend_codes
from pitlane.operators.evaluate import regression_metrics_of
from pitlane.operators.sampling import mark_split
from pitlane.plans.forest import Forest, fit_forest
from pitlane.plans.models import Standardizer
from pitlane.sinks.results import read_json_document


def regression_matrix(prepared: DataFrame) -> DataFrame:
    """Complete feature rows; identifying columns stay on the rows (J04 needs no lookup join)."""
    return prepared.na.drop(subset=S.REGRESSION_FEATURES + [S.REGRESSION_TARGET])


@dataclass
class RegressionResult:
    scaler: Standardizer
    linear: LinearRegressionModel | None
    forest: Forest | None
    test_scored: DataFrame
    metrics: dict = field(default_factory=dict)


def train_regression(prepared: DataFrame, num_trees: int = 100, max_depth: int | None = None, seed: int = 42,
                     models: tuple[str, ...] = ("linear", "forest")) -> RegressionResult:
    """ML02 + ML03 on an 80/20 hash split; E01 for the models asked for; the best is chosen by R^2 (E07). The forest's trees
    grow until their leaves are pure, unless max_depth is given."""
    marked = materialize(mark_split(regression_matrix(prepared)))
    counts = marked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_test").cast("int")).alias("n_test")).first()
    train, test = marked.filter(~F.col("is_test")), marked.filter(F.col("is_test"))
    scaler = Standardizer.fit(train, S.REGRESSION_FEATURES)
    lr = rf = None
    scored = test
    if "linear" in models:
        lr = LinearRegression(featuresCol="features", labelCol=S.REGRESSION_TARGET, predictionCol="pred_lr",
                              regParam=0.0, elasticNetParam=0.0, solver="normal", standardization=False).fit(scaler.transform(train))
        scored = lr.transform(scaler.transform(scored)).drop("features")
    if "forest" in models:
        columns = list(scaler.columns().values())
        rf = fit_forest(train, S.REGRESSION_FEATURES, columns, S.REGRESSION_TARGET, num_trees, max_depth, seed)
        scored = materialize(rf.predict(scored, columns, "pred_rf"))
    preds = {"linear_regression": ("pred_lr", lr), "random_forest": ("pred_rf", rf)}
    fitted = {name: col for name, (col, model) in preds.items() if model is not None}
    m = regression_metrics_of(scored, S.REGRESSION_TARGET, fitted).first()
    comp = {name: {k: round(m[f"{name}_{k}"], 4) for k in ("mae", "mse", "r2")} for name in fitted}
    best_key = max(reversed(comp), key=lambda name: comp[name]["r2"])
    best = {"random_forest": "Random Forest", "linear_regression": "Linear Regression"}[best_key]
    metrics = {
        "best_model": best, "algorithm": best, "comparison": comp,
        "target": S.REGRESSION_TARGET, "features": S.REGRESSION_FEATURES,
        "n_total": int(counts["n"]), "n_train": int(counts["n"] - counts["n_test"]), "n_test": int(counts["n_test"]),
        **comp[best_key],
        "ers_risk_range": {"min": 0, "max": C.RISK_SCALE_MAX},
        "superclipping_duration_range": {"min_s": C.DURATION_BASE, "max_s": C.DURATION_BASE + C.DURATION_SPAN},
    }
    if rf is not None:
        metrics["forest"] = {"num_trees": num_trees, "max_depth": max_depth, "depth_reached": rf.depth, "n_nodes": rf.n_nodes}
    return RegressionResult(scaler, lr, rf, scored, metrics)


@dataclass
class LapTimeModel:
    """A saved forest with what its features were encoded by."""

    scaler: Standardizer
    forest: Forest
    codes: DataFrame
    version: int
    year_base: int

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LapTimeModel:
        """From the `ml` folder that a training run has written."""
        doc = read_json_document(spark, f"{path}/regression_scaler")
        if doc is None:
            raise FileNotFoundError(f"no regression model under {path}")
        codes = spark.read.parquet(f"{path}/race_codes")
        return cls(Standardizer.from_dict(doc), Forest.load(spark, f"{path}/forest"), codes, int(doc["codes_version"]), int(doc["year_base"]))

    def predict(self, laps: DataFrame) -> DataFrame:
        """(row_key, predicted, race_unseen, missing) of every lap: its time over the race's median. Races that the training
        run has not had get the next codes of its dictionary and are marked; laps with a missing feature have no prediction
        and name what is missing."""
        codes = extend_codes(self.codes, laps)
        rows = attach_codes(laps.withColumn("compound_encoded", lookup.compound_code()), codes, self.version)
        rows = rows.withColumn("year_encoded", F.col("year") - self.year_base)
        names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in self.scaler.features]))
        rows = materialize(rows.select("row_key", "race_unseen", F.when(F.size(names) > 0, F.array_join(names, ",")).alias("missing"),
                                       *[F.col(c).cast("double").alias(c) for c in self.scaler.features]))
        whole = self.forest.predict(rows.where("missing is null"), list(self.scaler.columns().values()), "predicted")
        columns = ["row_key", "predicted", "race_unseen", "missing"]
        return whole.select(*columns).unionByName(rows.where("missing is not null").select("row_key", F.lit(None).cast("double").alias("predicted"), "race_unseen", "missing"))
