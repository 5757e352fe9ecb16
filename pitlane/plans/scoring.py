"""Scoring laps with the trained models (ML12-ML14) and shaping the rows for the history tables.

Scoring is a column-expression + MLlib transform over any lap DataFrame,
batch or streaming. Every lap gets exactly one row from each scorer: where a
feature is missing the predictions are null and `missing` names the features.
By default the live feature definitions are used (78 s reference lap, live risk
formula), which need nothing but the lap itself, so a new or missing race makes
no difference; mode="train" uses those of the training run (race medians and
risk bounds saved with it).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.functions import lookup, risk
from pitlane.functions.carstate import interpretation
from pitlane.operators.dims import checked_dim
from pitlane.plans.clusters import ClusterResult, assign
from pitlane.plans.safety import SvmModel
from pitlane.plans.tree import predict_status


@dataclass
class ScoringContext:
    tree_model: object
    tree_classes: list[str]
    clusters: ClusterResult
    safety: SvmModel
    ers_bounds: tuple[float, float]
    race_medians: DataFrame  # race -> laptime_baseline (one row per race)
    _dims: dict = field(default_factory=dict, repr=False)

    def dim(self, name: str, build) -> DataFrame:
        """A small dimension materialised (and size-checked) once per context, reused by every
        batch and micro-batch that is scored with it."""
        if name not in self._dims:
            self._dims[name] = checked_dim(build())
        return self._dims[name]


def _require(model, what: str):
    if model is None:
        raise RuntimeError(f"{what} model not loaded; train it first (the other scorers still work)")


def demo_lap_frame(spark) -> DataFrame:
    """The defaulted one-row lap used when no lap is available for scoring."""
    d = dict(C.DEMO_LAP)
    return spark.createDataFrame([(
        "demo", d["lap_number"], d["normalized_tyre_life"], d["race_progress"], d["lap_time_delta"],
        d["tyre_life"], d["compound"], d["lap_time_s"], d["cumulative_degradation"], d["race"])],
        "row_key string, lap_number int, normalized_tyre_life double, race_progress double, "
        "lap_time_delta double, tyre_life double, compound string, lap_time_s double, "
        "cumulative_degradation double, race string")


def _missing(features: list[str]) -> Column:
    names = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in features]))
    return F.when(F.size(names) > 0, F.array_join(names, ","))


def _marked(df: DataFrame, features: list[str]) -> tuple[DataFrame, Column]:
    """The rows with missing features named in `missing` (null if complete) and filled, so that a model takes them;
    and the condition that a row is complete, under which alone a prediction counts."""
    marked = df.withColumn("missing", _missing(features))
    return marked.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features}), F.col("missing").isNull()


def _with_compound(df: DataFrame) -> DataFrame:
    return df if "compound_encoded" in df.columns else df.withColumn("compound_encoded", lookup.compound_code())


def score_risk_class(ctx: ScoringContext, laps: DataFrame) -> DataFrame:
    """ML12: ERS class, three probabilities and colour of every lap."""
    _require(ctx.tree_model, "risk classification")
    x, whole = _marked(_with_compound(laps), S.TREE_FEATURES)
    out = predict_status(ctx.tree_model, ctx.tree_classes, x)
    known = {c: F.when(whole, F.col(c)) for c in ("predicted_status", "prob_normal", "prob_alerta", "prob_critico", "color")}
    return out.select("row_key", known["predicted_status"].alias("ers_status_predicted"),
                      *(known[c].alias(c) for c in ("prob_normal", "prob_alerta", "prob_critico", "color")),
                      F.col("lap_number").cast("int").alias("lap"),
                      F.coalesce(F.col("race"), F.lit("Unknown")).alias("race"), "missing")


def with_laptime_normalized(ctx: ScoringContext | None, laps: DataFrame, mode: str) -> DataFrame:
    if mode == "live":
        return laps.withColumn("laptime_normalized", risk.laptime_vs_constant())
    med = ctx.dim("race_medians", lambda: ctx.race_medians)
    j = laps.drop("laptime_baseline", "laptime_normalized").join(med, "race", "left")
    return j.withColumn("laptime_normalized", F.col("lap_time_s") - F.col("laptime_baseline"))


def with_risk(ctx: ScoringContext | None, laps: DataFrame, mode: str) -> DataFrame:
    if mode == "live":
        return laps.withColumn("ers_risk", risk.live_risk())
    if "ers_risk" in laps.columns:
        return laps
    lo, hi = ctx.ers_bounds
    return laps.withColumn("ers_risk", risk.ers_scaled(risk.ers_raw(), F.lit(lo), F.lit(hi)))


def scoring_inputs(laps: DataFrame) -> DataFrame:
    """The live features of every lap and, for each scorer, the names of those that are missing (null: none)."""
    x = with_risk(None, with_laptime_normalized(None, _with_compound(laps), "live"), "live")
    missing = {"missing_risk_class": S.TREE_FEATURES, "missing_clusters": S.CLUSTER_FEATURES, "missing_safety": S.SAFETY_FEATURES}
    return x.select("row_key", F.col("lap_number").cast("int").alias("lap"), "ers_risk", "laptime_normalized",
                    *(_missing(features).alias(n) for n, features in missing.items()))


def score_clusters(ctx: ScoringContext, laps: DataFrame, mode: str = "live") -> DataFrame:
    """ML13: cluster id, label, interpretation sentence and the cluster's profile means of every lap."""
    _require(ctx.clusters, "cluster")
    c = ctx.clusters
    given = laps.withColumns({"given_tyre_life": F.col("tyre_life"), "given_race_progress": F.col("race_progress")})
    x, whole = _marked(with_laptime_normalized(ctx, given, mode), S.CLUSTER_FEATURES)
    a = assign(c.model, c.mapping, c.scaler.transform(x)).drop("features")
    a = a.withColumn("cluster", F.when(whole, F.col("cluster")))
    prof = ctx.dim("cluster_profiles", lambda: c.profiles.join(c.labels, "cluster").select(
        "cluster", "cluster_label", F.col("tyre_life_mean").alias("p_tyre_life_mean"),
        F.col("cumulative_degradation_mean").alias("p_deg_mean")))
    j = a.join(prof, "cluster", "left")  # k rows
    return j.select(
        "row_key", F.col("cluster").alias("cluster_id"),
        F.coalesce(F.col("cluster_label"), F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
         .alias("cluster_label"),
        F.when(F.col("cluster").isNotNull(), interpretation(
            "lap_number", F.coalesce(F.col("cluster_label"), F.lit("?")), "p_tyre_life_mean", "p_deg_mean")).alias("interpretation"),
        F.col("given_tyre_life").alias("tyre_life"), F.col("given_race_progress").alias("race_progress"),
        F.col("lap_number").cast("int").alias("lap"), "missing")


def score_safety(ctx: ScoringContext, laps: DataFrame, mode: str = "live") -> DataFrame:
    """ML14: critical flag from the SVM and the calibrated probability (they may disagree) of every lap."""
    _require(ctx.safety, "safety")
    x, whole = _marked(with_risk(ctx, laps, mode).withColumn("given_risk", F.col("ers_risk")), S.SAFETY_FEATURES)
    p = ctx.safety.predict(x)
    return p.select("row_key", F.when(whole, F.col("prediction")).alias("is_critical"),
                    F.when(whole, F.round("probability_critical", 4)).alias("probability_critical"),
                    F.lit(ctx.safety.kernel).alias("kernel"), F.col("lap_number").cast("int").alias("lap"),
                    F.col("given_risk").alias("ers_risk"), "missing")


def critical_alerts(safety_rows: DataFrame) -> DataFrame:
    """K07 payload from safety scores: one alert per critical lap."""
    crit = safety_rows.filter(F.col("is_critical") == 1)
    return crit.select(
        "row_key", F.lit(C.STATUS_CRITICAL).alias("severity"),
        F.concat(F.lit("CRITICAL EVENT LAP "), F.col("lap").cast("string")).alias("title"),
        F.concat(F.lit("probability "), F.col("probability_critical").cast("string"), F.lit(", kernel "),
                 F.col("kernel")).alias("description"))
