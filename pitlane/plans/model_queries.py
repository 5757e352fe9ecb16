"""Registered model and scoring queries.

Each model family is fitted by itself, once per application and input, when the
first query asks for it; a scoring query needs the family that it scores with,
those of all scorers need three and not the forest. All families read one stored training frame.
"""

from __future__ import annotations

import os
import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from pitlane import schemas as S
from pitlane.operators.stored import stored
from pitlane.plans.catalog import laps, prepared, query
from pitlane.plans.oracle_sql import r, with_ctes
from pitlane.plans.scoring import ScoringContext
from pitlane.plans.train_all import TrainingRun, run_training, scoring_context

_RUNS: dict[tuple[str, str, str], TrainingRun] = {}
_CONTEXTS: dict[tuple, ScoringContext] = {}
_LOCKS: dict[tuple, threading.RLock] = {}
_LOCK = threading.Lock()


def _key(spark, sf) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf if "://" in sf else os.path.abspath(sf)


def _once(cache: dict, key: tuple, build):
    """cache[key], built by the first that asks; others that ask for the same key wait, those for another do not."""
    with _LOCK:
        lock = _LOCKS.setdefault(key, threading.RLock())
    with lock:
        if key not in cache:
            cache[key] = build()
        return cache[key]


def family(spark, sf, name: str) -> TrainingRun:
    """The training run of one family: linear, forest, tree, clusters or safety."""
    key = (*_key(spark, sf), name)
    frame = lambda: stored(spark, sf, "prepared", lambda: prepared(spark, sf))
    return _once(_RUNS, key, lambda: run_training(laps(spark, sf), run_id=f"q{abs(hash(key)) % 10**8}", which=(name,), prepared=frame()))


def context(spark, sf, names=("tree", "clusters", "safety")) -> ScoringContext:
    """The fitted models that score laps, of the families named. They are fitted side by side: each has stretches of small jobs or
    of a single task, which leave cores to the others."""
    def build():
        with ThreadPoolExecutor(len(names)) as pool:
            return scoring_context(**dict(zip(names, pool.map(lambda n: family(spark, sf, n), names))))

    return _once(_CONTEXTS, (*_key(spark, sf), *names), build)


@query("model_linear_regression")
def q_model_linear_regression(spark, sf):
    """ML01 + ML02: least-squares predictions on the test split."""
    scored = family(spark, sf, "linear").regression.test_scored
    return scored.select("row_key", F.col(S.REGRESSION_TARGET).alias("real"), F.col("pred_lr").alias("predicted"))


@query("model_random_forest")
def q_model_random_forest(spark, sf):
    """ML03: predictions of the forest without a depth limit on the test split."""
    scored = family(spark, sf, "forest").regression.test_scored
    return scored.select("row_key", F.col(S.REGRESSION_TARGET).alias("real"), F.col("pred_rf").alias("predicted"))


@query("model_decision_tree")
def q_model_decision_tree(spark, sf):
    """ML04: predicted status and class probabilities on the test split."""
    t = family(spark, sf, "tree").tree
    return t.test_scored.select("row_key", S.TREE_TARGET, "predicted_status", "prob_normal", "prob_alerta",
                                "prob_critico")


@query("tree_nodes")
def q_tree_nodes(spark, sf):
    """ML15: the fitted tree as a node table (split, children, rows, impurity, gain, prediction)."""
    from pitlane.plans.tree import tree_nodes
    return tree_nodes(spark, family(spark, sf, "tree").tree.model)


_CLASSES = ["ALERTA", "CRÍTICO", "NORMAL"]  # in order of their names
_TREE_ROWS = " AND ".join(f"{c} IS NOT NULL" for c in [*S.TREE_FEATURES, S.TREE_TARGET])
_TREE_VALUES = " UNION ALL ".join(f"SELECT {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, {S.TREE_TARGET} AS label FROM enc WHERE {_TREE_ROWS}"
                                  for i, c in enumerate(S.TREE_FEATURES))


def _half(sides: list[str]) -> str:
    return f"CAST({' + '.join(f'({c}) * ({c})' for c in sides)} AS DOUBLE) / ({' + '.join(f'({c})' for c in sides)})"


@query("tree_root_split", with_ctes(["enc"], f"""
SELECT feature, {r("threshold", 9)} AS threshold, {r("score", 4)} AS score, n_left FROM (
  SELECT *, row_number() OVER (PARTITION BY f ORDER BY score DESC, v) AS place FROM (
    SELECT f, feature, v, v / 2 + nxt / 2 AS threshold, {_half(["l0", "l1", "l2"])} + {_half(["a0 - l0", "a1 - l1", "a2 - l2"])} AS score,
           l0 + l1 + l2 AS n_left
    FROM (SELECT *, lead(v) OVER (PARTITION BY f ORDER BY v) AS nxt, {", ".join(
        f"CAST(sum(c{i}) OVER (PARTITION BY f ORDER BY v) AS BIGINT) AS l{i}, CAST(sum(c{i}) OVER (PARTITION BY f) AS BIGINT) AS a{i}" for i in range(3))}
          FROM (SELECT f, feature, v, {", ".join(f"count(*) FILTER (label = '{c}') AS c{i}" for i, c in enumerate(_CLASSES))}
                FROM ({_TREE_VALUES}) GROUP BY f, feature, v)) WHERE nxt IS NOT NULL)) WHERE place = 1"""))
def q_tree_root_split(spark, sf):
    """ML04: for every feature the threshold of all laps that parts the status classes best, without bins."""
    from pitlane.functions.numeric import round_half_up as rh
    from pitlane.plans.cart import split_scores
    from pitlane.plans.tree import tree_frame
    scores = split_scores(tree_frame(prepared(spark, sf)), S.TREE_FEATURES, S.TREE_TARGET, _CLASSES, F.lit(1).cast("long"))
    best = scores.groupBy("f").agg(F.max(F.struct("score", (-F.col("v")).alias("v"), "threshold", *(f"left_{i}" for i in range(3)))).alias("s"))
    names = F.array(*[F.lit(c) for c in S.TREE_FEATURES])
    return best.select(names[F.col("f")].alias("feature"), rh("s.threshold", 9).alias("threshold"), rh("s.score", 4).alias("score"),
                       sum((F.col(f"s.left_{i}") for i in range(3)), F.lit(0)).alias("n_left"))


@query("model_kmeans")
def q_model_kmeans(spark, sf):
    """ML05: cluster of every complete row, with its label."""
    c = family(spark, sf, "clusters").clusters
    return c.assigned.select("row_key", "cluster").join(c.labels, "cluster", "left")


@query("kmeans_sweep")
def q_kmeans_sweep(spark, sf):
    """ML06 + E05 + E06 + T10: inertia and silhouette per k, with the chosen k flagged."""
    c = family(spark, sf, "clusters").clusters
    rows = [(k, float(c.inertias[k]), float(c.silhouettes[k]), k == c.optimal_k) for k in sorted(c.silhouettes)]
    return spark.createDataFrame(rows, "k int, inertia double, silhouette double, chosen boolean")


@query("pca_projection")
def q_pca_projection(spark, sf):
    """ML07: two principal components of the standardised clustering features."""
    from pitlane.plans.clusters import pca_projection
    c = family(spark, sf, "clusters").clusters
    scaled = c.scaler.transform(c.assigned.drop("features"))
    return pca_projection(c.pca, scaled)


def _svm(spark, sf, kernel):
    """Predictions on the run's own test part."""
    return family(spark, sf, "safety").safety.test_by_kernel[kernel].select(
        "row_key", S.SAFETY_TARGET, "prediction", "margin", "probability_critical")


@query("model_svm_linear")
def q_model_svm_linear(spark, sf):
    """ML08 + ML10: weighted linear SVM on the test split."""
    return _svm(spark, sf, "linear")


@query("model_svm_rbf")
def q_model_svm_rbf(spark, sf):
    """ML09: RBF kernel machine of all training rows."""
    return _svm(spark, sf, "rbf")


@query("svm_probability")
def q_svm_probability(spark, sf):
    """ML11: Platt-calibrated probability of the selected kernel (monotone in the margin)."""
    run = family(spark, sf, "safety")
    return _svm(spark, sf, run.safety.best.kernel).select("row_key", "margin", "probability_critical")


@query("score_risk_class")
def q_score_risk_class(spark, sf):
    """ML12: tree scores of every lap (classification_results rows)."""
    from pitlane.plans.scoring import score_risk_class
    return score_risk_class(context(spark, sf, ("tree",)), laps(spark, sf))


@query("score_clusters")
def q_score_clusters(spark, sf):
    """ML13: cluster assignment of every lap (cluster_assignments rows)."""
    from pitlane.plans.scoring import score_clusters
    return score_clusters(context(spark, sf, ("clusters",)), laps(spark, sf))


@query("score_safety")
def q_score_safety(spark, sf):
    """ML14: critical-event scores of every lap (safety_events rows)."""
    from pitlane.plans.scoring import score_safety
    return score_safety(context(spark, sf, ("safety",)), laps(spark, sf))


@query("score_accounting", with_ctes(
    ["laps"], "SELECT 'clusters' AS scorer, count(*) AS n, count(*) FILTER (WHERE cumulative_degradation IS NULL OR tyre_life IS NULL "
              "OR lap_time_s IS NULL) AS n_missing FROM laps UNION ALL SELECT 'risk_class', count(*), count(*) FILTER (WHERE "
              "normalized_tyre_life IS NULL OR race_progress IS NULL OR lap_time_delta IS NULL OR tyre_life IS NULL) FROM laps "
              "UNION ALL SELECT 'safety', count(*), count(*) FILTER (WHERE lap_time_delta IS NULL OR race_progress IS NULL OR tyre_life IS NULL) FROM laps"))
def q_score_accounting(spark, sf):
    """ML12-ML14: every lap has one row from each scorer; those with a missing feature have no prediction."""
    from pitlane.plans.scoring import score_clusters, score_risk_class, score_safety
    ctx, lp = context(spark, sf), laps(spark, sf)
    out = [rows.agg(F.lit(name).alias("scorer"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(pred).isNull()).alias("n_missing"))
           for name, pred, rows in (("risk_class", "ers_status_predicted", score_risk_class(ctx, lp)), ("clusters", "cluster_id", score_clusters(ctx, lp)),
                                    ("safety", "is_critical", score_safety(ctx, lp)))]
    return out[0].unionByName(out[1]).unionByName(out[2])
