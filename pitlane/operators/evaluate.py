"""Evaluation operators (E01-E06, T09-T11): all aggregates, no per-row Python except the silhouette blocks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlane.operators.dims import materialize, scalar
from pitlane.operators.sampling import hash_sample

# The silhouette block function runs in Python workers; ship this module's code by
# value so workers do not need the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, MSE and R^2 in one aggregate pass.

    The total sum of squares is n * var_pop(y): Spark's central-moment aggregate
    is numerically stable and needs no second pass for the mean.
    """
    return df.agg(*_regression_aggregates(y, p), F.count(F.lit(1)).alias("n"))


def _regression_aggregates(y: str, p: str, prefix: str = "") -> list[Column]:
    e = F.col(y) - F.col(p)
    return [F.avg(F.abs(e)).alias(f"{prefix}mae"), F.avg(e * e).alias(f"{prefix}mse"),
            (F.lit(1.0) - F.sum(e * e) / (F.var_pop(y) * F.count(F.lit(1)))).alias(f"{prefix}r2")]


def regression_metrics_of(df: DataFrame, y: str, predictions: dict[str, str]) -> DataFrame:
    """E01 of several predictors of the same rows in one pass: columns <name>_mae, <name>_mse, <name>_r2, and n."""
    return df.agg(*[c for name, p in predictions.items() for c in _regression_aggregates(y, p, f"{name}_")], F.count(F.lit(1)).alias("n"))


def _safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """E02 + E03: per-class precision/recall/F1/support, macro and weighted averages, accuracy.

    The input is read once, for its counts by (truth, predicted) pair; all rows of the report come from that
    small frame. Zero division gives 0. Labels are compared as text.
    """
    pairs = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(pred).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs)  # classes squared rows
    side = F.explode(F.array(
        F.struct(F.col("t").alias("label"), F.col("n").alias("sup"), F.lit(0).cast("bigint").alias("prd"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("sup"), F.col("n").alias("prd"), F.lit(0).cast("bigint").alias("tp"))))
    c = (pairs.select(side.alias("x")).groupBy(F.col("x.label").alias("label"))
         .agg(F.sum("x.sup").alias("support"), F.sum("x.prd").alias("predicted"), F.sum("x.tp").alias("tp")))
    per = c.select(
        "label",
        _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
        _safe_div(F.col("tp"), F.col("support")).alias("recall"),
        "support",
    ).withColumn("f1", _safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    per = per.select("label", "precision", "recall", "f1", "support")
    total = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       (F.sum(F.col("precision") * F.col("support")) / total).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / total).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / total).alias("f1"), total.alias("support"))
    same = F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), F.col("n"))
    acc = pairs.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                    F.lit(None).cast("double").alias("recall"),
                    (F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum(same)).alias("f1"),
                    F.sum("n").alias("support"))
    return per.unionByName(macro).unionByName(weighted).unionByName(acc)


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts over all (truth, predicted) label pairs, zero-filled.

    The label set (a handful of classes) is one array built by a scalar subquery;
    the pair grid is produced by exploding it twice -- a k*k dimension, never a
    join of the data with itself.
    """
    t, p = F.col(truth).cast("string"), F.col(pred).cast("string")
    labels = scalar(df, F.array_sort(F.array_union(F.collect_set(t), F.collect_set(p))))
    grid = (df.sparkSession.range(1).select(F.explode(labels).alias("truth"))
            .select("truth", F.explode(labels).alias("predicted")))
    counts = df.groupBy(t.alias("truth"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return (grid.join(counts, ["truth", "predicted"], "left")
            .select("truth", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def _silhouette_blocks(points: np.ndarray, labelings: np.ndarray):
    """Per-point silhouette for each labeling against the broadcast sample.

    points: n x d, labelings: m x n (int). Returns a function for mapInPandas.
    """
    def run(batches):
        for pdf in batches:
            idx = pdf["_i"].to_numpy()
            out = np.zeros((len(idx), labelings.shape[0]))
            for s in range(0, len(idx), 128):
                blk = idx[s:s + 128]
                dist = np.zeros((len(blk), len(points)))
                for x in points.T:  # exact Euclidean, block x n, one dimension after the other
                    diff = x[blk][:, None] - x[None, :]
                    dist += diff * diff
                dist = np.sqrt(dist)
                for j, lab in enumerate(labelings):
                    ks = np.unique(lab)
                    onehot = (lab[:, None] == ks[None, :]).astype(np.float64)
                    sums = dist @ onehot
                    cnt = onehot.sum(0)
                    own = np.searchsorted(ks, lab[blk])
                    rows = np.arange(len(blk))
                    own_cnt = cnt[own]
                    a = np.where(own_cnt > 1, sums[rows, own] / np.maximum(own_cnt - 1, 1), 0.0)
                    mean_other = sums / cnt[None, :]
                    mean_other[rows, own] = np.inf
                    b = mean_other.min(1) if len(ks) > 1 else np.zeros(len(blk))
                    den = np.maximum(a, b)
                    sil = np.where((own_cnt > 1) & (den > 0), (b - a) / np.where(den > 0, den, 1.0), 0.0)
                    out[s:s + len(blk), j] = sil
            yield pd.DataFrame({f"s{j}": out[:, j] for j in range(labelings.shape[0])})
    return run


def silhouette(df: DataFrame, features: list[str], label_cols: list[str], key: str = "row_key",
               max_points: int = 20_000, blocks: int = 64) -> DataFrame:
    """Mean silhouette with plain Euclidean distance, one value per labeling column.

    Spark's evaluator only offers squared Euclidean/cosine. Exact Euclidean
    silhouette needs all pairwise distances, so it runs on a hash sample of at
    most `max_points` rows (the bounded broadcast: max_points*d doubles); the
    points are split into `blocks` tasks and each computes its rows' distances
    to the sample in numpy blocks. Distances are computed once and reused for
    every labeling (the k sweep passes seven labelings at once).
    """
    spark = df.sparkSession
    sample = hash_sample(df.select(key, *features, *label_cols), max_points, key=key).toPandas()
    pts = sample[features].to_numpy(dtype=np.float64)
    labs = np.stack([sample[c].to_numpy().astype(np.int64) for c in label_cols]) if label_cols else np.zeros((0, 0))
    bc_pts = spark.sparkContext.broadcast(pts)
    bc_labs = spark.sparkContext.broadcast(labs)
    n = len(sample)

    def run(batches):
        yield from _silhouette_blocks(bc_pts.value, bc_labs.value)(batches)

    schema = T.StructType([T.StructField(f"s{j}", T.DoubleType()) for j in range(len(label_cols))])
    idx = spark.range(n, numPartitions=max(1, min(blocks, n))).select(F.col("id").alias("_i"))
    per_point = idx.mapInPandas(run, schema)
    return per_point.agg(*[F.avg(f"s{j}").alias(c) for j, c in enumerate(label_cols)])


def real_vs_predicted(df: DataFrame, real: str, pred: str, key: str = "row_key", n: int = 60):
    """The first n (real, predicted) pairs in key order and the diagonal's min/max (as tables)."""
    head = df.select(key, F.col(real).alias("real"), F.col(pred).alias("predicted")).orderBy(key).limit(n)
    diag = df.agg(F.least(F.min(real), F.min(pred)).alias("lo"), F.greatest(F.max(real), F.max(pred)).alias("hi"))
    return head, diag
