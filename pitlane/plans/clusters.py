"""Stint clustering: k sweep on a sample, best-of-n k-means on all rows, profiles, labels, PCA
(ML05-ML07, A12, F17, E05, E06, T05, T10)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane import constants as C
from pitlane import schemas as S
from pitlane.functions import lookup
from pitlane.functions.numeric import round_even
from pitlane.operators.dims import materialize
from pitlane.operators.evaluate import silhouette
from pitlane.operators.sampling import hash_sample
from pitlane.plans.lloyd import best_of, drawn, fit_all, sample_points
from pitlane.plans.models import Standardizer

#: Passes after which a fit stops if its centres still move.
MAX_ITERATIONS = 300


def cluster_profiles(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Per cluster the four rounded means and the row count (one aggregate)."""
    return df.groupBy(cluster).agg(
        round_even(F.avg("compound_encoded"), 3).alias("compound_encoded_mean"),
        round_even(F.avg("tyre_life"), 2).alias("tyre_life_mean"),
        round_even(F.avg("laptime_normalized"), 4).alias("laptime_normalized_mean"),
        round_even(F.avg("cumulative_degradation"), 3).alias("cumulative_degradation_mean"),
        F.count(F.lit(1)).alias("count"),
    )


def profile_labels(profiles: DataFrame, cluster: str = "cluster") -> DataFrame:
    """F17 over the rounded profiles."""
    return profiles.select(cluster, lookup.cluster_label(
        "compound_encoded_mean", "tyre_life_mean", "laptime_normalized_mean", "cumulative_degradation_mean"
    ).alias("cluster_label"))


def cluster_frame(prepared: DataFrame) -> DataFrame:
    """Rows with complete clustering features and the compound code (P09 for clustering)."""
    return prepared.na.drop(subset=S.CLUSTER_FEATURES + ["compound_encoded"])


@dataclass
class Centroids:
    """A fitted k-means model as plain centres; assignment is a column expression (argmin of squared
    Euclidean distance), so it runs in whole-stage codegen in batch and streaming plans alike."""

    centres: list[list[float]]

    def distances(self, v: Column) -> list[Column]:
        """Squared distances of an array column to every centre."""
        return [sum((v[j] - F.lit(float(c[j]))) * (v[j] - F.lit(float(c[j]))) for j in range(len(c)))
                for c in self.centres]

    def transform(self, df: DataFrame, features: str = "features", out: str = "cluster") -> DataFrame:
        d = self.distances(F.col("_point"))
        best = F.array_min(F.array(*[F.struct(dk.alias("d"), F.lit(k).alias("k")) for k, dk in enumerate(d)]))
        # The array is a column of its own, so that a row's vector is turned into it once, not at each use.
        return df.withColumn("_point", vector_to_array(features)).withColumn(out, best.getField("k").cast("int")).drop("_point")

    def cost(self, df: DataFrame, features: str = "features") -> float:
        points = df.select(vector_to_array(features).alias("_point"))
        return float(points.agg(F.sum(F.least(*self.distances(F.col("_point"))))).first()[0] or 0.0)

    def sorted(self) -> "Centroids":
        """Stable ids: centres in lexicographic order."""
        return Centroids(sorted(self.centres))


@dataclass
class ClusterResult:
    scaler: Standardizer
    model: Centroids
    mapping: dict[int, int]
    optimal_k: int
    silhouettes: dict[int, float]
    inertias: dict[int, float]
    assigned: DataFrame
    profiles: DataFrame
    labels: DataFrame
    pca: PCAModel | None = None
    metrics: dict = field(default_factory=dict)


def assign(model, mapping: dict[int, int], scaled: DataFrame) -> DataFrame:
    """Cluster id of every row (`mapping` renumbers model ids; identity for sorted Centroids)."""
    out = model.transform(scaled)
    if all(k == v for k, v in mapping.items()):
        return out.withColumn("cluster", F.col("cluster").cast("int"))
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return out.withColumn("cluster", m[F.col("cluster")].cast("int"))


def kmeans_sweep(scaled: DataFrame, k_range=C.KMEANS_K_RANGE, sample_size: int = C.KMEANS_SWEEP_SAMPLE,
                 n_init: int = 10, seed: int = 42, max_iter: int = MAX_ITERATIONS):
    """ML06: per k, the best-of-n fit on a hash sample; inertia (E06) and Euclidean silhouette.

    All fits share their passes over the bounded sample (few partitions: a pass is
    dominated by its job), and the silhouette distances are computed once for all k
    (seven labelings at once). The third value are all fits, which go on on all rows, the
    fourth the points of the sample that cut all rows into packs: those of least hash, as
    a sample of all rows would have them.
    """
    sample = materialize(hash_sample(scaled, sample_size).coalesce(4))
    every = fit_all(sample, drawn(sample, list(k_range), n_init, seed), max_iter)
    fits = best_of(every)
    models = {k: Centroids(fits[k].centres.tolist()).sorted() for k in k_range}
    inertias, labelled = {k: fits[k].cost for k in k_range}, sample
    for k in k_range:
        labelled = models[k].transform(labelled, out=f"k{k}")
    arr = labelled.withColumn("_v", vector_to_array("features"))
    d = len(models[k_range[0]].centres[0])
    pts = arr.select("row_key", *[F.col("_v")[i].alias(f"x{i}") for i in range(d)], *[f"k{k}" for k in k_range])
    sil_row = silhouette(pts, [f"x{i}" for i in range(d)], [f"k{k}" for k in k_range],
                         max_points=sample_size).first()
    silhouettes = {k: round(float(sil_row[f"k{k}"]), 4) for k in k_range}
    return silhouettes, inertias, every, sample_points(sample)


def choose_k(silhouettes: dict[int, float]) -> int:
    """Highest silhouette; a tie takes the smallest k."""
    return sorted(silhouettes.items(), key=lambda kv: (-kv[1], kv[0]))[0][0]


def train_clusters(prepared: DataFrame, n_init: int = 10, seed: int = 42, sample_size: int = C.KMEANS_SWEEP_SAMPLE,
                   k_range=C.KMEANS_K_RANGE, max_iter: int = MAX_ITERATIONS, with_pca: bool = True) -> ClusterResult:
    data = cluster_frame(prepared)
    scaler = Standardizer.fit(data, S.CLUSTER_FEATURES)
    scaled = scaler.transform(data)  # cheap columns of the written training frame: no copy of it
    sil, inert, every, points = kmeans_sweep(scaled, k_range, sample_size, n_init, seed, max_iter)
    k = choose_k(sil)
    # ML05: every start goes on from where the sample took it, on all rows, to convergence; the lowest cost over them is kept.
    best = best_of(fit_all(scaled, [f for f in every if f.k == k], max_iter, packed=True, points=points))[k]
    model = Centroids(best.centres.tolist()).sorted()
    mapping = {i: i for i in range(k)}
    assigned = assign(model, mapping, scaled)
    profiles = materialize(cluster_profiles(assigned))  # k rows, which every later use reads
    labels = profile_labels(profiles)
    pca = PCA(k=2, inputCol="features", outputCol="pca").fit(scaled) if with_pca else None
    prof_rows = {r["cluster"]: r.asDict() for r in profiles.collect()}  # k rows
    label_rows = {r["cluster"]: r["cluster_label"] for r in labels.collect()}
    metrics = {
        "algorithm": "KMeans", "objective": "within-cluster sum of squares", "features": S.CLUSTER_FEATURES, "optimal_k": k,
        "silhouette_score": sil[k], "inertias": {str(kk): round(v, 2) for kk, v in inert.items()},
        "silhouettes": {str(kk): v for kk, v in sil.items()},
        "cluster_profiles": {str(c): {kk: vv for kk, vv in p.items() if kk != "cluster"} for c, p in prof_rows.items()},
        "cluster_labels": {str(c): lab for c, lab in label_rows.items()},
        "n_total": int(sum(p["count"] for p in prof_rows.values())),
        "inertia_full": best.cost, "centres": model.centres,
    }
    return ClusterResult(scaler, model, mapping, k, sil, inert, assigned, profiles, labels, pca, metrics)


def pca_projection(pca: PCAModel, scaled: DataFrame) -> DataFrame:
    """ML07: two components; the sign of each is fixed so that its largest-magnitude loading is positive."""
    pc = pca.pc.toArray()  # d x 2
    signs = [1.0 if pc[abs(pc[:, j]).argmax(), j] >= 0 else -1.0 for j in range(pc.shape[1])]
    out = pca.transform(scaled).withColumn("_p", vector_to_array("pca"))
    return out.select("row_key", "cluster", *[(F.col("_p")[j] * F.lit(signs[j])).alias(f"pc{j + 1}")
                                               for j in range(pc.shape[1])])
