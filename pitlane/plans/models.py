"""Model building blocks shared by the four model families (ML01, ML10, ML11).

Fitting statistics (means, standard deviations, class counts) are one
aggregate each; only those few numbers reach the driver, as model parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlane.operators.dims import join_dim, scalar


@dataclass
class Standardizer:
    """ML01: mean 0 and population standard deviation 1 (a zero deviation scales by 1)."""

    features: list[str]
    means: list[float]
    stds: list[float]

    @classmethod
    def fit(cls, df: DataFrame, features: list[str]) -> "Standardizer":
        aggs = []
        for c in features:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        row = df.agg(*aggs).first()
        means = [float(row[f"m_{c}"]) for c in features]
        stds = [float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0 for c in features]
        return cls(features, means, [s if s > 0 else 1.0 for s in stds])

    def columns(self, prefix: str = "z_") -> dict[str, Column]:
        return {f"{prefix}{c}": (F.col(c) - F.lit(m)) / F.lit(s)
                for c, m, s in zip(self.features, self.means, self.stds)}

    def transform(self, df: DataFrame, out: str = "features", keep_columns: bool = False) -> DataFrame:
        cols = self.columns()
        z = df.withColumns(cols)
        v = VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(z)
        return v if keep_columns else v.drop(*cols)

    def to_dict(self) -> dict:
        return {"features": self.features, "means": self.means, "stds": self.stds}

    @classmethod
    def from_dict(cls, d: dict) -> "Standardizer":
        return cls(list(d["features"]), list(d["means"]), list(d["stds"]))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """ML10: balanced weight n_total / (n_classes * n_class) per class (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = scalar(counts, F.sum("n"))
    k = scalar(counts, F.count(F.lit(1)))
    return counts.select(label, "n", (total.cast("double") / (k * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(label, F.col("weight").alias(out))
    return join_dim(df, w, label, "left")
