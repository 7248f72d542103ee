"""Synthetic manifolds of known dimension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Name, true dimension, notes.
CATALOG = (
    ("IG-16", 16, "isotropic Gaussian in 16 dimensions"),
    ("AG-16", 16, "anisotropic Gaussian in 16 dimensions, condition number 100"),
    ("LR-4-in-64", 4, "4-dimensional subspace of 64 dimensions with noise 1e-3"),
    ("SR-2", 2, "Swiss roll in 3 dimensions"),
)


def isotropic(n: int, d: int = 16, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((n, d))


def anisotropic(n: int, d: int = 16, condition: float = 100.0, seed: int = 42) -> np.ndarray:
    """Variances fall geometrically from condition to 1."""
    return np.random.default_rng(seed).standard_normal((n, d)) * np.sqrt(np.geomspace(condition, 1.0, d))


def subspace(n: int, d: int = 64, rank: int = 4, noise: float = 1e-3, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((d, rank)))[0]
    return rng.standard_normal((n, rank)) @ basis.T + noise * rng.standard_normal((n, d))


def swiss_roll(n: int, noise: float = 0.0, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    t, h = 1.5 * np.pi * (1 + 2 * rng.random(n)), 21 * rng.random(n)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], axis=1)
    return x + noise * rng.standard_normal(x.shape)


MAKERS = {"IG-16": isotropic, "AG-16": anisotropic, "LR-4-in-64": subspace, "SR-2": swiss_roll}


def points(spark: SparkSession, n: int = 4000, seed: int = 42) -> DataFrame:
    """manifold, point_id, vec of all manifolds; each is made in one task, so n bounds it."""
    made = spark.createDataFrame([(m,) for m, _, _ in CATALOG], "manifold string").repartition(len(CATALOG), "manifold")

    def make(pdf):
        import pandas as pd

        x = MAKERS[pdf.manifold.iloc[0]](n, seed=seed)
        return pd.DataFrame({"manifold": pdf.manifold.iloc[0], "point_id": np.arange(n), "vec": list(x)})

    return made.groupBy("manifold").applyInPandas(make, "manifold string, point_id bigint, vec array<double>")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATALOG), "manifold string, true_id int, notes string")


def swiss_roll_expr(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """The Swiss roll of any size, by column expressions."""
    df = spark.range(n).select(F.col("id").alias("point_id"), (1.5 * np.pi * (1 + 2 * F.rand(seed))).alias("t"), (21 * F.rand(seed + 1)).alias("h"))
    return df.select("point_id", F.array(F.col("t") * F.cos("t"), F.col("h"), F.col("t") * F.sin("t")).alias("vec"))
