"""Outlier dimensions of layer means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def outlier_dimensions(means: DataFrame, layer: str, model: str | None = None, z: float = 3.0) -> DataFrame:
    """layer, n_outliers, overlap_prev, mean_exceed (and the model, if one is named).

    means: layer, dim, mean. A dimension is an outlier of a layer if its mean
    is at least mu + z sigma, over all layers and dimensions (sigma of the
    population). The first layer overlaps with none; without outliers the mean
    excess is 0. The limits come from one aggregation of the means, joined back
    as a row per model.
    """
    keys = [model] if model else []
    lim = means.groupBy(*keys).agg((F.avg("mean") + F.lit(z) * F.stddev_pop("mean")).alias("thr"))
    m = means.join(F.broadcast(lim), keys) if keys else means.crossJoin(F.broadcast(lim))  # a row per model
    m = m.withColumn("mask", F.col("mean") >= F.col("thr"))
    m = m.withColumn("before", F.lag("mask", 1, False).over(W.partitionBy(*keys, "dim").orderBy(layer)))
    return m.groupBy(*keys, layer).agg(
        F.sum(F.col("mask").cast("bigint")).alias("n_outliers"),
        F.sum((F.col("mask") & F.col("before")).cast("bigint")).alias("overlap_prev"),
        F.coalesce(F.avg(F.when(F.col("mask"), F.col("mean") - F.col("thr"))), F.lit(0.0)).alias("mean_exceed"),
    )
