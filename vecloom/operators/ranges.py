"""Numbers of rows in an order, without a task that orders a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.session import settle


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, weight: Column | None = None, total: str | None = None) -> DataFrame:
    """df with `name`: how many rows (or how much weight) of the group come up to a row, itself included, in the given order.

    Rows are put in ranges of the order; the rows of each range are counted and
    numbered on from the ranges before. `total` names a column for the sum of
    the group. Groups are found by equality, nulls among them. The order has to
    tell the rows apart, else equal ones are numbered arbitrarily.
    """
    df = df.withColumn("__w", F.lit(1).cast("bigint") if weight is None else weight)
    # Written, as the ranges must not change between reads.
    part = settle(df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id()))
    n = part.groupBy(*keys, "__p").agg(F.sum("__w").alias("__n"))
    own = W.partitionBy(*keys)  # a row per range of a group
    before = F.coalesce(F.sum("__n").over(own.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__p").alias("__q"), before.alias("__before"), F.sum("__n").over(own).alias("__all"))
    cond = F.col("__p") == F.col("__q")
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    place = F.sum("__w").over(W.partitionBy(*keys, "__p").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = part.withColumn("__at", place).join(n, cond)
    made = {name: F.col("__before") + F.col("__at")} | ({total: F.col("__all")} if total else {})
    return out.withColumns(made).drop("__w", "__p", "__q", "__at", "__before", "__all", *[f"__k{i}" for i in range(len(keys))])
