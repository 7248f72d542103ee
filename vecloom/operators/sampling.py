"""Deterministic samples by hash order, bootstrap indices and confidence intervals."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.ranges import numbered
from vecloom.session import settle


def unit_hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that looks random and depends on the values and the seed only."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 53)) / float(1 << 53)


#: Rows that one bucket of hashes shall hold about, and the most buckets of a group.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 20


def _up_to_quota(rows: DataFrame, group: list[str], level: str) -> tuple[DataFrame, DataFrame]:
    """rows split by the ordered column `level`: those at values that fit the group's __quota whole, and those at
    the value where it is reached, with what is left of it. Only counts are shuffled."""
    at = [*group, level]
    n = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"), F.first("__quota").alias("__all"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy(level).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("__before", before).where(F.col("__before") < F.col("__all"))
    n = n.select(*[F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(at)], (F.col("__all") - F.col("__before")).alias("__left"), "__n")
    cond = F.lit(True)
    for i, c in enumerate(at):
        cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"__g{i}"))
    joined = rows.join(n, cond)
    whole = joined.where(F.col("__n") <= F.col("__left")).select(*rows.columns)
    cut = joined.where(F.col("__n") > F.col("__left")).select(*[c for c in rows.columns if c != "__quota"], F.col("__left").alias("__quota"))
    return whole, cut


def first_per_group(df: DataFrame, keys: list[str], ids: list[str], quota: Column | int, seed: int = 42) -> DataFrame:
    """The first `quota` rows of every group in the order of a hash of the ids: exactly min(quota, rows of the group).

    quota is a number, or a column that is constant in a group. The same rows
    at any partitioning; rows with equal ids follow a hash of all their
    columns, and rows equal in all are told apart by nothing. Rows are counted
    by ranges of the hash, and only the range where the quota is reached is
    looked at closer, so neither a hot group nor a hot id meets in one task.
    Null keys form a group, null ids are an id. A quota of 0 or less gives none.
    """
    columns = df.columns
    quota = F.lit(quota) if isinstance(quota, int) else quota
    buckets = max(1, min(MOST_BUCKETS, df.count() // BUCKET_ROWS))
    own = lambda c: F.pmod(F.col(c), F.lit(buckets)).cast("int")
    rows = df.withColumn("__quota", quota.cast("bigint")).withColumn("__u", F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in ids])).withColumn("__ub", own("__u"))
    levels = [("__ub", None), ("__u", None), ("__vb", own("__v")), ("__v", None)]
    out, group, cut = [], list(keys), rows
    for level, made in levels:
        if made is not None:
            cut = cut.withColumn("__v", F.xxhash64(F.lit(seed + 1), *[F.col(f"`{c}`") for c in columns])).withColumn(level, made)
        whole, cut = _up_to_quota(cut, group, level)
        out.append(whole.select(*columns))
        group.append(level)
        cut = settle(cut)  # at first about a bucket a group, and none at all once rows are told apart
        if cut.isEmpty():
            return reduce(DataFrame.unionByName, out)
    # Equal rows, as one with its number of copies.
    same = cut.groupBy(*cut.columns).agg(F.count(F.lit(1)).alias("__copies"))
    upto = F.sum("__copies").over(W.partitionBy(*group).orderBy("__quota").rowsBetween(W.unboundedPreceding, W.currentRow))
    take = F.least("__copies", F.col("__quota") - (upto - F.col("__copies")))
    same = same.withColumn("__take", take).where("__take > 0")
    out.append(same.select(*columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "__take")).alias("__copy")).drop("__copy"))
    return reduce(DataFrame.unionByName, out)


def cap_per_group(df: DataFrame, keys: list[str], ids: list[str], cap: int, seed: int = 42) -> DataFrame:
    """At most `cap` rows of every group: first_per_group() with one quota for all."""
    return first_per_group(df, keys, ids, cap, seed)


def pool(df: DataFrame, ids: list[str], n: int, seed: int = 42) -> DataFrame:
    """n rows (all if fewer) with a dense global_idx from 0 in hash order; rows that are equal in their ids are numbered arbitrarily."""
    kept = first_per_group(df, [], ids, n, seed).withColumn("__u", unit_hash(seed, *[F.col(f"`{c}`") for c in ids]))
    return numbered(kept, [], ["__u", *ids], "global_idx").withColumn("global_idx", F.col("global_idx") - 1).drop("__u")


def subsamples(pooled: DataFrame, ids: list[str], n_points: int, m: int, seed: int = 42) -> DataFrame:
    """point_id and the rows of n_points samples of m rows without replacement; an error if there are fewer than m rows.

    The pool may be a whole table: of each sample, only counts by hash are shuffled.
    """
    n = pooled.count()
    if m > n:
        raise ValueError(f"samples of {m} rows from {n}")
    points = pooled.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("point_id"))
    return first_per_group(points, ["point_id"], ["point_id", *ids], m, seed)


def bootstrap_draw(n: int, m: int, replicate: int, seed: int = 42) -> np.ndarray:
    """The m draws with replacement from n of one replicate: the same for all layers of a class, in any task."""
    return np.random.default_rng([seed, replicate]).integers(0, n, size=m)


def confidence(df: DataFrame, keys: list[str], value: str, lo: float = 0.025, hi: float = 0.975) -> DataFrame:
    """mean, ci_low, ci_high of the replicates of every group; NaN and null replicates are left out."""
    x = F.when(~F.isnan(f"`{value}`"), F.col(f"`{value}`"))
    p = F.percentile(x, F.array(F.lit(lo), F.lit(hi)))
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), p[0].alias("ci_low"), p[1].alias("ci_high"))


def balanced_frequency(df: DataFrame, cls: str, ids: list[str], seed: int = 42) -> DataFrame:
    """Every class cut to the number of rows of the smallest one."""
    least = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    return cap_per_group(df, [cls], ids, int(least or 0), seed)


def balanced_types(df: DataFrame, cls: str, type_col: str, seed: int = 42) -> DataFrame:
    """Every class cut to the rows of as many types as the class with the fewest types has."""
    types = df.where(F.col(type_col).isNotNull()).select(cls, type_col).distinct()
    least = types.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    kept = cap_per_group(types, [cls], [type_col], int(least or 0), seed)
    return df.join(kept, [cls, type_col], "left_semi")
