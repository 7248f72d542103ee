"""Counts, histograms and class profiles of token features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, c: Column | str, name: str = "value") -> DataFrame:
    """A row per non-null value with its count n."""
    col = F.col(f"`{c}`") if isinstance(c, str) else c
    return df.select(col.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, c: str, lo: int, hi: int, name: str = "bin", gate: bool = False) -> DataFrame:
    """Counts of the whole numbers lo..hi, 0 where there is none. The range is checked before rounding half to even.

    With `gate`, a column without any value has no rows instead of zeros.
    """
    if gate and df.where(F.col(f"`{c}`").isNotNull()).isEmpty():
        return df.sparkSession.createDataFrame([], f"`{name}` int, n bigint")
    x = F.col(f"`{c}`").cast("double")
    counts = value_counts(df.where(x.between(lo, hi)), F.bround(x, 0).cast("int"), name)
    domain = df.sparkSession.range(lo, hi + 1).select(F.col("id").cast("int").alias(name))
    return domain.join(counts, name, "left").select(name, F.coalesce("n", F.lit(0)).alias("n"))


def top_k(df: DataFrame, c: Column | str, k: int, name: str = "value") -> DataFrame:
    """The k commonest values; equal counts in the order of the values."""
    return value_counts(df, c, name).orderBy(F.desc("n"), F.asc(name)).limit(k)


def _feature_counts(df: DataFrame, cls: str, features: list[str]) -> DataFrame:
    """cls, feature, value, n by one pass: every feature is a row of the same partial aggregation."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("string").alias("value")) for f in features]))
    long = df.where(F.col(f"`{cls}`").isNotNull()).select(F.col(f"`{cls}`").alias("cls"), pairs.alias("p"))
    return long.where(F.col("p.value").isNotNull()).groupBy("cls", "p.feature", "p.value").agg(F.count(F.lit(1)).alias("n"))


def class_profile(df: DataFrame, cls: str, features: list[str], k: int = 1, types: str = "word_norm") -> DataFrame:
    """Long form: cls, n_tokens, n_types, feature, rank, value, n, pct for the k commonest values of every feature.

    pct is 100 n / n_tokens to two decimals. Equal counts fall to the smaller
    value, as a number where both are. The ranking window is over the distinct
    values of a class and feature, not over its tokens.
    """
    base = df.where(F.col(f"`{cls}`").isNotNull()).groupBy(F.col(f"`{cls}`").alias("cls")).agg(F.count(F.lit(1)).alias("n_tokens"), F.count_distinct(f"`{types}`").alias("n_types"))
    order = [F.desc("n"), F.col("value").try_cast("double").asc_nulls_last(), F.asc("value")]
    ranked = _feature_counts(df, cls, features).withColumn("rank", F.row_number().over(W.partitionBy("cls", "feature").orderBy(*order)))
    pct = F.round(F.lit(100.0) * F.col("n") / F.col("n_tokens"), 2)
    return ranked.where(F.col("rank") <= k).join(base, "cls").select("cls", "n_tokens", "n_types", "feature", "rank", "value", "n", pct.alias("pct"))


def class_profile_wide(df: DataFrame, cls: str, features: list[str], types: str = "word_norm") -> DataFrame:
    """cls, n_tokens, n_types, then top_X and top_X_pct for every feature X."""
    one = [x for f in features for x in (F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f"top_{f}"), F.max(F.when(F.col("feature") == f, F.col("pct"))).alias(f"top_{f}_pct"))]
    return class_profile(df, cls, features, 1, types).groupBy(F.col("cls").alias(cls), "n_tokens", "n_types").agg(*one)


def class_profile_lists(df: DataFrame, cls: str, features: list[str], k: int = 5, types: str = "word_norm") -> DataFrame:
    """cls, n_tokens, n_types, then top_X_vals, _counts and _pct lists of length up to k."""
    out = []
    for f in features:
        found = F.array_sort(F.collect_list(F.when(F.col("feature") == f, F.struct("rank", "value", "n", "pct"))))
        parts = {"vals": lambda x: x["value"], "counts": lambda x: x["n"], "pct": lambda x: x["pct"]}
        out += [F.transform(found, get).alias(f"top_{f}_{name}") for name, get in parts.items()]
    return class_profile(df, cls, features, k, types).groupBy(F.col("cls").alias(cls), "n_tokens", "n_types").agg(*out)
