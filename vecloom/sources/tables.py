"""Reading annotated sentences, and writing result tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators.ranges import numbered
from vecloom.schema import METRIC_BY_CLASS, METRIC_BY_LAYER


def read_csv(spark: SparkSession, path: str | None = None, columns: list[str] | None = None, env: str = "CSV_PATH", schema: T.StructType | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV file with a header, quotes doubled inside quoted fields, fields of several lines; all columns as text.

    Without a path, the environment variable `env` names it. Only the named
    columns are read. A file whose fields may span lines is read by one task;
    where none does, multi_line=False lets Spark split it.
    """
    path = path or os.environ[env]
    r = spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"').option("escape", '"')
    df = (r.schema(schema) if schema else r).csv(path)
    return df.select(*[f"`{c}`" for c in columns]) if columns else df


def write_csv(df: DataFrame, path: str) -> None:
    """A table as CSV with a header, quotes doubled inside quoted fields, as read_csv() takes it; null and empty text are both empty fields."""
    df.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A parquet, ORC, JSON or CSV table, by the ending of its name unless fmt says."""
    fmt = fmt or path.rstrip("/").rpartition(".")[2]
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt not in ("parquet", "orc", "json"):
        raise ValueError(f"format {fmt!r} is not known")
    return spark.read.format(fmt).load(path)


def first_rows(df: DataFrame, key: str, n: int | None) -> DataFrame:
    """The n rows of the smallest keys; all for None."""
    return df if n is None else df.orderBy(key).limit(n)


def finite_or_null(c):
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def result_rows(stats: DataFrame, subset: str, model: str, feature: str, cls: str, layer: str, word_rep_mode: str, source: str) -> DataFrame:
    """Statistics in the twelve columns of the metric-by-class table; values that are not finite are null."""
    return stats.select(
        F.lit(subset).alias("subset"), F.lit(model).alias("model"), F.lit(feature).alias("feature"), F.col(cls).cast("string").alias("class"), "metric",
        F.col(layer).cast("int").alias("layer"), *[finite_or_null(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")],
        F.col("n_tokens").cast("bigint").alias("n_tokens"), F.lit(word_rep_mode).alias("word_rep_mode"), F.lit(source).alias("source_csv"),
    ).select(*METRIC_BY_CLASS)


def layer_rows(stats: DataFrame, model: str, tag: str, layer: str, word_rep_mode: str, source: str) -> DataFrame:
    """Statistics in the ten columns of the metric-by-layer table."""
    return stats.select(
        F.lit(model).alias("model"), F.lit(tag).alias("model_tag"), F.lit(word_rep_mode).alias("word_rep_mode"), "metric", F.col(layer).cast("int").alias("layer"),
        *[finite_or_null(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")], F.col("n_tokens").cast("bigint").alias("n_tokens"), F.lit(source).alias("source_csv"),
    ).select(*METRIC_BY_LAYER)


def write_results(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Result rows as one folder per subset, metric and model, named by_X; the files keep all columns."""
    by = ["subset", "metric", "model"]
    by = {f"by_{c}": F.col(c) for c in by if c in rows.columns}
    w = rows.withColumns(by).repartition(*by).write.mode("overwrite").partitionBy(*by)
    w.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def missing_vectors(tokens: DataFrame, vectors: DataFrame, keys: list[str]) -> int:
    """Number of tokens without a vector."""
    return tokens.join(vectors, keys, "left_anti").count()


def dense_id(df: DataFrame, order: list[str], name: str = "token_id") -> DataFrame:
    """df with a dense id from 0 in the given order, without a task that orders all rows.

    Rows are put in ranges of the order; the rows of each range are counted and
    numbered on from the ranges before.
    """
    return numbered(df, [], order, name).withColumn(name, (F.col(name) - 1).cast("bigint"))
