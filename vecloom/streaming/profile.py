"""Token profiles kept up to date while sentences arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.hotkeys import tag


def tag_counts(tokens: DataFrame, time: str = "loaded_at", window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tokens per tag and window of arrival; the state of a window is dropped `late` after its end.

    Works on a stream and on a table. Null tags and null times have no row.
    """
    rows = tokens.where(F.col(time).isNotNull()).withColumn("tag", tag("pos")).where(F.col("tag").isNotNull())
    if rows.isStreaming:
        rows = rows.withWatermark(time, late)
    return rows.groupBy(F.window(time, window).alias("w"), "tag").agg(F.count(F.lit(1)).alias("n_tokens"), F.approx_count_distinct("word_norm").alias("n_types")).select("w.start", "w.end", "tag", "n_tokens", "n_types")
