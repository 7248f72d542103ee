"""Exact ranks and running sums inside groups of any size, without a task that holds a whole group.

Rows get a random but reproducible 64-bit key. The key's range is cut into
buckets, counts (or sizes) per group and bucket are added up, and only inside a
bucket are rows sorted. The number of buckets grows with the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that one bucket shall hold about, and the most buckets of a group.
BUCKET_ROWS, MOST_BUCKETS = 20_000, 1 << 20


def random_key(seed: int, *cols: Column) -> Column:
    """A bigint that looks random, the same for the same values and seed at any partitioning."""
    return F.xxhash64(F.lit(seed), *cols)


def bucket_count(rows: int) -> int:
    """Buckets per group for a table of so many rows, as if one group held them all."""
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def bucket_of(key: Column, buckets: int) -> Column:
    """The bucket of a key. Buckets are ranges: their order is the order of the keys."""
    unit = (key.cast("double") / float(1 << 63) + 1.0) / 2.0
    return F.least(F.floor(unit * buckets), F.lit(buckets - 1)).cast("int")


def with_offsets(sums: DataFrame, group: list[str], value: str) -> DataFrame:
    """sums (group, bucket, value) with `before`: the value of all earlier buckets of the group.

    A group has at most MOST_BUCKETS buckets, so this window is bounded.
    """
    w = W.partitionBy(*group).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return sums.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0)))
