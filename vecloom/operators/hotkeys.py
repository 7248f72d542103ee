"""Per-key results where a few keys hold most records (problem 3).

Counts and exact quantiles per key by distributed exact selection: passes over
the data count the values of each key into the bins of its open intervals, and
the bin that holds a wanted rank is the next interval, until it holds one
distinct value. A shuffled row is a partial count of a bin, never a record, so
a hot key costs no task more than its share and its values never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.session import settle

#: Bins of an open interval in one pass.
BINS = 4096
#: Open intervals up to this number are broadcast; more of them are joined by salted shuffle.
BROADCAST_ROWS, SALTS = 50_000, 16
_KEY = ["field_name", "key_text"]
_GROUP = [*_KEY, "measure"]
BLANKS = " \t\n\r\v\f"


def tag(c: Column | str) -> Column:
    """A tag trimmed and upper-cased; null stays null."""
    return F.upper(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _long(df: DataFrame, keys: dict[str, Column], measures: list[str]) -> DataFrame:
    """field_name, key_text, measure, value: a row per record, non-null key and measure."""
    key = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), c.cast("string").alias("key_text")) for n, c in keys.items()]))
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), _finite(F.col(f"__m{i}")).alias("value")) for i, m in enumerate(measures)]))
    slim = df.select(key.alias("k"), *[F.col(f"`{m}`").alias(f"__m{i}") for i, m in enumerate(measures)])
    return slim.where(F.col("k.key_text").isNotNull()).select("k.*", pair.alias("p")).select(*_KEY, "p.measure", "p.value")


def _counted(long: DataFrame, open_: DataFrame, n_open: int) -> DataFrame:
    """Counts and limits of the bins of the open intervals. open_: the group, lo, hi."""
    values = long.where(F.col("value").isNotNull())
    if n_open <= BROADCAST_ROWS:
        hit = values.join(F.broadcast(open_), _GROUP)
    else:
        salted = open_.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        values = values.withColumn("__salt", F.pmod(F.xxhash64("value", F.rand(17)), F.lit(SALTS)).cast("int"))
        hit = values.join(salted, [*_GROUP, "__salt"])
    hit = hit.where(F.col("value").between(F.col("lo"), F.col("hi")))
    # Halved, so that the width of an interval can't overflow. The first and the last bin differ: each pass narrows.
    at = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS
    bin_ = F.when(F.col("value") >= F.col("hi"), F.lit(BINS - 1)).otherwise(F.least(F.floor(at), F.lit(BINS - 1))).cast("int")
    return hit.groupBy(*_GROUP, "lo", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("bin_lo"), F.max("value").alias("bin_hi"))


def key_profile(df: DataFrame, keys: dict[str, Column], measures: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Per key field, key and measure: rows, share of all rows, values, limits and exact quantiles.

    field_name, key_text, measure, n_rows, share, n_values, min_value,
    max_value, quantiles. A quantile p is the smallest value with at least
    p * n_values values up to it. Null keys have no group but count in the
    share; null, NaN and infinite values are no values; a group without values
    has null quantiles. Measures are compared as double: whole numbers beyond
    2^53 that no double tells apart are one value. No rows in, no rows out.
    """
    total = df.count()
    long = _long(df, keys, measures)
    groups = settle(
        long.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    )
    rank = [F.struct(F.lit(i).alias("q"), F.greatest(F.ceil(F.lit(p) * F.col("n_values") - F.lit(1e-9)), F.lit(1)).cast("bigint").alias("rank")) for i, p in enumerate(probs)]
    wanted = groups.where(F.col("n_values") > 0).select(*_GROUP, F.col("min_value").alias("lo"), F.col("max_value").alias("hi"), F.explode(F.array(*rank)).alias("w"))
    state = settle(wanted.select(*_GROUP, "lo", "hi", "w.q", "w.rank"))
    done = state.where("lo = hi").select(*_GROUP, "q", F.col("lo").alias("quantile"))
    state = state.where("lo < hi")
    while n_state := state.count():
        intervals = state.select(*_GROUP, "lo", "hi").distinct()
        # At most BINS bins of an interval: the running count is over a bounded group.
        upto = F.sum("n").over(W.partitionBy(*_GROUP, "lo").orderBy("bin"))
        bins = _counted(long, intervals, n_state).withColumn("upto", upto)
        holds = (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n"))
        found = state.join(bins, [*_GROUP, "lo"]).where(holds)
        found = settle(found.select(*_GROUP, F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), "q", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank")))
        done = done.unionByName(found.where("lo = hi").select(*_GROUP, "q", F.col("lo").alias("quantile")))
        state = found.where("lo < hi")
    by_group = done.groupBy(*_GROUP).agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "quantile"))), lambda x: x["quantile"]).alias("quantiles"))
    share = (F.col("n_rows") / F.lit(max(total, 1))).alias("share")
    return groups.join(by_group, _GROUP, "left").select(*_GROUP, "n_rows", share, "n_values", "min_value", "max_value", "quantiles")


def heavy_keys(profile: DataFrame, least_share: float) -> DataFrame:
    """field_name, key_text of the keys whose share of all rows is at least least_share.

    A key comes with its selection resolved: every measure that has values has
    its quantiles, else the profile is not whole and the key is not given.
    """
    whole = (F.col("n_values") == 0) | F.col("quantiles").isNotNull()
    keys = profile.where(F.col("share") >= least_share).groupBy(*_KEY).agg(F.bool_and(whole).alias("whole"))
    return keys.where("whole").select(*_KEY)


TOKEN_MEASURES = ["index", "length", "head_dist", "arity"]


def token_profile(tokens: DataFrame) -> DataFrame:
    """key_profile() of the token table by pos (trimmed, upper-cased) and relation_type."""
    return key_profile(tokens, {"pos": tag("pos"), "relation_type": F.col("relation_type")}, TOKEN_MEASURES)
