"""Spearman correlation of columns, stars, normalisation and pivots of metric tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.stats import spearman_p_udf
from vecloom.operators.ranges import numbered
from vecloom.session import settle


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


#: A value that holds more than this share of a column's rows has its rank broadcast; a column has at most 1/share of them.
HOT_SHARE = 1 / 4096


def _sides(metrics: list[str], there: dict[str, int], n: int) -> dict[tuple[str, str], int]:
    """Which ranking (by number) the first of two metrics takes in the pair: one of its own if the second lacks rows, else the same in all pairs."""
    names: dict[tuple[str, str | None], int] = {}
    return {(a, b): names.setdefault((a, None if there[b] == n else b), len(names)) for a in metrics for b in metrics if a != b}


def _ranks(df: DataFrame, sides: dict[tuple[str, str], int]) -> DataFrame:
    """v, value, rank, hot: the average rank of every distinct value of every ranking."""
    first = {v: pair for pair, v in reversed(sides.items())}
    cells = [F.struct(F.lit(v).alias("v"), F.when(_finite(F.col(f"`{b}`")).isNotNull(), _finite(F.col(f"`{a}`"))).alias("value")) for v, (a, b) in first.items()]
    # A metric with its own ranking in all pairs stands with one that has all rows, so the condition holds for every row there.
    counts = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("value").isNotNull()).groupBy("v", "value").agg(F.count(F.lit(1)).alias("c"))
    upto = numbered(counts, ["v"], ["value"], "upto", F.col("c"), total="all")
    return settle(upto.select("v", "value", (F.col("upto") - (F.col("c") - 1) / 2.0).alias("rank"), (F.col("c") > HOT_SHARE * F.col("all")).alias("hot")))


def _with_rank(long: DataFrame, ranks: DataFrame, v: str, value: str, name: str) -> DataFrame:
    """long with the rank of `value` in ranking `v`: by broadcast for hot values, so that the join of the others knows no hot key."""
    r = ranks.select(F.col("v").alias(v), F.col("value").alias(value), F.col("rank").alias(name), "hot")
    near = long.join(F.broadcast(r.where("hot").drop("hot")), [v, value], "left")  # at most 1 / HOT_SHARE rows a ranking
    rest = near.where(F.col(name).isNull()).drop(name).join(r.where("not hot").drop("hot"), [v, value])
    return near.where(F.col(name).isNotNull()).unionByName(rest)


def _sums_by_pairs(df: DataFrame, metrics: list[str], sides: dict[tuple[str, str], int], ranks: DataFrame) -> DataFrame:
    """m1, m2 and the sums of the ranks, over the distinct value pairs of every two metrics."""
    two = [
        F.struct(F.lit(a).alias("m1"), F.lit(b).alias("m2"), F.lit(sides[a, b]).alias("vx"), F.lit(sides[b, a]).alias("vy"), _finite(F.col(f"`{a}`")).alias("x"), _finite(F.col(f"`{b}`")).alias("y"))
        for a, b in combinations(metrics, 2)
    ]
    long = df.select(F.explode(F.array(*two)).alias("p")).select("p.*").where(F.col("x").isNotNull() & F.col("y").isNotNull())
    long = settle(long.groupBy("m1", "m2", "vx", "vy", "x", "y").agg(F.count(F.lit(1)).alias("n")))
    r = _with_rank(_with_rank(long, ranks, "vx", "x", "rx"), ranks, "vy", "y", "ry")
    w = F.col("n").cast("double")
    return r.groupBy("m1", "m2").agg(
        F.sum("n").alias("n"), F.sum(w * F.col("rx")).alias("sx"), F.sum(w * F.col("ry")).alias("sy"),
        F.sum(w * F.col("rx") * F.col("rx")).alias("sxx"), F.sum(w * F.col("ry") * F.col("ry")).alias("syy"), F.sum(w * F.col("rx") * F.col("ry")).alias("sxy"),
    )


def _sums_side_by_side(df: DataFrame, metrics: list[str], sides: dict[tuple[str, str], int], ranks: DataFrame) -> DataFrame:
    """The same where every row has all metrics: a row gets each rank once, and no pairs are made."""
    cold = {r.v for r in ranks.where("not hot").select("v").distinct().collect()}  # rankings
    wide = df.select(*[_finite(F.col(f"`{m}`")).alias(f"x{i}") for i, m in enumerate(metrics)])
    for i, m in enumerate(metrics):
        v = sides[m, metrics[i - 1]]
        own = ranks.where(F.col("v") == v).select(F.col("value").alias(f"x{i}"), F.col("rank").alias(f"r{i}"), "hot")
        hot, rest = F.broadcast(own.where("hot").drop("hot")), own.where("not hot").drop("hot")  # at most 1 / HOT_SHARE rows
        if v not in cold:
            wide = wide.join(hot, f"x{i}").drop(f"x{i}")
            continue
        near = wide.join(hot, f"x{i}", "left")
        far = near.where(F.col(f"r{i}").isNull()).drop(f"r{i}").join(rest, f"x{i}")
        wide = near.where(F.col(f"r{i}").isNotNull()).unionByName(far).drop(f"x{i}")
    k = range(len(metrics))
    r = lambda i: F.col(f"r{i}")
    one = wide.agg(F.count(F.lit(1)).alias("n"), *[F.sum(r(i)).alias(f"s{i}") for i in k], *[F.sum(r(i) * r(j)).alias(f"s{i}_{j}") for i in k for j in k if i <= j])
    two = [
        F.struct(F.lit(metrics[i]).alias("m1"), F.lit(metrics[j]).alias("m2"), F.col("n"), *[F.col(c).alias(n) for c, n in ((f"s{i}", "sx"), (f"s{j}", "sy"), (f"s{i}_{i}", "sxx"), (f"s{j}_{j}", "syy"), (f"s{i}_{j}", "sxy"))])
        for i, j in combinations(k, 2)
    ]
    return one.select(F.explode(F.array(*two)).alias("p")).select("p.*")


def spearman(df: DataFrame, metrics: list[str]) -> DataFrame:
    """m1, m2, n, rho for every two metrics, over the rows where both are finite; null for fewer than three rows.

    Ranks are average ranks within the rows of the pair; a metric is ranked
    once for all partners that have every row. Where rows lack values, the
    correlation is summed over distinct value pairs, so repeated values cost
    nothing. A constant column has a null correlation.
    """
    total = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(_finite(F.col(f"`{m}`"))).alias(f"m{i}") for i, m in enumerate(metrics)]).first()
    there = {m: total[f"m{i}"] for i, m in enumerate(metrics)}
    sides = _sides(metrics, there, total["n"])
    complete = total["n"] > 0 and all(n == total["n"] for n in there.values())
    s = (_sums_side_by_side if complete else _sums_by_pairs)(df, metrics, sides, _ranks(df, sides))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    var = (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("n"))
    return s.select("m1", "m2", "n", F.when((F.col("n") >= 3) & (var > 0), cov / F.sqrt(var)).alias("rho"))


def stars(p: Column) -> Column:
    return F.when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 5e-2, "*").otherwise("")


def spearman_matrix(df: DataFrame, metrics: list[str]) -> DataFrame:
    """m1, m2, rho, p, cell for all ordered pairs; the diagonal is 1 with p 1 and cell 1.00. Metrics without a finite value are left out."""
    there = df.agg(*[F.count(_finite(F.col(f"`{m}`"))).alias(m) for m in metrics]).first()
    metrics = [m for m in metrics if there[m]]
    one = spearman(df, metrics) if len(metrics) > 1 else None
    spark = df.sparkSession
    diagonal = spark.createDataFrame([(m, m, 1.0, 1.0, "1.00") for m in metrics], "m1 string, m2 string, rho double, p double, cell string")
    if one is None:
        return diagonal
    one = one.withColumn("p", spearman_p_udf(F.col("rho"), F.col("n").cast("double")))
    cell = F.when(F.col("rho").isNotNull(), F.concat(F.format_string("%.2f", "rho"), stars(F.col("p")))).otherwise("")
    one = one.select("m1", "m2", "rho", "p", cell.alias("cell"))
    return one.unionByName(one.select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), "rho", "p", "cell")).unionByName(diagonal)


def min_max(df: DataFrame, metric: str, value: str) -> DataFrame:
    """df with `norm`: the value between the least and the greatest of its metric, 0 where they are equal, null for null."""
    lim = df.groupBy(metric).agg(F.min(_finite(F.col(value))).alias("__lo"), F.max(_finite(F.col(value))).alias("__hi"))
    x = F.when(F.col("__hi") > F.col("__lo"), (_finite(F.col(value)) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.when(_finite(F.col(value)).isNotNull(), F.lit(0.0)))
    return df.join(lim, metric).withColumn("norm", x).drop("__lo", "__hi")


def pivot(df: DataFrame, rows: str, columns: str, value: str, order: list) -> DataFrame:
    """One row per `rows`, one column per value of `columns` in the given order."""
    return df.groupBy(rows).pivot(columns, order).agg(F.first(value))


def labelled(matrix: DataFrame, order: list[str], labels: dict[str, str]) -> DataFrame:
    """The cells of spearman_matrix() as a table: a row and a column per metric that is present, in the given order, under their display names."""
    there = {r.m1 for r in matrix.select("m1").distinct().collect()}  # metrics
    shown = [m for m in order if m in there]
    spark = matrix.sparkSession
    if not shown:
        return spark.createDataFrame([], "ord int, metric string")
    names = F.broadcast(spark.createDataFrame([(i, m, labels.get(m, m)) for i, m in enumerate(shown)], "ord int, m1 string, metric string"))
    cells = [F.max(F.when(F.col("m2") == m, F.col("cell"))).alias(labels.get(m, m)) for m in shown]
    return matrix.join(names, "m1").groupBy("ord", "metric").agg(*cells)
