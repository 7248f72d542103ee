"""Vector-set aggregates by group: from mergeable moments where those suffice, else on bounded samples."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators import kernels as K
from vecloom.operators.sampling import bootstrap_draw, cap_per_group, confidence
from vecloom.operators.vectors import NEAREST, moments, nearest_metrics, norm
from vecloom.session import settle

#: Vectors of a group that one kernel call takes at most, by cost.
CAPS = {"fast": 100_000, "heavy": 5_000}
#: Draws of a replicate at most, as in the reference, and vectors of a group that they are drawn from.
DRAWS = {"fast": 184_870, "heavy": 5_000}
#: Replicates of a bootstrap by cost, and those that one task evaluates.
REPS, REPS_PER_TASK = {"fast": 50, "heavy": 200}, 25
#: Different rows of a block that one task draws from, and numbers that it multiplies at once.
DRAW_ROWS, DRAW_NUMBERS = 20_000, 1 << 21


def _fields(df: DataFrame, keys: list[str], *more: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([f for k in keys for f in df.schema.fields if f.name == k] + [T.StructField(n, t) for n, t in more])


def evaluate(kernel: str | Callable[[K.Cloud], float], cloud: K.Cloud) -> tuple[float | None, str | None]:
    """Value and error of one metric; a failure or a value that is not finite becomes null."""
    try:
        value = float((K.METRICS[kernel][1] if isinstance(kernel, str) else kernel)(cloud))
        return (value, None) if math.isfinite(value) else (None, None)
    except Exception as e:  # noqa: BLE001
        return None, repr(e)[:200]


def spectral_agg(df: DataFrame, keys: list[str], vec: str, metrics: tuple[str, ...] = K.SPECTRAL) -> DataFrame:
    """keys, metric, value, n for metrics of the spectrum, over all vectors: only moments are shuffled."""
    out = _fields(df, keys, ("metric", T.StringType()), ("value", T.DoubleType()), ("n", T.LongType()))

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n, s = int(r["n"]), np.asarray(r["sums"], dtype=float)
                d = len(s)
                c = np.asarray(r["scatter"], dtype=float).reshape(d, d) - (np.outer(s, s) / n if n else 0.0)
                lam = np.clip(np.linalg.eigvalsh(c)[::-1][: min(n, d)], 0.0, None)
                for m in metrics:
                    v = K.from_spectrum(lam, m)
                    rows.append((*[r[k] for k in keys], m, v if math.isfinite(v) else None, n))
            yield pd.DataFrame(rows, columns=out.names)

    return moments(df, keys, vec).mapInPandas(run, out)


def _evaluator(keys: list[str], own: list[str], seed: int, names: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    registered = {m: K.METRICS[m][1] for m in own}  # sent along: a task's registry has the built-in metrics only

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        cloud = K.Cloud(np.stack([np.asarray(v, dtype=np.float64) for v in pdf["__v"]]), seed)
        key = tuple(pdf[k].iloc[0] for k in keys)
        return pd.DataFrame([(*key, m, *evaluate(f, cloud)) for m, f in registered.items()], columns=[*keys, "metric", "value", "error"]).assign(n=cloud.n)[names]

    return run


def _from_moments(df: DataFrame, keys: list[str], vec: str, own: list[str], out: T.StructType) -> DataFrame:
    """Metrics of MOMENT, or that of DIRECTION where vec has unit vectors, over all vectors."""
    registered = {m: (lambda c: K.concentration(float(np.linalg.norm(c.mean)), c.d) if c.n > 1 else math.nan) if m == K.DIRECTION else K.METRICS[m][1] for m in own}

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                c = K.Moments(int(r["n"]), np.asarray(r["sums"], dtype=float), np.asarray(r["scatter"], dtype=float))
                for m, f in registered.items():
                    value, error = evaluate(f, c)
                    rows.append((*[r[k] for k in keys], m, value, c.n, error))
            yield pd.DataFrame(rows, columns=out.names)

    return moments(df, keys, vec).mapInPandas(run, out)


def vector_agg(df: DataFrame, keys: list[str], id_: str, vec: str, metrics: list[str] | None = None, seed: int = 42, caps: dict[str, int] | None = None) -> DataFrame:
    """keys, metric, value, n, error: every metric of every group.

    Metrics of moments take all vectors, and so do those of NEAREST unless a
    cap for heavy ones is named. For the others a group is first cut to the cap
    of their cost by a hash of the id, and its vectors are taken in the order
    of the ids, so results do not depend on the partitioning. n is the number
    of vectors taken. Undefined values are null.
    """
    metrics = metrics or list(K.METRICS)
    near = [m for m in metrics if m in NEAREST and "heavy" not in (caps or {})]
    caps = CAPS | (caps or {})
    out = _fields(df, keys, ("metric", T.StringType()), ("value", T.DoubleType()), ("n", T.LongType()), ("error", T.StringType()))
    parts = []
    whole = [m for m in metrics if m in K.MOMENT]
    if whole:
        parts.append(_from_moments(df, keys, vec, whole, out))
    if K.DIRECTION in metrics:
        unit = F.transform(vec, lambda x: x.cast("double") / (norm(F.col(vec)) + 1e-9))
        parts.append(_from_moments(df.select(*keys, unit.alias(vec)), keys, vec, [K.DIRECTION], out))
    if near:
        value = F.when(~F.isnan("value") & (F.abs("value") < math.inf), F.col("value")).alias("value")
        parts.append(nearest_metrics(df, keys, id_, vec, near).select(*keys, "metric", value, "n", F.lit(None).cast("string").alias("error")))
    for cost in ("fast", "heavy"):
        own = [m for m in metrics if K.METRICS[m][0] == cost and m not in (*whole, *near, K.DIRECTION)]
        if not own:
            continue
        slim = df.where(F.col(vec).isNotNull()).select(*keys, F.col(id_).alias("__id"), F.col(vec).alias("__v"))
        parts.append(cap_per_group(slim, keys, ["__id"], caps[cost], seed).groupBy(*keys).applyInPandas(_evaluator(keys, own, seed, out.names), out))
    return reduce(DataFrame.unionByName, parts)


def bootstrap(df: DataFrame, cls: str, layer: str, id_: str, vec: str, metric: str, reps: int | None = None, m: int | None = None, seed: int = 42, cap: int | None = None) -> DataFrame:
    """cls, layer, metric, mean, ci_low, ci_high, n_tokens over replicates drawn with replacement.

    There are REPS replicates by the cost of the metric, of m draws each, by
    default as many as the class has vectors up to the kernel's DRAWS. All
    layers of a class use the same draws: the vectors are taken in the order of
    their ids, and the draws depend on their number, the seed and the number of
    the replicate. REPS_PER_TASK of them are evaluated by one task. Classes
    with fewer than 3 vectors are left out; undefined replicates do not count.
    """
    cost = K.METRICS[metric][0]
    cap, reps = cap or DRAWS[cost], reps or REPS[cost]
    keys = [cls] if cls == layer else [cls, layer]
    out = _fields(df, keys, ("value", T.DoubleType()), ("n", T.LongType()))

    kernel = K.METRICS[metric][1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 3:
            return pd.DataFrame(columns=out.names)
        pdf = pdf.sort_values("__id")
        x, first = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["__v"]]), int(pdf["__part"].iloc[0]) * REPS_PER_TASK
        draws = (bootstrap_draw(len(x), min(m or len(x), len(x)), r, seed) for r in range(first, min(first + REPS_PER_TASK, reps)))
        return pd.DataFrame([(*[pdf[k].iloc[0] for k in keys], evaluate(kernel, K.Cloud(x[i], seed))[0], len(x)) for i in draws], columns=out.names)

    slim = df.where(F.col(vec).isNotNull()).select(*keys, F.col(id_).alias("__id"), F.col(vec).alias("__v"))
    parts = F.explode(F.sequence(F.lit(0), F.lit((reps - 1) // REPS_PER_TASK))).alias("__part")
    values = cap_per_group(slim, keys, ["__id"], cap, seed).select("*", parts).groupBy(*keys, "__part").applyInPandas(run, out)
    n = values.groupBy(*keys).agg(F.max("n").alias("n_tokens"))
    stats = confidence(values, keys, "value")
    cond = [stats[k].eqNullSafe(n[k]) for k in keys]
    return stats.join(n, reduce(lambda a, b: a & b, cond)).select(*[stats[k] for k in keys], F.lit(metric).alias("metric"), "mean", "ci_low", "ci_high", "n_tokens")


def bootstrap_moments(df: DataFrame, cls: str, vecs: str, layers: str, metric: str, layer: str = "layer", reps: int | None = None, seed: int = 42) -> DataFrame:
    """cls, layer, metric, mean, ci_low, ci_high, n_tokens as bootstrap() gives them, for a metric of MOMENT, over whole classes.

    vecs: the vectors of all layers one after the other, as many as `layers`
    says; rows with nulls or NaN are left out. A replicate draws as many rows
    as the class has, with replacement, and takes all layers of each. How often
    the rows are drawn is multinomial, so it is drawn first for blocks of a
    class, then within each block, and rows that are equal in all layers are
    drawn as one with their number. A task holds a block, whatever the class's
    size; only sums go on. Draws depend on the rows, the seed and the number of
    the replicate, not on the partitioning.
    """
    if metric not in K.MOMENT:
        raise ValueError(f"{metric} is no metric of moments")
    reps, kernel = reps or REPS[K.METRICS[metric][0]], K.METRICS[metric][1]
    finite = ~F.exists(vecs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    rows = df.where(F.col(vecs).isNotNull() & finite).select(F.col(cls).alias("__c"), F.col(layers).cast("int").alias("__l"), F.transform(vecs, lambda x: x.cast("double")).alias("__v"))
    rows = settle(rows.groupBy("__c", "__l", "__v").agg(F.count(F.lit(1)).alias("__n")))
    blocks = max(1, -(-rows.count() // DRAW_ROWS))
    rows = rows.withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), "__v"), F.lit(blocks)).cast("int"))
    sizes = rows.groupBy("__c", "__b").agg(F.sum("__n").alias("__size"))
    shared = T.StructType([sizes.schema["__c"], T.StructField("__b", T.IntegerType()), T.StructField("__draws", T.ArrayType(T.LongType()))])

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        """The draws of a class that fall to each of its blocks, by replicate."""
        pdf = pdf.sort_values("__b")
        size = pdf["__size"].to_numpy()
        n = int(size.sum())
        if n < 3:
            return pd.DataFrame(columns=shared.names)
        draws = np.stack([np.random.default_rng([seed, r]).multinomial(n, size / n) for r in range(reps)], axis=1)
        return pd.DataFrame({"__c": pdf["__c"], "__b": pdf["__b"], "__draws": list(draws)})

    sums = T.StructType([sizes.schema["__c"], *T.StructType.fromDDL("layer int, rep int, n bigint, sums array<double>, scatter array<double>")])

    def draw(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        """The sums of a block's drawn rows, by layer and replicate."""
        if own.empty or given.empty:
            return pd.DataFrame(columns=sums.names)
        (b, draws), count = (int(given["__b"].iloc[0]), given["__draws"].iloc[0]), int(own["__l"].iloc[0])
        x, n = np.stack([np.asarray(v, dtype=np.float64) for v in own["__v"]]), own["__n"].to_numpy()
        at = np.lexsort(x.T[::-1])
        x, n = x[at].reshape(len(x), count, -1), n[at]
        times = np.stack([np.random.default_rng([seed, r, b]).multinomial(int(m), n / n.sum()) for r, m in enumerate(draws)]).astype(np.float64)
        d, out = x.shape[2], []
        step = max(1, DRAW_NUMBERS // max(d * d, 1))
        for at in range(count):
            total = times @ x[:, at]
            scatter = sum(times[:, i : i + step] @ (y[:, :, None] * y[:, None, :]).reshape(len(y), -1) for i in range(0, len(x), step) for y in [x[i : i + step, at]])
            out += [(own["__c"].iloc[0], at, r, int(times[r].sum()), total[r].tolist(), scatter[r].tolist()) for r in range(len(times))]
        return pd.DataFrame(out, columns=sums.names)

    out = T.StructType([sizes.schema["__c"], *T.StructType.fromDDL("layer int, value double, n bigint")])

    def value(pdf: pd.DataFrame) -> pd.DataFrame:
        n, total, scatter = int(pdf["n"].sum()), np.stack(pdf["sums"]).sum(axis=0), np.stack(pdf["scatter"]).sum(axis=0)
        return pd.DataFrame([(pdf["__c"].iloc[0], pdf["layer"].iloc[0], evaluate(kernel, K.Moments(n, total, scatter))[0], n)], columns=out.names)

    draws = sizes.groupBy("__c").applyInPandas(share, shared)
    parts = rows.groupBy("__c", "__b").cogroup(draws.groupBy("__c", "__b")).applyInPandas(draw, sums)
    values = parts.groupBy("__c", "layer", "rep").applyInPandas(value, out)
    stats = confidence(values, ["__c", "layer", "n"], "value")  # n is the class's size in every replicate
    return stats.select(F.col("__c").alias(cls), F.col("layer").alias(layer), F.lit(metric).alias("metric"), "mean", "ci_low", "ci_high", F.col("n").alias("n_tokens"))


def points_table(samples: DataFrame, point: str, id_: str, vec: str, metrics: list[str], heavy_cap: int = 1000, seed: int = 42) -> DataFrame:
    """A row per sample: point, n, and a column per metric in the given order; heavy ones on heavy_cap vectors."""
    out = T.StructType([T.StructField(point, samples.schema[point].dataType), T.StructField("n", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in metrics]])

    registered = [K.METRICS[m] for m in metrics]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_)
        x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
        p = int(pdf[point].iloc[0])
        some = x if len(x) <= heavy_cap else x[np.random.default_rng(seed + p).choice(len(x), heavy_cap, replace=False)]
        clouds = {"fast": K.Cloud(x, seed), "heavy": K.Cloud(some, seed)}
        return pd.DataFrame([[p, len(x), *[evaluate(f, clouds[cost])[0] for cost, f in registered]]], columns=out.names)

    return samples.select(point, id_, vec).groupBy(point).applyInPandas(run, out)


def pca_projection(df: DataFrame, keys: list[str], id_: str, vec: str, keep: list[str] = (), k: int = 3, few: bool = False, d: int | None = None) -> DataFrame:
    """df's keys, id and kept columns with pc1..pck. The directions come from the moments of all vectors.

    df is read twice, so settle() it where its vectors cost more to make than
    to keep. With `few`, for keys of few values (as layers), their directions
    are broadcast and the rows stay where they are; else the planner decides.
    d is the length of the vectors where it is known and small: the products
    are then written out, which is compiled and much faster.
    """
    schema = _fields(df, keys, ("mean", T.ArrayType(T.DoubleType())), ("axes", T.ArrayType(T.ArrayType(T.DoubleType()))))

    def axes(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                n, s = int(r["n"]), np.asarray(r["sums"], dtype=float)
                c = np.asarray(r["scatter"], dtype=float).reshape(len(s), len(s)) - np.outer(s, s) / n
                v = np.linalg.eigh(c)[1][:, ::-1][:, :k]
                v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])] < 0, -1.0, 1.0)
                rows.append((*[r[x] for x in keys], (s / n).tolist(), [v[:, j].tolist() for j in range(v.shape[1])]))
            yield pd.DataFrame(rows, columns=schema.names)

    a = moments(df, keys, vec).mapInPandas(axes, schema)
    if d is not None:
        flat = a.select(*keys, *[F.get("mean", F.lit(i)).alias(f"__m{i}") for i in range(d)], *[F.get(F.get("axes", F.lit(j)), F.lit(i)).alias(f"__a{j}_{i}") for j in range(k) for i in range(d)])
        dims = [F.get(F.col(vec), F.lit(i)).cast("double") - F.col(f"__m{i}") for i in range(d)]
        pc = [reduce(lambda acc, x: acc + x, [F.lit(0.0), *[x * F.col(f"__a{j}_{i}") for i, x in enumerate(dims)]]).alias(f"pc{j + 1}") for j in range(k)]
        return df.join(F.broadcast(flat) if few else flat, keys).select(*keys, id_, *keep, *pc)
    centred = F.zip_with(vec, "mean", lambda x, m: x.cast("double") - m)
    pc = [F.aggregate(F.zip_with("__c", F.get("axes", F.lit(j)), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x).alias(f"pc{j + 1}") for j in range(k)]
    return df.join(F.broadcast(a) if few else a, keys).withColumn("__c", centred).select(*keys, id_, *keep, *pc)
