"""Vector columns: means, scatter, isotropy and linear dimension from mergeable moments, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.operators.ranges import numbered
from vecloom.session import settle

#: Vectors of a block of the neighbour search; a task compares two blocks, so this bounds its work and memory.
BLOCK_ROWS, CHUNK = 4096, 64
#: Bytes of sums that a task holds before it hands them on.
HELD_BYTES = 256 << 20
#: Partial moments are merged in two steps, first within this many parts of a group.
MERGE_PARTS = 64


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + eps)


def dim_means(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, dim (from 0), mean: the mean activation of every dimension."""
    long = df.select(*keys, F.posexplode(vec).alias("dim", "x"))
    return long.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pooled(df: DataFrame, keys: list[str], order: str, vec: str, how: str) -> DataFrame:
    """One vector per key from those of its parts: first, last (by `order`), or mean, as keys, dim, x."""
    if how == "mean":
        return dim_means(df, keys, vec).withColumnRenamed("mean", "x")
    pick = F.min_by if how == "first" else F.max_by
    return df.groupBy(*keys).agg(pick(vec, order).alias("__v")).select(*keys, F.posexplode("__v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


def _key_fields(df: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [f for k in keys for f in df.schema.fields if f.name == k]


def _matrix(vecs: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix; a null among them is NaN."""
    n = pc.list_value_length(vecs).to_numpy(zero_copy_only=False)
    if len(n) and (n != n[0]).any():
        raise ValueError("vectors of a group differ in length")
    return vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(n), int(n[0]) if len(n) else 0)


def _by_key(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.Array | None]]:
    """Every key of a batch with its rows; NaN is null. No rows are named where the batch has one key."""
    rows = [np.arange(batch.num_rows)]
    if keys:
        codes = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
        at = np.argsort(codes, kind="stable")
        rows = np.split(at, np.flatnonzero(np.diff(codes[at])) + 1)
    for r in rows:
        key = (batch.column(k)[int(r[0])].as_py() for k in keys)
        yield tuple(None if pd.isna(k) else k for k in key), pa.array(r) if len(rows) > 1 else None


def moments(df: DataFrame, keys: list[str], vec: str, outer: bool = True, unit: bool = False) -> DataFrame:
    """keys, n, sums, scatter: per group the number of vectors, their sum and the flat sum of outer products.

    Every task adds up its own vectors; only sums are shuffled, merged in two
    steps, so a group of any size costs no task more than MERGE_PARTS sums.
    Vectors with nulls or NaN are left out; those of a group must have one length.
    Without `outer`, scatter is empty. With `unit`, units is the sum of the
    vectors divided by their lengths.
    """
    sums = ["sums", "scatter", *["units"] * unit]
    schema = T.StructType([*_key_fields(df, keys), T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in sums]])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[tuple, list] = {}
        kinds: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, vecs = [batch.schema.field(k).type for k in keys], batch.column("__v")
            for key, rows in _by_key(batch, keys):
                x = _matrix(vecs if rows is None else vecs.take(rows))
                x = x[np.isfinite(x).all(axis=1)]
                d = x.shape[1]
                got = acc.setdefault(key, [0, np.zeros(d), np.zeros((d, d) if outer else 0), np.zeros(d if unit else 0), batch.column("__p")[0].as_py()])
                got[0] += len(x)
                got[1] += x.sum(axis=0)
                if outer:
                    got[2] += x.T @ x
                if unit:
                    got[3] += (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)).sum(axis=0)
            if sum(8 * sum(x.size for x in held[1:4]) for held in acc.values()) > HELD_BYTES:
                yield table(acc, kinds)
                acc = {}
        if acc:
            yield table(acc, kinds)

    def table(acc: dict[tuple, list], kinds: list[pa.DataType]) -> pa.RecordBatch:
        made = [pa.array([k[i] for k in acc], type=kind) for i, kind in enumerate(kinds)]
        part, n = pa.array([held[4] for held in acc.values()], type=pa.int32()), pa.array([held[0] for held in acc.values()], type=pa.int64())
        lists = [pa.array([held[1 + i].ravel() for held in acc.values()], type=pa.list_(pa.float64())) for i in range(len(sums))]
        return pa.RecordBatch.from_arrays([*made, part, n, *lists], names=schema.names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["n"] = int(pdf["n"].sum())
        for c in sums:
            out[c] = [np.sum(np.stack([np.asarray(v) for v in pdf[c]]), axis=0).tolist()]
        return out

    slim = df.where(F.col(vec).isNotNull()).select(*keys, F.col(vec).alias("__v"), F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS)).alias("__p"))
    once = slim.mapInArrow(partial, schema).groupBy(*keys, "part").applyInPandas(merge, schema)
    return once.groupBy(*keys).applyInPandas(merge, schema).drop("part")


def scatter_matrix(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, i, j, s: the centred scatter matrix (not divided by n) in long form."""
    m = moments(df, keys, vec)
    d = F.size("sums")
    cell = F.posexplode("scatter").alias("at", "raw")
    long = m.select(*keys, "n", "sums", d.alias("d"), cell)
    i, j = F.floor(F.col("at") / F.col("d")).cast("int"), (F.col("at") % F.col("d")).cast("int")
    return long.select(*keys, i.alias("i"), j.alias("j"), (F.col("raw") - F.element_at("sums", i + 1) * F.element_at("sums", j + 1) / F.col("n")).alias("s"))


def _participation(r: dict, eps: float) -> tuple[int, float, float | None]:
    """d, pr and iso_score of a row of moments()."""
    s = np.asarray(r["sums"], dtype=float)
    d = len(s)
    c = np.asarray(r["scatter"], dtype=float).reshape(d, d) - np.outer(s, s) / max(r["n"], 1)
    pr = float(np.trace(c) ** 2 / ((c * c).sum() + eps))
    return d, pr, (pr - 1) / (d - 1) if d > 1 else None


_ISO = (T.StructField("d", T.IntegerType()), T.StructField("pr", T.DoubleType()), T.StructField("iso_score", T.DoubleType()))


def participation(df: DataFrame, keys: list[str], vec: str, eps: float = 1e-12) -> DataFrame:
    """keys, d, pr, iso_score: from trace and Frobenius norm of the scatter matrix, without eigenvalues."""
    out = T.StructType([*_key_fields(df, keys), *_ISO])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(*[r[k] for k in keys], *_participation(r, eps)) for r in pdf.to_dict("records")], columns=out.names)

    return moments(df, keys, vec).mapInPandas(run, out)


def _concentration(n: Column, d: Column, r: Column) -> Column:
    k = F.greatest(r * (d - r * r) / (1 - r * r + 1e-9), F.lit(0.0))
    return F.when(n >= 2, F.when(r < 1e-9, F.lit(0.0)).otherwise(k)).alias("vmf_kappa")


def vmf_kappa(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """keys, vmf_kappa: concentration of the directions, from their sum; null for fewer than two vectors."""
    unit = df.withColumn("__n", norm(F.col(vec))).select(*keys, F.transform(vec, lambda x: x.cast("double") / (F.col("__n") + 1e-9)).alias("__unit"))
    d = F.size("sums")
    m = moments(unit, keys, "__unit", outer=False).select(*keys, "n", d.alias("d"), (norm(F.col("sums")) / F.greatest("n", F.lit(1))).alias("r"))
    return m.select(*keys, _concentration(F.col("n"), F.col("d"), F.col("r")))


def isotropy(df: DataFrame, keys: list[str], vec: str, eps: float = 1e-12) -> DataFrame:
    """keys, d, pr, iso_score, vmf_kappa: participation() and vmf_kappa() in one pass over the vectors, which are kept nowhere."""
    out = T.StructType([*_key_fields(df, keys), *_ISO, T.StructField("__n", T.LongType()), T.StructField("__r", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(*[r[k] for k in keys], *_participation(r, eps), r["n"], float(np.linalg.norm(r["units"])) / max(r["n"], 1)) for r in pdf.to_dict("records")]
            yield pd.DataFrame(rows, columns=out.names)

    m = moments(df, keys, vec, unit=True).mapInPandas(run, out)
    return m.select(*keys, *[f.name for f in _ISO], _concentration(F.col("__n"), F.col("d"), F.col("__r")))


def mean_abs_cosine(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(F.avg(F.abs(cosine(F.col(a), F.col(b)))).alias("mean_abs_cosine"))


def _compared(df: DataFrame, keys: list[str], id_: str, vec: str, kernel, out: T.StructType) -> DataFrame:
    """kernel(keys, queries, points) over every two blocks of a group; a block is about BLOCK_ROWS vectors of it.

    queries and points are (ids, matrix); both hold a block's vectors in the
    order of their ids. A vector is sent once for every block of its group, and
    no task holds more than two blocks. Null vectors are left out.
    """
    slim = df.where(F.col(vec).isNotNull()).select(*keys, F.col(id_).alias("__id"), F.transform(vec, lambda x: x.cast("double")).alias("__v"))
    n = slim.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("__b"))
    n = n.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], "__b")
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & F.col(f"`{k}`").eqNullSafe(F.col(f"__k{i}"))
    own = slim.join(n, cond).select(*keys, "__id", "__v", "__b", F.pmod(F.xxhash64("__id"), F.col("__b")).cast("int").alias("__own"))
    each = F.explode(F.sequence(F.lit(0), F.col("__b") - 1))
    sides = [own.select(*keys, "__id", "__v", F.lit(side).alias("__side"), F.col("__own").alias(mine), each.alias(others)) for side, mine, others in ((0, "__q", "__p"), (1, "__p", "__q"))]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id", kind="stable")
        key = tuple(pdf[k].iloc[0] for k in keys)
        two = [(g["__id"].to_numpy(), np.stack(g["__v"].to_numpy())) if len(g) else (np.array([]), np.zeros((0, 0))) for g in (pdf[pdf["__side"] == side] for side in (0, 1))]
        return kernel(key, *two) if all(len(x[0]) for x in two) else pd.DataFrame(columns=out.names)

    return sides[0].unionByName(sides[1]).groupBy(*keys, "__q", "__p").applyInPandas(run, out)


def _chunks(queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Squared distances of CHUNK queries at a time by one matrix product, with the error that they may have."""
    centre = points.mean(axis=0)
    q, p = queries - centre, points - centre
    pp = np.einsum("ij,ij->i", p, p)
    for at in range(0, len(q), CHUNK):
        x = q[at : at + CHUNK]
        xx = np.einsum("ij,ij->i", x, x)[:, None]
        yield at, np.clip(xx + pp[None, :] - 2 * x @ p.T, 0.0, None), 1e-12 * (xx + pp.max()), x


def nearest(df: DataFrame, keys: list[str], id_: str, vec: str, k: int) -> DataFrame:
    """keys, id, rs: the distances to the k nearest others of every vector in its group, ascending; fewer where there are fewer.

    Exact, by blocks of the group: each task gives the k nearest of two blocks,
    and those of a vector are merged. A group's vectors need ids of their own
    and one length.
    """
    out = T.StructType([*_key_fields(df, keys), T.StructField("id", df.schema[id_].dataType), T.StructField("rs", T.ArrayType(T.DoubleType()))])

    def kernel(key: tuple, queries: tuple, points: tuple) -> pd.DataFrame:
        (ids, q), (others, p) = queries, points
        rows = []
        for at, d2, error, _ in _chunks(q, p):
            own = others[None, :] == ids[at : at + len(d2), None]
            d2[own] = np.inf
            if len(p) > k:
                # What may be among the k nearest is measured anew, so that equal vectors are at distance 0.
                close = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] + 2 * error
            else:
                close = np.isfinite(d2)
            for i in range(len(d2)):
                j = np.flatnonzero(close[i] & ~own[i])
                r = np.sort(np.sqrt(((q[at + i] - p[j]) ** 2).sum(axis=1)))[:k]
                rows.append((*key, ids[at + i], r))
        return pd.DataFrame(rows, columns=out.names)

    found = _compared(df, keys, id_, vec, kernel, out)
    # A list per block of the group.
    return found.groupBy(*keys, "id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("rs"))), 1, k).alias("rs"))


def neighbour_distances(df: DataFrame, keys: list[str], id_: str, vec: str, k: int) -> DataFrame:
    """keys, id, rank (from 1), r: nearest() in long form."""
    return nearest(df, keys, id_, vec, k).select(*keys, "id", F.posexplode("rs").alias("at", "r")).select(*keys, "id", (F.col("at") + 1).alias("rank"), "r")


def pairs_within(df: DataFrame, keys: list[str], id_: str, vec: str, radii: list[float]) -> DataFrame:
    """keys, pairs, within: ordered pairs of different vectors of every group, and how many are nearer than each radius. Only counts are shuffled."""
    out = T.StructType([*_key_fields(df, keys), T.StructField("pairs", T.LongType()), T.StructField("within", T.ArrayType(T.LongType()))])

    def kernel(key: tuple, queries: tuple, points: tuple) -> pd.DataFrame:
        (ids, q), (others, p) = queries, points
        pairs, within = 0, np.zeros(len(radii), dtype=np.int64)
        for at, d2, error, _ in _chunks(q, p):
            other = others[None, :] != ids[at : at + len(d2), None]
            pairs += int(other.sum())
            for n, r in enumerate(radii):
                unsure = (np.abs(d2 - r * r) <= 2 * error) & other
                i, j = np.nonzero(unsure)
                near = np.sqrt(((q[at + i] - p[j]) ** 2).sum(axis=1)) < r
                within[n] += int(((d2 < r * r) & other & ~unsure).sum()) + int(near.sum())
        return pd.DataFrame([(*key, pairs, within)], columns=out.names)

    each = [F.sum(F.get("within", F.lit(n))) for n in range(len(radii))]
    return _compared(df, keys, id_, vec, kernel, out).groupBy(*keys).agg(F.sum("pairs").alias("pairs"), F.array(*each).alias("within"))


def _lists(neighbours: DataFrame, keys: list[str], k: int) -> DataFrame:
    """nearest() with lists of up to k, from it or from neighbour_distances()."""
    if "rs" in neighbours.columns:
        return neighbours.withColumn("rs", F.slice("rs", 1, k))
    r = F.transform(F.array_sort(F.collect_list(F.struct("rank", "r"))), lambda x: x["r"])
    return neighbours.where(F.col("rank") <= k).groupBy(*keys, "id").agg(r.alias("rs"))


def two_nn(neighbours: DataFrame, keys: list[str], keep: float = 0.9) -> DataFrame:
    """keys, twonn: slope through the origin of -ln(1 - i/N) on ln(r2/r1), over the lowest `keep` of the ratios.

    neighbours: of nearest() or neighbour_distances(). The ratios are numbered by ranges, so no task orders a group.
    """
    mu = _lists(neighbours, keys, 2).where((F.size("rs") > 1) & (F.get("rs", F.lit(0)) > 0))
    mu = numbered(mu.select(*keys, "id", F.log(F.col("rs")[1] / F.col("rs")[0]).alias("x")), keys, ["x", "id"], "i", total="n")
    mu = mu.where(F.col("i") <= F.floor(F.col("n") * keep))
    y = -F.log(1 - F.col("i") / F.col("n"))
    return mu.groupBy(*keys).agg((F.sum(F.col("x") * y) / F.sum(F.col("x") * F.col("x"))).alias("twonn"))


def neighbour_dimensions(neighbours: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """keys, mle, mom, mada from the k nearest neighbours; points with a zero distance are left out of mle and mada."""
    own = _lists(neighbours, keys, k).where(F.size("rs") == k)
    rk, half = F.element_at("rs", k), F.element_at("rs", max(1, k // 2))
    logs = F.aggregate(F.slice("rs", 1, k - 1), F.lit(0.0), lambda acc, x: acc + F.log(rk / x)) / (k - 1)
    m1 = F.aggregate("rs", F.lit(0.0), lambda acc, x: acc + x) / k
    ok = F.element_at("rs", 1) > 0
    per = own.select(*keys, F.when(ok, logs).alias("inv"), F.when(rk > m1, m1 / (rk - m1)).alias("mom"), F.when(ok & (rk > half), F.log(F.lit(2.0)) / F.log(rk / half)).alias("mada"))
    return per.groupBy(*keys).agg((1 / F.avg("inv")).alias("mle"), F.avg("mom").alias("mom"), F.avg("mada").alias("mada"))


#: Metrics that the distances to the nearest neighbours suffice for, and how many each takes.
NEAREST = {"twonn": 2, "mle": 20, "mada": 20, "mind_ml": 21, "mom": 100}


def nearest_metrics(df: DataFrame, keys: list[str], id_: str, vec: str, metrics: list[str] | None = None, max_dim: int = 10) -> DataFrame:
    """keys, metric, value, n for metrics of NEAREST over whole groups, by exact neighbours found in blocks.

    As the kernels of these names with their defaults, but for equal vectors: a
    point at distance 0 of another is left out of twonn, mle and mada instead
    of all being jittered. Groups of two vectors or fewer have null values.
    """
    metrics = list(NEAREST) if metrics is None else metrics
    near = settle(nearest(df, keys, id_, vec, max(NEAREST[m] for m in metrics)))
    at = lambda k: F.get("rs", k - 1)
    m = F.size("rs")
    k, last = F.least(m, F.lit(20)), F.least(m, F.lit(21))
    apart = at(F.lit(1)) > 0
    logs = F.aggregate(F.slice("rs", F.lit(1), k - 1), F.lit(0.0), lambda acc, x: acc + F.log(at(k) / x)) / (k - 1)
    mean = F.aggregate("rs", F.lit(0.0), lambda acc, x: acc + x) / m
    half = at(F.greatest(F.floor(k / 2).cast("int"), F.lit(1)))
    rho = F.greatest(F.least(at(F.lit(1)) / at(last), F.lit(1 - 1e-12)), F.lit(1e-12))
    likely = [F.log((last - 1) * d) + (d - 1) * F.log(rho) + (last - 2) * F.log(1 - F.pow(rho, F.lit(d))) for d in range(1, max_dim + 1)]
    many = m > 1
    own = near.select(
        *keys, F.when(many & apart, logs).alias("mle"), F.when(many & (at(m) > mean), mean / (at(m) - mean)).alias("mom"),
        F.when(many & apart & (at(k) > half), F.log(F.lit(2.0)) / F.log(at(k) / half)).alias("mada"), *[F.when(many, x).alias(f"__d{d}") for d, x in enumerate(likely, 1)],
    )
    best = F.greatest(*[F.sum(f"__d{d}") for d in range(1, max_dim + 1)])
    dim = F.coalesce(*[F.when(F.sum(f"__d{d}") == best, F.lit(float(d))) for d in range(1, max_dim + 1)])
    values = {"mle": 1 / F.avg("mle"), "mom": F.avg("mom"), "mada": F.avg("mada"), "mind_ml": dim}
    wide = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[values[x].alias(f"__{x}") for x in metrics if x != "twonn"])
    if "twonn" in metrics:
        t = two_nn(near, keys).select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keys)], F.col("twonn").alias("__twonn"))
        cond = F.lit(True)
        for i, c in enumerate(keys):
            cond = cond & F.col(f"`{c}`").eqNullSafe(F.col(f"__k{i}"))
        wide = wide.join(t, cond, "left")
    cells = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"__{x}").alias("value")) for x in metrics])).alias("c")
    return wide.select(*keys, cells, "n").select(*keys, "c.metric", "c.value", "n")


def correlation_integral(df: DataFrame, keys: list[str], id_: str, vec: str, lo: float, hi: float) -> DataFrame:
    """keys, corrint: the slope of the log share of pairs nearer than lo and hi; null where none is nearer than lo."""
    c = pairs_within(df, keys, id_, vec, [lo, hi]).select(*keys, (F.col("within")[0] / F.col("pairs")).alias("a"), (F.col("within")[1] / F.col("pairs")).alias("b"))
    return c.select(*keys, F.when((F.col("a") > 0), (F.log("b") - F.log("a")) / (F.log(F.lit(hi)) - F.log(F.lit(lo)))).alias("corrint"))


def tensor_shape(df: DataFrame, layer: str, vec: str) -> DataFrame:
    """n_layers, n_vectors, least_dim, most_dim: what a model's description would say, from the data."""
    size = F.size(vec)
    return df.agg((F.max(layer) + 1).alias("n_layers"), F.count(F.lit(1)).alias("n_vectors"), F.min(size).alias("least_dim"), F.max(size).alias("most_dim"))
