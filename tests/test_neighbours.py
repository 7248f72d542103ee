"""Blocked neighbours and numbers by range, against brute force."""

import math

import numpy as np

from vecloom.operators import vectors as V
from vecloom.operators.ranges import numbered


def _frame(spark, x):
    rows = [("g" if i % 3 else None, i, None if i == 7 else [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "g string, id bigint, v array<float>").repartition(4)


def _brute(x, k):
    x = x.astype(np.float32).astype(float)
    out = {}
    for mod in (True, False):
        ids = [i for i in range(len(x)) if bool(i % 3) == mod and i != 7]
        for i in ids:
            out[i] = sorted(math.sqrt(((x[i] - x[j]) ** 2).sum()) for j in ids if j != i)[:k]
    return out


def test_blocks_give_the_exact_neighbours(spark, monkeypatch):
    x = np.random.default_rng(1).normal(size=(150, 4))
    x[20:24] = x[26]  # equal vectors are at distance 0, others not
    want = _brute(x, 6)
    for rows in (4096, 16):
        monkeypatch.setattr(V, "BLOCK_ROWS", rows)
        got = {r.id: r.rs for r in V.nearest(_frame(spark, x), ["g"], "id", "v", 6).collect()}
        assert set(got) == set(want) and all(np.allclose(got[i], want[i], atol=1e-12) for i in want)
        assert got[26][0] == 0.0
        long = V.neighbour_distances(_frame(spark, x), ["g"], "id", "v", 2).collect()
        assert len(long) == 2 * len(want) and {r["rank"] for r in long} == {1, 2}


def test_pairs_within_radii(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 20)
    x = np.round(np.random.default_rng(2).normal(size=(120, 3)), 1)  # distances that are equal to a radius
    want = _brute(x, 1000)
    for r in V.pairs_within(_frame(spark, x), ["g"], "id", "v", [0.5, 1.0]).collect():
        own = [d for i, ds in want.items() if bool(i % 3) == (r.g is not None) for d in ds]
        assert r.pairs == len(own) and list(r.within) == [sum(d < 0.5 for d in own), sum(d < 1.0 for d in own)]


def test_few_vectors(spark):
    df = _frame(spark, np.ones((3, 2)))
    assert {r.id: list(r.rs) for r in V.nearest(df, ["g"], "id", "v", 5).collect()} == {0: [], 1: [0.0], 2: [0.0]}
    assert V.nearest(df.where("false"), ["g"], "id", "v", 5).collect() == []
    assert V.two_nn(V.nearest(df, ["g"], "id", "v", 2), ["g"]).collect() == []


def test_numbers_by_range(spark):
    rows = [("a" if i % 5 else None, i * 7 % 200, i % 3 + 1) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x int, w int")
    from pyspark.sql import functions as F

    got = numbered(df, ["g"], ["x"], "i", F.col("w").cast("bigint"), total="n").collect()
    for g in ("a", None):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.x)
        assert [r.i for r in own] == list(np.cumsum([r.w for r in own])) and {r.n for r in own} == {sum(r.w for r in own)}
    assert numbered(df.where("false"), [], ["x"], "i").collect() == []


def test_whole_groups_as_the_kernels(spark, monkeypatch):
    from vecloom.operators import kernels as K
    from vecloom.operators import metrics

    monkeypatch.setattr(V, "BLOCK_ROWS", 64)
    x = np.random.default_rng(3).normal(size=(200, 5))
    df = spark.createDataFrame([("g", i, [float(v) for v in row]) for i, row in enumerate(x)] + [("two", i, [float(i)]) for i in range(2)] + [("one", 0, [1.0])], "g string, id bigint, v array<double>")
    got = {(r.g, r.metric): r for r in metrics.vector_agg(df, ["g"], "id", "v", list(V.NEAREST)).collect()}
    assert all(abs(got["g", m].value - K.METRICS[m][1](K.Cloud(x))) < 1e-6 and got["g", m].n == 200 for m in V.NEAREST)
    assert all(got[g, m].value is None for g in ("one",) for m in V.NEAREST) and got["two", "twonn"].value is None


def test_spearman_by_pairs_and_side_by_side(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vecloom.operators import rankstats

    rng = np.random.default_rng(4)
    rows = [(float(rng.integers(0, 4)), float(a), float(rng.normal()), 1.0) for a in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = None
    for share in (1 / 4096, 1 / 100, 2.0):  # all hot, some, none
        monkeypatch.setattr(rankstats, "HOT_SHARE", share)
        for lacking in (False, True):
            own = df.unionByName(df.limit(1).select("a", F.lit(None).cast("double").alias("b"), "c", "d")).where("b is not null or a is not null") if lacking else df
            got = {(r.m1, r.m2): r.rho for r in rankstats.spearman(own.where("b is not null") if not lacking else own, ["a", "b", "c", "d"]).collect() if "b" in (r.m1, r.m2)}
            want = want or got
            assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-12 for k in want)
