"""Exact quantiles per key, against sorting."""

import math
import random

from vecloom.operators import hotkeys as H
from pyspark.sql import functions as F


def _disc(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(p * len(s) - 1e-9)) - 1] if s else None


def _profile(spark, rows, **kw):
    df = spark.createDataFrame(rows, "k string, v double, field_name int")
    return {r.key_text: r for r in H.key_profile(df, {"k": F.col("k")}, ["v"], **kw).collect()}


def test_quantiles_as_by_sorting(spark, monkeypatch):
    monkeypatch.setattr(H, "BINS", 8)  # several passes
    rng = random.Random(1)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.random() * 1e300, -0.0, 5.0]), 1) for _ in range(900)] + [(k, rng.random(), 1) for k in "abc" for _ in range(20)]
    rows += [("hot", None, 1), ("hot", float("nan"), 1), (None, 1.0, 1), ("none", None, 1), ("inf", float("inf"), 1)]
    probs = (0.0, 0.1, 0.5, 0.9, 1.0)
    got = _profile(spark, rows, probs=probs)
    assert set(got) == {"hot", "a", "b", "c", "none", "inf"}
    for k, r in got.items():
        own = [v for key, v, _ in rows if key == k and v is not None and math.isfinite(v)]
        assert r.n_rows == sum(x[0] == k for x in rows) and r.n_values == len(own)
        assert r.quantiles == ([_disc(own, p) for p in probs] if own else None)
        assert abs(r.share - r.n_rows / len(rows)) < 1e-12


def test_intervals_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    rows = [("a", float(i * i), 0) for i in range(500)] + [("b", float(i), 0) for i in range(5)]
    got = _profile(spark, rows)
    assert got["a"].quantiles == [_disc([float(i * i) for i in range(500)], p) for p in (0.25, 0.5, 0.75)]
    assert got["b"].quantiles == [1.0, 2.0, 3.0]


def test_heavy_keys(spark):
    df = spark.createDataFrame([(" noun ",)] * 3 + [("NOUN",)] * 3 + [("x",)] * 2 + [(None,)] * 12, "pos string").withColumn("v", F.lit(1))
    assert [tuple(r) for r in H.heavy_keys(H.key_profile(df, {"pos": H.tag("pos")}, ["v"]), 0.3).collect()] == [("pos", "NOUN")]


def test_empty_table(spark):
    assert _profile(spark, []) == {}
