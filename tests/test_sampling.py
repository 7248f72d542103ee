"""Caps and samples: exact sizes for any ids, the same rows at any partitioning."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import sampling as S

ROWS = "g string, id bigint, x int, quota bigint"


def _sizes(df):
    return Counter(r.g for r in df.collect())


@pytest.fixture(params=[20_000, 7])
def bucket_rows(request, monkeypatch):
    monkeypatch.setattr(S, "BUCKET_ROWS", request.param)


def test_exactly_the_cap_for_repeated_ids(spark, bucket_rows):
    rows = [("a", i % 3, 0, 0) for i in range(1000)] + [("b", 1, i, 0) for i in range(400)] + [(None, None, i % 5, 0) for i in range(300)] + [("small", i, i, 0) for i in range(20)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for cap in (0, 1, 100):
        for seed in (1, 2):
            got = _sizes(S.cap_per_group(df, ["g"], ["id"], cap, seed))
            assert got == {g: min(n, cap) for g, n in {"a": 1000, "b": 400, None: 300, "small": 20}.items() if cap}
    kept = S.cap_per_group(df, ["g"], ["id"], 100).collect()
    have = Counter(map(tuple, rows))
    assert all(n <= have[r] for r, n in Counter(map(tuple, kept)).items())


def test_the_same_rows_at_any_partitioning(spark, bucket_rows):
    df = spark.createDataFrame([(str(i % 2), i, i % 7, 0) for i in range(500)], ROWS)
    one, two = (sorted(map(tuple, S.cap_per_group(df.repartition(n), ["g"], ["id"], 60).collect())) for n in (1, 6))
    assert one == two and len(one) == 120


def test_other_columns_do_not_change_the_ids(spark):
    ids = [{r.id for r in S.cap_per_group(spark.range(300).select(F.lit("g").alias("g"), "id", (F.col("id") * k).alias("x")), ["g"], ["id"], 50).collect()} for k in (1, 2)]
    assert ids[0] == ids[1] and len(ids[0]) == 50


def test_a_quota_of_each_group(spark):
    df = spark.createDataFrame([(g, i, 0, q) for g, q in (("a", 3), ("b", 50), ("c", 0), ("d", -1)) for i in range(20)], ROWS)
    assert _sizes(S.first_per_group(df, ["g"], ["id"], F.col("quota"))) == {"a": 3, "b": 20}


def test_empty_and_without_keys(spark):
    df = spark.createDataFrame([], ROWS)
    assert S.cap_per_group(df, ["g"], ["id"], 5).collect() == []
    assert S.first_per_group(spark.range(100), [], ["id"], 7).count() == 7


def test_more_than_there_is_raises(spark):
    with pytest.raises(ValueError, match="samples of 5 rows from 4"):
        S.subsamples(spark.range(4), ["id"], 2, 5)


def test_a_bootstrap_of_moments_takes_whole_classes(spark, monkeypatch):
    """Classes beyond DRAWS were cut to it; here that is 50, and a block holds about 30 different rows."""
    from vecloom.operators import kernels as K
    from vecloom.operators import metrics

    monkeypatch.setattr(metrics, "DRAWS", {"fast": 50, "heavy": 50})
    monkeypatch.setattr(metrics, "DRAW_ROWS", 30)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [4, 2, 1, 1]
    rows = [("a", 2, [float(v) for v in (*r, *(2 * r + 1))]) for r in x] + [("a", 2, [float(v) for v in (*x[0], *(2 * x[0] + 1))])] * 100
    rows += [("b", 2, [float(i % 5)] * 8) for i in range(7)] + [(None, 2, [float(i), 1.0, 0.0, float(i * i)] * 2) for i in range(9)]
    rows += [("few", 2, [1.0] * 8)] * 2 + [("a", 2, None), ("a", 2, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "c string, layers int, v array<double>")
    one, two = ({(r.c, r.layer): r for r in metrics.bootstrap_moments(df.repartition(n), "c", "v", "layers", "pr", reps=300).collect()} for n in (1, 5))
    assert {(k, r.n_tokens) for k, r in one.items()} == {((c, layer), n) for c, n in (("a", 500), ("b", 7), (None, 9)) for layer in (0, 1)}
    for k, r in one.items():
        assert all(abs(r[c] - two[k][c]) < 1e-9 for c in ("mean", "ci_low", "ci_high"))
    for c in ("a", "b", None):  # the second layer is the first one scaled and moved, so pr is the same if the draws are
        assert all(abs(one[c, 0][m] - one[c, 1][m]) < 1e-9 for m in ("mean", "ci_low", "ci_high"))
    whole = np.concatenate([x, np.repeat(x[:1], 100, axis=0)])
    want = [K.METRICS["pr"][1](K.Cloud(whole[rng.integers(0, 500, 500)])) for _ in range(2000)]
    got = one["a", 0]
    assert abs(got["mean"] - np.mean(want)) < 4 * np.std(want) / 300**0.5
    assert abs((got.ci_high - got.ci_low) / (np.percentile(want, 97.5) - np.percentile(want, 2.5)) - 1) < 0.25
    with pytest.raises(ValueError, match="twonn"):
        metrics.bootstrap_moments(df, "c", "v", "layers", "twonn")


def test_the_class_bootstrap_takes_every_token(spark, sf, monkeypatch):
    from vecloom.operators import metrics
    from vecloom.plans import reference

    monkeypatch.setattr(metrics, "DRAWS", {"fast": 20, "heavy": 20})
    n = {(r.index_class, r.layer): r["count"] for r in reference.token_vectors(spark, sf).groupBy("index_class", "layer").count().collect()}
    assert {(r["class"], r.layer): r.n_tokens for r in reference.class_layer_bootstrap(spark, sf).collect()} == n and max(n.values()) > 20


def test_the_class_bootstrap_joins_no_vectors(spark, sf, monkeypatch):
    """The vectors were joined to their tokens, and one side broadcast; now equal tokens are settled as one, and nothing is broadcast."""
    from vecloom.operators import metrics
    from vecloom.plans import reference

    seen = []
    monkeypatch.setattr(metrics, "settle", lambda df: seen.append(df) or df)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (reference.class_layer_bootstrap(spark, sf), *seen)]
    assert len(seen) == 1 and all("Join" not in p and "Broadcast" not in p for p in plans)
    n = reference.token_vectors(spark, sf).where("layer = 0").count()
    assert seen[0].agg(F.sum("__n")).first()[0] == n > seen[0].count()
