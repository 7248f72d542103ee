"""Vector aggregates against closed forms, NumPy and manifolds of known dimension."""

import math

import numpy as np
import pytest

from vecloom.functions.stats import spearman_p
from vecloom.operators import kernels as K
from vecloom.operators import metrics, outliers, rankstats, vectors
from vecloom.sources import embedder, manifolds, tables

EXPECTED = {  # name: least and greatest plausible value of the non-linear estimators at n = 500
    "IG-16": (8, 22), "AG-16": (5, 20), "LR-4-in-64": (3, 5.5), "SR-2": (1.6, 2.9),
}


def _frame(spark, x, group="g"):
    return spark.createDataFrame([(group, i, [float(v) for v in row]) for i, row in enumerate(x)], "g string, id bigint, v array<double>")


def test_flat_and_rank_one_spectra():
    x = np.concatenate([np.eye(8), -np.eye(8)])
    c = K.Cloud(x)
    assert [round(K.from_spectrum(c.spectrum, m), 6) for m in ("pr", "erank", "sf", "stable_rank")] == [8, 8, 1, 8]
    assert abs(K.iso_score(c) - 1) < 1e-9
    one = K.Cloud(np.outer(np.arange(10), np.ones(4)))
    assert [round(K.from_spectrum(one.spectrum, m), 6) for m in ("pr", "stable_rank", "pca99")] == [1, 1, 1] and abs(K.iso_score(one)) < 1e-9


@pytest.mark.parametrize(("name", "n", "pr", "erank", "stable"), [("IG-16", 2000, 15.872, 15.936, 13.877), ("AG-16", 2000, 6.549, 8.585, 3.773), ("LR-4-in-64", 2000, 3.992, 3.997, 3.759)])
def test_linear_metrics_of_manifolds(name, n, pr, erank, stable):
    lam = K.Cloud(manifolds.MAKERS[name](n)).spectrum
    got = [K.from_spectrum(lam, m) for m in ("pr", "erank", "stable_rank")]
    assert np.allclose(got, [pr, erank, stable], rtol=0.06)


@pytest.mark.parametrize("name", list(EXPECTED))
def test_non_linear_dimensions_of_manifolds(name):
    c = K.Cloud(manifolds.MAKERS[name](500))
    lo, hi = EXPECTED[name]
    for m in ("twonn", "gride", "mle", "mom", "tle", "mada", "corrint", "ess"):
        v = K.METRICS[m][1](c)
        assert lo * 0.7 <= v <= hi * 1.3, (m, v)
    assert 1 <= K.mind_ml(c) <= 10 and 1 <= K.graph_length(c) <= c.d and K.fishers(c) > 0


def test_danco_on_the_swiss_roll():
    assert K.danco(K.Cloud(manifolds.swiss_roll(300))) in (2.0, 3.0)


def test_edge_groups():
    for x in (np.zeros((0, 3)), np.zeros((1, 3)), np.ones((2, 3)), np.ones((30, 3)), np.random.default_rng(1).normal(size=(5, 20))):
        for m in K.METRICS:
            metrics.evaluate(m, K.Cloud(x))
    assert metrics.evaluate("pr", K.Cloud(np.zeros((0, 3)))) == (None, None)


def test_moments_do_not_depend_on_the_partitioning(spark):
    x = np.random.default_rng(3).normal(size=(200, 6)) + 5
    c = K.Cloud(x)
    for parts in (1, 7):
        df = _frame(spark, x).repartition(parts)
        got = {r.metric: r.value for r in metrics.spectral_agg(df, ["g"], "v").collect()}
        assert all(abs(got[m] - K.from_spectrum(c.spectrum, m)) < 1e-6 for m in K.SPECTRAL)
        p = vectors.participation(df, ["g"], "v").first()
        assert abs(p.pr - got["pr"]) < 1e-6 and abs(p.iso_score - K.iso_score(c)) < 1e-6
        assert abs(vectors.vmf_kappa(df, ["g"], "v").first().vmf_kappa - K.vmf(c)) < 1e-6


def test_sql_neighbours_as_the_kernels(spark):
    x = np.random.default_rng(4).normal(size=(120, 5))
    df, c = _frame(spark, x), K.Cloud(x)
    near = vectors.neighbour_distances(df, ["g"], "id", "v", 20)
    assert abs(vectors.two_nn(near, ["g"]).first().twonn - K.twonn(c)) < 1e-6
    r = vectors.neighbour_dimensions(near, ["g"]).first()
    assert abs(r.mle - K.mle(c)) < 1e-6 and abs(r.mom - K.mom(c, 20)) < 1e-6 and abs(r.mada - K.mada(c)) < 1e-6


def test_pca_is_centred_and_uncorrelated(spark):
    x = np.random.default_rng(5).normal(size=(100, 6)) * [5, 3, 2, 1, 1, 1] + 7
    got = np.array([[r.pc1, r.pc2, r.pc3] for r in metrics.pca_projection(_frame(spark, x), ["g"], "id", "v").orderBy("id").collect()])
    assert np.allclose(got, K.pca(x), atol=1e-6) and np.allclose(got.mean(axis=0), 0, atol=1e-8)


def test_outlier_dimensions(spark):
    m = spark.createDataFrame([(layer, d, 10.0 if d == 3 else 0.0) for layer in range(3) for d in range(20)], "layer int, dim int, mean double")
    got = [tuple(r) for r in outliers.outlier_dimensions(m, "layer").orderBy("layer").collect()]
    thr = 0.5 + 3 * math.sqrt(0.05 * 100 - 0.25)
    assert [g[:3] for g in got] == [(0, 1, 0), (1, 1, 1), (2, 1, 1)] and abs(got[0][3] - (10 - thr)) < 1e-9


def test_spearman_with_ties_and_gaps(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.integers(0, 5)), float(a), None if a % 7 == 0 else float(a * a), 1.0) for a in range(60)]
    got = {(r.m1, r.m2): r for r in rankstats.spearman_matrix(spark.createDataFrame(rows, "a double, b double, c double, d double"), ["a", "b", "c", "d"]).collect()}
    import pandas as pd

    want = pd.DataFrame(rows, columns=list("abcd"), dtype=float).corr(method=lambda x, y: pd.Series(x).rank().corr(pd.Series(y).rank()))
    for m1, m2 in (("a", "b"), ("a", "c"), ("b", "c")):
        assert abs(got[m1, m2].rho - want.loc[m1, m2]) < 1e-9 and got[m1, m2].rho == got[m2, m1].rho
    assert got["b", "c"].cell == "1.00***" and got["a", "d"].rho is None and got["a", "d"].cell == "" and got["a", "a"].cell == "1.00"


def test_p_values():
    assert abs(spearman_p(0.139, 200) - 0.0496) < 2e-4 and abs(spearman_p(0.1815, 200) - 0.0101) < 2e-4 and abs(spearman_p(0.2305, 200) - 0.00102) < 2e-5
    assert spearman_p(1.0, 10) == 0.0 and spearman_p(0.5, 2) is None


def test_min_max(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", None), ("c", 2.0), ("c", 2.0)], "metric string, value double")
    got = sorted(((r.metric, r.value, r.norm) for r in rankstats.min_max(df, "metric", "value").collect()), key=repr)
    assert got == [("c", 2.0, 0.0), ("c", 2.0, 0.0), ("m", 1.0, 0.0), ("m", 3.0, 1.0), ("m", None, None)]


def test_bootstrap_pairs_layers_and_registers_metrics(spark):
    K.register_metric("first_mean", lambda x: float(x[:, 0].mean()))
    rows = [("c", layer, i, [float(i), 1.0]) for layer in (0, 1) for i in range(40)] + [("small", 0, 1, [0.0, 0.0])]
    got = metrics.bootstrap(spark.createDataFrame(rows, "cls string, layer int, id bigint, v array<double>"), "cls", "layer", "id", "v", "first_mean", reps=20, m=40).orderBy("layer").collect()
    del K.METRICS["first_mean"]
    assert len(got) == 2 and got[0]["mean"] == got[1]["mean"] and got[0].ci_low < got[0]["mean"] < got[0].ci_high


def test_embedding_hook(spark, tmp_path):
    df = spark.createDataFrame([("s", ["abcdefgh", "xy", ""])], "sentence_id string, words array<string>")
    v = {m: {(r.word_id, r.layer): np.array(r.vec) for r in embedder.embed(df, embedder.hash_model, m).collect()} for m in ("first", "last", "mean")}
    assert len(v["mean"]) == 6 and np.allclose(v["mean"][0, 1], (v["first"][0, 1] + v["last"][0, 1]) / 2, atol=1e-6)
    with pytest.raises(RuntimeError, match="none of"):
        embedder.load_first(["a", "b"], lambda name: 1 / 0)
    t = spark.createDataFrame([("s", i) for i in range(4)], "sentence_id string, word_id int")
    assert tables.missing_vectors(t, embedder.embed(df, embedder.hash_model), ["sentence_id", "word_id"]) == 1


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('sentence_id,tokens,pos\ns1,"[\'a\', ""b""]","x\ny"\n')
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), ["sentence_id", "tokens"])
    assert df.collect()[0].tokens == "['a', \"b\"]"
    stats = spark.createDataFrame([("1", 0, "pr", float("nan"), 1.0, 2.0, 5)], "cls string, layer int, metric string, mean double, ci_low double, ci_high double, n_tokens int")
    out = tables.result_rows(stats, "all", "m", "index", "cls", "layer", "first", "a.csv")
    tables.write_results(out, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out")).collect()[0]
    assert back["class"] == "1" and back["mean"] is None and back.metric == "pr" and len(out.columns) == 12
    ids = tables.dense_id(spark.range(1000).selectExpr("id * 7 % 1000 as k"), ["k"]).collect()
    assert all(r.k == r.token_id for r in ids)


def test_points_over_all_embeddings(spark, sf):
    from vecloom.operators import sampling
    from vecloom.plans import reference

    got = reference.metric_points(spark, sf).collect()
    names = {"iso", "sf", "erank", "pr", "stable_rank", "vmf_kappa", "lpca", "lpca99", "twonn", "gride", "mle", "mom", "tle", "corrint", "fishers", "ess", "mada"}
    assert sorted(r.point_id for r in got) == list(range(200)) and {r.n for r in got} == {50} and set(got[0].asDict()) == {"point_id", "n", *names}
    # 50 vectors in 64 dimensions are all separable: FisherS is undefined.
    assert all(any(r[m] is not None for r in got) for m in names - {"fishers"})
    s = sampling.subsamples(spark.range(3000), ["id"], 40, 50).collect()
    assert len(s) == 2000 and len({(r.point_id, r.id) for r in s}) == 2000 and len({r.id for r in s}) > 1000


def test_bootstrap_draws_as_many_as_there_are(spark):
    from pyspark.sql import functions as F

    K.register_metric("size", lambda x: float(len(x)))
    got = metrics.bootstrap(spark.range(1200).select(F.lit("c").alias("cls"), F.lit(0).alias("layer"), "id", F.array(F.col("id").cast("double")).alias("v")), "cls", "layer", "id", "v", "size", reps=3).collect()
    del K.METRICS["size"]
    assert [(r["mean"], r.ci_low, r.ci_high, r.n_tokens) for r in got] == [(1200.0, 1200.0, 1200.0, 1200)]


def test_danco_beyond_32_dimensions():
    x = np.random.default_rng(8).normal(size=(600, 48))
    x *= np.random.default_rng(9).random((600, 1)) ** (1 / 48) / np.linalg.norm(x, axis=1, keepdims=True)
    assert 38 <= K.danco(K.Cloud(x)) <= 48


def test_moment_metrics_take_whole_groups(spark):
    x = np.random.default_rng(11).normal(size=(300, 6)) * [3, 2, 1, 1, 1, 1] + 1
    got = {r.metric: r for r in metrics.vector_agg(_frame(spark, x), ["g"], "id", "v", [*K.MOMENT, "vmf_kappa", "twonn"], caps={"fast": 50, "heavy": 50}).collect()}
    c = K.Cloud(x)
    assert all(got[m].n == 300 and abs(got[m].value - K.METRICS[m][1](c)) < 1e-6 for m in (*K.MOMENT, "vmf_kappa"))
    assert got["twonn"].n == 50


def test_isotropy_in_one_pass(spark):
    """As participation() and vmf_kappa(), for any kind of key, null keys among them; the vectors are read once and written nowhere."""
    import decimal

    from pyspark.sql import functions as F

    from vecloom.operators import vectors

    rng = np.random.default_rng(5)
    vecs = [[float(x) for x in rng.normal(size=3) + 1] for _ in range(60)]
    vecs[3], vecs[4], vecs[5] = None, [1.0, None, 2.0], [1.0, float("nan"), 2.0]
    rows = [(["a", None, "b"][i % 3], [1, None][i % 2], decimal.Decimal(i % 2), v) for i, v in enumerate(vecs)]
    df = spark.createDataFrame(rows, "k string, l int, m decimal(5,2), v array<double>").repartition(4)
    got = {r[:3]: r for r in vectors.isotropy(df, ["k", "l", "m"], "v").collect()}
    assert len(got) == 6
    for part, names in ((vectors.participation, ("d", "pr", "iso_score")), (vectors.vmf_kappa, ("vmf_kappa",))):
        want = part(df, ["k", "l", "m"], "v").collect()
        assert len(want) == 6 and all(abs(got[r[:3]][c] - r[c]) < 1e-9 for r in want for c in names)
    x = np.array([v for i, v in enumerate(vecs) if i % 6 == 0])
    assert abs(got["a", 1, 0].pr - K.METRICS["pr"][1](K.Cloud(x))) < 1e-9
    assert vectors.isotropy(df.where("false"), ["k"], "v").collect() == []
    whole = vectors.isotropy(df.where("l = 1").withColumn("v", F.col("v").cast("array<float>")), [], "v").collect()
    assert len(whole) == 1 and whole[0].d == 3


def test_class_layer_metrics_keep_no_vectors(spark, sf, monkeypatch):
    """They wrote every vector to the shared folder first, and joined the vectors to the tokens."""
    from vecloom.plans import reference

    monkeypatch.setattr(reference, "settle", lambda df: 1 / 0)
    df = reference.class_layer_metrics(spark, sf)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 20


def test_pca_by_few_layers_keeps_the_rows_where_they_are(spark, sf):
    """The tokens' vectors were joined, which broadcast one side, written, and shuffled by layer."""
    from pyspark.sql import functions as F

    from vecloom.plans import reference

    df = _frame(spark, np.random.default_rng(6).normal(size=(90, 6)) * [5, 3, 2, 1, 1, 1] + 7).withColumn("layer", F.col("id") % 2)
    ways = [{(r.layer, r.id): (r.pc1, r.pc2, r.pc3) for r in metrics.pca_projection(df, ["layer"], "id", "v", **how).collect()} for how in ({}, {"few": True}, {"few": True, "d": 6})]
    assert len(ways[0]) == 90 and all(way.keys() == ways[0].keys() and all(np.allclose(v, way[k], atol=1e-12) for k, v in ways[0].items()) for way in ways[1:])
    got = reference.pca3d_tokens(spark, sf)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1 and "hashpartitioning(layer" not in plan.split("BroadcastExchange")[0]
    assert got.count() == reference.token_vectors(spark, sf).count() and got.where("pc1 is null or pc2 is null or pc3 is null").count() == 0
