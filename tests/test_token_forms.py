"""The forms of token rows, first rows of a key, tokens with vectors, and labelled tables."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vecloom.operators import lists, metrics, profile, rankstats, tokens
from vecloom.sources import embedder

SENT = "sid string, words string, idx string, upos string"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_index_form(spark):
    df = spark.createDataFrame([("s", "['a', 'b', 'c', 'd', 'e']", "['1', '0', '3.7', '12']", None), ("t", "['x']", None, None), ("u", None, "[1]", None)], SENT)
    assert _rows(tokens.expand_by_index(df)) == [("s", 0, "1", "a"), ("s", 3, "10", "d")]
    assert _rows(tokens.expand_by_index(df, include_zero=True, exclude_first=True)) == [("s", 1, "0", "b"), ("s", 3, "10", "d")]
    with pytest.raises(ValueError, match="index"):
        tokens.expand_by_index(df.drop("idx"))
    assert tokens.expand_by_index(df.where("false")).collect() == []


def test_pos_form(spark):
    df = spark.createDataFrame([("s", "['a', 'b', 'c', 'd']", None, "['X', 'x', None]"), ("t", "['a'", None, "['NOUN']"), ("u", "['a']", None, "['a', 1 2]")], SENT)
    assert _rows(tokens.expand_by_pos(df)) == [("s", 1), ("s", 2), ("t", 0)]


def test_keep_first(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", None, "x"), ("a", 2, "b"), ("b", None, "z"), (None, 1, "n"), (None, 1, "m")], "k string, o int, v string")
    assert _rows(tokens.keep_first(df.repartition(3), ["k"], ["o"])) == [("a", 2, "b"), ("b", None, "z"), (None, 1, "m")]
    assert tokens.keep_first(df.where("false"), ["k"], ["o"]).collect() == []


def test_lists_in_the_jvm_as_by_python(spark):
    cells = ["['a', None, \"b's\", 3, -0, 007]", "['a', None, \"b's\", 3, -12,]", "[ ]", "[None]", "[Nonesuch]", "['a' 'b']", "['\\n', 'x']", "[1.50]", "['a',, 'b']", "[['a']]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = {r.i: r.x for r in df.select("i", lists.parse_list(F.col("c")).alias("x")).collect()}
    assert got == {0: None, 1: ["a", None, "b's", "3", "-12"], 2: [], 3: [None], 4: None, 5: ["ab"], 6: ["\n", "x"], 7: ["1.5"], 8: None, 9: ["['a']"]}


def test_pieces_are_pooled(spark):
    df = spark.createDataFrame([("s", ["abcdefgh", "", "xy"], [4, 7, 9])], "sentence_id string, words array<string>, word_ids array<int>")
    pieces = embedder.embed_pieces(df, embedder.digest_model)
    v = {m: {(r.word_id, r.layer): np.array(r.vec) for r in embedder.pool_pieces(pieces, m).collect()} for m in ("first", "last", "mean")}
    assert set(v["mean"]) == {(w, layer) for w in (4, 7, 9) for layer in (0, 1)}
    assert np.allclose(v["mean"][4, 1], (v["first"][4, 1] + v["last"][4, 1]) / 2) and np.allclose(v["first"][9, 0], v["last"][9, 0])
    with pytest.raises(ValueError, match="mode"):
        embedder.pool_pieces(pieces, "sum")


def test_a_missing_key_fails(spark):
    t = spark.createDataFrame([("s", 0), ("s", 1)], "sentence_id string, word_id int")
    v = spark.createDataFrame([("s", 0, [1.0])], "sentence_id string, word_id int, vec array<double>")
    assert embedder.attach(t, v).count() == 1 and embedder.attach(t.where("word_id = 0"), v, missing="fail").first().vec == [1.0]
    with pytest.raises(PySparkException, match="no vector for word 1 of sentence s"):
        embedder.attach(t, v, missing="fail").collect()


def test_tokens_are_embedded_where_they_stand(spark):
    """As by pieces, in every pooling; sentences reach over batches, repeated rows count once, and null ids are like others."""
    rows = [(s, w, f"{'äb' * ((s or 7) % 4)}w{w}", 1) for s in (1, 2, None) for w in range(9)] + [(2, 3, "later", 2), (2, 3, "latest", None), (2, None, "nameless", 1)]
    df = spark.createDataFrame(rows, "sentence_id bigint, word_id int, word string, at int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {how: {(r.sentence_id, r.word_id, r.word, r.layer): r.vec for r in embedder.embed_tokens(embedder.together(df, ["at", "word"]), embedder.digest_model, ["word"], how).collect()} for how in ("first", "last", "mean")}
        wide = embedder.embed_tokens(embedder.together(df, ["at", "word"]), embedder.digest_model, ["word"], wide=True).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    once = [r[:3] for r in rows if "late" not in r[2]]
    assert set(got["mean"]) == {(*r, layer) for r in once for layer in (0, 1)}
    words = spark.createDataFrame([(str(i), [w], [0]) for i, (_, _, w) in enumerate(once)], "sentence_id string, words array<string>, word_ids array<int>")
    for how, own in got.items():
        want = {(once[int(r.sentence_id)], r.layer): r.vec for r in embedder.pool_pieces(embedder.embed_pieces(words, embedder.digest_model), how).collect()}
        assert all(np.allclose(v, want[k[:3], k[3]], atol=1e-15) for k, v in own.items())
    assert all(r.vec == got["mean"][r.sentence_id, r.word_id, r.word, 0] + got["mean"][r.sentence_id, r.word_id, r.word, 1] for r in wide) and len(wide) == len(once)


def test_words_without_vectors(spark):
    def odd():
        return lambda words: (np.flatnonzero([w != "" for w in words]), np.ones((2, sum(w != "" for w in words), 3)))

    df = spark.createDataFrame([(1, 0, "a"), (1, 1, ""), (2, 0, "")], "sentence_id bigint, word_id int, word string")
    v = embedder.embed_tokens(embedder.together(df, []), odd, ["word"])
    assert sorted((r.sentence_id, r.word_id, r.layer, r.vec is None) for r in v.collect()) == [(s, w, layer, word == "") for s, w, word in ((1, 0, "a"), (1, 1, ""), (2, 0, "")) for layer in (0, 1)]
    assert embedder.require_vectors(v.where("word <> ''")).count() == 2
    with pytest.raises(PySparkException, match="no vector for word 1 of sentence 1"):
        embedder.require_vectors(v.where("sentence_id = 1")).collect()
    with pytest.raises(ValueError, match="mode"):
        embedder.embed_tokens(df, odd, [], "sum")


def test_gated_histogram(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert profile.histogram(df, "x", 0, 2, gate=True).collect() == [] and profile.histogram(df, "x", 0, 2).count() == 3


def test_layers_share_their_draws(spark):
    rows = [("c", layer, i, [float((i * 37) % 101) + layer]) for layer in (0, 1) for i in range(101)]
    df = spark.createDataFrame(rows, "cls string, layer int, id bigint, v array<double>")
    metrics.K.register_metric("mean0", lambda x: float(x.mean()))
    try:
        a, b = metrics.bootstrap(df, "cls", "layer", "id", "v", "mean0", reps=60).orderBy("layer").collect()
    finally:
        del metrics.K.METRICS["mean0"]
    assert all(abs(b[c] - a[c] - 1) < 1e-9 for c in ("mean", "ci_low", "ci_high")) and a.n_tokens == 101


def test_labelled_cells(spark):
    m = rankstats.spearman_matrix(spark.createDataFrame([(float(i), float(-i), float(i % 3)) for i in range(20)], "a double, b double, c double"), ["a", "b", "c"])
    rows = rankstats.labelled(m, ["c", "zz", "a"], {"c": "Third"}).orderBy("ord").collect()
    assert [r.metric for r in rows] == ["Third", "a"] and rows[0]["Third"] == "1.00" and set(rows[0].asDict()) == {"ord", "metric", "Third", "a"}
