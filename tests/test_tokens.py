"""List cells, token rows, classes, profiles."""

import pytest
from pyspark.sql import functions as F

from vecloom import schema
from vecloom.functions.casefold import casefold
from vecloom.operators import lists, profile, sampling, tokens


def _one(spark, cells, **kw):
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    return [r[0] for r in df.select(lists.parse_list(F.col("c"), **kw)).collect()]


def test_parse_list(spark):
    cells = ["['a', 'b']", "[\"don't\", 'x']", "['a', None]", "['\\xa0']", "['a'", "a b", None, "[]", "[1, -2]", "['a\\'b']", "[a b]"]
    assert _one(spark, cells) == [["a", "b"], ["don't", "x"], ["a", None], ["\xa0"], ["['a'"], ["a b"], None, [], ["1", "-2"], ["a'b"], None]
    assert _one(spark, ["[a b]"], on_error="empty") == [[]]
    assert _one(spark, ["[a b]"], on_error="wrap") == [["[a b]"]]
    assert _one(spark, [" a  b "], bare="split") == [["a", "b"]]
    with pytest.raises(Exception, match="no list"):
        _one(spark, ["[a b]"], on_error="fail")


def test_casefold_is_pythons(spark):
    words = ["Straße", "ẞ", "İstanbul", "ΣΊΣΥΦΟΣ", "ﬁn", "ABC", "", None, "ǅ", "Ⅷ", "ᾳ", "Ꭰ"] + [chr(c) for c in range(1, 0x2500) if chr(c).isprintable()]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(casefold("w")).collect()]
    assert got == [None if w is None else w.casefold() for w in words]


def test_expand(spark):
    rows = [("s1", "['A', 'ran', 'ß']", "['x', None]", "[1, '3.7']", "[0, 2]", "['root', 'obj']", "[1, 0]"), ("s2", None, "['a']", "[1]", "[0]", "['r']", "[0]"), ("s3", "['a', 'b']", "['n', 'n']", "[1, 'x']", "[0, 1]", "['r', 'r']", "[0, 0]")]
    df = spark.createDataFrame(rows, "sid string, Tokens string, upos string, position string, head_distance string, deprel string, ariety string")
    got = [tuple(r) for r in tokens.expand_tokens(df).orderBy("sentence_id", "word_id").collect()]
    assert got == [
        ("s1", 0, "A", "X", 1.0, 1, 0.0, "root", 1.0, "a"), ("s1", 1, "ran", None, 3.7, 3, 2.0, "obj", 0.0, "ran"),
        ("s3", 0, "a", "N", 1.0, 1, 0.0, "r", 0.0, "a"), ("s3", 1, "b", "N", None, 1, 1.0, "r", 0.0, "b"),
    ]
    some = tokens.expand_tokens(df.select("sid", "Tokens"), exclude_first=True).orderBy("sentence_id").collect()
    assert [(r.sentence_id, r.word, r["index"], r.pos) for r in some] == [("s1", "ran", 2.0, None), ("s1", "ß", 3.0, None), ("s3", "b", 2.0, None)]
    with pytest.raises(ValueError, match="no column"):
        tokens.expand_tokens(df.drop("sid"))


def test_alias_order():
    assert schema.resolve(["idx", "position"], "index") == "position"
    assert schema.resolve(["Index"], "index") is None and schema.resolve(["Index"], "index", schema.INDEX_CLASS_ALIASES) == "Index"


def test_classes_and_filters(spark):
    df = spark.createDataFrame([(str(x),) for x in (-1, 0, 1, 10, 11, "3.7", "x")], "i string")
    assert [r[0] for r in df.select(tokens.index_class(F.col("i"))).collect()] == [None, None, "1", "10", "10", None, None]
    assert df.select(tokens.index_class(F.col("i"), include_zero=True)).collect()[1][0] == "0"
    t = spark.createDataFrame([("X", 0), ("x", 1), (None, 2), ("NOUN", 3)], "pos string, word_id int")
    assert {r.pos for r in tokens.without_pos(t).collect()} == {"x", None, "NOUN"}
    assert tokens.without_first(t).count() == 3
    with pytest.raises(ValueError, match="no tokens"):
        tokens.require_rows(t.where("false"), "tokens")


def test_histogram_checks_the_range_before_rounding_half_to_even(spark):
    df = spark.createDataFrame([(x,) for x in (-6.4, 0.5, 1.5, 2.5, 6.0, 6.4, None, float("nan"))], "h double")
    got = {r.bin: r.n for r in profile.histogram(df, "h", -6, 6).collect()}
    assert len(got) == 13 and {k: v for k, v in got.items() if v} == {0: 1, 2: 2, 6: 1}


def test_class_profile(spark):
    rows = [("N", "1", "a", "w1"), ("N", "2", "a", "w1"), ("N", "10", "b", "w2"), ("V", None, "b", None), (None, "1", "a", "w")]
    df = spark.createDataFrame(rows, "pos string, idx string, rel string, word_norm string")
    got = {r.pos: r for r in profile.class_profile_wide(df, "pos", ["idx", "rel"]).collect()}
    assert tuple(got["N"]) == ("N", 3, 2, "1", 33.33, "a", 66.67) and tuple(got["V"]) == ("V", 1, 0, None, None, "b", 100.0)
    lists_ = {r.pos: r for r in profile.class_profile_lists(df, "pos", ["idx"], 2).collect()}
    assert lists_["N"].top_idx_vals == ["1", "2"] and lists_["N"].top_idx_counts == [1, 1]


def test_samples_do_not_depend_on_the_partitioning(spark):
    df = spark.range(3000).selectExpr("id", "cast(id % 3 as string) as k").withColumn("k", F.when(F.col("k") != "2", F.col("k")))
    one = {r.id for r in sampling.cap_per_group(df.repartition(1), ["k"], ["id"], 50).collect()}
    many = {r.id for r in sampling.cap_per_group(df.repartition(13), ["k"], ["id"], 50).collect()}
    assert one == many and len(one) == 150
    p = sampling.pool(df, ["id"], 100)
    assert sorted(r.global_idx for r in p.collect()) == list(range(100))
    s = sampling.subsamples(p, ["id"], 3, 20).groupBy("point_id").count().collect()
    assert [r["count"] for r in s] == [20, 20, 20]


def test_confidence_leaves_nan_out(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (float("nan"),), (None,)], "v double")
    r = sampling.confidence(df, [], "v").first()
    assert (round(r["mean"], 6), round(r.ci_low, 6), round(r.ci_high, 6)) == (round(7 / 3, 6), 1.05, 3.9)


def test_explode_shortest_takes_every_readable_sentence(spark, sf):
    from vecloom.operators import rejects
    from vecloom.plans import reference

    sentences = spark.read.parquet(f"{sf}/en_ewt_ud_train_sentences.parquet")
    good = rejects.separate(rejects.classify_sentences(sentences, rejects.known_labels(spark.read.parquet(f"{sf}/relation_labels.parquet"), "relation_type"))).valid
    want = tokens.expand_tokens(good, keep=["row_id"]).groupBy("row_id").count()
    got = {r.row_id: r.n for r in reference.explode_shortest(spark, sf).collect()}
    assert got == {r.row_id: r["count"] for r in want.collect()}
    odd = {r.row_id for r in good.where("pos is not null and pos not like '[%]' and tokens like '[%]'").collect()}
    assert odd & set(got)
