"""Rows that fail to parse, against a reader that takes one character at a time."""

import random

import brute
import pytest

from vecloom.operators import rejects as R

LABELS = ["root", "punct", "acl:relcl"]
SCHEMA = "row_id bigint, tokens string, relation_type string, ariety string, reason string, extra int"
CELLS = [
    ("['a', 'b']", "['root', 'punct']", "[1, 0]"), ("['a', \"n't\"]", "['root', 'punct']", "[1, 0]"), ("['a'", None, None), ("'a', 'b']", None, None), ("['a', b', 'c']", None, None),
    ("['or'der']", None, None), ("['The, 'x']", None, None), ("['a', 'b']", "['root']", None), ("['a']", None, "[0, 1]"), ("a;b", "['root', 'root']", "[0, 0]"), ("a;b;", "['root', 'root']", None),
    ("a;;b", "['root', 'root', 'root']", None), ('{"x"}', "['root']", None), ("['a' 'b']", "['root', 'punct']", None), (None, None, None), ("", "['root']", None), ("  ", None, None), ("[]", None, None), ("[ ]", "[]", None),
    ("['a']", "['ROOT']", None), ("['a']", "[None]", None), ("['a']", "['']", None), ("['a']", None, "[-1]"), ("['a']", None, "['1']"), ("['a']", None, "[1.0]"), ("['a']", None, "[None]"), ("['a']", "", "  "),
    ("['it\\'s', 'b']", None, "[0, 0]"), ("['\\xa0']", None, "[0]"), ('a | """" | b', "['root', 'root', 'root']", None), ("\"n't\" x", None, "[0, 0]"), ("['a',]", "['root']", None), ("[1, 2]", None, "[0, 0]"), ("don't", None, None),
    ("['a']", "root", "0"), ("['a', 'b']", "root punct", "0 1"),
]


def _classified(spark, cells):
    rows = [(i, *c, "old", 7) for i, c in enumerate(cells)]
    return {r.row_id: r for r in R.classify_sentences(spark.createDataFrame(rows, SCHEMA), LABELS).collect()}


def test_cells_as_the_character_reader(spark):
    got = _classified(spark, CELLS)
    assert len(got) == len(CELLS)
    for i, c in enumerate(CELLS):
        assert got[i].reason == brute.reason(*c, set(LABELS)), c
        assert got[i].extra == 7


def test_any_text_as_the_character_reader(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("[]{}'\",;|/ ab1") for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    cells = [(t, "['root']", None) for t in texts]
    got = _classified(spark, cells)
    wrong = [(c, got[i].reason) for i, c in enumerate(cells) if got[i].reason != brute.reason(*c, set(LABELS))]
    assert wrong[:5] == []


LINES = [
    's,"[\'a\']",,,,"[\'root\']","[0]"', "s,['a'],,,,,", 's,"[\'a\']"x,,,,,', 's,"[\'a\'],,,,,', "s,t", "", None, ",,,,,,", "s,a;b,,,,,", 's,"[""n\'t""]",,,,,[0]', "s,['a'],,,,,,", 's,"[\'a\', \'b\']",,,,"[\'root\']",', 'a"b,[1],,,,,',
]


def test_lines(spark):
    df = spark.createDataFrame([(i, t, "keep", None) for i, t in enumerate(LINES)], "line_id bigint, raw_line string, tokens string, note string")
    got = {r.line_id: r for r in R.classify_lines(df, LABELS).collect()}
    for i, t in enumerate(LINES):
        assert got[i].reason == brute.line_reason(t, set(LABELS)), t
    assert got[9].tokens == '["n\'t"]'  # the decoded field replaces the input's column


def test_no_row_is_lost_and_none_is_twice(spark):
    both = R.separate(R.classify_sentences(spark.createDataFrame([(i % 5, *c, "", 1) for i, c in enumerate(CELLS * 2)], SCHEMA), LABELS))
    assert both.valid.count() + both.failing.count() == 2 * len(CELLS)


def test_empty_tables(spark):
    s = spark.createDataFrame([], "row_id bigint, tokens string, relation_type string, ariety string")
    lines = spark.createDataFrame([], "line_id bigint, raw_line string")
    labels = spark.createDataFrame([], "relation_type string")
    assert R.failing_rows(s, lines, labels, ("a", "b")).collect() == []


def test_very_long_cells(spark):
    long = "['" + "', '".join(["word"] * 200_000) + "']"
    cells = [(long, None, None), (long[:-1], None, None), ("w;" * 200_000, None, None), ("['" + "x" * 3_000_000 + "']", "['root']", None)]
    got = _classified(spark, cells)
    assert [got[i].reason for i in range(4)] == [None, "quoting", None, None]


def test_too_many_labels(spark):
    with pytest.raises(ValueError, match="more than"):
        R.known_labels(spark.range(20).selectExpr("cast(id as string) as relation_type"), "relation_type", most=10)


def test_many_labels_are_joined(spark, sf, monkeypatch):
    tables = [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("en_ewt_ud_train_sentences", "sentence_lines", "relation_labels")]
    want = {tuple(r) for r in R.failing_rows(*tables, ("a", "b")).collect()}
    monkeypatch.setattr(R, "MOST_LABELS", 3)
    assert {tuple(r) for r in R.failing_rows(*tables, ("a", "b")).collect()} == want
