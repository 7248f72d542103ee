"""Mixes: shares, caps and repeats."""

import random

from vecloom.llm import mixing as M

DOCS, TARGETS = "doc_id bigint, text string, source string, weight int", "mix_id string, source string, weight double, max_repeats bigint, total_factor double"


def test_water_filling():
    assert M.water_fill([(0.5, 100), (0.5, 100)], 50) == [25, 25]
    assert M.water_fill([(0.5, 10), (0.25, 100), (0.25, 100)], 50) == [10, 20, 20]
    assert M.water_fill([(0.5, 10), (0.4, 12), (0.1, 100)], 50) == [10, 12, 28]
    assert M.water_fill([(0.6, 1), (0.4, 2)], 50) == [1, 2]
    assert M.water_fill([(0.0, 5), (1.0, 9)], 4) == [0.0, 4.0] and M.water_fill([], 3) == []


def test_shares_repeats_and_shortfalls(spark, monkeypatch):
    monkeypatch.setattr(M.R, "BUCKET_ROWS", 100)
    rng = random.Random(6)
    rows = [(i, "x" * rng.randint(50, 150), "big" if i < 900 else "mid" if i < 1100 else "small", 3) for i in range(1150)] + [(2000, None, "big", 0), (2001, "", "mid", 0), (2002, "x" * 500, None, 0)]
    targets = [("m", "big", 0.4, 1, 1.0), ("m", "mid", 0.4, 3, 1.0), ("m", "small", 0.1, 2, 1.0), ("m", "gone", 0.1, 2, 1.0), ("n", "big", 1.0, 1, 0.5)]
    mix = M.Mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    r = {(x.mix_id, x.source): x for x in mix.report().collect()}
    total = sum(len(t or "") for _, t, s, _ in rows if s)
    assert not r["m", "big"].short and r["m", "gone"].short and r["m", "gone"].tokens == 0
    assert abs(r["n", "big"].tokens - total * 0.5) <= 150
    for x in r.values():
        assert abs(x.tokens - x.given) <= 150 and x.tokens <= (x.max_repeats or 0) * x.size
        assert x.exhausted == (x.max_repeats * x.size < x.weight * {"m": 1.0, "n": 0.5}[x.mix_id] * total)
    uses = {}
    for x in mix.rows.where("mix_id = 'm'").collect():
        uses.setdefault((x.source, x.doc_id), []).append(x.use_no)
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    assert max(len(u) for (s, _), u in uses.items() if s == "mid") <= 3


def test_same_mix_at_any_partitioning(spark):
    rows = spark.createDataFrame([(i, "x" * (i % 50), "a", 0) for i in range(400)], DOCS)
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 0.3)], TARGETS)
    one, two = ({r.doc_id for r in M.Mix(rows.repartition(n), targets).rows.collect()} for n in (1, 7))
    assert one == two and one


def test_empty_tables(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, 1, 0.3)], TARGETS)
    assert [(r.tokens, r.short) for r in M.Mix(docs, targets).report().collect()] == [(0, False)]
    assert M.Mix(docs, targets.where("false")).report().collect() == []


def test_gaps_are_filled():
    assert M.fill_gaps({"a": 400.0}, {"a": {1000: 10}}, ["a"]) == {}
    assert M.fill_gaps({"a": 400.0}, {"a": {300: 1, 90: 5, 1000: 2}}, ["a"]) == {("a", 300): 1, ("a", 90): 1}
    assert M.fill_gaps({"a": 400.0, "b": 10.0}, {"a": {1000: 10}, "b": {7: 2, 3: 1, 200: 3}}, ["a", "b"]) == {("b", 7): 1, ("b", 3): 1, ("b", 200): 2}


def test_large_documents_are_passed_over(spark):
    rows = [(i, "x" * 1000, "big", 0) for i in range(10)] + [(100 + i, "x" * (40 + i), "small", 0) for i in range(200)] + [(500 + i, "x" * (5000 if i % 2 else 30), "both", 0) for i in range(40)]
    targets = [("m", "big", 0.004, 1, 0.5), ("m", "small", 0.2, 1, 0.5), ("m", "both", 0.796, 1, 0.5)]
    mix = M.Mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    r = {x.source: x for x in mix.report().collect()}
    assert r["big"].tokens == 0 and r["big"].short and not r["big"].exhausted
    # What the large documents leave open is filled, and the mix as a whole is reached.
    assert abs(sum(x.tokens for x in r.values()) - sum(x.given for x in r.values())) <= 40
    assert not r["small"].short
    ids = [(x.source, x.doc_id, x.use_no) for x in mix.rows.collect()]
    assert len(ids) == len(set(ids)) and {u for *_, u in ids} == {1}


def test_repeated_ids_and_uses(spark):
    rows = [(7, "x" * 100, "a", 0)] * 5 + [(8, "x" * 10, "a", 0)] * 3
    mix = M.Mix(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("m", "a", 1.0, 3, 1.5)], TARGETS))
    r = mix.report().first()
    # 795 are wanted; no eight documents give 265 besides the whole use, so the best are two of 100 and all of 10.
    assert r.tokens == 530 + 230 and r.uses == 13 and r.short and not r.exhausted


def test_nulls_in_the_targets(spark):
    docs = spark.createDataFrame([(None, "abc", "a", 0), (None, "abc", "a", 0), (3, None, "a", 0), (4, "x" * 10, None, 0)], DOCS)
    targets = [(None, "a", 1.0, 2, 1.5), ("m", None, 0.5, 1, 1.0), ("m", "a", None, None, None)]
    mix = M.Mix(docs, spark.createDataFrame(targets, TARGETS))
    r = {(x.mix_id, x.source): x for x in mix.report().collect()}
    assert r[None, "a"].tokens == 9 and not r[None, "a"].short and r["m", None].exhausted and r["m", "a"].tokens == 0
    assert mix.rows.count() == r[None, "a"].uses
