"""Containers: nothing lost, nothing over capacity, little room left over."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import containers as C

DOCS, SPECS = "doc_id bigint, text string, block int", "spec_id string, capacity_tokens bigint"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 100), max_size=40), st.integers(1, 12))
def test_differencing_keeps_every_item_and_sums_right(sizes, k):
    place, most = C.difference(sizes, k)
    sums = [0] * max(k, 1)
    for w, s in zip(place, sizes, strict=True):
        sums[w] += s
    assert max(sums, default=0) == most


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 300) for _ in range(400)]
    assert C.difference(sizes, 8)[1] <= sum(sizes) / 8 * 1.001 + 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_pack_never_exceeds_the_capacity(sizes):
    place = C.pack(sizes, 50)
    sums = {}
    for w, s in zip(place, sizes, strict=True):
        sums[w] = sums.get(w, 0) + s
    assert all(s <= 50 for s in sums.values())


def test_documents(spark):
    rng = random.Random(5)
    texts = ["x" * int(rng.expovariate(1 / 400)) for _ in range(1500)] + [None, "", "é" * 1000, "y" * 2048, "y" * 2049, "z" * 100_000]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], DOCS)
    specs = spark.createDataFrame([("a", 2048), ("b", 4096), ("none", None), ("zero", 0)], SPECS)
    rows = C.fill_containers(docs, specs).collect()
    for spec, cap in (("a", 2048), ("b", 4096)):
        own = [r for r in rows if r.spec_id == spec]
        used = {}
        for r in own:
            used[r.container_id] = used.get(r.container_id, 0) + r.n_tokens
        size = [len((t or "").encode()) for t in texts]
        assert max(used.values()) <= cap and sum(used.values()) == sum(size)
        by_doc = {}
        for r in own:
            by_doc.setdefault(r.doc_id, []).append((r.start_token, r.n_tokens))
        for i, n in enumerate(size):
            pieces = sorted(by_doc[i])
            assert len(pieces) == max(1, -(-n // cap)) and sum(p[1] for p in pieces) == n
            assert all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:], strict=False))
        assert 1 - sum(size) / (len(used) * cap) < 0.03
    assert {r.spec_id for r in rows} == {"a", "b"}
    found = {(r.spec_id, r.doc_id) for r in C.split_documents(C.fill_containers(docs, specs)).collect()}
    assert found == {(s, i) for s, c in (("a", 2048), ("b", 4096)) for i, t in enumerate(texts) if len((t or "").encode()) > c}


def test_empty_tables_and_repeated_ids(spark):
    specs = spark.createDataFrame([("a", 10)], SPECS)
    assert C.fill_containers(spark.createDataFrame([], DOCS), specs).collect() == []
    assert C.fill_containers(spark.createDataFrame([(1, "abc", 0)] * 5 + [(None, "abc", 0)], DOCS), specs).count() == 6


def test_many_specs_in_turn(spark, monkeypatch):
    monkeypatch.setattr(C, "SPECS_AT_ONCE", 2)
    docs = spark.createDataFrame([(i, "x" * (i % 40), 0) for i in range(100)], DOCS)
    specs = spark.createDataFrame([(f"s{k}", 20 + k) for k in range(5)], SPECS)
    got = {(r.spec_id, r.n) for r in C.fill_containers(docs, specs).groupBy("spec_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {(f"s{k}", sum(i % 40 for i in range(100))) for k in range(5)}
    assert C.fill_containers(docs, specs.where("false")).collect() == []
