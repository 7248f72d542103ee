"""Proportional samples, against a plain divisor method."""

import random
from collections import Counter

from vecloom.llm import proportions as P

ROWS = "row_id bigint, word_id int, pos string, index double, head_dist double, category string"
TARGETS = "target_id string, field_name string, category string, target_share double, sample_share double, min_rows bigint"


def brute_seats(categories, size):
    """Every priority in one sorted list."""
    least = {c: min(n, f) for c, _, n, f in categories}
    rest = sorted((0 if r <= least[c] else 1, (r - 0.5) / w, c) for c, w, n, f in categories for r in range(1, n + 1) if w > 0)
    kept = Counter({c: 0 for c, *_ in categories})
    for _, _, c in rest[: max(size, sum(least.values()))]:
        kept[c] += 1
    return dict(kept)


def test_seats_as_by_sorting():
    rng = random.Random(2)
    for _ in range(300):
        k = rng.randint(1, 6)
        shares = [rng.choice([0.1, 0.25, rng.random() + 0.01]) for _ in range(k)]
        cats = [(f"c{i}", w / sum(shares), rng.randint(0, 40), rng.choice([0, 0, 3, 9])) for i, w in enumerate(shares)]
        size = rng.randint(0, 120)
        got, want = P.seats(cats, size), brute_seats(cats, size)
        assert sum(got.values()) == sum(want.values()), (cats, size)
        # Where rows of a floor would come in by priority too, both count them once.
        assert all(abs(got[c] - want[c]) <= 1 for c in got), (cats, size, got, want)


def test_shares_floors_and_shortfalls(spark, monkeypatch):
    monkeypatch.setattr(P.R, "BUCKET_ROWS", 50)  # many buckets
    rows = [(i, 0, " noun" if i % 2 else "NOUN ", 1.0, 0.0, "clash") for i in range(600)] + [(i, 1, "VERB", 12.0, -1.0, "clash") for i in range(300)] + [(i, 2, "X", 0.5, None, None) for i in range(7)] + [(1, 3, None, None, None, None)]
    targets = [("t", "pos", "NOUN", 0.5, 0.5, 5), ("t", "pos", "VERB", 0.4, 0.5, 5), ("t", "pos", "X", 0.1, 0.5, 20), ("t", "pos", "GONE", 0.0, 0.5, 3), ("i", "index", "10", 1.0, 0.1, 0), ("h", "head_dist", "-1", 1.0, 0.1, None)]
    s = P.ProportionalSample(spark.createDataFrame(rows, ROWS), spark.createDataFrame(targets, TARGETS))
    r = {(x.target_id, x.category): x for x in s.report().collect()}
    assert (r["t", "X"].taken, r["t", "X"].short) == (7, True) and r["t", "GONE"].short
    assert r["t", "NOUN"].taken + r["t", "VERB"].taken == 454 - 7 and abs(r["t", "NOUN"].taken / 447 - 5 / 9) < 0.01 and not r["t", "VERB"].short
    assert r["i", "10"].taken == 91 and r["h", "-1"].taken == 91
    kept = s.rows.where("target_id = 't'").collect()
    assert len({(x.row_id, x.word_id) for x in kept}) == len(kept) == 454
    ranks = sorted(x["rank"] for x in kept if x.category == "VERB")
    assert ranks == list(range(1, len(ranks) + 1))


def test_same_sample_at_any_partitioning(spark):
    rows = spark.range(500).selectExpr("id as row_id", "0 as word_id", "if(id % 3 = 0, 'A', 'B') as pos", "cast(null as double) as index", "cast(null as double) as head_dist")
    targets = spark.createDataFrame([("t", "pos", "A", 0.7, 0.2, 0), ("t", "pos", "B", 0.3, 0.2, 0)], TARGETS)
    one, two = ({(r.row_id, r.category) for r in P.ProportionalSample(rows.repartition(n), targets).rows.collect()} for n in (1, 9))
    assert one == two and len(one) == 100


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = spark.createDataFrame([(1, 1, "A", None, None, None)] * 10, ROWS)
    s = P.ProportionalSample(rows, spark.createDataFrame([("t", "pos", "A", 1.0, 0.5, 0)], TARGETS))
    assert s.rows.count() == 5


def test_empty_tables(spark):
    rows, targets = spark.createDataFrame([], ROWS), spark.createDataFrame([("t", "pos", "A", 1.0, 0.5, 2)], TARGETS)
    assert [(r.taken, r.short) for r in P.ProportionalSample(rows, targets).report().collect()] == [(0, True)]
    assert P.ProportionalSample(rows, targets.where("false")).report().collect() == []


def test_another_field_is_an_error(spark):
    import pytest

    rows = spark.createDataFrame([(1, 0, "NOUN", 1.0, 1.0)], "row_id bigint, word_id int, pos string, index double, head_dist double")
    targets = spark.createDataFrame([("t", "length", "3", 1.0, 0.5, 0)], "target_id string, field_name string, category string, target_share double, sample_share double, min_rows bigint")
    with pytest.raises(ValueError, match="no categories by length"):
        P.ProportionalSample(rows, targets)
