"""Term and phrase counts, against dictionaries."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vecloom.llm import frequency as Q

TOKENS = "row_id bigint, word_id int, word string, term string"


def brute(rows, longest):
    records = defaultdict(dict)
    for rid, at, w, _ in rows:
        if rid is not None:
            old = records[rid].get(at)
            records[rid][at] = w if old is None else old if w is None else min(old, w)
    n, df = Counter(), Counter()
    for r in records.values():
        words = [r[k] for k in sorted(r, key=lambda k: (k is None, k))]
        seen = set()
        for i in range(len(words)):
            for k in range(1, longest + 1):
                p = tuple(words[i : i + k])
                if len(p) == k and None not in p:
                    n[p] += 1
                    seen.add(p)
        df.update(seen)
    return {(" ".join(p), len(p)): (c, df[p]) for p, c in n.items()}


def _got(spark, rows, longest):
    df = Q.phrase_frequency(spark.createDataFrame(rows, TOKENS), "row_id", "word_id", F.col("word"), longest)
    return {(r.term, r.n_terms): (r.occurrences, r.records) for r in df.collect()}


def test_counts_as_by_dictionaries(spark):
    rng = random.Random(3)
    rows = [(r, i, rng.choice(["the"] * 6 + ["cat", "dog", "ß", "", None]), "clash") for r in range(120) for i in range(rng.randint(0, 12))]
    rows += rows[:40] + [(None, 0, "lost", None), (500, None, "odd", None)]
    for longest in (1, 2, 3):
        assert _got(spark, rows, longest) == brute(rows, longest)


def test_counts_over_many_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(r, i, w, None) for r in range(30) for i, w in enumerate(["a", "b", "a", "b", "c"])]
        assert _got(spark, rows, 3) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_marks(spark):
    rows = [(r, 0, "Die" if r % 2 else "die", None) for r in range(40)] + [(r, 1, "STRASSE" if r < 2 else "Straße", None) for r in range(4)] + [(r, 2, "mid", None) for r in range(5)]
    got = {r.term: (r.records, r.mark) for r in Q.token_terms(spark.createDataFrame(rows, TOKENS), 1).collect()}
    assert got == {"die": (40, "common"), "strasse": (4, "rare"), "mid": (5, None)}


def test_long_record_and_empty_table(spark):
    rows = [(1, i, f"w{i % 7}", None) for i in range(20_000)]
    assert _got(spark, rows, 2) == brute(rows, 2)
    assert _got(spark, [], 2) == {}


def test_every_term_of_a_repeated_position_counts(spark):
    rows = [(1, 0, w, None) for w in ("b", "a", "b", None)] + [(1, 1, "c", None), (2, 0, "b", None)]
    terms = {("a", 1): (1, 1), ("b", 1): (2, 2), ("c", 1): (1, 1)}
    assert _got(spark, rows, 1) == terms and _got(spark, rows, 2) == terms | {("a c", 2): (1, 1)}


def test_types_of_a_profile(spark):
    tokens = spark.createDataFrame([("b", " noun", w) for w in ("Die", "die", "der", None)] + [("b", None, "x"), (None, "NOUN", "y")], "batch_id string, pos string, word string")
    summary = spark.createDataFrame([(1, "b", "NOUN", 9, 2), (2, "b", "noun ", 9, None), (3, "b", "NOUN", 2, 3), (4, "b", "NOUN", 9, 1), (5, "b", "NOUN", 9, 5), (6, "b", None, 9, 5), (7, None, "NOUN", 0, 0)], "summary_id bigint, batch_id string, pos string, n_tokens bigint, n_types bigint")
    got = {r.summary_id: (r.counted, r.verdict) for r in Q.check_types(tokens, summary).collect()}
    assert got == {1: (2, "equal"), 2: (2, "missing"), 3: (2, "impossible"), 4: (2, "too_few"), 5: (2, "open"), 6: (0, "open"), 7: (0, "impossible")}
    assert Q.check_types(tokens, summary.where("false")).collect() == []


def test_repeated_rows_and_text_records(spark):
    rows = [(1, 0, "a", None)] * 3 + [(1, None, "a", None)] * 2 + [(2, 0, "a", None)]
    assert _got(spark, rows, 1) == {("a", 1): (3, 2)}
    df = spark.createDataFrame([("r1", 0, "a"), ("r2", 0, "a"), ("r2", 0, "a")], "row_id string, word_id int, word string")
    assert [(r.occurrences, r.records) for r in Q.phrase_frequency(df, "row_id", "word_id", F.col("word"), 1).collect()] == [(2, 2)]
