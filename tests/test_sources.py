"""Readers by format, the row cap, and synthetic points of any number."""

import math

import pytest

from vecloom import schema
from vecloom.sources import manifolds, tables


def test_read_any(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"\nc"), (2, None)], "i int, t string")
    for fmt in ("parquet", "orc", "json"):
        df.write.format(fmt).save(str(tmp_path / f"x.{fmt}"))
        assert sorted(map(tuple, tables.read_any(spark, str(tmp_path / f"x.{fmt}")).select("i", "t").collect())) == [(1, 'a,"b"\nc'), (2, None)]
    tables.write_csv(df, str(tmp_path / "x.csv"))
    assert sorted(map(tuple, tables.read_any(spark, str(tmp_path / "x.csv")).collect())) == [("1", 'a,"b"\nc'), ("2", None)]
    with pytest.raises(ValueError, match="format"):
        tables.read_any(spark, "x.xls")


def test_path_from_the_environment(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    monkeypatch.setenv("CSV_PATH", str(tmp_path / "a.csv"))
    assert [tuple(r) for r in tables.read_csv(spark, columns=["v"]).collect()] == [("2",)]


def test_row_cap(spark):
    df = spark.range(50).selectExpr("49 - id as k")
    assert [r.k for r in tables.first_rows(df, "k", 3).collect()] == [0, 1, 2] and tables.first_rows(df, "k", None).count() == 50


def test_swiss_roll_of_any_size(spark):
    for r in manifolds.swiss_roll_expr(spark, 200).collect():
        x, h, z = r.vec
        t = math.hypot(x, z)
        assert 1.5 * math.pi - 1e-9 <= t <= 4.5 * math.pi and 0 <= h <= 21 and abs(x - t * math.cos(t)) < 1e-6


def test_result_columns(spark):
    stats = spark.createDataFrame([("1", 0, "pr", 1.0, 1.0, float("inf"), 5)], "cls string, layer int, metric string, mean double, ci_low double, ci_high double, n_tokens int")
    assert tuple(tables.layer_rows(stats, "m", "t", "layer", "mean", "s").columns) == schema.METRIC_BY_LAYER
    assert tables.result_rows(stats, "all", "m", "index", "cls", "layer", "mean", "s").first().ci_high is None
