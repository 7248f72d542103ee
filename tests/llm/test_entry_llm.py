"""The optional queries are part of the entry point."""

import __spark_entry__ as entry


def test_names():
    assert {f"p{n}_found" for n in (2, 5, 6, 7, 8)} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
