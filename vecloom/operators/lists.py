"""Cells that hold a list written as text, as arrays."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import notation as N


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal(cells: pd.Series) -> pd.Series:
    def one(cell):
        try:
            got = ast.literal_eval(cell.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError, AttributeError):
            return None
        return [None if x is None else str(x) for x in got] if isinstance(got, list) else None

    return cells.map(one, na_action="ignore")


#: A list of strings without escapes, whole numbers and None, as Python writes it.
_QUOTED = r"""'[^'\\\n\r]*+'|"[^"\\\n\r]*+\""""
_PLAIN_ITEM = rf"""(?:{_QUOTED}|(?:0|-?[1-9][0-9]*+)(?![^\s,\]])|None(?![^\s,\]]))"""
_PLAIN = rf"""^\s*+\[\s*+(?:{_PLAIN_ITEM}\s*+(?:,\s*+{_PLAIN_ITEM}\s*+)*+(?:,\s*+)?+)?+\]\s*+$"""


def _plain_values(s: Column) -> Column:
    items = F.regexp_extract_all(s, F.lit(f"({_PLAIN_ITEM})"), F.lit(1))
    return F.transform(items, lambda x: F.when(x == "None", F.lit(None).cast("string")).when(x.rlike("^['\"]"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def list_kind(c: Column) -> Column:
    """simple, ints or plain for the forms that parse_list() splits in the JVM, else null; meant to be computed once, in a projection of its own."""
    s = F.trim(c)
    kind = N.kind(s)
    return F.when(kind.isin("simple", "ints"), kind).when(s.rlike(_PLAIN), F.lit("plain"))


def parse_list(c: Column, on_error: str = "null", bare: str = "wrap", kind: Column | None = None) -> Column:
    """The list that a cell holds as array<string>; None elements are null.

    on_error, for a cell in brackets that is no list: null, empty, wrap (the
    cell as its only element) or fail. bare, for a cell without brackets: wrap
    or split (at blanks). A null cell gives null. The common forms are split in
    the JVM; only cells with escapes, nested lists or other literals reach
    Python. kind: a column made by list_kind().
    """
    s = F.trim(c)
    kind = list_kind(c) if kind is None else kind
    text = F.when(kind == "plain", _plain_values(s)).when(kind.isNotNull(), N.list_values(kind, s))
    text = text.otherwise(_literal(F.when(kind.isNull() & s.startswith("[") & s.endswith("]"), s)))
    failed = {
        "null": F.lit(None).cast("array<string>"),
        "empty": F.array().cast("array<string>"),
        "wrap": F.array(s),
        "fail": F.when(F.lit(True), F.raise_error(F.concat(F.lit("no list: "), s)).cast("array<string>")),
    }[on_error]
    plain = F.array(s) if bare == "wrap" else F.filter(F.split(s, r"\s+"), lambda x: x != "")
    return F.when(c.isNull(), F.lit(None).cast("array<string>")).when(s.startswith("[") & s.endswith("]"), F.coalesce(text, failed)).otherwise(plain)
