"""Recognition of packed cells: list literals and delimited notations, as JVM expressions.

All patterns use possessive quantifiers, which Java's regex engine runs as
loops, so a cell of many megabytes neither backtracks nor overflows the stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that may separate values; blanks count as well.
HARD = ",;|/"
#: A quoted value of a list literal: backslash escapes the next character.
_LIT = r"""'(?:[^'\\]++|\\[\s\S])*+'|"(?:[^"\\]++|\\[\s\S])*+\""""
#: An element of a list literal.
LIST_ITEM = rf"""(?:{_LIT}|[^\s,'"\[\]]++)"""
#: A whole list literal: comma-separated elements in square brackets.
LIST = rf"""^\s*+\[\s*+(?:{LIST_ITEM}\s*+(?:,\s*+{LIST_ITEM}\s*+)*+(?:,\s*+)?+)?+\]\s*+$"""
#: A quoted value of a delimited cell: a doubled quote stands for one.
QUOTED = r"""'(?:[^']++|'')*+'|"(?:[^"]++|"")*+\""""
_BARE = r"""[^,;|/\s'"\[\]{}()]++"""
_DELIM = r"[,;|/\s]"


def _delimited(quoted: str) -> str:
    return rf"""(?:{_DELIM}*+(?:(?:(?:{quoted})|{_BARE})(?={_DELIM}|$))*+)*+"""


#: Without outer brackets, and in brackets of any kind but not as LIST.
PLAIN = rf"""^{_DELIM}*+(?:(?:(?:{QUOTED})|{_BARE})(?:{_DELIM}++|$))*+$"""
_IN = rf"""{_DELIM}*+(?:(?:(?:{_LIT}|{QUOTED})|{_BARE})(?:{_DELIM}++|(?=\s*+[\]}})]\s*+$)))*+"""
BRACKETED = rf"""^\s*+(?:\[{_IN}\]|\{{{_IN}\}}|\({_IN}\))\s*+$"""
#: One line of comma-separated values, quoted with " and doubled inside.
_FIELD = r"""(?:"(?:[^"]++|"")*+"|[^",]*+)"""
CSV_LINE = rf"""^{_FIELD}(?:,{_FIELD})*+$"""


#: The two commonest forms of LIST, told apart because their values come out by a plain split.
_SIMPLE = r"""^\[(?:'[^'\\]*+'(?:, ?(?=')|(?=\])))++\]$"""
_INTS = r"""^\[(?:-?[0-9]++(?:, ?(?=[-0-9])|(?=\])))++\]$"""


def is_blank(c: Column) -> Column:
    return ~c.rlike(r"\S")


def kind(c: Column) -> Column:
    """null, blank, list (of which simple and ints are forms), delimited, or bad: a quote or bracket has no partner.

    Meant to be computed once, in a projection of its own; values() and
    value_count() take it as a column.
    """
    return (
        F.when(c.isNull(), F.lit(None))
        .when(c.rlike(_SIMPLE), F.lit("simple"))
        .when(c.rlike(_INTS), F.lit("ints"))
        .when(is_blank(c), F.lit("blank"))
        .when(c.rlike(LIST), F.lit("list"))
        .when(c.rlike(PLAIN) | c.rlike(BRACKETED), F.lit("delimited"))
        .otherwise(F.lit("bad"))
    )


def is_list(kind_: Column) -> Column:
    """By kind(): a comma-separated list in square brackets; false for null."""
    return F.coalesce(kind_.isin("simple", "ints", "list"), F.lit(False))


def list_items(c: Column) -> Column:
    """The elements of a LIST cell as written, quotes included."""
    return F.regexp_extract_all(c, F.lit(f"({LIST_ITEM})"), F.lit(1))


def unquoted(item: Column) -> Column:
    """The value of an element: outer quotes off, escaped quotes and backslashes resolved."""
    inner = F.substring(item, F.lit(2), F.length(item) - 2)
    plain = F.when(F.instr(inner, "\\") > 0, F.regexp_replace(inner, r"\\(['\"\\])", "$1")).otherwise(inner)
    return F.when(item.rlike("^['\"]"), plain).otherwise(item)


def list_values(kind_: Column, c: Column) -> Column:
    """The values of a list cell, without quotes; null for other kinds."""
    return (
        F.when(kind_ == "simple", F.split(F.substring(c, F.lit(3), F.length(c) - 4), "', ?'"))
        .when(kind_ == "ints", F.split(F.substring(c, F.lit(2), F.length(c) - 2), ", ?"))
        .when(kind_ == "list", F.transform(list_items(c), unquoted))
    )


def slot_count(c: Column) -> Column:
    """Number of values of a well-quoted cell that is not a LIST; empty slots count, a final delimiter
    opens none, and a cell with nothing but delimiters has no value.

    Whitespace around another delimiter belongs to it; else a run of whitespace is one delimiter.
    """
    core = F.regexp_replace(F.trim(c), r"^\s*+[\[{(]|[\]})]\s*+$", " ")
    core = F.when(c.rlike(BRACKETED), core).otherwise(c)
    masked = F.regexp_replace(core, rf"{QUOTED}", "x")
    tight = F.regexp_replace(F.regexp_replace(masked, r"^\s++|\s++$", ""), r"\s*+([,;|/])\s*+", "$1")
    tight = F.regexp_replace(tight, r"\s++", " ")
    tight = F.regexp_replace(tight, r"[,;|/]$", "")
    delims = F.regexp_replace(tight, r"[^,;|/\s]++", "")
    return F.when(F.length(tight) == F.length(delims), F.lit(0)).otherwise(F.length(delims) + 1)


def value_count(kind_: Column, values: Column, c: Column) -> Column:
    """Number of values of a cell that is not bad, in any notation; null for null."""
    return F.when(kind_ == "blank", F.lit(0)).when(is_list(kind_), F.size(values)).when(kind_ == "delimited", slot_count(c))
