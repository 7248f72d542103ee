"""Slow, independent versions of the parsing operators: one character at a time, no regular expressions."""

from __future__ import annotations

import csv

SEPARATORS = ",;|/"
BLANKS = " \t\n\r\f\x0b"
PAIRS = {"[": "]", "{": "}", "(": ")"}


def list_elements(cell: str) -> list[str] | None:
    """Raw elements of a comma-separated list in square brackets, or None."""
    s = cell.strip(BLANKS)
    if len(s) < 2 or s[0] != "[" or s[-1] != "]":
        return None
    body, out, i, want_value = s[1:-1], [], 0, True
    while i < len(body):
        ch = body[i]
        if ch in BLANKS:
            i += 1
        elif ch == ",":
            if want_value:
                return None
            want_value, i = True, i + 1
        elif not want_value:
            return None
        else:
            j = i
            if ch in "'\"":
                j += 1
                while j < len(body) and body[j] != ch:
                    j += 2 if body[j] == "\\" else 1
                if j >= len(body):
                    return None
                j += 1
            else:
                while j < len(body) and body[j] not in BLANKS + ",'\"[]":
                    j += 1
                if j == i or (j < len(body) and body[j] in "'\"[]"):
                    return None
            out.append(body[i:j])
            want_value, i = False, j
    return out


def slots(cell: str) -> list[str] | None:
    """Values of a delimited cell, empty slots as ''; None if a quote or bracket has no partner."""
    s = cell.strip(BLANKS)
    if s and s[0] in PAIRS:
        if s[-1] != PAIRS[s[0]]:
            return None
        s = s[1:-1].strip(BLANKS)
    out, i, pending = [], 0, True  # pending: a slot is open
    while i < len(s):
        ch = s[i]
        if ch in BLANKS + SEPARATORS:
            hard = 0
            while i < len(s) and s[i] in BLANKS + SEPARATORS:
                if s[i] in SEPARATORS:
                    hard += 1
                    if hard > 1 or pending:
                        out.append("")
                    pending = True
                i += 1
            pending = True
        elif ch in "'\"":
            j, buf = i + 1, ""
            while j < len(s):
                if s[j] == ch and s[j + 1 : j + 2] == ch:
                    buf, j = buf + ch, j + 2
                elif s[j] == ch:
                    break
                else:
                    buf, j = buf + s[j], j + 1
            if j >= len(s) or (j + 1 < len(s) and s[j + 1] not in BLANKS + SEPARATORS):
                return None
            out.append(buf)
            pending, i = False, j + 1
        else:
            j = i
            while j < len(s) and s[j] not in BLANKS + SEPARATORS:
                if s[j] in "'\"[]{}()":
                    return None
                j += 1
            out.append(s[i:j])
            pending, i = False, j
    return out if any(out) or "'" in s or '"' in s else []


def reason(tokens: str | None, relation: str | None, arity: str | None, labels: set[str]) -> str | None:
    parsed = []
    for cell in (tokens, relation, arity):
        if cell is None or not cell.strip(BLANKS):
            parsed.append(None)
            continue
        got = list_elements(cell)
        if got is None:
            got = slots(cell)
            if got is None:
                return "quoting"
        parsed.append(got)
    n = len(parsed[0] or [])
    if n and any(p is not None and len(p) != n for p in parsed[1:]):
        return "column_count"
    if not n:
        return "bad_value"
    strip = lambda x: x[1:-1].replace("\\'", "'") if x[:1] in ("'", '"') else x
    if parsed[1] is not None and any(strip(x) not in labels for x in parsed[1]):
        return "bad_value"
    if parsed[2] is not None and any(not (x.lstrip("+").isascii() and x.lstrip("+").isdigit()) for x in parsed[2]):
        return "bad_value"
    return None


def line_fields(line: str) -> list[str] | None:
    """Fields of a CSV line; None if a quote has no partner or ends early."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j, buf = i + 1, ""
            while True:
                if j >= len(line):
                    return None
                if line[j] == '"' and line[j + 1 : j + 2] == '"':
                    buf, j = buf + '"', j + 2
                elif line[j] == '"':
                    break
                else:
                    buf, j = buf + line[j], j + 1
            j += 1
        else:
            j = i
            while j < len(line) and line[j] != ",":
                if line[j] == '"':
                    return None
                j += 1
            buf = line[i:j]
        out.append(buf)
        if j >= len(line):
            return out
        if line[j] != ",":
            return None
        i = j + 1


def line_reason(line: str | None, labels: set[str]) -> str | None:
    if line is None:
        return "column_count"
    fields = line_fields(line)
    if fields is None:
        return "quoting"
    if len(fields) != 7:
        return "column_count"
    assert fields == next(csv.reader([line]), [""])
    cells = [f or None for f in fields]
    return reason(cells[1], cells[5], cells[6], labels)
