"""Rows that fail to parse: set apart with a reason, the valid rows loaded (problem 1)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import notation as N
from vecloom.session import settle

#: The seven fields of a raw line, in order.
LINE_FIELDS = ("sentence_id", "tokens", "pos", "index", "head_dist", "relation_type", "ariety")
CHECKED = ("tokens", "relation_type", "ariety")
_CORRUPT, _CELLS = "__corrupt_line", "__cells"


@dataclass(frozen=True)
class Separated:
    """`valid` and `failing` (with `reason`) share one classified plan; no row is in both or in neither."""

    valid: DataFrame
    failing: DataFrame


#: Labels that are compared within the expression; more of them are joined.
MOST_LABELS = 10_000


def known_labels(labels: DataFrame, column: str, most: int = MOST_LABELS) -> list[str]:
    """The valid values of a column, fetched to the driver up to a checked bound; label_set() goes on beyond it."""
    rows = labels.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} labels; join against them instead")
    return sorted(r[0] for r in rows)


def label_set(labels: DataFrame, column: str) -> list[str] | DataFrame:
    """The valid values of a column: a list up to MOST_LABELS of them, else a table of one column `label`."""
    try:
        return known_labels(labels, column, MOST_LABELS)
    except ValueError:
        return labels.select(F.col(column).alias("label")).where(F.col("label").isNotNull()).distinct()


def parse_lines(lines: DataFrame, raw: str = "raw_line") -> DataFrame:
    """lines with the decoded fields as struct `__cells`, the raw text of corrupt lines kept beside.

    Read permissively under an explicit schema: a line with another number of
    fields comes back with its text in the corrupt column instead of failing.
    """
    fields = [T.StructField(f"f{i}", T.StringType()) for i in range(len(LINE_FIELDS))]
    schema = T.StructType([*fields, T.StructField(_CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT, "quote": '"', "escape": '"', "sep": ","}
    return lines.withColumn(_CELLS, F.from_csv(F.col(raw), schema.simpleString(), options))


def _with_parts(df: DataFrame, cells: dict[str, Column]) -> DataFrame:
    """df with kind and values of each checked cell, each computed once, in projections of their own."""
    df = df.withColumns({f"__kind_{n}": N.kind(c) for n, c in cells.items()})
    return df.withColumns({f"__values_{n}": N.list_values(F.col(f"__kind_{n}"), c) for n, c in cells.items()})


def _loose(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"^\s*+[\[{(]|[\]})]\s*+$", " "), r"[,;|/\s]++"), lambda x: x != "")


def _relations(cells: dict[str, Column]) -> Column:
    kind, values = F.col("__kind_relation_type"), F.col("__values_relation_type")
    items = F.coalesce(values, _loose(cells["relation_type"]))
    return F.when(N.is_list(kind), items).otherwise(F.transform(items, N.unquoted))


def _with_unknown(df: DataFrame, cells: dict[str, Column], labels: list[str] | DataFrame) -> DataFrame:
    """df with `__unknown`: whether a relation_type element is none of the labels."""
    if isinstance(labels, list):
        known = F.array(*[F.lit(x) for x in labels]) if labels else F.array().cast("array<string>")
        return df.withColumn("__unknown", F.size(F.array_except(_relations(cells), known)) > 0)
    df = settle(df.withColumn("__relations", _relations(cells)).withColumn("__row", F.monotonically_increasing_id()))
    used = df.select("__row", F.explode(F.array_distinct("__relations")).alias("label"))
    # A label that most rows use meets one row of the labels' table: the anti join may broadcast it, or is split by AQE.
    bad = used.join(labels, "label", "left_anti").select("__row").distinct().withColumn("__unknown", F.lit(True))
    return df.join(bad, "__row", "left").withColumn("__unknown", F.coalesce("__unknown", F.lit(False))).drop("__row", "__relations")


def _cell_checks(cells: dict[str, Column]) -> dict[str, Column]:
    """The three checks over the cells of one sentence, on the columns that _with_parts() and _with_unknown() made."""
    kinds = {n: F.col(f"__kind_{n}") for n in CHECKED}
    values = {n: F.col(f"__values_{n}") for n in CHECKED}
    counts = {n: N.value_count(kinds[n], values[n], cells[n]) for n in CHECKED}
    present = {n: F.coalesce(kinds[n] != "blank", F.lit(False)) for n in CHECKED}
    n = F.coalesce(counts["tokens"], F.lit(0))

    # A quoted number is text, not a whole number: those lists are of the kind `list` or `simple`.
    raw = F.when(kinds["ariety"].isin("simple", "list"), N.list_items(cells["ariety"])).otherwise(F.coalesce(values["ariety"], _loose(cells["ariety"])))
    return {
        "quoting": F.coalesce(kinds["tokens"] == "bad", F.lit(False)) | F.coalesce(kinds["relation_type"] == "bad", F.lit(False)) | F.coalesce(kinds["ariety"] == "bad", F.lit(False)),
        "column_count": (n > 0) & ((present["relation_type"] & (counts["relation_type"] != n)) | (present["ariety"] & (counts["ariety"] != n))),
        "bad_value": (n == 0)
        | (present["relation_type"] & F.col("__unknown"))
        | (present["ariety"] & F.exists(F.array_distinct(raw), lambda x: ~x.rlike(r"^\+?[0-9]++$"))),
    }


def _first_reason(checks: dict[str, Column]) -> Column:
    reason = None
    for name, holds in checks.items():
        holds = F.coalesce(holds, F.lit(False))
        reason = F.when(holds, F.lit(name)) if reason is None else reason.when(holds, F.lit(name))
    return reason


def _settled_reason(df: DataFrame, reason: Column) -> DataFrame:
    """df with `reason`, computed once: a filter on it can't be pushed below the generator, to run the checks twice."""
    made = [c for c in df.columns if c.startswith("__") and c != _CELLS]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in made and c != "reason"]
    return df.select(*kept, F.explode_outer(F.array(reason)).alias("reason"))


def classify_sentences(sentences: DataFrame, labels: list[str] | DataFrame) -> DataFrame:
    """sentences with `reason`: null for a readable row, else the first fault that holds.

    Null or blank tokens are `bad_value`; a null or blank relation_type or
    ariety is no fault. Columns beyond the checked ones pass through untouched;
    an own column `reason` in the input is replaced.
    """
    cells = {c: F.col(f"`{c}`") for c in CHECKED}
    return _settled_reason(_with_unknown(_with_parts(sentences, cells), cells, labels), _first_reason(_cell_checks(cells)))


def classify_lines(lines: DataFrame, labels: list[str] | DataFrame, raw: str = "raw_line") -> DataFrame:
    """lines with the seven decoded fields as columns and `reason`.

    A null line has no fields and is `column_count`, as is an empty one. Field
    columns of the input with the same names are replaced.
    """
    line = F.col(f"`{raw}`")
    by_name = {n: F.col(f"{_CELLS}.f{i}") for i, n in enumerate(LINE_FIELDS)}
    parsed = _with_unknown(_with_parts(parse_lines(lines, raw), {n: by_name[n] for n in CHECKED}), by_name, labels)
    # Corrupt rows are classified anew: what looks like a wrong count may be a quote without partner.
    line_quoting = line.isNotNull() & ~line.rlike(N.CSV_LINE)
    commas = F.regexp_replace(F.regexp_replace(line, r'"(?:[^"]++|"")*+"', ""), r"[^,]++", "")
    seven = line.isNotNull() & (F.length(commas) == len(LINE_FIELDS) - 1)
    checks = _cell_checks(by_name)
    reason = _first_reason(
        {
            "quoting": line_quoting | (seven & checks["quoting"]),
            "column_count": ~seven | checks["column_count"],
            "bad_value": checks["bad_value"] | F.col(f"{_CELLS}.{_CORRUPT}").isNotNull(),
        }
    )
    return _settled_reason(parsed, reason).withColumns(by_name).drop(_CELLS)


def separate(classified: DataFrame) -> Separated:
    return Separated(
        classified.where(F.col("reason").isNull()).drop("reason"),
        classified.where(F.col("reason").isNotNull()),
    )


def failing_rows(sentences: DataFrame, lines: DataFrame, labels: DataFrame, names: tuple[str, str]) -> DataFrame:
    """(src_name, row_id, reason) of the failing rows of both inputs."""
    known = label_set(labels, "relation_type")
    a = separate(classify_sentences(sentences, known)).failing
    b = separate(classify_lines(lines, known)).failing
    return a.select(F.lit(names[0]).alias("src_name"), F.col("row_id"), "reason").unionByName(
        b.select(F.lit(names[1]).alias("src_name"), F.col("line_id").alias("row_id"), "reason")
    )
