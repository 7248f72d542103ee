"""Several values packed in one field, in differing notations: one value per row (problem 4).

The notation of every cell is chosen by minimum description length. Candidate
dialects (which characters separate, whether quotes count) parse the cell; a
parse costs the code lengths of its values under the value frequencies of the
whole collection, plus what it takes to name the dialect, the separators used
and every exception to the rule that a value holding a separator, quote or
bracket is quoted. The cheapest parse wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import notation as N
from vecloom.session import settle

HARD = N.HARD
_PAIRS = {"[": "]", "{": "}", "(": ")"}
_DELIMS = HARD + " \t"
_SPECIAL = re.compile(r"""[,;|/\s'"\[\]{}()]""")
_QUOTED = re.compile(r"""(?:^|(?<=[,;|/\s]))(?:"[^"]*(?:""[^"]*)*"|'[^']*(?:''[^']*)*')(?=[,;|/\s]|$)""")
_MASK = re.compile("\x00([0-9]+)\x01")
#: Bits for an exception to the quoting rule, for a character of a value never seen, for an empty slot.
EXCEPTION_BITS, CHAR_BITS, EMPTY_BITS = 24.0, 7.0, 7.0
#: A value with more than this share of all occurrences is joined by broadcast; at most 1/share of them exist.
HOT_SHARE = 1 / 4096


@lru_cache(maxsize=256)
def _splitter(delims: str) -> re.Pattern:
    hard = "".join(c for c in delims if c in HARD)
    soft = "".join(c for c in delims if c not in HARD)
    parts = [rf"\s*[{re.escape(hard)}]\s*"] if hard else []
    if " " in soft:
        soft += "\n\r\f\v"
    parts += [f"[{soft}]+"] if soft else []
    return re.compile("|".join(parts))


def strip_outer(cell: str) -> str:
    """The cell without outer whitespace and one pair of outer brackets."""
    s = cell.strip()
    if len(s) > 1 and _PAIRS.get(s[0]) == s[-1]:
        s = s[1:-1].strip()
    return s


def parses(cell: str) -> list[tuple[str, list[str], float]]:
    """(dialect, values, bits without the values' own codes) for every candidate with a parse of its own.

    A dialect is named by its separators, then `q` where quotes count. Empty
    slots are ''; a final separator opens none.
    """
    core = strip_outer(cell)
    if not core:
        return []
    quotes: list[str] = []

    def mask(m: re.Match) -> str:
        quotes.append(m.group())
        return f"\x00{len(quotes) - 1}\x01"

    modes = [("", core)]
    if ("'" in core or '"' in core) and "\x00" not in core and "\x01" not in core:
        masked = _QUOTED.sub(mask, core)
        if quotes:
            modes.insert(0, ("q", masked))
    out: list[tuple[str, list[str], float]] = []
    seen: set[tuple[str, ...]] = set()
    for mode, text in modes:
        bare = _MASK.sub("", text) if mode else text
        present = [d for d in _DELIMS if d in bare or (d == " " and re.search(r"[\n\r\f\v]", bare))]
        for k in range(len(present) + 1):
            for chosen in combinations(present, k):
                delims = "".join(chosen)
                pieces = _splitter(delims).split(text) if delims else [text]
                if len(pieces) > 1 and not pieces[-1].strip():
                    pieces.pop()
                bits = log2(len(_DELIMS) + 1) * (k + 1) + (len(pieces) - 1) * (log2(k) if k > 1 else 0.0)
                values = []
                for p in pieces:
                    p = p.strip()
                    whole = _MASK.fullmatch(p) if mode else None
                    if whole:
                        q = quotes[int(whole.group(1))]
                        values.append(q[1:-1].replace(q[0] * 2, q[0]))
                        bits += 2
                    else:
                        if mode:
                            p = _MASK.sub(lambda m: quotes[int(m.group(1))], p)
                        bits += EXCEPTION_BITS * len(_SPECIAL.findall(p))
                        values.append(p)
                if (key := tuple(values)) not in seen:
                    seen.add(key)
                    out.append((delims + mode, values, bits))
    return out


_CANDIDATES = T.StructType(
    [
        T.StructField("src_name", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("copies", T.LongType()),
        T.StructField("cell_id", T.LongType()),
        T.StructField("dialect", T.StringType()),
        T.StructField("base_bits", T.DoubleType()),
        T.StructField("item_values", T.ArrayType(T.StringType())),
    ]
)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [
            (src, row, field, copies, cid, dialect, bits, values)
            for src, row, field, copies, cid, cell in zip(pdf.src_name, pdf.row_id, pdf.field_name, pdf.copies, pdf.cell_id, pdf.cell, strict=True)
            for dialect, values, bits in parses(cell)
        ]
        out = pd.DataFrame(rows, columns=_CANDIDATES.names)
        out["row_id"] = pd.array([r[1] for r in rows], dtype="Int64")
        yield out


def _cells_and_values(cells: DataFrame) -> DataFrame:
    """One pass over all cells: every packed cell, and the number of each value of the plain lists.

    is_cell, src_name, row_id, field_name, text, n. The grouping is combined
    before the shuffle, so a value held by a third of all cells is a row of
    each task.
    """
    cells = cells.withColumn("__kind", N.kind(F.col("cell")))
    values = N.list_values(F.col("__kind"), F.col("cell"))
    none = lambda kind: F.lit(None).cast(kind)
    id_type = dict(cells.dtypes)["row_id"]
    value = lambda x: F.struct(F.lit(False).alias("is_cell"), none("string").alias("src_name"), none(id_type).alias("row_id"), x.alias("text"))
    cell = F.struct(F.lit(True).alias("is_cell"), F.col("src_name"), F.col("row_id"), F.col("cell").alias("text"))
    found = F.when(N.is_list(F.col("__kind")), F.transform(values, value)).when(F.col("__kind").isin("delimited", "bad"), F.array(cell))
    # explode_outer: the filter then stays above, and the values are made once.
    long = cells.select("field_name", F.explode_outer(found).alias("x")).where(F.col("x.is_cell").isNotNull())
    return long.groupBy("x.is_cell", "x.src_name", "x.row_id", "field_name", "x.text").agg(F.count(F.lit(1)).alias("n"))


def choose_dialects(cells: DataFrame) -> DataFrame:
    """The cheapest parse of every packed cell.

    cells: src_name, row_id (may be null), field_name, cell. Returns src_name,
    row_id, field_name, dialect, item_values, copies. Null and blank cells and
    plain lists have no row; the lists are what the value frequencies are taken
    from. A cell that is repeated with its row_id has one row with its number
    of copies; equal costs fall to the dialect with fewer separators, then by
    its name.
    """
    both = settle(_cells_and_values(cells))
    packed = both.where("is_cell").select("src_name", "row_id", "field_name", F.col("text").alias("cell"), F.col("n").alias("copies"))
    packed = packed.withColumn("cell_id", F.monotonically_increasing_id())
    # Written once: the ids are then fixed, and the parses are not made again for each use below.
    cand = settle(packed.mapInPandas(_candidates, _CANDIDATES))
    model = both.where("not is_cell").select("field_name", F.col("text").alias("value"), "n")
    totals = model.groupBy("field_name").agg(F.sum("n").alias("total"))

    use = cand.select("field_name", "cell_id", "dialect", F.explode("item_values").alias("value"))
    # Code lengths of the values in use. Both sides hold a value once, so the join knows no hot key.
    uses = use.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("m"))
    all_uses = uses.groupBy("field_name").agg(F.sum("m").alias("all_m"))
    total = F.coalesce(F.col("total"), F.lit(0)) + 1.0
    unseen = F.log2(total) + CHAR_BITS * (F.length("value") + 1)
    bits = F.when(F.col("value") == "", F.lit(EMPTY_BITS)).when(F.col("n").isNotNull(), F.log2(total) - F.log2(F.col("n"))).otherwise(unseen)
    codes = settle(
        uses.join(model, ["field_name", "value"], "left")
        .join(F.broadcast(totals), "field_name", "left")  # a row per field
        .join(F.broadcast(all_uses), "field_name")
        .select("field_name", "value", bits.alias("bits"), (F.col("m") > HOT_SHARE * F.col("all_m")).alias("hot"))
    )
    hot = codes.where("hot").select("field_name", "value", F.col("bits").alias("hot_bits"))
    cold = codes.where("not hot").select("field_name", "value", F.col("bits").alias("cold_bits"))
    use = use.join(F.broadcast(hot), ["field_name", "value"], "left")  # at most 1 / HOT_SHARE rows a field
    known = use.where("hot_bits is not null").select("cell_id", "dialect", F.col("hot_bits").alias("bits"))
    rest = use.where("hot_bits is null").join(cold, ["field_name", "value"]).select("cell_id", "dialect", F.col("cold_bits").alias("bits"))
    coded = known.unionByName(rest).groupBy("cell_id", "dialect").agg(F.sum("bits").alias("bits"))
    cost = cand.select("cell_id", "dialect", "base_bits").join(coded, ["cell_id", "dialect"])
    order = F.struct(F.round(F.col("base_bits") + F.col("bits"), 6), F.length("dialect"), F.col("dialect"))
    best = cost.groupBy("cell_id").agg(F.min_by("dialect", order).alias("dialect"))
    return cand.join(best, ["cell_id", "dialect"], "left_semi").select("src_name", "row_id", "field_name", "dialect", "item_values", "copies")


def unpack(cells: DataFrame) -> DataFrame:
    """src_name, row_id, field_name, item_no (from 1, empty slots counted), item: the non-empty values of packed cells."""
    chosen = choose_dialects(cells)
    chosen = chosen.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    long = chosen.select("src_name", "row_id", "field_name", F.posexplode("item_values").alias("at", "item"))
    return long.where(F.col("item") != "").select("src_name", "row_id", "field_name", (F.col("at") + 1).cast("bigint").alias("item_no"), "item")


def stack_cells(df: DataFrame, src_name: str, row_id: str, fields: list[str]) -> DataFrame:
    """The named fields of df as rows of src_name, row_id, field_name, cell."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("cell")) for f in fields])
    return df.select(F.lit(src_name).alias("src_name"), F.col(f"`{row_id}`").alias("row_id"), F.explode(pairs).alias("x")).select("src_name", "row_id", "x.field_name", "x.cell")


def packed_fields(sentences: DataFrame, summaries: DataFrame, labels: DataFrame) -> DataFrame:
    """unpack() over the readable sentences' tokens, pos and head_dist and the summaries' top_pos_vals."""
    from vecloom.operators import rejects

    readable = rejects.separate(rejects.classify_sentences(sentences, rejects.label_set(labels, "relation_type"))).valid
    a = stack_cells(readable, "en_ewt_ud_train_sentences", "row_id", ["tokens", "pos", "head_dist"])
    b = stack_cells(summaries, "head_dist_summary", "summary_id", ["top_pos_vals"])
    return unpack(a.unionByName(b))
