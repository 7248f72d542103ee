"""Frequency of every term and phrase, and in how many records each occurs (problem 5).

Suffix-sorted n-gram counting: every position of a record gives the suffix that
starts there, truncated to the longest phrase. Suffixes are routed by their
first term, sorted in reverse lexicographic order, and one pass with a stack of
the open prefixes adds up the occurrences and the record set of every prefix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.casefold import casefold

#: Parts of a first term, by record: each holds its own records, so their counts add up. One part for this many records.
LEAST_PARTS, PART_RECORDS = 16, 500_000
_SEP = "\x1f"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def suffixes(tokens: DataFrame, record: str, position: str, term: Column, longest: int) -> DataFrame:
    """record, at, t0..t{longest-1}: a row per position with a term.

    A term that is repeated at its position counts once. Where a position has
    several terms, each counts alone, and the smallest is the one of the
    phrases; a null term ends the phrases before it.
    """
    rows = tokens.select(F.col(f"`{record}`").alias("record"), F.col(f"`{position}`").alias("at"), term.alias("t0"))
    # Sent by record once: the grouping and the windows below all find their rows together.
    rows = rows.where(F.col("record").isNotNull()).repartition("record").dropDuplicates(["record", "at", "t0"])
    if longest > 1:
        place = F.row_number().over(W.partitionBy("record", "at").orderBy(F.col("t0").asc_nulls_last()))
        w = W.partitionBy("record", "more").orderBy(F.col("at").asc_nulls_last())
        rows = rows.withColumn("more", place > 1)
        rows = rows.withColumns({f"t{k}": F.when(~F.col("more"), F.lead("t0", k).over(w)) for k in range(1, longest)})
        for k in range(1, longest):
            rows = rows.withColumn(f"t{k}", F.when(F.col(f"t{k - 1}").isNotNull(), F.col(f"t{k}")))
    return rows.where(F.col("t0").isNotNull()).select("record", "at", *[f"t{k}" for k in range(longest)])


class _Open:
    """An open prefix of the stack: its terms, the occurrences so far, and the records seen so far."""

    def __init__(self, terms: tuple):
        self.terms, self.n, self.records = terms, 0, []

    def row(self) -> tuple[str, int, int, int]:
        return _SEP.join(self.terms), len(self.terms), self.n, len(np.unique(np.concatenate(self.records)))


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; false at the first."""
    codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    out = np.zeros(len(codes), dtype=bool)
    out[1:] = codes[1:] != codes[:-1]
    return out


def _count_prefixes(longest: int):
    """Counts every prefix of the sorted suffixes. Runs within a batch are counted at once; the stack holds those that reach into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Open | None] = [None] * longest  # the open prefix of each length
        last: tuple | None = None  # the row before: terms, record, position
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple[list, list, list, list]] = []
            terms, records, places = [batch.column(k) for k in range(longest)], batch.column(longest).to_numpy(zero_copy_only=False), batch.column(longest + 1)
            first = (tuple(t[0].as_py() for t in terms), int(records[0]), places[0].as_py())
            end = (tuple(t[-1].as_py() for t in terms), int(records[-1]), places[-1].as_py())
            changed = [_changes(t) for t in terms]
            fresh = np.logical_or.reduce([*changed, np.concatenate([[False], records[1:] != records[:-1]]), _changes(places)])
            fresh[0] = first != last  # an occurrence that is the same as the one before was delivered again
            starts = np.zeros(len(records), dtype=bool)
            starts[0] = True
            for k in range(longest):
                starts |= changed[k]  # a prefix of k + 1 terms starts where any of them differs from the row before
                at = np.flatnonzero(starts)
                n = np.add.reduceat(fresh.astype(np.int64), at)
                # A record counts once in a run.
                of = np.cumsum(starts) - 1
                order = np.lexsort((records, of))
                own = np.ones(len(order), dtype=bool)
                own[1:] = (of[order][1:] != of[order][:-1]) | (records[order][1:] != records[order][:-1])
                distinct = np.bincount(of[order][own], minlength=len(at))
                bounds = np.append(at, len(records))
                prefix = first[0][: k + 1]
                if stack[k] is not None and stack[k].terms != prefix:
                    out.append(tuple([x] for x in stack[k].row()))
                    stack[k] = None
                if prefix[k] is not None:
                    stack[k] = stack[k] or _Open(prefix)
                    stack[k].n += int(n[0])
                    stack[k].records.append(np.unique(records[: bounds[1]]))
                if len(at) > 1:
                    if stack[k] is not None:
                        out.append(tuple([x] for x in stack[k].row()))
                    inner = slice(1, len(at) - 1)
                    names = [t.take(pa.array(at[inner])) for t in terms[: k + 1]]
                    keep = np.asarray(names[k].is_valid())
                    joined = pa.compute.binary_join_element_wise(*names, _SEP) if k else names[0]
                    out.append((joined.filter(pa.array(keep)).to_pylist(), [k + 1] * int(keep.sum()), n[inner][keep].tolist(), distinct[inner][keep].tolist()))
                    prefix = end[0][: k + 1]
                    stack[k] = None if prefix[k] is None else _Open(prefix)
                    if stack[k] is not None:
                        stack[k].n, stack[k].records = int(n[-1]), [np.unique(records[at[-1] :])]
            last = end
            yield _rows(out)
        yield _rows([tuple([x] for x in o.row()) for o in stack if o is not None])

    return run


def _rows(parts: list[tuple[list, list, list, list]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
    data = [pa.array([x for p in parts for x in p[j]], kind) for j, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(data, names=["phrase", "n_terms", "occurrences", "records"])


def phrase_frequency(tokens: DataFrame, record: str, position: str, term: Column, longest: int = 2, n_records: int | None = None) -> DataFrame:
    """term (its words split by one blank), n_terms, occurrences, records: for every term and phrase up to `longest` terms.

    A term counts once at a position of a record. A row with a null record is
    of no record and counts nowhere; a record without terms adds to none. Empty
    input gives no rows. n_records, if known, saves a pass. Records that are no
    whole numbers are told apart by a hash of 64 bits.
    """
    if n_records is None:
        n_records = tokens.select(F.approx_count_distinct(F.col(f"`{record}`"))).first()[0]
    parts = max(LEAST_PARTS, -(-n_records // PART_RECORDS))
    whole = isinstance(tokens.schema[record].dataType, _WHOLE)
    id_ = F.col("record").cast("bigint") if whole else F.xxhash64("record")
    terms = [f"t{k}" for k in range(longest)]
    if longest > 1:
        s = suffixes(tokens, record, position, term, longest)
    else:  # a suffix of one term needs no neighbours: sent once, straight to its term, where repeated positions meet
        s = tokens.select(F.col(f"`{record}`").alias("record"), F.col(f"`{position}`").alias("at"), term.alias("t0")).where(F.col("record").isNotNull())
    # A hot first term is spread over its parts; equal suffixes of one part stay together.
    s = s.select(*terms, id_.alias("__record"), "at").withColumn("__part", F.pmod(F.xxhash64("__record", F.lit(1)), F.lit(parts)))
    routed = s.repartition("t0", "__part").sortWithinPartitions("__part", *[F.desc_nulls_last(t) for t in terms], "__record", "at")
    found = routed.select(*terms, "__record", "at").mapInArrow(_count_prefixes(longest), "phrase string, n_terms int, occurrences bigint, records bigint")
    sums = found.groupBy("phrase", "n_terms").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return sums.select(F.replace("phrase", F.lit(_SEP), F.lit(" ")).alias("term"), "n_terms", "occurrences", "records")


def marked(frequency: DataFrame, n_records: int, rare_below: int = 5, common_above: float = 0.18) -> DataFrame:
    """frequency with `mark`: rare in fewer than rare_below records, common in more than that share of all records, else null."""
    common = F.col("records") > F.lit(common_above * n_records)
    return frequency.withColumn("mark", F.when(F.col("records") < rare_below, F.lit("rare")).when(common, F.lit("common")))


def token_terms(tokens: DataFrame, longest: int = 2) -> DataFrame:
    """Frequency and mark of every folded word and phrase of the token table; a record is a row_id."""
    n_records = tokens.select(F.count_distinct("row_id")).first()[0]
    return marked(phrase_frequency(tokens, "row_id", "word_id", casefold("word"), longest, n_records), n_records)


def check_types(tokens: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows of a profile per batch and tag against the different terms counted: summary_id, n_types, counted, verdict.

    tokens: batch_id, pos, word; summary: summary_id, batch_id, pos, n_tokens,
    n_types. Tags are compared trimmed and upper-cased, terms by full case
    folding. The tokens at hand may be a part of those profiled, so verdict is
    `missing` (no n_types), `impossible` (under 1 or more than n_tokens),
    `too_few` (the tokens at hand have more), `equal`, or `open` (they have
    fewer). A tag without tokens has 0 counted, as have null tags and batches.
    """
    tag = F.upper(F.btrim("pos", F.lit(" \t\n\r\v\f"))).alias("tag")
    there = tokens.select(F.col("batch_id").alias("batch"), tag, casefold("word").alias("term")).where(F.col("term").isNotNull())
    counted = there.groupBy("batch", "tag").agg(F.count_distinct("term").alias("counted"))
    rows = summary.select("summary_id", F.col("batch_id").alias("batch"), tag, "n_tokens", "n_types").join(counted, ["batch", "tag"], "left")
    n, counted = F.col("n_types"), F.coalesce("counted", F.lit(0).cast("bigint"))
    verdict = (
        F.when(n.isNull(), "missing")
        .when((n < 1) | (n > F.col("n_tokens")), "impossible")
        .when(n < counted, "too_few")
        .when(n == counted, "equal")
        .otherwise("open")
    )
    return rows.select("summary_id", "n_types", counted.alias("counted"), verdict.alias("verdict"))
