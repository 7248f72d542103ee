"""Mixing sources to target weights (problem 7).

Capped water-filling: a source gets its weight of the total unless that exceeds
its size times its repeats; such sources are clamped there and what they lack
goes to the others in proportion to their weights, until all fit. A source is
then used a whole number of times plus a seeded fraction of its documents.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm import ranking as R
from vecloom.llm.containers import size_in_tokens
from vecloom.operators.sampling import first_per_group
from vecloom.session import settle

_PLAN = "mix_id string, source string, weight double, max_repeats bigint, size bigint, wanted double, given double, whole bigint, part double"
_FILL = "mix_id string, source string, n_tokens bigint, take bigint"
#: A source that reaches less than this share of what it should give is short.
REACHED = 0.99


def water_fill(sources: list[tuple[float, float]], total: float) -> list[float]:
    """What each source gives: (weight, most it can give). The sum is total, or all they can give."""
    given, open_ = [0.0] * len(sources), {i for i, (w, _) in enumerate(sources) if w > 0}
    left = total
    while open_:
        weight = sum(sources[i][0] for i in open_)
        level = left / weight
        full = {i for i in open_ if sources[i][1] <= sources[i][0] * level}
        if not full:
            for i in open_:
                given[i] = sources[i][0] * level
            break
        for i in full:
            given[i] = sources[i][1]
            left -= sources[i][1]
        open_ -= full
        left = max(left, 0.0)
    return given


def fill_gaps(gaps: dict[str, float], stock: dict[str, dict[int, int]], order: list[str]) -> dict[tuple[str, int], int]:
    """Documents to add, by source and size: first into each source's own gap, largest that fit first, then into what all lack together.

    gaps: tokens wanted by source; stock: documents left of each size, by
    source; order: who fills what the others could not.
    """
    take: dict[tuple[str, int], int] = {}
    sizes = {s: sorted(stock.get(s, {})) for s in order}

    def fill(source: str, room: float) -> float:
        own, upto = sizes[source], len(sizes[source])
        while (upto := bisect_right(own, room, 0, upto)) > 0:
            size = own[upto - 1]
            n = min(stock[source][size] - take.get((source, size), 0), int(room // size))
            if n > 0:
                take[source, size] = take.get((source, size), 0) + n
                room -= n * size
            upto -= 1
        return room

    left = sum(fill(s, gaps.get(s, 0.0)) for s in order)
    for s in order:
        left = fill(s, left)
    return take


class Mix:
    """`plan`: what every mix takes of each source; `rows`: a row per use of a document.

    docs: doc_id, text, source. Documents without a source are in no mix and
    not in the total; null and empty texts have size 0 and come with the whole
    repeats. targets: mix_id, source, weight, max_repeats, total_factor, a
    table that the driver can hold; a null weight, repeat or factor is 0, and
    rows with a null mix_id are a mix. The
    fractional use of a source takes documents in the order of a seeded hash as
    long as all fit, then the largest of the rest that do; what is still
    missing, less than any document left of the source, is taken from the
    mix's other sources. Rows that repeat a doc_id are documents of their own.
    Empty inputs give empty results.
    """

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 42):
        spark = docs.sparkSession
        # Texts are read once, for their sizes.
        sized = docs.where(F.col("source").isNotNull()).select(F.monotonically_increasing_id().alias("item"), "doc_id", "source", size_in_tokens(F.col("text")).alias("n_tokens"))
        sized = settle(sized)
        sizes = settle(sized.groupBy("source").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs")))
        wanted = targets.select("mix_id", "source", "weight", "max_repeats", "total_factor").collect()
        total, n_docs = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
        names = spark.createDataFrame([(s,) for s in sorted({r.source for r in wanted if r.source is not None})], "source string")
        there = {r.source: r.size for r in sizes.join(names, "source").collect()}  # no more than names
        by_mix: dict[str, list] = {}
        for r in wanted:
            by_mix.setdefault(r.mix_id, []).append(r)
        out = []
        for mix, own in by_mix.items():
            most = [float((r.max_repeats or 0) * there.get(r.source, 0)) for r in own]
            all_ = max((r.total_factor or 0.0) for r in own) * total
            given = water_fill([(r.weight or 0.0, m) for r, m in zip(own, most, strict=True)], all_)
            for r, g in zip(own, given, strict=True):
                size = there.get(r.source, 0)
                repeats = min(g / size, float(r.max_repeats or 0)) if size else 0.0
                whole = int(repeats + 1e-9)
                out.append((mix, r.source, r.weight, r.max_repeats, size, (r.weight or 0.0) * (r.total_factor or 0.0) * total, g, whole, max(0.0, (repeats - whole) * size)))
        self.plan = spark.createDataFrame(out, _PLAN)
        self.rows = self._rows(sized, n_docs, seed)

    def _rows(self, sized: DataFrame, n_docs: int, seed: int) -> DataFrame:
        spark, group, buckets = sized.sparkSession, ["mix_id", "source"], R.bucket_count(n_docs)
        plan = {(r.mix_id, r.source): r for r in self.plan.collect()}  # the target rows, which the driver made
        kinds = "mix_id string, source string, whole bigint, part double, edge int, before bigint"

        def keyed_by(rows: list[tuple]) -> DataFrame:
            docs = sized.join(spark.createDataFrame(rows, kinds), "source").withColumn("key", R.random_key(seed, F.col("mix_id"), F.col("doc_id")))
            return docs.withColumn("bucket", R.bucket_of(F.col("key"), buckets))

        keyed = keyed_by([(m, s, r.whole, r.part, None, None) for (m, s), r in plan.items()])
        before = R.with_offsets(keyed.where("part > 0").groupBy(*group, "part", "bucket").agg(F.sum("n_tokens").alias("n")), group, "n")
        # The bucket in which the wanted size is reached; only its documents are put in order.
        edge = before.where((F.col("before") <= F.col("part")) & (F.col("before") + F.col("n") > F.col("part")))
        edge = {(r.mix_id, r.source): (r.edge, r.start) for r in edge.groupBy(*group).agg(F.max("bucket").alias("edge"), F.max_by("before", "bucket").alias("start")).collect()}
        keyed = keyed_by([(m, s, r.whole, r.part, *edge.get((m, s), (buckets, None))) for (m, s), r in plan.items()])
        upto = F.sum("n_tokens").over(W.partitionBy(*group).orderBy("key", "doc_id", "n_tokens", "item").rowsBetween(W.unboundedPreceding, W.currentRow))
        partly = F.col("part") > 0
        at_edge = partly & (F.col("bucket") == F.col("edge"))
        inside = settle(keyed.where(at_edge).withColumn("extra", (F.col("before") + upto <= F.col("part")).cast("int")))
        sure = keyed.where(~at_edge).withColumn("extra", (partly & (F.col("bucket") < F.col("edge"))).cast("int"))
        both = sure.unionByName(inside)
        got = {(r.mix_id, r.source): r.n for r in inside.where("extra = 1").groupBy(*group).agg(F.sum("n_tokens").alias("n")).collect()}  # no more than targets
        used = both.withColumn("uses", F.col("whole") + F.col("extra")).where("uses > 0")
        used = used.select(*group, "doc_id", "n_tokens", F.explode(F.sequence(F.lit(1).cast("bigint"), "uses")).alias("use_no"))
        more = self._more(both, plan, {k: plan[k].part - start - got.get(k, 0) for k, (_, start) in edge.items()}, seed)
        return used.unionByName(more.select(*group, "doc_id", "n_tokens", (F.col("whole") + 1).alias("use_no")))

    def _more(self, both: DataFrame, plan: dict, gaps: dict[tuple, float], seed: int) -> DataFrame:
        """Documents besides those taken that fill what is missing: by the number of documents left of each size that could fit."""
        group, room = ["mix_id", "source"], {}
        for (m, _), g in gaps.items():
            room[m] = room.get(m, 0.0) + g
        # Sources that may give another use of a document.
        open_ = [(m, s, room[m]) for (m, s), r in plan.items() if m in room and r.whole < (r.max_repeats or 0)]
        limits = both.sparkSession.createDataFrame(open_, "mix_id string, source string, room double")
        spare = both.where((F.col("extra") == 0) & (F.col("n_tokens") > 0)).join(limits, group).where(F.col("n_tokens") <= F.col("room"))
        stock = spare.groupBy(*group, "n_tokens").agg(F.count(F.lit(1)).alias("left"))
        order, own = {m: [] for m in room}, {m: {} for m in room}
        for (m, s), r in sorted(plan.items(), key=lambda x: (-(x[1].weight or 0.0), x[0][1] or "")):
            if m in room and s is not None:
                order[m].append(s)
                own[m][s] = gaps.get((m, s), 0.0)

        # A group is a mix: the distinct sizes of its sources that are less than a few documents.
        def fill(pdf: pd.DataFrame) -> pd.DataFrame:
            mix, stock = pdf.mix_id.iloc[0], {}
            for s, n, k in zip(pdf.source, pdf.n_tokens, pdf.left, strict=True):
                stock.setdefault(s, {})[int(n)] = int(k)
            take = fill_gaps(own[mix], stock, order[mix])
            return pd.DataFrame([(mix, s, n, k) for (s, n), k in take.items()], columns=["mix_id", "source", "n_tokens", "take"])

        take = stock.groupBy("mix_id").applyInPandas(fill, _FILL)
        some = settle(spare.join(take, [*group, "n_tokens"]).select(*group, "n_tokens", "doc_id", "whole", "item", "take"))
        return first_per_group(some, [*group, "n_tokens"], ["doc_id", "item"], F.col("take"), seed)

    def report(self) -> DataFrame:
        """Per mix and source: weight, size, what was wanted and given, the tokens and share reached, `exhausted` and `short`.

        exhausted: every document was used max_repeats times. short: that is
        less than the weight asked for, or the tokens reached are less than
        REACHED of what the source was to give, as no documents of the size
        that is missing are left.
        """
        reached = self.rows.groupBy("mix_id", "source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"))
        reached = reached.withColumnsRenamed({"mix_id": "__mix", "source": "__source"})
        r = self.plan.join(reached, F.col("mix_id").eqNullSafe(F.col("__mix")) & F.col("source").eqNullSafe(F.col("__source")), "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("tokens", "uses")})
        all_ = F.sum("tokens").over(W.partitionBy("mix_id"))
        most = F.coalesce(F.col("max_repeats"), F.lit(0)) * F.col("size")
        exhausted = (F.col("tokens") == most) & (F.col("tokens").cast("double") < F.col("wanted"))
        short = exhausted | (F.col("tokens") < REACHED * F.col("given"))
        return r.select(
            "mix_id", "source", "weight", "max_repeats", "size", "wanted", "given", "tokens", "uses",
            F.when(all_ > 0, F.col("tokens") / all_).alias("reached_share"), exhausted.alias("exhausted"), short.alias("short"),
        )
