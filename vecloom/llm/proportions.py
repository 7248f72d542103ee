"""A sample that matches target category proportions (problem 2).

Divisor method: the rows of a category are ranked at random, a row's priority
is (rank - 0.5) / target share, the rows up to the category's floor come first,
and the rows with the globally smallest priorities are kept. What an exhausted
category can't fill falls to the others by itself, as their next rows follow.
"""

from __future__ import annotations

from math import floor, inf

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm import ranking as R
from vecloom.session import settle

FIELDS = ("pos", "index", "head_dist")
BLANKS = " \t\n\r\v\f"
_CAT = ["field_name", "category"]
_TARGET = "target_id string, field_name string, category string, target_share double, min_rows bigint, wanted double, available bigint, seats bigint"


def category_of(field: str) -> Column:
    """The category of a token row by pos, index or head_dist; null where it has none."""
    c = F.col(f"`{field}`")
    if field == "pos":
        return F.nullif(F.upper(F.btrim(c, F.lit(BLANKS))), F.lit(""))
    c = c.cast("double")
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    if field == "index":
        return F.when(whole & (c >= 1), F.least(c, F.lit(10.0)).cast("bigint").cast("string"))
    return F.when(whole, c.cast("bigint").cast("string"))


def seats(categories: list[tuple[str, float, int, int]], sample_rows: int) -> dict[str, int]:
    """Rows to keep of each category: (name, target share, rows there are, floor).

    The sample_rows smallest priorities after the floors, by bisection on the
    priority. Floors hold even where they exceed the sample. Equal priorities
    fall to the categories first in the alphabet.
    """
    least = {c: min(n, max(f, 0)) for c, _, n, f in categories}

    def upto(t: float) -> dict[str, int]:
        return {c: max(least[c], min(n, floor(min(t * w + 0.5, n + 1.0)))) if w > 0 else least[c] for c, w, n, _ in categories}

    low, high = 0.0, max([(n + 1.0) / w for _, w, n, _ in categories if w > 0], default=0.0)
    if sum(upto(high).values()) <= sample_rows:
        return upto(high)
    if sum(least.values()) >= sample_rows:
        return least
    while low < (mid := (low + high) / 2) < high:
        low, high = (mid, high) if sum(upto(mid).values()) < sample_rows else (low, mid)
    kept, more = upto(low), upto(high)
    spare = sample_rows - sum(kept.values())
    for c in sorted(kept):
        add = min(spare, more[c] - kept[c])
        kept[c], spare = kept[c] + add, spare - add
    return kept


class ProportionalSample:
    """The sample (`rows`) and the seats given to every target category (`seated`).

    ids name a row; rows that repeat them are rows of their own, ordered
    arbitrarily. Rows without a category (null or odd values) are in no sample.
    Targets that all their categories together can't fill keep every row. A
    null or zero share keeps the floor only; a null floor is 0. Other columns
    of the input are not read. Empty inputs give empty results. targets is a
    table that the driver can hold; a target by another field than FIELDS is an
    error.
    """

    def __init__(self, rows: DataFrame, targets: DataFrame, ids: tuple[str, ...] = ("row_id", "word_id"), seed: int = 42):
        spark = rows.sparkSession
        n_rows = rows.count()
        wanted = targets.select("target_id", *_CAT, "target_share", "sample_share", "min_rows").collect()
        named = {r.field_name for r in wanted}
        if named - {*FIELDS}:
            raise ValueError(f"no categories by {', '.join(sorted(map(str, named - {*FIELDS})))}")
        fields = [f for f in FIELDS if f in named] or ["pos"]
        kinds = F.array(*[F.struct(F.lit(f).alias("field_name"), category_of(f).alias("category")) for f in fields])
        id_cols = [F.col(f"`{c}`") for c in ids]
        names = spark.createDataFrame(sorted({(r.field_name, r.category) for r in wanted if r.category is not None}), "field_name string, category string")
        long = rows.select(*id_cols, R.random_key(seed, *id_cols).alias("key"), F.explode(kinds).alias("x"))
        long = long.select("x.field_name", "x.category", *ids, "key", R.bucket_of(F.col("key"), R.bucket_count(n_rows)).alias("bucket"))
        long = long.join(F.broadcast(names), _CAT)  # no more than the targets, which the driver holds, here and below
        offsets = settle(R.with_offsets(long.groupBy(*_CAT, "bucket").agg(F.count(F.lit(1)).alias("n")), _CAT, "n"))

        there = {(r.field_name, r.category): r.n for r in offsets.groupBy(*_CAT).agg(F.sum("n").alias("n")).collect()}  # no more than names
        out, by_target = [], {}
        for r in wanted:
            by_target.setdefault(r.target_id, []).append(r)
        for target, own in by_target.items():
            size = round(max(r.sample_share or 0.0 for r in own) * n_rows)
            got = seats([(r.category, r.target_share or 0.0, there.get((r.field_name, r.category), 0), r.min_rows or 0) for r in own], size)
            out += [
                (target, r.field_name, r.category, r.target_share, r.min_rows, max(float(r.min_rows or 0), (r.target_share or 0.0) * (r.sample_share or 0.0) * n_rows), there.get((r.field_name, r.category), 0), got[r.category])
                for r in own
            ]
        self.seated = spark.createDataFrame(out, _TARGET)
        # Only buckets that start at or before the last wanted rank are shuffled and sorted.
        most = F.broadcast(self.seated.groupBy(*_CAT).agg(F.max("seats").alias("most")))
        last = offsets.join(most, _CAT).where(F.col("before") < F.col("most")).groupBy(*_CAT).agg(F.max("bucket").alias("last"))
        near = long.join(F.broadcast(last), _CAT).where(F.col("bucket") <= F.col("last")).drop("last")
        place = F.row_number().over(W.partitionBy(*_CAT, "bucket").orderBy("key", *ids))
        ranked = near.withColumn("place", place).join(offsets.select(*_CAT, "bucket", "before"), [*_CAT, "bucket"])
        ranked = ranked.withColumn("rank", (F.col("before") + F.col("place")).cast("bigint"))
        seated = F.broadcast(self.seated.select("target_id", *_CAT, "target_share", "seats"))
        priority = F.when(F.col("target_share") > 0, (F.col("rank") - 0.5) / F.col("target_share")).otherwise(F.lit(inf))
        self.rows = ranked.join(seated, _CAT).where(F.col("rank") <= F.col("seats")).select("target_id", *_CAT, *ids, "rank", priority.alias("priority"))

    def report(self) -> DataFrame:
        """A row per target category: what was wanted, there, taken, the share reached, and whether it falls short."""
        taken = self.rows.groupBy("target_id", *_CAT).agg(F.count(F.lit(1)).alias("taken"))
        r = self.seated.join(taken, ["target_id", *_CAT], "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("bigint")))
        all_ = F.sum("taken").over(W.partitionBy("target_id"))  # the rows of a target table
        share = F.when(all_ > 0, F.col("taken") / all_)
        # Short: the sample holds less than was wanted, and more rows would not have been there.
        short = (F.col("taken") < F.col("wanted")) & (F.col("available") < F.col("wanted"))
        return r.select("target_id", *_CAT, "target_share", "min_rows", "wanted", "available", "taken", share.alias("reached_share"), short.alias("short"))
