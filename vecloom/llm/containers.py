"""Filling fixed-capacity containers with items (problem 6).

Karmarkar-Karp multiway differencing: every item is a partial partition into k
windows with one filled; the two partial partitions of the largest imbalance
are merged, the fullest windows of one against the emptiest of the other, until
one near-equal partition is left. Where a window exceeds the capacity, the
windows that are full enough, or become so by one exchange, are kept, and the
items of the others are differenced again; the window count rises in the end.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import settle

#: Windows that one block of items shall fill about. Blocks are packed apart, so this bounds a task's work.
BLOCK_WINDOWS, BLOCK_ITEMS = 128, 20_000
#: Specs that one plan takes; more of them are done in turn.
SPECS_AT_ONCE = 500
#: How full a window has to be to be kept in the first round, the second and so on.
FULL_ENOUGH = (0.998, 0.995, 0.99, 0.98, 0.96)


def size_in_tokens(text: Column) -> Column:
    """Tokens of a tokenizer with one token per UTF-8 byte; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def difference(sizes: list[int], k: int) -> tuple[list[int], int]:
    """The window (0..k-1) of every item, and the largest window sum."""
    if k <= 1 or not sizes:
        return [0] * len(sizes), sum(sizes)
    # A partial partition: its filled windows as (sum, tree of items), fullest first; a tree is an item or a pair.
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapify(heap)
    while len(heap) > 1:
        _, i, a = heappop(heap)
        _, _, b = heappop(heap)
        spare = k - len(a)
        if len(b) <= spare:
            merged = a + b
        else:
            # b's fullest go to empty windows, the rest onto a's emptiest: the fullest of each meet the emptiest of the other.
            merged = a[: len(a) - (len(b) - spare)] + b[:spare]
            rest = b[spare:]
            merged += [(x[0] + y[0], (x[1], y[1])) for x, y in zip(reversed(a[len(a) - len(rest) :]), rest, strict=True)]
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heappush(heap, (least - merged[0][0], i, merged))
    windows = heap[0][2]
    place = [0] * len(sizes)
    for w, (_, tree) in enumerate(windows):
        stack = [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                place[x] = w
    return place, windows[0][0]


def _rising(sizes: list[int], capacity: int) -> list[int]:
    """The window of every item; the window count rises until none is over capacity."""
    k = max(1, -(-sum(sizes) // capacity), sum(2 * s > capacity for s in sizes))
    while True:
        place, most = difference(sizes, k)
        if most <= capacity:
            return place
        sums = [0] * k
        for w, s in zip(place, sizes, strict=True):
            sums[w] += s
        over = sum(max(0, s - capacity) for s in sums)
        k += max(1, over // capacity)


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The window of every item, none over capacity; items above the capacity must have been cut before."""
    left, place, used = list(range(len(sizes))), [0] * len(sizes), 0
    for enough in FULL_ENOUGH:
        own = [sizes[i] for i in left]
        k = max(1, -(-sum(own) // capacity), sum(2 * s > capacity for s in own))
        at, most = difference(own, k)
        if most <= capacity:
            break
        kept = _keep_full(dict(zip(left, at, strict=True)), sizes, k, capacity, enough * capacity)
        for n, window in enumerate(kept):
            for i in window:
                place[i] = used + n
        used += len(kept)
        done = {i for window in kept for i in window}
        left = [i for i in left if i not in done]
    for i, w in zip(left, _rising([sizes[i] for i in left], capacity), strict=True):
        place[i] = used + w
    return place


def _keep_full(at: dict[int, int], sizes: list[int], k: int, capacity: int, least: float) -> list[list[int]]:
    """The windows that hold at least `least` and at most the capacity, as they are or after one exchange with another window."""
    windows: list[list[int]] = [[] for _ in range(k)]
    for i, w in at.items():
        windows[w].append(i)
    pool, kept = sorted((sizes[i], i) for i in at), []
    for w in range(k):
        own = windows[w]
        total = sum(sizes[i] for i in own)
        best, out, into = (total if total <= capacity else -1), None, None
        if best < least:
            for a in (None, *{sizes[i]: i for i in own}.values()):
                base = total - (0 if a is None else sizes[a])
                j = bisect_right(pool, (capacity - base, len(sizes))) - 1
                while j >= 0 and at[pool[j][1]] == w:
                    j -= 1
                if j >= 0 and base + pool[j][0] > best:
                    best, out, into = base + pool[j][0], a, pool[j][1]
        if best < least:
            continue
        if into is not None:
            windows[at[into]].remove(into)
            own = [i for i in own if i != out] + [into]
            if out is not None:
                windows[at[into]].append(out)
                at[out] = at[into]
        for i in own:
            pool.pop(bisect_left(pool, (sizes[i], i)))
            at[i] = -1
        windows[w] = []
        kept.append(own)
    return kept


_OUT = "spec_no int, spec_id string, capacity_tokens bigint, block bigint, item bigint, doc_id bigint, piece_no bigint, n_pieces bigint, start_token bigint, n_tokens bigint, window bigint"


def _pack_block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["n_tokens", "doc_id", "piece_no", "item"], ascending=[False, True, True, True], kind="stable")
    pdf["window"] = pack(pdf.n_tokens.tolist(), int(pdf.capacity_tokens.iloc[0]))
    return pdf[[c.split(" ")[0] for c in _OUT.split(", ")]]


def fill_containers(docs: DataFrame, specs: DataFrame, seed: int = 42) -> DataFrame:
    """Every document in containers of every spec.

    docs: doc_id, text; specs: spec_id, capacity_tokens, a table that the
    driver can hold. Returns spec_id, capacity_tokens, container_id, item,
    doc_id, piece_no (from 1), n_pieces, start_token, n_tokens; item is a
    number of the input row. A document is whole (n_pieces 1) unless it exceeds
    the capacity; then its full pieces fill a container each and the last piece
    is an item like others. Null and empty texts are items of size 0. Rows that
    repeat a doc_id are items of their own. A null or non-positive capacity
    gives no rows. Empty inputs give empty results.

    Texts are read once, for their sizes. Items are assigned to blocks by a
    hash and a block is packed by one call; a block holds about BLOCK_WINDOWS
    windows however many documents there are.
    """
    rows = specs.where(F.col("capacity_tokens") > 0).select("spec_id", F.col("capacity_tokens").cast("bigint")).collect()
    sized = settle(docs.select(F.monotonically_increasing_id().alias("item"), "doc_id", size_in_tokens(F.col("text")).alias("size")))
    parts = [_fill(sized, list(some), seed) for some in batched(list(enumerate(rows)), SPECS_AT_ONCE)] or [_fill(sized.limit(0), [(0, ("", 1))], seed)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _fill(sized: DataFrame, specs: list[tuple[int, tuple[str, int]]], seed: int) -> DataFrame:
    def with_specs(plan: list[tuple]) -> DataFrame:
        names = ("spec_no", "spec_id", "capacity_tokens", "n_blocks")
        kinds = ("int", "string", "bigint", "bigint")
        one = [F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(r, kinds, names, strict=True)]) for r in plan]
        return sized.select("*", F.explode(F.array(*one)).alias("s")).select(*sized.columns, "s.*")

    cap = F.col("capacity_tokens")
    rest = F.when(F.col("size") > cap, F.col("size") % cap).otherwise(F.when(F.col("size") < cap, F.col("size")).otherwise(0))
    # Blocks by what is packed, without full pieces, and by number where most documents are tiny.
    load = with_specs([(no, *spec, 1) for no, spec in specs]).groupBy("spec_no").agg(F.sum(rest).alias("packed"), F.count(F.lit(1)).alias("n"))
    load = {r.spec_no: r for r in load.collect()}  # a row a spec
    plan = [(no, *spec, max(1, load[no].packed // (spec[1] * BLOCK_WINDOWS), load[no].n // BLOCK_ITEMS) if no in load else 1) for no, spec in specs]
    pieces = F.greatest(F.ceil(F.col("size") / cap), F.lit(1)).cast("bigint")
    items = with_specs(plan).withColumn("n_pieces", pieces)
    items = items.withColumn("piece_no", F.explode(F.sequence(F.lit(1).cast("bigint"), "n_pieces")))
    items = items.withColumns({
        "start_token": (F.col("piece_no") - 1) * cap,
        "n_tokens": F.least(cap, F.col("size") - (F.col("piece_no") - 1) * cap),
        "block": F.pmod(F.xxhash64(F.lit(seed), "spec_id", "item"), F.col("n_blocks")),
    }).drop("size", "n_blocks")
    full = F.col("n_tokens") == cap
    packed = items.where(~full).groupBy("spec_no", "block").applyInPandas(_pack_block, _OUT)
    whole = items.where(full).withColumn("window", F.lit(None).cast("bigint")).select(*packed.columns)
    name = F.when(F.col("window").isNotNull(), F.concat_ws("-", "spec_id", F.lit("b"), "block", "window"))
    name = name.otherwise(F.concat_ws("-", "spec_id", F.lit("i"), "item", "piece_no")).alias("container_id")
    return packed.unionByName(whole).select("spec_id", "capacity_tokens", name, "item", "doc_id", "piece_no", "n_pieces", "start_token", "n_tokens")


def fill_report(filled: DataFrame) -> DataFrame:
    """Per spec: containers, tokens, and the share of their room left unused."""
    one = filled.groupBy("spec_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("used"))
    r = one.groupBy("spec_id", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"))
    return r.withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")))


def split_documents(filled: DataFrame) -> DataFrame:
    """spec_id, doc_id of the documents that ended in more than one container. One with a single piece is in one."""
    many = filled.where(F.col("n_pieces") > 1).groupBy("spec_id", "item", "doc_id").agg(F.count_distinct("container_id").alias("n"))
    return many.where("n > 1").select("spec_id", "doc_id")
