"""Sentences to token rows, token classes, and the filters on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.casefold import casefold
from vecloom.operators.lists import list_kind, parse_list
from vecloom.schema import ALIASES, INDEX_CLASS_ALIASES, REQUIRED, resolve

LISTS = ("tokens", "pos", "index", "head_dist", "relation_type", "arity")
# Tags that the filtered corpus leaves out.
EXCLUDED_POS = ("X", "SYM", "INTJ", "PART")


def sentence_lists(sentences: DataFrame, keep: list[str] = (), on_error: str = "wrap") -> DataFrame:
    """sentence_id and the list columns present, parsed; `keep` names further columns of the input."""
    df = _with_kept(sentences, list(keep))
    # A missing cell of a list column is an empty list: no token of that sentence survives the shortest length.
    empty, kinds = F.array().cast("array<string>"), dict(df.dtypes)
    columns, text = df.columns, [c for c in LISTS if kinds.get(c) == "string"]
    df = df.withColumns({f"__kind_{c}": list_kind(F.col(f"`{c}`")) for c in text})
    made = {c: F.coalesce(parse_list(F.col(f"`{c}`"), on_error, kind=F.col(f"__kind_{c}")), empty) if c in text else F.coalesce(F.col(f"`{c}`"), F.array()) for c in LISTS if c in columns}
    return df.withColumns(made).select(*[f"`{c}`" for c in columns])


def _with_kept(sentences: DataFrame, keep: list[str]) -> DataFrame:
    found = {name: at for name in ALIASES if (at := resolve(sentences.columns, name))}
    if missing := [r for r in REQUIRED if r not in found]:
        raise ValueError(f"no column for {', '.join(missing)}")
    return sentences.select(*[F.col(f"`{at}`").alias(name) for name, at in found.items()], *[F.col(f"`{k}`") for k in keep if k not in found])


def shortest(df: DataFrame) -> Column:
    """The length of the shortest list present in a row."""
    sizes = [F.size(f"`{c}`") for c in LISTS if c in df.columns]
    return F.least(*sizes) if len(sizes) > 1 else sizes[0]


def number(c: Column) -> Column:
    return c.try_cast("double")


def expand_tokens(sentences: DataFrame, exclude_first: bool = False, keep: list[str] = (), on_error: str = "wrap") -> DataFrame:
    """A row per token: word_id from 0, word, pos (upper case), index, length, head_dist, relation_type, arity, word_norm.

    Parallel lists are cut to the shortest that is present. A missing index
    column counts from 1; other missing columns are null, as are numbers that
    are none. The length is in code points.
    """
    df = sentence_lists(sentences, keep, on_error)
    extra = [k for k in keep if k in df.columns]
    lists = [c for c in LISTS if c in df.columns]
    cut = F.arrays_zip(*[F.slice(F.col(f"`{c}`"), F.lit(1), shortest(df)).alias(c) for c in lists])
    t = df.select("sentence_id", *[F.col(f"`{k}`") for k in extra], F.posexplode(cut).alias("word_id", "t"))
    if exclude_first:
        t = t.where("word_id <> 0")
    get = lambda c: F.col(f"t.`{c}`").cast("string") if c in lists else F.lit(None).cast("string")
    word = F.coalesce(get("tokens"), F.lit("None"))
    index = number(get("index")) if "index" in lists else (F.col("word_id") + 1).cast("double")
    return t.select(
        "sentence_id", *[F.col(f"`{k}`") for k in extra], "word_id", word.alias("word"), F.upper(get("pos")).alias("pos"), index.alias("index"), F.length(word).alias("length"),
        number(get("head_dist")).alias("head_dist"), get("relation_type").alias("relation_type"), number(get("arity")).alias("arity"), casefold(word).alias("word_norm"),
    )


def _exploded(sentences: DataFrame, lists: dict[str, str], on_error: str) -> DataFrame:
    """sentence_id, word_id and the named lists side by side, cut to the shortest of these; lists: logical name to column."""
    at = resolve(sentences.columns, "sentence_id")
    if at is None:
        raise ValueError("no column for sentence_id")
    kinds, empty = dict(sentences.dtypes), F.array().cast("array<string>")
    df = sentences.select(F.col(f"`{at}`").cast("string").alias("sentence_id"), *[F.col(f"`{c}`").alias(n) for n, c in lists.items()])
    df = df.select("sentence_id", *[F.coalesce(parse_list(F.col(n), on_error), empty).alias(n) if kinds[c] == "string" else F.coalesce(n, F.array()).alias(n) for n, c in lists.items()])
    n = F.least(*[F.size(n) for n in lists])
    t = df.select("sentence_id", F.posexplode(F.arrays_zip(*[F.slice(c, F.lit(1), n).alias(c) for c in lists])).alias("word_id", "t"))
    return t.select("sentence_id", "word_id", *[F.col(f"t.{c}").cast("string").alias(c) for c in lists])


def expand_by_index(sentences: DataFrame, top: int = 10, include_zero: bool = False, exclude_first: bool = False, on_error: str = "wrap") -> DataFrame:
    """sentence_id, word_id, index_class, word: tokens with a class by their index, cut to the tokens and the index alone.

    A sentence needs an index column; tokens whose index is no whole number or
    below the least have no row.
    """
    words, index = resolve(sentences.columns, "tokens"), resolve(sentences.columns, "index", INDEX_CLASS_ALIASES)
    if words is None or index is None:
        raise ValueError(f"no column for {'tokens' if words is None else 'index'}")
    t = _exploded(sentences, {"word": words, "index": index}, on_error).withColumn("index_class", index_class(F.col("index"), top, include_zero))
    t = t.where(F.col("index_class").isNotNull())
    return (without_first(t) if exclude_first else t).select("sentence_id", "word_id", "index_class", "word")


def expand_by_pos(sentences: DataFrame, tags: tuple[str, ...] = EXCLUDED_POS, exclude_first: bool = False, on_error: str = "empty") -> DataFrame:
    """sentence_id, word_id of the tokens whose tag is not among `tags`, cut to the tokens and the tags alone; a null tag stays."""
    words, pos = resolve(sentences.columns, "tokens"), resolve(sentences.columns, "pos")
    if words is None or pos is None:
        raise ValueError(f"no column for {'tokens' if words is None else 'pos'}")
    t = without_pos(_exploded(sentences, {"word": words, "pos": pos}, on_error), tags)
    return (without_first(t) if exclude_first else t).select("sentence_id", "word_id")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given order, nulls last; rows equal in it are taken by the order of their other columns.

    By partial aggregation, so a key that holds most rows is combined before the shuffle. Null keys are a key.
    """
    columns = [f"`{c}`" for c in df.columns]
    rank = [x for c in [*order, *[c for c in df.columns if c not in order]] for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    first = F.min_by(F.struct(*columns), F.struct(*[x.alias(f"o{i}") for i, x in enumerate(rank)]))
    kept = df.groupBy(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)]).agg(first.alias("__first"))
    return kept.select(*[F.col(f"__first.{c}") for c in columns])


def index_class(index: Column, top: int = 10, include_zero: bool = False) -> Column:
    """The class of a token by its index: a whole number as text, `top` for all above; null where it has none."""
    whole = index.try_cast("int")  # cuts numbers, and takes text only if it is a whole number
    return F.when(whole >= (0 if include_zero else 1), F.least(whole, F.lit(top)).cast("string"))


def without_pos(tokens: DataFrame, tags: tuple[str, ...] = EXCLUDED_POS) -> DataFrame:
    """Tokens whose tag is not among `tags`, by exact case; a null tag stays."""
    return tokens.where(~F.coalesce(F.col("pos").isin(*tags), F.lit(False)))


def without_first(tokens: DataFrame) -> DataFrame:
    return tokens.where("word_id <> 0")


def least_size(df: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Rows of the classes with at least `least` rows."""
    kept = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    return df.join(kept, key, "left_semi")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def reduce_to(sentences: DataFrame, ids: DataFrame, key: str = "sentence_id") -> DataFrame:
    """The sentences whose id is among `ids`, each once, whatever its number of tokens there."""
    return sentences.join(ids.select(key), key, "left_semi")
