"""Vectors for tokens: a hook for any model, and a deterministic hash model for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: words of a sentence -> for each layer, sub-token word ids and vectors: (word_ids (m,), vectors (layers, m, d)).
Model = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
#: Numbers that a task holds before it hands vectors on, and pieces whose vectors digest_model() remembers.
HELD_NUMBERS, KNOWN_PIECES = 1 << 19, 1 << 16


def hash_model(layers: int = 2, d: int = 8, piece: int = 4) -> Model:
    """Pieces of `piece` characters, each with a vector that depends on the piece and the layer only."""

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, pieces = [], []
        for i, w in enumerate(words):
            for at in range(0, max(len(w), 1), piece):
                ids.append(i)
                pieces.append(w[at : at + piece])
        v = [[np.random.default_rng(xxhash.xxh64_intdigest(p, seed=layer)).standard_normal(d) for p in pieces] for layer in range(layers)]
        return np.array(ids), np.array(v).reshape(layers, len(pieces), d)

    return run


def digest_model(layers: int = 2, d: int = 8, piece: int = 4) -> Model:
    """As hash_model(), the vectors read off the MD5 digits of the piece and the layer, so that SQL can make them, too."""

    known: dict[str, bytes] = {}

    def digits(p: str) -> bytes:
        v = [[int(x, 16) / 7.5 - 1 for x in hashlib.md5(f"{p}|{layer}".encode(), usedforsecurity=False).hexdigest()[:d]] for layer in range(layers)]
        return np.array(v, dtype=np.float64).tobytes()

    def run(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [i for i, w in enumerate(words) for _ in range(0, max(len(w), 1), piece)]
        pieces = [w[at : at + piece] for w in words for at in range(0, max(len(w), 1), piece)]
        if len(known) > KNOWN_PIECES:
            known.clear()
        v = b"".join([known.get(p) or known.setdefault(p, digits(p)) for p in pieces])
        return np.array(ids, dtype=int), np.frombuffer(v).reshape(len(pieces), layers, d).transpose(1, 0, 2)

    return run


def load_first(candidates: list[str], load: Callable[[str], Model]) -> Model:
    """The first candidate that loads; if none does, an error with the last reason."""
    last: Exception | None = None
    for c in candidates:
        try:
            return load(c)
        except Exception as e:  # noqa: BLE001
            last = e
    raise RuntimeError(f"none of {candidates} could be loaded: {last}")


def embed(sentences: DataFrame, model: Callable[[], Model], mode: str = "first", half: bool = False) -> DataFrame:
    """sentence_id, word_id, layer, vec of every word that the model returns sub-tokens for.

    sentences: sentence_id, words (array<string>). mode: first, last or mean of
    a word's sub-tokens. The model is made once per task. Words without
    sub-tokens have no row. half rounds the vectors to 16-bit floats on the way.
    """
    if mode not in ("first", "last", "mean"):
        raise ValueError(f"mode {mode!r} is not first, last or mean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            rows = []
            for sid, words in zip(pdf.sentence_id, pdf.words, strict=True):
                ids, v = m(list(words))
                for w in np.unique(ids):
                    own = v[:, ids == w]
                    pooled = own[:, 0] if mode == "first" else own[:, -1] if mode == "last" else own.mean(axis=1)
                    rows += [(sid, int(w), layer, pooled[layer].astype(np.float16 if half else np.float32).astype(np.float32)) for layer in range(len(v))]
            yield pd.DataFrame(rows, columns=["sentence_id", "word_id", "layer", "vec"])

    return sentences.select("sentence_id", F.col("words")).mapInPandas(run, "sentence_id string, word_id int, layer int, vec array<float>")


def embed_pieces(sentences: DataFrame, model: Callable[[], Model]) -> DataFrame:
    """sentence_id, word_id, piece, layer, vec: a row per sub-token and layer, for pool_pieces().

    sentences: sentence_id, words (array<string>) and word_ids (array<int>),
    the numbers of the words. The model is made once per task; sentences go
    through it in Arrow batches, and one sentence has to fit a task, as it has
    to fit the model.
    """
    schema = T.StructType([sentences.schema["sentence_id"], *T.StructType.fromDDL("word_id int, piece int, layer int, vec array<double>")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            rows = []
            for sid, words, numbers in zip(pdf.sentence_id, pdf.words, pdf.word_ids, strict=True):
                ids, v = m(list(words))
                rows += [(sid, int(numbers[w]), n, layer, v[layer, n]) for n, w in enumerate(ids) for layer in range(len(v))]
            yield pd.DataFrame(rows, columns=schema.names)

    return sentences.select("sentence_id", "words", "word_ids").mapInPandas(run, schema)


def pool_pieces(pieces: DataFrame, how: str = "mean") -> DataFrame:
    """sentence_id, word_id, layer, vec: the first or the last sub-token of every word, or the mean of all."""
    groups = pieces.groupBy("sentence_id", "word_id", "layer")
    if how in ("first", "last"):
        return groups.agg((F.min_by if how == "first" else F.max_by)("vec", "piece").alias("vec"))
    if how != "mean":
        raise ValueError(f"mode {how!r} is not first, last or mean")
    vecs = F.transform(F.array_sort(F.collect_list(F.struct("piece", "vec"))), lambda x: x["vec"])  # the pieces of a word
    total = F.aggregate(F.slice("vecs", F.lit(2), F.size("vecs")), F.get("vecs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return groups.agg(vecs.alias("vecs")).select("sentence_id", "word_id", "layer", F.transform(total, lambda x: x / F.size("vecs")).alias("vec"))


def together(tokens: DataFrame, order: list[str]) -> DataFrame:
    """Token rows by sentence, each sentence in one task and in the order of word_id, as embed_tokens() takes them.

    One shuffle and one sort. Rows with the same word_id stand in `order`, nulls last.
    """
    return tokens.repartition("sentence_id").sortWithinPartitions("sentence_id", "word_id", *[F.col(f"`{c}`").asc_nulls_last() for c in order])


def _new(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it, as the first does; nulls are alike."""
    out = np.zeros(len(columns[0]), dtype=bool)
    out[:1] = True
    for c in columns:
        a, b = c[1:], c[:-1]
        out[1:] |= pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return out


def pool_words(ids: np.ndarray, v: np.ndarray, how: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that have sub-tokens and their vectors (layers, ids, d): of the first or the last sub-token, or the mean of all."""
    if (np.diff(ids) < 0).any():
        at = np.argsort(ids, kind="stable")
        ids, v = ids[at], v[:, at]
    present, start, n = np.unique(ids, return_index=True, return_counts=True)
    if how == "mean":
        return present, np.add.reduceat(v, start, axis=1) / n[None, :, None] if len(start) else v
    return present, v[:, start if how == "first" else start + n - 1]


def embed_tokens(tokens: DataFrame, model: Callable[[], Model], keep: list[str], how: str = "mean", digits: int | None = None, wide: bool = False) -> DataFrame:
    """sentence_id, word_id, the kept columns, layer and vec: a row per token and layer; vec is null where the model returns no sub-tokens.

    tokens: sentence_id, word_id, word and the kept columns, as together()
    leaves them; of rows with one sentence and word_id the first counts, nulls
    being alike. A sentence goes through the model as one, and has to fit a
    task; what is handed on at once is bounded. Sub-tokens are pooled where the
    model made them, so nothing is shuffled. digits rounds the vectors, halves
    away from zero. wide gives a row per token, with vec the vectors of all
    layers one after the other, and layers their number.
    """
    if how not in ("first", "last", "mean"):
        raise ValueError(f"mode {how!r} is not first, last or mean")
    names = ["sentence_id", "word_id", *keep]
    last = "layers" if wide else "layer"
    schema = T.StructType([*[tokens.schema[c] for c in names], T.StructField(last, T.IntegerType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def rows(t: pa.Table, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        present, v = pool_words(np.concatenate([ids for ids, _ in parts]), np.concatenate([v for _, v in parts], axis=1), how)
        layers, _, d = v.shape
        out = np.zeros((t.num_rows, layers, d))
        out[present] = v.transpose(1, 0, 2)
        if digits is not None:
            scaled = out * 10.0**digits
            out = np.trunc(scaled + np.copysign(0.5, scaled)) / 10.0**digits + 0.0
        missing = np.ones(t.num_rows, dtype=bool)
        missing[present] = False
        each, size = (1, layers * d) if wide else (layers, d)
        vec = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size, dtype=np.int32)) if size else pa.array(np.zeros(each * t.num_rows + 1, dtype=np.int32)), pa.array(out.ravel()), mask=pa.array(np.repeat(missing, each)))
        layer = np.full(t.num_rows, layers, dtype=np.int32) if wide else np.tile(np.arange(layers, dtype=np.int32), t.num_rows)
        own = t.select(names) if each == 1 else t.select(names).take(pa.array(np.repeat(np.arange(t.num_rows), each)))
        return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in own.columns], pa.array(layer), vec], names=schema.names)

    def embedded(t: pa.Table, m: Model) -> Iterator[pa.RecordBatch]:
        """t's sentences are whole."""
        words = t["word"].to_pylist()
        bounds = [*np.flatnonzero(_new(t["sentence_id"].combine_chunks())).tolist(), t.num_rows]
        begun, parts, size = 0, [], 0
        for a, b in zip(bounds, bounds[1:]):
            ids, v = m(words[a:b])
            parts.append((np.asarray(ids, dtype=int) + (a - begun), v))
            size += max(v.size, (b - a) * v.shape[0] * v.shape[2])
            if size > HELD_NUMBERS or b == t.num_rows:
                yield rows(t.slice(begun, b - begun), parts)
                begun, parts, size = b, [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held = model(), None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            if not t.num_rows:
                continue
            t = t.filter(pa.array(_new(t["sentence_id"].combine_chunks(), t["word_id"].combine_chunks())))
            begins = int(np.flatnonzero(_new(t["sentence_id"].combine_chunks()))[-1])
            yield from embedded(t.slice(0, begins), m)
            held = t.slice(begins)
        if held is not None:
            yield from embedded(held, m)

    return tokens.select(*dict.fromkeys([*names, "word"])).mapInArrow(run, schema)


def attach(tokens: DataFrame, vectors: DataFrame, missing: str = "drop") -> DataFrame:
    """Tokens with their vectors, by sentence and word. A token without one is left out, or an error where missing is `fail`."""
    if missing == "drop":
        return tokens.join(vectors, ["sentence_id", "word_id"])
    if missing != "fail":
        raise ValueError(f"missing {missing!r} is neither drop nor fail")
    out = tokens.join(vectors.withColumn("__there", F.lit(True)), ["sentence_id", "word_id"], "left")
    return require_vectors(out, F.col("__there")).drop("__there")


def require_vectors(tokens: DataFrame, there: Column | None = None) -> DataFrame:
    """Tokens as they are; one without a vector, or where `there` does not hold, is an error."""
    word, sentence = (F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("word_id", "sentence_id"))
    told = F.raise_error(F.concat(F.lit("no vector for word "), word, F.lit(" of sentence "), sentence))
    there = F.col("vec").isNotNull() if there is None else there
    return tokens.withColumn("vec", F.when(there, F.col("vec")).otherwise(told.cast(tokens.schema["vec"].dataType)))
