"""Text decoded with the wrong character encoding: found, and restored where possible (problem 8).

Garbled passages meet their clean twins on the text stripped of non-ASCII
characters. Aligning the characters in between shows which re-decodings took
place; those with enough support are the learned transformations. They are then
undone on every word of the remaining records where the word count of the whole
collection speaks for the result. Words with lost characters follow the word
that their twins have.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.session import settle

LOST = "�"
# The encodings that re-decodings are sought among.
SINGLE_BYTE = (
    "cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "mac_roman", "mac_latin2", "mac_cyrillic",
    "cp437", "cp850", "cp852", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15",
)
#: A passage is compared by its ASCII characters if it has at least this many besides blanks, else by a stricter key (_shape).
LEAST_ASCII = 6
#: A transformation counts as learned from this many different aligned words on, which no better one explains;
#: a word counts from two passages on, as two garbled forms of one text may also meet.
LEAST_PAIRS, LEAST_VOTES = 3, 2
#: Explanation sets (which transformations explain a pair) that are fetched to the driver; of more, the gains by chain are.
MOST_SETS = 100_000
#: How much commoner the restored word must be where its bytes alone prove nothing, and the surroundings likewise.
WORD_RATIO, LEAST_WORDS, CONTEXT_RATIO, LEAST_CONTEXTS = 5, 5, 20, 20
#: How much commoner the restored form of a word too short to judge must be, to find a document by it alone.
WEAK_RATIO = 100
BROADCAST_ROWS, SALTS = 200_000, 16

_BREAK = r"\n+|(?<=[.!?])\s+"
#: Letters, digits and what is not ASCII, with at least one of the latter. Begun at a word's start only: else a long word costs its square.
_WORD = r"(?<![A-Za-z0-9])[A-Za-z0-9]*+(?:[^\x00-\x7F]++[A-Za-z0-9]*+)++"
_PY_WORD = re.compile(_WORD)
_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"[0-9]+")


@lru_cache(maxsize=64)
def _code_page(name: str) -> tuple[dict[str, int], list[str]]:
    """Character to byte and byte to character; a byte that the page leaves undefined stands for itself."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in enumerate(chars)}, chars


def _encode(text: str, name: str) -> bytes | None:
    codes = _code_page(name)[0]
    try:
        return bytes([codes[c] for c in text])
    except KeyError:
        return None


def _decode(data: bytes, name: str) -> str:
    chars = _code_page(name)[1]
    return "".join([chars[b] for b in data])


def undo(text: str, chain: str) -> str | None:
    """The text before `chain` garbled it, or None if the chain can't have. A chain is from>read[*times]."""
    source, _, rest = chain.partition(">")
    read, _, times = rest.partition("*")
    for _ in range(int(times or 1)):
        data = _encode(text, read)
        if data is None:
            return None
        if source == "utf-8":
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError as e:
                # A last byte A0 reads as a no-break space, which often became a blank: outside the word.
                if e.reason != "unexpected end of data" or e.start != len(data) - 1 or not 0xC2 <= data[-1] <= 0xDF:
                    return None
                text = (data + b"\xa0").decode("utf-8")
        else:
            text = _decode(data, source)
    return text


def chains() -> list[str]:
    """All re-decodings sought: UTF-8 read as another encoding, once or twice, and one of those read as another."""
    out = [f"utf-8>{r}{t}" for r in SINGLE_BYTE for t in ("", "*2")]
    return out + [f"{s}>{r}" for s in SINGLE_BYTE for r in SINGLE_BYTE if s != r]


#: Chains whose result checks itself, and those that leave control characters, which no text is meant to have.
PROVEN = frozenset(c for c in chains() if c.startswith("utf-8>"))
CONTROL = frozenset(f"{s}>latin-1" for s in SINGLE_BYTE if not s.startswith(("iso", "latin")))


def completed(word: str, chain: str) -> bool:
    """Whether undo() had to add a last byte to the word."""
    read, _, times = chain.partition(">")[2].partition("*")
    for _ in range(int(times or 1)):
        try:
            word = (_encode(word, read) or b"").decode("utf-8")
        except UnicodeDecodeError:
            return True
    return False


def _explained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chains that turn garbled into clean. Where neither is the commoner word, only those that prove themselves."""
    known, proven = chains(), [c for c in chains() if c in PROVEN]
    for pdf in batches:
        sets = ["|".join(c for c in (proven if tied else known) if undo(g, c) == t) for g, t, tied in zip(pdf.garbled, pdf.clean, pdf.tied, strict=True)]
        yield pdf[["garbled", "clean", "votes"]].assign(explained=sets)


def _shape(text: str) -> str:
    """The text with the non-ASCII characters of every word numbered by first occurrence: single-byte re-decodings of a word keep it."""

    def shape(m: re.Match) -> str:
        seen: dict[str, int] = {}
        return "".join([ch if ch < "\x80" else chr(0x100 + seen.setdefault(ch, len(seen))) for ch in m.group()])

    return _PY_WORD.sub(shape, text)


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(shape=[_shape(p) for p in pdf.passage])


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of passages of one shape whose words are equal or become so when one single-byte chain is undone."""
    known = [c for c in chains() if c not in PROVEN]
    for pdf in batches:
        rows = []
        for group in pdf["group"]:
            n = {g["passage"]: g["n"] for g in group}
            words = {p: _PY_WORD.findall(p) for p in n}
            at = defaultdict(list)  # the passages by place and word
            for p, own in words.items():
                for i, w in enumerate(own):
                    at[i, w].append(p)
            met = set()
            for p, own in words.items():
                for c in known:
                    undone = [undo(w, c) for w in own]
                    for i, (w, r) in enumerate(zip(own, undone, strict=True)):
                        if r is not None and r != w:
                            met |= {(min(p, q), max(p, q)) for q in at.get((i, r), ()) if all(x in y for x, y in zip(words[q], zip(own, undone, strict=True), strict=True))}
            rows += [(p, q, n[p], n[q]) for p, q in met]
        yield pd.DataFrame(rows, columns=["passage", "twin", "n", "twin_n"])


def _proven_forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every passage with what its words are before a UTF-8 chain."""
    proven = [c for c in chains() if c in PROVEN]
    for pdf in batches:
        rows = []
        for p, n in zip(pdf.passage, pdf.n, strict=True):
            forms = {_PY_WORD.sub(lambda m, c=c: undo(m.group(), c) or m.group(), p) for c in proven}
            rows += [(p, f, n) for f in forms if f != p]
        yield pd.DataFrame(rows, columns=["passage", "twin", "n"])


def best_chains(sets: list[tuple[str, int]], least: int) -> list[str]:
    """A small set of chains that explains the pairs: the one that explains most first, until less than `least` are added."""
    left = [(frozenset(s.split("|")), n) for s, n in sets if s]
    order = {c: i for i, c in enumerate(chains())}
    out: list[str] = []
    while left:
        gain: dict[str, int] = {}
        for s, n in left:
            for c in s:
                gain[c] = gain.get(c, 0) + n
        best = max(gain, key=lambda c: (gain[c], -order[c]))
        if gain[best] < least:
            break
        out.append(best)
        left = [(s, n) for s, n in left if best not in s]
    return out


def _plain(word: str) -> str:
    return _DIGITS.sub("0", word)


def _kind(ch: str) -> str:
    return "^" if not ch else "9" if ch.isdigit() else "A" if ch.isupper() else "a"


def _contexts(word: str) -> list[tuple[str, str, str]]:
    """Every run of non-ASCII characters of a word with the kinds of its neighbours."""
    return [(_kind(word[m.start() - 1 : m.start()] if m.start() else ""), m.group(), _kind(word[m.end() : m.end() + 1])) for m in _RUN.finditer(word)]


def _key(c: tuple[str, str, str]) -> str:
    return "".join((c[0], c[2], c[1]))


def _word_contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(_key(c), n) for w, n in zip(pdf.word, pdf.n_docs, strict=True) for c in set(_contexts(w))]
        yield pd.DataFrame(rows, columns=["context", "n_docs"])


def _control(word: str) -> bool:
    return any("\x80" <= ch < "\xa0" for ch in word)


def _strength(word: str, chain: str) -> int:
    """2 where the word can be judged by itself, 1 for a sign or two of a single-byte chain, 0 where its only sign had a byte added."""
    if chain in PROVEN:
        return 0 if sum(ch > "\x7f" for ch in word) == 1 and completed(word, chain) else 2
    return 2 if _control(word) or len(word.replace("0", "")) > 2 else 1


def _tries(learned: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for w, n in zip(pdf.word, pdf.n_docs, strict=True):
                for c in learned:
                    r = undo(w, c)
                    # Undone run by run: only then do the contexts of both words pair off.
                    if r is None or r == w or LOST in r or len(_RUN.findall(w)) != len(_RUN.findall(r)):
                        if r is None or r == w or LOST in r:
                            continue
                        pairs = []
                    else:
                        pairs = [(_key(a), _key(b)) for a, b in zip(_contexts(w), _contexts(r), strict=True) if a != b]
                    rows.append((w, n, c, r, _plain(r), _strength(w, c), c in PROVEN or (c in CONTROL and _control(w)), pairs))
            if not rows:
                continue
            out = pd.DataFrame(rows, columns=["word", "n_docs", "chain", "restored", "plain", "strength", "proven", "pairs"])
            out["pairs"] = [[{"before": a, "after": b} for a, b in p] for p in out["pairs"]]
            yield out

    return run


_TRIED = "word string, n_docs bigint, chain string, restored string, plain string, strength int, proven boolean, pairs array<struct<before:string,after:string>>"


def _words(text):
    """Distinct words with non-ASCII characters of a text, runs of digits as 0."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)), lambda w: F.regexp_replace(w, "[0-9]++", "0")))


class Repair:
    """What is garbled in a collection and how to restore it.

    docs: doc_id, text. learned: the transformations; words: garbled words with
    their chain (or, for lost characters, their restored form); found():
    doc_id of the garbled documents; restored(): their texts. Null, empty and
    ASCII texts are never garbled. Rows that repeat a doc_id are told by their
    text. A collection without twins teaches no transformation; then only
    documents with replacement characters are found.
    """

    def __init__(self, docs: DataFrame):
        self.docs = docs.where(F.col("text").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]")).select("doc_id", "text")
        self.spark = docs.sparkSession
        # The words of every document, made once: counted here, and looked up when the garbled ones are known.
        self.doc_words = settle(self.docs.select("doc_id", _words(F.col("text")).alias("words"), F.col("text").contains(LOST).alias("lost")))
        self.word_counts = settle(self.doc_words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n_docs")))
        self.pairs = settle(self._twins())
        self.learned = self._infer()
        self.words = settle(self._garbled_words())

    def _twins(self) -> DataFrame:
        """garbled, clean, tied, votes: aligned words of passages that are equal but for their non-ASCII characters.

        The commoner word is the clean one; equally common words are tied, and come both ways.
        """
        passage = F.explode(F.split("text", _BREAK)).alias("passage")
        p = self.docs.select(passage).where(F.col("passage").rlike(r"[^\x00-\x7F]"))
        p = p.groupBy("passage").agg(F.count(F.lit(1)).alias("n"))  # combined before the shuffle
        # The ASCII characters alone, a mark where others stood: equal for twins, whose words then pair off.
        p = p.withColumn("skeleton", F.regexp_replace("passage", r"[^\x00-\x7F]++", "\x00"))
        p = settle(p.withColumn("short", F.length(F.regexp_replace("skeleton", r"[\x00\s]++", "")) < LEAST_ASCII))
        short = p.where("short").select("passage", "n")
        p = p.where("not short").select(F.xxhash64("skeleton").alias("key"), "skeleton", "passage", "n")
        # Two representatives per skeleton, not all pairs: the commonest passage, and the plainest, as garbling makes text longer
        # and brings in signs. Where all are equally common, the second is the clean one of those garbled through UTF-8.
        odd, long_ = F.length(F.regexp_replace("passage", r"[\p{L}\p{N}\p{P}\p{Z}]++", "")), F.length("passage")
        commonest = F.max_by("passage", F.struct("n", -odd, -long_, "passage"))
        plainest = F.min_by("passage", F.struct(odd, long_, -F.col("n"), "passage"))
        best = p.groupBy("key", "skeleton").agg(F.array_distinct(F.array(commonest, plainest)).alias("twins"), F.count(F.lit(1)).alias("variants"))
        both = p.join(best.where("variants > 1"), ["key", "skeleton"]).withColumn("twin", F.explode("twins")).where(F.col("passage") != F.col("twin"))
        both = both.select("passage", "twin", "n").unionByName(self._short_twins(short))
        words = lambda c: F.regexp_extract_all(F.col(c), F.lit(f"({_WORD})"), F.lit(1))
        zipped = F.explode(F.arrays_zip(words("passage").alias("a"), words("twin").alias("b"))).alias("w")
        w = both.select("n", zipped).select("n", "w.a", "w.b").where("a != b")
        w = w.select("n", F.regexp_replace("a", "[0-9]++", "0").alias("a"), F.regexp_replace("b", "[0-9]++", "0").alias("b"))
        w = w.groupBy("a", "b").agg(F.sum("n").alias("votes"))
        counts = self.word_counts
        w = w.join(counts.select(F.col("word").alias("a"), F.col("n_docs").alias("a_docs")), "a").join(counts.select(F.col("word").alias("b"), F.col("n_docs").alias("b_docs")), "b")
        way = lambda a, b: F.struct(F.col(a).alias("garbled"), F.col(b).alias("clean"))
        ways = F.when(F.col("a_docs") > F.col("b_docs"), F.array(way("b", "a"))).when(F.col("a_docs") < F.col("b_docs"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
        w = w.select("votes", (F.col("a_docs") == F.col("b_docs")).alias("tied"), F.explode(ways).alias("way")).select("way.*", "votes", "tied")
        return w.groupBy("garbled", "clean", "tied").agg(F.sum("votes").alias("votes"))

    def _short_twins(self, short: DataFrame) -> DataFrame:
        """passage, twin, n of passages with few ASCII characters: those that a chain turns into another, and those with lost characters.

        n is the rarer passage's. Where the other is as much commoner as a
        restored word has to be, it is no garbled form itself: that counts as LEAST_VOTES.
        """
        short = short.groupBy(F.regexp_replace("passage", "[0-9]++", "0").alias("passage")).agg(F.sum("n").alias("n"))
        whole = short.where(~F.col("passage").contains(LOST))
        shaped = whole.mapInPandas(_shapes, "passage string, n bigint, shape string")
        groups = shaped.groupBy("shape").agg(F.collect_list(F.struct("passage", "n")).alias("group")).where(F.size("group") > 1)
        single = groups.select("group").mapInPandas(_meet, "passage string, twin string, n bigint, twin_n bigint")
        less, more = F.least("n", "twin_n"), F.greatest("n", "twin_n")
        sure = (more >= LEAST_WORDS) & (more >= WORD_RATIO * less)
        single = single.select("passage", "twin", F.when(sure, F.greatest(less, F.lit(LEAST_VOTES))).otherwise(less).cast("bigint").alias("n"))
        # A UTF-8 chain changes the number of characters: what it is undone to is looked up.
        forms = whole.mapInPandas(_proven_forms, "passage string, twin string, n bigint")
        utf8 = forms.join(whole.select(F.col("passage").alias("twin")), "twin").select("passage", "twin", "n")
        # With lost characters: as long, and equal in the others, of which there are as many as elsewhere.
        key = F.regexp_replace("passage", r"[^\x00-\x7F]", "\x00").alias("key")
        lost = short.where(F.col("passage").contains(LOST)).select("passage", "n", key)
        near = lost.join(whole.select(F.col("passage").alias("twin"), key), "key")
        kept = F.length(F.regexp_replace("passage", rf"[{LOST}\s]++", "")) >= LEAST_ASCII
        same = F.forall(F.zip_with(F.split("passage", ""), F.split("twin", ""), lambda a, b: (a == b) | (a == LOST)), lambda x: x)
        return single.unionByName(utf8).unionByName(near.where(kept & same).select("passage", "twin", "n"))

    def _infer(self) -> list[str]:
        whole = self.pairs.where(~F.col("garbled").contains(LOST) & ~F.col("clean").contains(LOST))
        explained = whole.mapInPandas(_explained, "garbled string, clean string, votes bigint, explained string").where("explained != ''")
        firm = F.count(F.when(F.col("votes") >= LEAST_VOTES, 1)).alias("firm")
        sets = settle(explained.groupBy(F.split("explained", r"\|").alias("set")).agg(F.count(F.lit(1)).alias("n"), firm))
        # Bytes that decode as UTF-8 prove themselves: one pair is enough.
        sure = self._choose(sets.select("set", "n"), PROVEN, (), 1)
        learned = sure + self._choose(sets.select("set", F.col("firm").alias("n")), chains(), sure, LEAST_PAIRS)
        # Chains of pairs that none of these explains: words may confirm them.
        open_ = sets.where(~F.arrays_overlap("set", F.array(*[F.lit(c) for c in learned]))) if learned else sets
        self.hinted = sorted(r[0] for r in open_.select(F.explode("set")).distinct().collect())  # no more than chains()
        return learned

    def _choose(self, sets: DataFrame, among, without, least: int) -> list[str]:
        """best_chains() of (set, n) rows: with the chains `among` alone, and the sets that hold none of `without`."""
        with_some = lambda cs: F.arrays_overlap("set", F.array(*[F.lit(c) for c in cs]))
        left = sets.where(~with_some(without)) if without else sets
        left = left.select(F.filter("set", lambda c: c.isin(sorted(among))).alias("set"), "n").where(F.size("set") > 0)
        left = left.groupBy("set").agg(F.sum("n").alias("n"))
        rows = left.limit(MOST_SETS + 1).collect()
        if len(rows) <= MOST_SETS:
            return best_chains([("|".join(r.set), r.n) for r in rows], least)
        out: list[str] = []
        order = {c: i for i, c in enumerate(chains())}
        left = settle(left)
        while True:
            rest = left.where(~with_some(out)) if out else left
            gain = {r.c: r.n for r in rest.select(F.explode("set").alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect()}
            best = max(gain, key=lambda c: (gain[c], -order[c]), default=None)
            if best is None or gain[best] < least:
                return out
            out.append(best)

    def _garbled_words(self) -> DataFrame:
        """word, chain, restored: by a learned chain whose result the collection confirms, else by the twins."""
        counts = self.word_counts
        by_word = counts.select(F.col("word").alias("plain"), F.col("n_docs").alias("plain_docs"))
        contexts = settle(counts.mapInPandas(_word_contexts, "context string, n_docs bigint").groupBy("context").agg(F.sum("n_docs").alias("n")))
        wanted = [c for c in chains() if c in PROVEN or c in CONTROL or c in self.learned or c in self.hinted]
        # Many steps a word: spread over all cores, whatever files the counts lie in.
        words = counts.where(~F.col("word").contains(LOST)).repartition(self.spark.sparkContext.defaultParallelism, "word")
        tried = settle(words.mapInPandas(_tries(wanted), _TRIED).withColumn("id", F.monotonically_increasing_id()))
        self.learned += self._by_words(tried, by_word)
        tried = tried.where(F.col("chain").isin(self.learned))
        t = tried.join(by_word, "plain", "left").withColumn("plain_docs", F.coalesce("plain_docs", F.lit(0).cast("bigint")))
        # Contexts: the rarest of the restored word, and the least gain over the garbled one's.
        c = tried.select("id", F.explode("pairs").alias("p")).select("id", "p.*")
        c = c.join(contexts.select(F.col("context").alias("before"), F.col("n").alias("before_n")), "before", "left")
        c = c.join(contexts.select(F.col("context").alias("after"), F.col("n").alias("after_n")), "after", "left")
        c = c.groupBy("id").agg(F.min(F.coalesce("after_n", F.lit(0))).alias("after_n"), F.min(F.coalesce("after_n", F.lit(0)) / F.greatest(F.coalesce("before_n", F.lit(0)), F.lit(1))).alias("gain"))
        t = t.join(c, "id", "left").fillna({"after_n": 0, "gain": 0.0})
        proven = F.col("proven")  # text that isn't UTF-8 read wrongly hardly ever decodes as UTF-8
        seen = F.when(proven, F.col("plain_docs") >= 1).otherwise(F.col("plain_docs") >= F.greatest(F.lit(LEAST_WORDS), WORD_RATIO * F.col("n_docs")))
        # A sign or two, or a word whose last byte was added, are judged by the words around them unless the count is overwhelming.
        overwhelming = F.col("plain_docs") >= F.greatest(F.lit(LEAST_WORDS), WEAK_RATIO * F.col("n_docs"))
        strength = F.when(overwhelming, 2).otherwise(F.col("strength"))
        around = F.when(proven, F.col("after_n") >= LEAST_CONTEXTS).otherwise((F.col("after_n") >= LEAST_CONTEXTS) & (F.col("gain") >= CONTEXT_RATIO))
        ok = t.where(seen | around).withColumn("strength", strength)
        rank = F.struct(F.col("plain_docs"), F.col("after_n"), F.col("chain"))
        by_chain = ok.groupBy("word").agg(F.max_by(F.struct("chain", "restored", "strength"), rank).alias("x")).select("word", "x.chain", "x.restored", "x.strength")
        lost = self.pairs.where(F.col("garbled").contains(LOST) & ~F.col("clean").contains(LOST))
        lost = lost.groupBy(F.col("garbled").alias("word")).agg(F.max("clean").alias("restored"), F.count_distinct("clean").alias("ways"))
        lost = lost.where("ways = 1").select("word", F.lit("twin").alias("chain"), "restored", F.lit(2).alias("strength"))
        return by_chain.unionByName(lost)

    def _by_words(self, tried: DataFrame, by_word: DataFrame) -> list[str]:
        """Chains not yet learned that turn different words into words of the collection: its words are twins, too.

        LEAST_VOTES words do for a UTF-8 chain, LEAST_PAIRS for others. A chain
        that does not prove itself needs a pair of twins besides, and words
        that are as much commoner as restored ones have to be.
        """
        t = tried.where(F.col("strength") == 2).join(by_word, "plain")
        commoner = F.col("plain_docs") >= F.greatest(F.lit(LEAST_WORDS), WORD_RATIO * F.col("n_docs"))
        t = t.where(F.col("proven") | (commoner & F.col("chain").isin(self.hinted)))
        sets = t.groupBy("word", "plain").agg(F.array_sort(F.collect_set("chain")).alias("set"))
        sets = settle(sets.groupBy("set").agg(F.count(F.lit(1)).alias("n")))
        more = self._choose(sets, PROVEN, self.learned, LEAST_VOTES)
        return more + self._choose(sets, [c for c in chains() if c not in PROVEN], [*self.learned, *more], LEAST_PAIRS)

    def _hits(self) -> DataFrame:
        """doc_id with each garbled word of the document: word, chain, restored, strength. Documents without have no row."""
        long = self.doc_words.select("doc_id", F.explode("words").alias("word"))
        n = self.words.count()
        if n <= BROADCAST_ROWS:
            return long.join(F.broadcast(self.words), "word")
        salted = self.words.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        long = long.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        return long.join(salted, ["word", "__salt"]).drop("__salt")

    def found(self) -> DataFrame:
        # Found by a word of its own strength, or by two different short ones of one chain.
        by_chain = self._hits().groupBy("doc_id", "chain").agg(F.max("strength").alias("best"), F.count_distinct(F.when(F.col("strength") > 0, F.col("word"))).alias("n"))
        by_word = by_chain.where("best = 2 or n > 1").select("doc_id")
        return by_word.unionByName(self.doc_words.where("lost").select("doc_id")).distinct()

    def restored(self) -> DataFrame:
        """doc_id, restored (the text with every garbled word restored that can be), n_restored, n_lost (replacement characters left)."""
        fix = F.struct("word", "chain", "restored", "strength")
        fixes = self._hits().select("doc_id", fix.alias("fix")).groupBy("doc_id").agg(F.collect_set("fix").alias("fixes"))
        # Words too short to judge are restored where the document has others of their chain, as in found().
        others = lambda x: F.filter("fixes", lambda y: (y["chain"] == x["chain"]) & ((y["strength"] == 2) | ((y["strength"] > 0) & (y["word"] != x["word"]) & (x["strength"] > 0))))
        fixes = fixes.select("doc_id", F.filter("fixes", lambda x: (x["strength"] == 2) | (F.size(others(x)) > 0)).alias("fixes")).where(F.size("fixes") > 0)
        lost = self.doc_words.where("lost").select("doc_id", F.lit(None).cast(fixes.schema["fixes"].dataType).alias("fixes"))
        # Null ids are an id, here as in found().
        wanted = fixes.unionByName(lost).groupBy(F.col("doc_id").alias("id")).agg(F.first("fixes", ignorenulls=True).alias("fixes"))
        out = "doc_id bigint, restored string, n_restored bigint, n_lost bigint"
        return self.docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", "text", "fixes").mapInPandas(_restore, out)


def _restore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, text, fixes in zip(pdf.doc_id, pdf.text, pdf.fixes, strict=True):
            by_word = {f["word"]: (f["chain"], f["restored"]) for f in (fixes if fixes is not None else [])}
            done = 0

            def fix(m: re.Match, by_word=by_word) -> str:
                nonlocal done
                chain, to = by_word.get(_plain(m.group()), (None, None))
                if chain is None:
                    return m.group()
                if chain != "twin":
                    to = undo(m.group(), chain)
                elif _DIGITS.search(m.group()):
                    return m.group()
                done += to is not None
                return m.group() if to is None else to

            text = _PY_WORD.sub(fix, text)
            rows.append((doc_id, text, done, text.count(LOST)))
        yield pd.DataFrame(rows, columns=["doc_id", "restored", "n_restored", "n_lost"])
