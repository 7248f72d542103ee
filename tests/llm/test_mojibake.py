"""Garbled text: found and restored, over a made-up collection."""

import random

import pytest

from vecloom.llm import mojibake as M

DOCS = "doc_id bigint, text string, words string"
SENTENCES = [
    "El niño de Luz soñó con una montaña pequeña.", "Können Sie mir zwei Stühle für den Saal schicken?", "Nous avons goûté trois gâteaux très différents.", "The café on the corner isn’t far from the façade.",
    "My résumé mentions the naïve approach of Zoë.", "Głośny pies leży na łące koło szkoły.", "Příští týden přijede vlak z Brna.", "They charge €20 or £15 for the crème brûlée.",
]
CHAINS = ["utf-8>cp1252", "utf-8>cp1252*2", "utf-8>mac_roman", "utf-8>cp437", "cp1252>mac_roman"]


def garble(text, chain):
    source, _, rest = chain.partition(">")
    read, _, times = rest.partition("*")
    for _ in range(int(times or 1)):
        out = []
        for ch in text:
            try:
                out.append(M._decode(ch.encode(source), read))
            except UnicodeEncodeError:
                out.append(ch)
        text = "".join(out)
    return text


@pytest.mark.parametrize("chain", CHAINS)
def test_undo(chain):
    for s in SENTENCES[:5]:
        assert M.undo(garble(s, chain), chain) == s


def test_clean_text_is_not_undone():
    assert M.undo("m’étonne", "utf-8>cp1252") is None and M.undo("NÃO", "utf-8>cp1252") is None
    assert M.undo("DÃ©jÃ", "utf-8>cp1252") == "Déjà"  # the no-break space became a blank


def test_code_pages_are_strict():
    # cp437 has no Ã; a byte that cp1252 leaves undefined stands for itself.
    assert M.undo("AndrÃ©", "utf-8>cp437") is None and M.undo("AndrÃ©", "utf-8>cp1252") == "André"
    assert M.undo("\x9d", "cp1250>cp1252") == "ť"


def test_strength():
    assert M.completed("Ã", "utf-8>cp1252") and not M.completed("Ã©", "utf-8>cp1252")
    assert [M._strength(w, c) for w, c in (("Ð", "utf-8>cp1252"), ("Ã©", "utf-8>cp1252"), ("Ä0", "cp1252>mac_roman"), ("cafÈ", "cp1252>mac_roman"), ("\x800", "cp1252>latin-1"))] == [0, 2, 1, 2, 2]


def test_meant_signs_stay(spark):
    # A sign that a learned chain could undo to a word of the collection is no case by itself.
    rows = [(i, f"Case {i}: the signs Ð and ≈ are meant.") for i in range(60)] + [(100, "Где Р?"), (101, "le Š")]
    rows += [(200 + i, t) for i, t in enumerate(SENTENCES * 8)] + [(300, garble(SENTENCES[1], "utf-8>cp1252")), (301, garble(SENTENCES[2], "utf-8>mac_roman"))]
    repair = M.Repair(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS))
    assert {"utf-8>cp1252", "utf-8>mac_roman"} <= set(repair.learned)
    assert {r.doc_id for r in repair.found().collect()} == {300, 301}


def test_learned_where_all_variants_are_equally_common(spark):
    rows = [(1, SENTENCES[1]), (2, garble(SENTENCES[1], "utf-8>cp437")), (3, "Der Saal hat zwei Stühle für mich."), (4, garble(SENTENCES[1], "utf-8>cp1252"))]
    repair = M.Repair(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS))
    assert {r.doc_id for r in repair.found().collect()} == {2, 4}
    assert {r.restored for r in repair.restored().collect()} == {SENTENCES[1]}


def test_many_garbled_words(spark, collection, monkeypatch):
    docs, truth = collection
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    learned = M.Repair(df).learned
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(M, "MOST_SETS", 0)
    repair = M.Repair(df)
    assert repair.learned == learned
    assert {r.doc_id for r in repair.found().collect()} - {3000} == set(truth)


@pytest.fixture(scope="module")
def collection():
    rng = random.Random(7)
    clean = [" ".join(rng.choice(SENTENCES) for _ in range(4)) + f" Note {i}." for i in range(400)]
    docs, truth = [(i, t) for i, t in enumerate(clean)], {}
    for j in range(60):
        i, chain = rng.randrange(400), CHAINS[j % len(CHAINS)]
        bad = garble(clean[i], chain)
        if bad != clean[i]:
            docs.append((1000 + j, bad))
            truth[1000 + j] = clean[i]
    docs += [(3000, clean[0].replace("é", "�").replace("ñ", "�")), (3001, "NÃO PERCA: A MANHÃ DE SÃO. ½ cup, √304 ≈ 17, ★★☆, ÂGE."), (3002, None), (3003, ""), (3004, "plain"), (3005, "x" * 500_000 + " café")]
    return docs, truth


def test_found_and_restored(spark, collection):
    docs, truth = collection
    repair = M.Repair(spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS).repartition(5))
    assert set(CHAINS) - {"cp1252>mac_roman"} <= set(repair.learned)
    found = {r.doc_id for r in repair.found().collect()}
    lost = {3000} if "�" in dict(docs)[3000] else set()
    assert found - lost == set(truth)
    restored = {r.doc_id: r for r in repair.restored().collect()}
    assert set(restored) == found
    right = sum(restored[i].restored == t for i, t in truth.items())
    assert right >= 0.9 * len(truth)


def test_few_documents(spark):
    rows = [(1, "café"), (1, "café"), (2, None), (3, "a�b")]
    repair = M.Repair(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS))
    assert [r.doc_id for r in repair.found().collect()] == [3]
    assert M.Repair(spark.createDataFrame([], DOCS)).found().collect() == []


def test_passages_with_little_ascii(spark):
    clean = ["Слово стоит перед глаголом.", "Где находится старая библиотека?", "Πού είναι ο σταθμός;", "Η λέξη έχει 12 γράμματα.", "Привет, дорогой друг."]
    bad = {100: (0, "cp1251>cp866"), 101: (1, "utf-8>cp1251"), 102: (2, "cp1253>cp1252"), 103: (3, "utf-8>cp1252*2")}
    docs = [(i, clean[i % 5]) for i in range(60)] + [(i, garble(clean[k], chain)) for i, (k, chain) in bad.items()]
    # Garbled in one word, and with a lost character.
    docs += [(104, "Слово стоит " + garble("перед", "cp1251>cp866") + " глаголом."), (105, clean[4].replace("ж", "\ufffd").replace("г", "\ufffd"))]
    repair = M.Repair(spark.createDataFrame([(i, t, "") for i, t in docs], DOCS))
    assert {r.doc_id for r in repair.found().collect()} == {*bad, 104, 105}
    restored = {r.doc_id: r.restored for r in repair.restored().collect()}
    assert restored == {**{i: clean[k] for i, (k, _) in bad.items()}, 104: clean[0], 105: clean[4]}


def test_null_ids(spark):
    rows = [(None, "a\ufffd"), (None, "cafÃ© Zoë"), (5, "café Zoë"), (6, "ZoÃ« Zoë café")]
    repair = M.Repair(spark.createDataFrame([(i, t, "") for i, t in rows], DOCS))
    assert {r.doc_id for r in repair.found().collect()} == {None, 6}
    assert sorted(((r.doc_id, r.restored, r.n_lost) for r in repair.restored().collect()), key=repr) == [(6, "Zoë Zoë café", 0), (None, "a\ufffd", 1), (None, "café Zoë", 0)]
