"""Packed cells, against a reader that takes one character at a time."""

import brute

from vecloom.operators import packed as P

FIELDS = "src_name string, row_id bigint, field_name string, cell string"
TAGS = "['NOUN', 'VERB', 'ADJ', 'DET', 'PUNCT']"
CELLS = [
    "NOUN;VERB", "NOUN; VERB; ADJ", "NOUN|VERB|", "|NOUN|VERB", "NOUN||VERB", "NOUN | VERB |  | ADJ", '"NOUN"\t"VERB"', "'NOUN' 'VERB'", "['NOUN' 'VERB']", "{NOUN}", '{"NOUN","VERB"}', "(NOUN, VERB)", "[ 1  2 -3]",
    "NOUN VERB, ADJ / DET;PUNCT", "  NOUN/VERB ", "NOUN", 'x|"a|b"|""""|\',\'', "\"n't\" VERB", "NOUN  VERB  ADJ", "NOUN\n", "unknown1 unknown2",
]


def _expected(rows):
    out = []
    for src, row, field, cell in rows:
        if cell is None or not cell.strip() or brute.list_elements(cell) is not None:
            continue
        out += [(src, row, field, i, v) for i, v in enumerate(brute.slots(cell), 1) if v]
    return sorted(out, key=repr)


def test_cells_as_the_character_reader(spark):
    rows = [("s", i, "pos", c) for i, c in enumerate(CELLS)] + [("s", 100 + i, "pos", TAGS) for i in range(30)] + [("s", 200, "pos", None), ("s", 201, "pos", " "), ("s", 202, "pos", "[]")]
    got = [tuple(r) for r in P.unpack(spark.createDataFrame(rows, FIELDS)).collect()]
    assert sorted(got, key=repr) == _expected(rows)


def test_repeated_rows_and_null_ids_are_kept(spark):
    rows = [("s", 1, "pos", "NOUN;VERB")] * 3 + [("s", None, "pos", "a,b")]
    got = [tuple(r) for r in P.unpack(spark.createDataFrame(rows, FIELDS)).collect()]
    assert sorted(got, key=repr) == _expected(rows)


def test_the_cheaper_dialect_wins_by_the_value_frequencies():
    dialects = {d: v for d, v, _ in P.parses("The, window|!")}
    assert dialects["|"] == ["The, window", "!"] and dialects[",|"] == ["The", "window", "!"]


def test_malformed_cells_have_a_parse(spark):
    rows = [("s", i, "pos", c) for i, c in enumerate(["don't x", "a;'b", "[a;b", "\x00;\x01'"])]
    got = P.unpack(spark.createDataFrame(rows, FIELDS)).collect()
    assert {r.row_id for r in got} == {0, 1, 2, 3}


def test_empty_table(spark):
    assert P.unpack(spark.createDataFrame([], FIELDS)).collect() == []


def test_very_long_cell(spark):
    rows = [("s", 1, "pos", "NOUN;" * 50_000 + "VERB"), ("s", 2, "pos", TAGS)]
    got = P.unpack(spark.createDataFrame(rows, FIELDS))
    assert got.count() == 50_001 and got.where("item = 'VERB'").first().item_no == 50_001
