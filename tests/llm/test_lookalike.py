import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.lookalike import consistent, consistent_bodies, equal_looking_classes, equal_looking_pairs, nearest_scripts, own_scripts, resolve

ALIKE = [
    ("törvény", "törvény"), ("törvény", "tӧrvе́ny"), ("őz", "о̋z"), ("a b", "​a b﻿ "), ("víz", "vίz"), ("ﬁzet", "fizet"), ("zároǉa", "zárolja"), ("XII.", "Ⅻ."), ("ＸＩＩ", "ΧΙΙ"),
    ("Ａ　ｋúｔ", "A kút"), ("tó‑mű", "tó-mű"), ("tó－mű", "tó‐mű"), ("rakoma⁠́ny", "rakomány"), ("а", "a"), ("soft­hyphen", "softhyphen"), ("ſt", "ﬅ"), ("", "‍"), ("мир", "миp"), ("a\tb", "a  b"),
]
UNLIKE = [("ü", "ű"), ("a", "A"), ("48", "⁴8"), ("²48", "248"), ("a-b", "a–b"), ("a–b", "a—b"), ("a.", "a"), ("o", "0"), ("l", "I"), ("l", "1"), ("i", "í"), ("ab", "a b"), ("н", "h"), ("в", "b"), ("№", "No")]


@pytest.mark.parametrize("a,b", ALIKE)
def test_alike(a, b):
    assert consistent(a) == consistent(b)


@pytest.mark.parametrize("a,b", UNLIKE)
def test_unlike(a, b):
    assert consistent(a) != consistent(b)


def test_scripts_of_a_word():
    assert resolve("pаy") == ("pay", frozenset()) and resolve("сор") == ("cop", frozenset({"Cyrillic"})) and resolve("миp")[0] == "мир" and resolve("жΛo")[1] == frozenset()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=30))
def test_form_is_stable_and_normal(text):
    form = consistent(text)
    assert consistent(form) == form and unicodedata.is_normalized("NFC", form)


def test_defined_cases(spark):
    rows = [(1, "a b", None), (2, "a b", None), (3, "а b", None), (4, None, "a b "), (5, None, None), (6, "", None), (7, "​", "x"), (8, "A b", None)]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "row_id bigint, text string, intro string, form string, n int")
    assert sorted(map(tuple, equal_looking_pairs(df).collect())) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (6, 7)]
    assert equal_looking_pairs(df.limit(0)).count() == 0
    classes = [tuple(r)[:1] + tuple(r)[3:] for r in equal_looking_classes(df).collect()]
    assert sorted(classes) == [(1, 4, 3), (2, 4, 3), (3, 4, 3), (4, 4, 3), (6, 2, 2), (7, 2, 2)] and equal_looking_classes(df.limit(0)).count() == 0


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/dashes.parquet")
    bodies = [(r.row_id, r.text if r.text is not None else r.intro) for r in df.collect()]
    by = {}
    for i, b in bodies:
        if b is not None:
            by.setdefault(consistent(b), []).append((i, b))
    want = {(min(i, j), max(i, j)) for g in by.values() for i, a in g for j, b in g if i != j and a != b}
    got = [tuple(r) for r in equal_looking_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want) > 0


def test_detection_of_mixed_and_whole_scripts(spark):
    rows = {1: "törvény", 2: "a pаy", 3: "a сор x", 4: "мир", 5: "сор жΛo", 6: "aא", 7: "שלום  a", 8: "", 9: "őz  ﬁ"}
    df = spark.createDataFrame([(k, v, None) for k, v in rows.items()], "row_id bigint, text string, intro string")
    got = {r.row_id: (r.form, r.detected) for r in consistent_bodies(df).collect()}
    assert {k: d for k, (_, d) in got.items()} == {1: "none", 2: "mixed", 3: "whole-script", 4: "none", 5: "mixed", 6: "mixed", 7: "none", 8: "none", 9: "none"}
    assert all(f == consistent(rows[k]) for k, (f, _) in got.items()) and got[3][0] == "a cop x"


@pytest.mark.parametrize("a,b", [("ᎪᏴ", "AB"), ("ꓮꓐ", "AB"), ("օհ", "oh"), ("ɑlma", "alma"), ("𝐀dó", "Adó"), ("ʜ", "н"), ("1∕2", "1/2"), ("1⁄2", "1/2"), ("Ⲥор", "Сор"), ("ցս", "gu")])
def test_further_scripts_and_signs(a, b):
    assert consistent(a) == consistent(b)


def test_script_extensions():
    assert own_scripts("a") == {"Latin"} and own_scripts("1") == frozenset() and own_scripts("א") == {"Other"} and own_scripts("ー") == {"Other"}


def test_neighbours_decide():
    russian = "мир и сор в лесу, а рак сух"
    assert consistent(russian) == russian
    assert consistent("мир и cop") == "мир и сор" and consistent("a sor és a сор") == "a sor és a cop"
    assert nearest_scripts(["cop", "мир", "cop", "cop", "sor", "cop"]) == ["Cyrillic", "Cyrillic", "Cyrillic", "Latin", "Latin", "Latin"]
    assert nearest_scripts(["cop", "х"]) == [None, None]
