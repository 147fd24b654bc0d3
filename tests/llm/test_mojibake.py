import random
import re
from collections import Counter

import pytest

from lexweave.llm.mojibake import MISPLACED, SIGNS, TELLING, USUAL, Chain, Model, code_page, fields_of, fit, fit_languages, foreign_dictionaries, misplaced, restore_fields, sample_values, sound, suspect, train, undo, unusual_pattern

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def values(spark):
    fields = fields_of(spark.read.parquet(f"{SF}/subpoints.parquet"))
    got = sorted(r.value for r in fields.where(sound(fields.value)).select("value").distinct().collect() if r.value)
    random.Random(1).shuffle(got)
    return got


@pytest.fixture(scope="module")
def model(values):
    return Model({"corpus": train(values[1000:])} | foreign_dictionaries())


def misread(text, written, read):
    return "".join(code_page(read)[b] for b in text.encode(written, "ignore"))


@pytest.mark.parametrize("written,read,least", [("utf_8", "cp1252", 0.99), ("utf_8", "cp1250", 0.99), ("utf_8", "mac_roman", 0.99), ("cp852", "cp1252", 0.85), ("cp852", "iso8859_1", 0.85), ("cp1250", "cp437", 0.93), ("cp1250", "cp852", 0.7), ("iso8859_2", "iso8859_1", 0.75)])
def test_round_trip_of_held_out_values(model, values, written, read, least):
    garbled = [(v, misread(v.replace("–", "-") if written == "iso8859_2" else v, written, read)) for v in values[:300]]
    garbled = [(v, g) for v, g in garbled if model.unusual.search(g)]
    found = [model.restore(g) for _, g in garbled]
    assert sum(n > 0 for _, n in found) >= 0.93 * len(garbled)
    assert sum(r.replace("–", "-") == v.replace("–", "-") for (v, _), (r, _) in zip(garbled, found)) >= least * len(garbled)


def test_garbled_twice(model, values):
    garbled = [(v, misread(misread(v, "utf_8", "cp1252"), "utf_8", "cp1252")) for v in values[:100] if not v.isascii()]
    assert sum(model.restore(g)[0] == v for v, g in garbled) >= 0.98 * len(garbled)


def test_foreign_words_and_signs_stay(model, values):
    rng = random.Random(2)
    odd = [w for w in [*SIGNS.split(), "façade", "ångström", "Škof", "São", "sõlm"] if model.unusual.search(w)]
    changed = 0
    for k in range(1500):
        words = values[k % 500].split(" ")
        words.insert(rng.randint(0, len(words)), odd[k % len(odd)])
        changed += model.restore(" ".join(words))[1] > 0
    assert changed <= 0.02 * 1500


def test_undo_keeps_what_cannot_come_from_it():
    assert undo("hÃ¡lózat", Chain("cp1252", "utf_8")) == "hálózat" and undo("Ã x", Chain("cp1252", "utf_8")) == "Ã x"


def test_defined_cases(spark, values):
    rows = [(1, None, None), (2, "", "az ángolna"), (3, "a hatÃ¡lyos tÃ¶rvÃ©ny szerint", "A rendelet szabÃ¡lyai"), (4, "t�rv�ny", None), (5, "a façade", None), (3, "a hatÃ¡lyos tÃ¶rvÃ©ny szerint", None), (6, "x" * 100_000 + " Ã©s továbbÃ¡", None)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "row_id bigint, text string, title string, value string")
    own = {"corpus": train(values)} | foreign_dictionaries()
    got = sorted((r.row_id, r.field_name, r.restored[-30:], r.lost) for r in restore_fields(fields_of(df), own).collect())
    whole = "a hatályos törvény szerint"
    assert got == [(3, "text", whole, False), (3, "text", whole, False), (3, "title", "A rendelet szabályai", False), (4, "text", "t�rv�ny", True), (6, "text", ("x" * 100_000 + " és továbbá")[-30:], False)]
    empty = fields_of(df.limit(0))
    assert restore_fields(empty, fit(empty)).count() == 0


@pytest.mark.parametrize("written,read", [("cp1250", "cp852"), ("iso8859_2", "cp852"), ("cp1250", "cp850")])
def test_garbled_into_usual_characters(model, values, written, read):
    garbled = [(v, g) for v in values[:1000] if (g := misread(v, written, read)) != v and not model.unusual.search(g)]
    found = [model.restore(g) for _, g in garbled]
    assert len(garbled) >= 10 and sum(n > 0 and r == v for (v, _), (r, n) in zip(garbled, found)) >= 0.9 * len(garbled)
    assert sum(model.restore(v)[1] > 0 for v in values[:1000]) <= 3


def test_usual_characters_reach_the_method(spark, values):
    rows = [(1, "a szÚkhelye, a törvény szerint"), (2, "a s”r forgalomban"), (3, "a szakasz erd§r törvény"), (4, "a 12. § (1) bekezdése szerint"), (5, "Útépítés és önkormányzat")]
    df = spark.createDataFrame([(*r, None) for r in rows], "row_id bigint, text string, title string")
    got = {r.row_id: r.restored for r in restore_fields(fields_of(df), {"corpus": train([*values, "székhelye, sör erdőr"])} | foreign_dictionaries()).collect()}
    assert got == {1: "a székhelye, a törvény szerint", 2: "a sör forgalomban", 3: "a szakasz erdőr törvény"}


def test_dictionary_of_distinct_whole_values(spark):
    rare = [f"sor{i}" for i in range(50)]
    df = spark.createDataFrame([("a törvény",)] * 400 + [(w,) for w in rare] + [("x " * 1500 + "végszó",), ("y " * 1500 + "Ã©",), (None,), ("",)], "value string")
    got = sorted(r.value for r in sample_values(df.select("value"), sample=100).collect())
    assert got == sorted([*rare, "a törvény", "x " * 1500 + "végszó"])
    words = fit(df, sample=60)["corpus"].decode().split()
    assert "végszó" in words and set(rare) <= set(words) and "Ã©" not in words
    few = {w for w in fit(df, sample=20)["corpus"].decode().split() if w.startswith("sor")}
    assert len(few) >= 15


@pytest.mark.parametrize("times", [3, 5, 6])
def test_garbled_many_times(model, times):
    whole = text = "a hatályos törvény szerinti kötelező közzététel"
    for _ in range(times):
        text = misread(text, "utf_8", "cp1252")
    assert model.restore(text)[0] == whole


@pytest.mark.parametrize("word", ["Škoda", "Noël", "100 €", "Dvořák", "Łódź", "naïve", "São Paulo", "ångström", "Straße", "Москва", "в соответствии с законом"])
def test_foreign_words_stay_and_come_back(model, word):
    whole = f"a {word} szerinti összeg megfizetése"
    assert model.restore(whole) == (whole, 0)
    for read in ("cp1252", "cp1250"):
        assert model.restore(misread(whole, "utf_8", read))[0] == whole


def test_unknown_foreign_words_stay(model):
    for word in ["Čermák", "Jørgstad", "Gonçalo", "Wałęsówna", "Žiniva", "Ñandú", "Иннокентий"]:
        whole = f"a {word} által fizetett összeg"
        assert model.restore(whole) == (whole, 0)


def test_cyrillic_text_read_as_western_is_not_made_another_wrong_one(model):
    whole = "статья закона Российской Федерации"
    assert model.restore(misread(whole, "cp1251", "cp1252"))[0] in (whole, misread(whole, "cp1251", "cp1252"))


def test_dictionaries_of_languages(spark):
    rows = [("de", "Die Gebührenordnung für Käufer Ã¼ber"), (" DE ", "Straßenverkehr"), ("fr", None), ("xx", "šum"), (None, "žal"), ("hu", "törvény")]
    got = fit_languages(spark.createDataFrame(rows, "lang string, text string"))
    assert {k: sorted(v.decode().split()) for k, v in got.items()} == {"de": ["Gebührenordnung", "Käufer", "Straßenverkehr", "für"]}
    assert fit_languages(spark.createDataFrame([], "lang string, text string")) == {}
    few = spark.createDataFrame([("de", f"wörter{i}") for i in range(40)] + [("de", "gleichförmig")] * 40, "lang string, text string")
    assert len(fit_languages(few, sample=10)["de"].decode().split()) == 10


def test_dictionary_counts_all_values(spark):
    df = spark.range(50_000).selectExpr("concat('w', id % 5000, '\\tv', id, ' ', if(id < 10, 'bő  \\n szó', 'szó'), ' ') AS value")
    df = df.union(spark.createDataFrame([("sor egész",)] * 3 + [("szÚk",), ("Ã©",), ("y" * 300_000,)], "value string"))
    values = {r.value for r in df.collect()} - {"szÚk", "Ã©"}
    counts = Counter(w for v in values for w in v.split())
    got = fit(df)["corpus"].decode()
    assert got.startswith(f" {' '.join(reversed(sorted(counts, key=lambda w: (-counts[w], w))))} ")
    # Of the values, those whose copies repeat most bytes come last.
    assert got.endswith(" sor egész ")


def test_dictionaries_of_languages_count_all_texts(spark):
    df = spark.range(700).selectExpr("'de' AS lang", "concat('wörter', id, '\\u00a0', if(id >= 600, 'größer', 'für'), ' Ãber') AS text")
    words = fit_languages(df)["de"].decode().split()
    assert set(words) == {"größer", "für", *(f"wörter{i}" for i in range(700))} and words[-2:] == ["größer", "für"]


def test_filters_in_spark_are_those_in_python(spark):
    rng = random.Random(3)
    chars = [*USUAL, *"aábBÉ1. .\n\t\r\x7f(", "\x85", "õ", "\U0001f600", "�"]
    rows = [("".join(rng.choices(chars, k=rng.randint(0, 5))),) for _ in range(20_000)]
    df = spark.createDataFrame(rows, "value string")
    unusual = re.compile(unusual_pattern())
    for r in df.select("value", sound(df.value).alias("s"), suspect(df.value).alias("t"), misplaced(df.value).alias("m")).distinct().collect():
        assert (r.s, r.t, r.m) == (not unusual.search(r.value), bool(re.search(f"[{TELLING}]", r.value) or unusual.search(r.value)), bool(re.search(MISPLACED, r.value))), repr(r.value)
