"""One consistent form for text that looks the same but is written with other characters.

1. Fold what can't be seen or is only drawn differently: invisible characters go, every kind of blank becomes a single space, full- and
   half-width forms, ligatures, digraph letters and number forms are spelled out, hyphens of equal length become the hyphen-minus.
   Accents are taken apart, so a look-alike letter with an accent is recognised by its base.
2. Resolve scripts word by word: intersect the sets of scripts that its letters can be spelled in. What is left is the word's resolved
   set. If it is one script, the word is spelled in it; if several, in that of the nearest word that leaves no choice (the one before, if
   two are as near), and without such a word in the first of PREFERENCE; if none, each letter goes to its first look-alike. The sets are
   those of the letters' shapes, so texts that look alike resolve alike. A word whose letters stand in several scripts is mixed; one
   that stands in a single script but is spelled in another is a whole-script look-alike.
3. Compose the accents again.

Letter case, accents, raised digits, punctuation and the length of dashes are kept.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import cut_lineage

#: Scripts told apart, in order of preference for words that several can spell.
PREFERENCE = ("Latin", "Cyrillic", "Greek", "Armenian", "Coptic", "Cherokee", "Lisu")
#: Letters without accents that are drawn alike in the scripts above, or twice in one of them.
LOOK_ALIKES = """
A А Α Ꭺ ꓮ
B В Β Ᏼ ꓐ Ⲃ
C С Ϲ Ꮯ ꓚ Ⲥ
D Ꭰ ꓓ
E Е Ε Ꭼ ꓰ Ⲉ
F Ϝ ꓝ
G Ԍ Ꮐ ꓖ
H Н Η Ꮋ ꓧ Ⲏ
I І Ӏ Ι Ⲓ ꓲ
J Ј Ϳ Ꭻ ꓙ
K К Κ Ꮶ ꓗ Ⲕ
L Ꮮ ꓡ
M М Μ Ꮇ ꓟ Ⲙ
N Ν ꓠ Ⲛ
O О Ο Օ ꓳ Ⲟ
P Р Ρ Ꮲ ꓑ Ⲣ
Q Ԛ
R Ꮢ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Т Τ Ꭲ ꓔ Ⲧ
U Ս ꓴ
V Ѵ Ꮩ ꓦ
W Ԝ Ꮃ ꓪ
X Х Χ ꓫ Ⲭ
Y У Ү Υ Ꭹ ꓬ Ⲩ
Z Ζ Ꮓ ꓜ
a а ɑ α
c с ϲ ⲥ
d ԁ
e е
g ց ɡ
h һ հ
i і ι
j ј ϳ
l ӏ
n ո
o о ο օ ⲟ
p р ρ ⲣ
q ԛ զ
s ѕ
u ս ʋ υ
v ѵ ν
w ԝ ա
x х
y у ү
ƙ κ
ʜ н
ʙ в
ᴍ м
ᴛ т
ᴋ к
Г Γ Ⲅ
П Π Ⲡ
Ф Φ Ⲫ
Λ Л Ⲗ
Δ Ⲇ
"""
#: Signs drawn like an ASCII one.
SIGNS = {"∕": "/", "⁄": "/", "∖": "\\", "∣": "|", "ǀ": "|", "；": ";", ";": ";", "․": ".", "‚": ",", "ʹ": "'", "ʼ": "'", "˸": ":", "։": ":", "∶": ":", "˜": "~", "∼": "~"}
#: Characters that are seen as nothing though Unicode doesn't class them as format characters, and the hyphens of the
#: length of a hyphen-minus.
UNSEEN = "͏ᅟᅠㅤﾠ឴឵᠋᠌᠍᠏"
HYPHENS = "‐‑﹣－"
#: Kinds of compatibility decomposition in which only the width (or, as "<font>", the type face) differs, and the blocks in which <compat> ones look like their parts.
_WIDTH = {"<wide>", "<narrow>", "<noBreak>", "<small>"}
_SPELLED_OUT = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06))


@functools.lru_cache(maxsize=100_000)
def own_scripts(ch: str) -> frozenset[str]:
    """The scripts of PREFERENCE that use a letter, by its script extensions; "Other" for letters of further ones; empty for what occurs
    in all (digits, signs, accents)."""
    if not ch.isalpha() or regex.match(r"[\p{Script_Extensions=Common}\p{Script_Extensions=Inherited}]", ch):
        return frozenset()
    return frozenset(s for s in PREFERENCE if regex.match(rf"\p{{Script_Extensions={s}}}", ch)) or frozenset({"Other"})


def script(ch: str) -> str:
    """The first of own_scripts(), or nothing."""
    found = own_scripts(ch)
    return next((s for s in (*PREFERENCE, "Other") if s in found), "")


def _spellings() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {}
    for line in LOOK_ALIKES.split("\n"):
        letters = line.split()
        own = {}
        for c in letters:
            own.setdefault(script(c), c)
        out |= {c: own for c in letters}
    return out


class _Fold(dict):
    """Folded form of a character, made by rule when first met."""

    def __missing__(self, code: int) -> str:
        self[code] = out = self._rule(chr(code))
        return out

    def _rule(self, c: str) -> str:
        category = unicodedata.category(c)
        if c.isspace() or category == "Zs" or c == "⠀":
            return " "
        if category in ("Cf", "Cc") or c in UNSEEN or "︀" <= c <= "️" or 0xE0100 <= ord(c) <= 0xE01EF:
            return ""
        if c in HYPHENS:
            return "-"
        if c in SIGNS:
            return SIGNS[c]
        kind, _, rest = unicodedata.decomposition(c).rpartition("> ")
        if not rest:
            return c
        if not kind:
            return unicodedata.normalize("NFD", c).translate(self) if len(unicodedata.normalize("NFD", c)) > 1 or unicodedata.normalize("NFD", c) != c else c
        if kind == "<font" or kind + ">" in _WIDTH or (kind == "<compat" and any(a <= ord(c) <= b for a, b in _SPELLED_OUT)):
            return "".join(chr(int(x, 16)) for x in rest.split()).translate(self)
        return c


_FOLD = _Fold()
_SPELL = _spellings()
_PLAIN = re.compile(r"(?:[!-~áéíóöőúüűÁÉÍÓÖŐÚÜŰ§–„”]+(?: (?! |$)|$))*")
#: Letters that are of another script than Latin, or have another spelling within it.
_CHANGED = regex.compile(r"(?V1)[[\p{L}--\p{Script=Latin}]" + "".join(c for c, own in _SPELL.items() if own.get("Latin", c) != c) + "]")
_WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ҃-҇])*")


@functools.lru_cache(maxsize=100_000)
def scripts(ch: str) -> frozenset[str]:
    """The scripts that a letter can be spelled in: its own and those of its look-alikes."""
    return own_scripts(ch) | frozenset(_SPELL.get(ch, ()))


#: What a word or text turns out to be, the worst last.
DETECTED = ("none", "whole-script", "mixed")


class Word(NamedTuple):
    """What a word's letters (accents apart) say: the scripts they stand in, empty if mixed, and those they all can be spelled in."""

    stood: frozenset[str]
    resolved: frozenset[str]
    letters: frozenset[str]


@functools.lru_cache(maxsize=100_000)
def resolved_sets(word: str) -> Word:
    """Intersections over the letters of a word."""
    letters = [c for c in word if own_scripts(c)]
    every = frozenset((*PREFERENCE, "Other"))
    return Word(every.intersection(*map(own_scripts, letters)), frozenset(PREFERENCE).intersection(*map(scripts, letters)), frozenset().union(*map(own_scripts, letters)))


def examine(word: str, near: str | None = None) -> tuple[str, frozenset[str], str]:
    """The word (accents apart) in one script, the script set of its letters as they stood (empty if mixed), and which of DETECTED it is.
    near: the script of the nearest word that leaves no choice."""
    found = resolved_sets(word)
    target = near if near in found.resolved else next((s for s in PREFERENCE if s in found.resolved), None)
    if target:
        spelled = "".join(_SPELL[c][target] if target in _SPELL.get(c, ()) else c for c in word)
    else:
        first = lambda c: next((_SPELL[c][s] for s in PREFERENCE if s in _SPELL[c]), c) if c in _SPELL else c
        spelled = "".join(map(first, word))
    if not found.stood and found.letters:
        return spelled, found.stood, "mixed"
    return spelled, found.stood, "whole-script" if target and found.letters and target not in found.stood else "none"


def resolve(word: str) -> tuple[str, frozenset[str]]:
    """The word (accents apart) in one script, and the script set of its letters as they stood: empty if mixed."""
    return examine(word)[:2]


def nearest_scripts(words: list[str]) -> list[str | None]:
    """For each word, the script of the nearest one whose resolved set is a single script; of two as near, the one before."""
    sure = [next(iter(r)) if len(r := resolved_sets(w).resolved) == 1 else None for w in words]
    out, last = [], None
    for i, s in enumerate(sure):
        last = i if s else last
        out.append(last)
    following = None
    for i in range(len(words) - 1, -1, -1):
        following = i if sure[i] else following
        if following is not None and (out[i] is None or following - i < i - out[i]):
            out[i] = following
    return [None if i is None else sure[i] for i in out]


def consistent_and_detected(text: str | None) -> tuple[str | None, str | None]:
    """The one form of all texts that look like this one, and the worst of DETECTED among its words; nulls of null."""
    if text is None:
        return None, None
    if _PLAIN.fullmatch(text):
        return text, DETECTED[0]
    folded, worst = text.translate(_FOLD), 0
    if _CHANGED.search(folded):
        near = iter(nearest_scripts(_WORDS.findall(folded)))

        def word(m: re.Match) -> str:
            nonlocal worst
            spelled, _, detected = examine(m[0], next(near))
            worst = max(worst, DETECTED.index(detected))
            return spelled

        folded = _WORDS.sub(word, folded)
    return unicodedata.normalize("NFC", " ".join(folded.split(" ")) if "  " not in folded else re.sub(" {2,}", " ", folded)).strip(" "), DETECTED[worst]


def consistent(text: str | None) -> str | None:
    """The one form of all texts that look like this one."""
    return consistent_and_detected(text)[0]


def consistent_column(text: Column) -> Column:
    """Arrow UDF of consistent()."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([consistent(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def detected_column(text: Column) -> Column:
    """Arrow UDF of consistent_and_detected(): a struct of form and detected."""

    @F.arrow_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("detected", T.StringType())]))
    def run(texts: pa.Array) -> pa.Array:
        found = [consistent_and_detected(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["form", "detected"])

    return run(text)


def body(df: DataFrame) -> DataFrame:
    """row_id and body of element rows: text, or intro if text is null; rows without either are left out."""
    return df.select(F.col("row_id").cast("bigint").alias("row_id"), F.coalesce(F.col("text").cast("string"), F.col("intro").cast("string")).alias("body")).where(F.col("body").isNotNull())


def consistent_bodies(df: DataFrame) -> DataFrame:
    """row_id, body, its consistent form, and whether words of it mix scripts or are whole-script look-alikes (`DETECTED`)."""
    return body(df).withColumn("_found", detected_column(F.col("body"))).select("row_id", "body", "_found.form", "_found.detected")


def _keys(name: str, value: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes that stand for a text."""
    return F.xxhash64(value).alias(f"{name}1"), F.xxhash64(F.lit("other"), F.reverse(value)).alias(f"{name}2")


def _rows(df: DataFrame) -> DataFrame:
    """row_id and the hashes of body (b1, b2) and form (f1, f2), written: no text is written or shuffled."""
    formed = body(df).withColumn("form", consistent_column(F.col("body")))
    return cut_lineage(formed.select("row_id", *_keys("b", F.col("body")), *_keys("f", F.col("form"))))


def _varied(rows: DataFrame) -> DataFrame:
    """The forms that more than one spelling has: f1, f2 and n_rows, n_spellings."""
    spellings = rows.groupBy("f1", "f2", "b1", "b2").agg(F.count("*").alias("n"))
    return spellings.groupBy("f1", "f2").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_spellings")).where("n_spellings > 1")


def equal_looking_classes(df: DataFrame) -> DataFrame:
    """(row_id, class_id, spelling_id, n_rows, n_spellings) of the rows whose bodies have an equal-looking one in another spelling. Rows of
    one class look the same; those of one spelling_id in it are the same string.

    The defined cases are those of equal_looking_pairs().
    """
    return _classes(_rows(df))


def _classes(rows: DataFrame) -> DataFrame:
    name = lambda a, b: F.concat(F.lower(F.hex(a)), F.lit("-"), F.lower(F.hex(b)))
    return rows.join(_varied(rows), ["f1", "f2"]).select("row_id", name("f1", "f2").alias("class_id"), name("b1", "b2").alias("spelling_id"), "n_rows", "n_spellings")


def equal_looking_pairs(df: DataFrame) -> DataFrame:
    """(row_id_a, row_id_b), row_id_a < row_id_b, of rows whose bodies look the same but aren't the same string.

    Made of equal_looking_classes(): pairs are formed between the spellings of a class, and each spelling then stands for its rows. So a
    body that a third of all rows share costs no more than the pairs it is part of.

    Defined cases: null bodies pair with none; an empty body and one of nothing visible look the same; equal strings are no pair;
    repeated rows are rows like any other; extra columns are not read; an empty table gives no pair.
    """
    rows = cut_lineage(_classes(_rows(df)).select("row_id", "class_id", "spelling_id"))
    spellings = rows.select("class_id", "spelling_id").distinct()
    a, b = spellings.withColumnRenamed("spelling_id", "spelling_a"), spellings.withColumnRenamed("spelling_id", "spelling_b")
    both = a.join(b, "class_id").where("spelling_a < spelling_b")
    left, right = (rows.select("class_id", F.col("spelling_id").alias(f"spelling_{x}"), F.col("row_id").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    pairs = both.join(left, ["class_id", "spelling_a"]).join(right, ["class_id", "spelling_b"])
    return pairs.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b")).where("row_id_a < row_id_b")
