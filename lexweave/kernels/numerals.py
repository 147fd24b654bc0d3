"""Hungarian and Roman numerals and month names, free of Spark."""

from __future__ import annotations

import re

#: Names of the parts of Hungarian ordinals.
ONES = ("első", "második", "harmadik", "negyedik", "ötödik", "hatodik", "hetedik", "nyolcadik", "kilencedik")
ONES_IN_COMPOUNDS = ("egyedik", "kettedik", "harmadik", "negyedik", "ötödik", "hatodik", "hetedik", "nyolcadik", "kilencedik")
TENS = ("tizedik", "huszadik", "harmincadik", "negyvenedik", "ötvenedik", "hatvanadik", "hetvenedik", "nyolcvanadik", "kilencvenedik")
TENS_IN_COMPOUNDS = ("tizen", "huszon", "harminc", "negyven", "ötven", "hatvan", "hetven", "nyolcvan", "kilencven")
HUNDRED = "századik"
#: Months.
MONTHS = ("január", "február", "március", "április", "május", "június", "július", "augusztus", "szeptember", "október", "november", "december")
#: Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def ordinals() -> dict[str, int]:
    """Ordinal words from 1 to 100, made by rule."""
    out = {w: i for i, w in enumerate(ONES, 1)} | {w: 10 * i for i, w in enumerate(TENS, 1)} | {HUNDRED: 100}
    for t, head in enumerate(TENS_IN_COMPOUNDS, 1):
        out |= {head + w: 10 * t + i for i, w in enumerate(ONES_IN_COMPOUNDS, 1)}
    return out


ORDINALS = ordinals()
ORDINAL_WORDS = {v: k for k, v in ORDINALS.items()}
_ROMAN_VALUES = {s: v for v, s in ROMAN}
_ROMAN_PARTS = re.compile("|".join(sorted(_ROMAN_VALUES, key=lambda s: (-len(s), s))))


def to_roman(n: int) -> str:
    """Roman numeral of a positive number."""
    out = ""
    for value, sign in ROMAN:
        times, n = divmod(n, value)
        out += sign * times
    return out


def from_roman(s: str) -> int:
    """Value of a Roman numeral, read greedily and without validation."""
    if not re.fullmatch("[MDCLXVI]+", s):
        raise ValueError(s)
    return sum(_ROMAN_VALUES[x] for x in _ROMAN_PARTS.findall(s))


def roman_to_arabic(s: str) -> str:
    """XII/A to 12/A."""
    m = re.match("[MDCLXVI]+", s)
    if not m:
        raise ValueError(s)
    return f"{from_roman(m[0])}{s[m.end():]}"


def ordinal(s: str) -> int:
    """Value of an ordinal word, whatever its case."""
    if s.lower() not in ORDINALS:
        raise ValueError(s)
    return ORDINALS[s.lower()]


def month(s: str) -> int:
    """Number of a month."""
    return MONTHS.index(s) + 1
