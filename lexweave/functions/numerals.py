"""Numerals as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.kernels.numerals import MONTHS, ORDINALS, ROMAN


def _map(pairs: list[tuple]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(pairs)))


def ordinal_value(word: Column) -> Column:
    """1 to 100 of a Hungarian ordinal, whatever its case; null for other words."""
    return F.element_at(_map(sorted(ORDINALS.items())), F.lower(word))


def ordinal_word(n: Column) -> Column:
    """The Hungarian ordinal of 1 to 100; null for others."""
    return F.element_at(_map(sorted((v, k) for k, v in ORDINALS.items())), n.cast("int"))


def roman(n: Column) -> Column:
    """Roman numeral of a positive number; null for others."""
    parts, rest = [], n.cast("int")
    for value, sign in ROMAN:
        parts.append(F.repeat(F.lit(sign), F.floor(rest / value).cast("int")))
        rest = F.pmod(rest, F.lit(value))
    return F.when(n > 0, F.concat(*parts))


def roman_value(s: Column) -> Column:
    """Value of a Roman numeral, read greedily; null if other characters stand in it."""
    signs = sorted((x for _, x in ROMAN), key=lambda x: (-len(x), x))
    found = F.regexp_extract_all(s, F.lit("(" + "|".join(signs) + ")"), F.lit(1))
    values = _map([(x, v) for v, x in ROMAN])
    return F.when(s.rlike("^[MDCLXVI]+$"), F.aggregate(found, F.lit(0), lambda a, x: a + F.element_at(values, x)))


def roman_to_arabic(s: Column) -> Column:
    """XII/A to 12/A; null without a numeral at the start."""
    head = F.regexp_extract(s, "^([MDCLXVI]+)", 1)
    return F.concat(roman_value(head).cast("string"), F.substr(s, F.length(head) + 1))


def arabic_to_roman(s: Column) -> Column:
    """12/A to XII/A; null without a number at the start."""
    head = F.regexp_extract(s, "^([0-9]+)", 1)
    return F.concat(roman(head.try_cast("int")), F.substr(s, F.length(head) + 1))


def month_number(word: Column) -> Column:
    """1 to 12 of a Hungarian month; null for other words."""
    return F.element_at(_map([(m, i) for i, m in enumerate(MONTHS, 1)]), word)


def month_name(n: Column) -> Column:
    """The Hungarian name of a month."""
    return F.element_at(F.array(*map(F.lit, MONTHS)), n.cast("int"))
