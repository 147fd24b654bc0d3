"""Identifiers as Column expressions: natural order, succession, id strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.kernels.identifiers import STEPS


def natural_key(identifier: Column) -> Column:
    """array<struct<s,n>> that orders identifiers so that 1/A < 2 < 2a < 10 < a; null stays null.

    A run of digits is (empty, number), a run of others (text, -1); arrays of structs compare element by element.
    """
    runs = F.regexp_extract_all(identifier, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    digits = lambda x: x.rlike("^[0-9]+$")
    return F.transform(runs, lambda x: F.struct(F.when(digits(x), F.lit("")).otherwise(x).alias("s"), F.when(digits(x), x.cast("bigint")).otherwise(F.lit(-1)).alias("n")))


def next_letter(a: Column, b: Column) -> Column:
    """Does letter b follow a in the Hungarian alphabet or by code point?"""
    steps = F.array(*(F.lit(f"{x}>{y}") for x, y in sorted(STEPS)))
    plain = (F.length(a) == 1) & (F.length(b) == 1) & (F.ascii(b) == F.ascii(a) + 1)
    return F.array_contains(steps, F.concat(a, F.lit(">"), b)) | plain


def next_number(a: Column, b: Column) -> Column:
    """Does b follow a: 1, 2; 1, 1a; 1a, 1b; 1a, 2? A slash before the letter doesn't count."""
    part = lambda c, i: F.regexp_extract(c, r"^([0-9]+)/?([a-zA-Z]*)$", i)
    na, nb = part(a, 1).try_cast("bigint"), part(b, 1).try_cast("bigint")
    la, lb = part(a, 2), part(b, 2)
    letter = F.when(la == "", lb.isin("a", "A")).otherwise(next_letter(la, lb))
    return F.coalesce(F.when(nb == na + 1, lb == "").when(nb == na, letter), F.lit(False))


def next_article(a: Column, b: Column) -> Column:
    """Succession of article identifiers, which may have a book before a colon; a new book begins with 1."""
    book = lambda c: F.regexp_extract(c, r"^([0-9]+):", 1)
    rest = lambda c: F.regexp_replace(c, r"^[0-9]+:", "")
    new_book = (book(b).try_cast("int") == book(a).try_cast("int") + 1) & (rest(b) == "1")
    return F.when(book(a) == book(b), next_number(rest(a), rest(b))).otherwise(F.coalesce(new_book, F.lit(False)))


def next_identifier(kind: Column, a: Column, b: Column) -> Column:
    """Does b follow a among siblings of the kind?"""
    prefixed = (F.length(a) > 1) & (F.length(b) > 1)
    sub = F.when(prefixed, (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & next_letter(F.substr(a, F.lit(2)), F.substr(b, F.lit(2)))).otherwise(next_letter(a, b))
    return F.when(kind == "Article", next_article(a, b)).when(kind == "AlphabeticPoint", next_letter(a, b)).when(kind == "AlphabeticSubpoint", sub).otherwise(next_number(a, b))


def header_prefix(kind: Column, identifier: Column) -> Column:
    """How an element's identifier is printed: `(1) `, `1. `, `a) `; empty without one."""
    marked = F.when(kind == "Paragraph", F.concat(F.lit("("), identifier, F.lit(") "))).when(kind.isin("NumericPoint", "NumericSubpoint"), F.concat(identifier, F.lit(". "))).when(kind.isin("AlphabeticPoint", "AlphabeticSubpoint"), F.concat(identifier, F.lit(") "))).when(kind == "Article", F.concat(identifier, F.lit(". §")))
    return F.coalesce(marked, F.lit(""))
