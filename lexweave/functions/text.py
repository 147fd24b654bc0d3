"""Text of lines as Column expressions: quotes, joins, list ends, parts of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is cut from the end of a list item, each once and in this order.
LIST_ENDS = (" és", " valamint", " illetve", " vagy", ";", ",")


def quote_change(s: Column) -> Column:
    """Quotes opened less quotes closed."""
    return F.regexp_count(s, F.lit("[„“]")) - F.regexp_count(s, F.lit("”"))


def join_lines(lines: Column) -> Column:
    """An array of lines as running text: a space between them, none after a hyphen; nulls and empty lines left out."""
    kept = F.filter(lines, lambda x: x.isNotNull() & (x != ""))
    return F.aggregate(kept, F.lit(""), lambda a, x: F.when((a == "") | a.endswith("-"), F.concat(a, x)).otherwise(F.concat(a, F.lit(" "), x)))


def fix_list_end(s: Column, end_sentence: bool = True) -> Column:
    """A list item as a sentence: conjunctions and separators cut from its end, a full stop added if it has no end mark."""
    for junk in LIST_ENDS:
        s = F.regexp_replace(s, re.escape(junk).replace("\\ ", " ") + "$", "")
    return F.when(s.rlike("[.:!?]$"), s).otherwise(F.concat(s, F.lit("."))) if end_sentence else s


def unquote(s: Column) -> Column:
    """A quote without its outer marks and blanks."""
    return F.regexp_replace(F.regexp_replace(s, "^„|”$", ""), r"^\s+|\s+$", "")


def is_upper(s: Column) -> Column:
    """Only Hungarian capitals; true for the empty string."""
    return s.rlike("^[A-ZÉÁŐÚŰÖÜÓÍ]*$")


def line_content(parts: Column) -> Column:
    """The text of a line's parts."""
    return F.array_join(F.transform(parts, lambda p: p["content"]), "")


def line_indent(parts: Column) -> Column:
    """Where the first part begins, 0 without parts."""
    return F.coalesce(F.get(parts, 0)["dx"], F.lit(0.0))


def line_bold(parts: Column) -> Column:
    """Are more than half of a line's characters bold?"""
    chars = lambda bold: F.aggregate(parts, F.lit(0), lambda a, p: a + F.when(p["bold"] | F.lit(not bold), F.length(p["content"])).otherwise(F.lit(0)))
    return chars(True) * 2 > chars(False)


def split_amendment_intro(intro: Column) -> tuple[Column, Column]:
    """The intro of a block amendment up to its colon, and the bracketed context that fills the rest; null if it has none."""
    # Of several colons with a bracket behind them the last one begins the context.
    tail = F.regexp_extract(intro, r"(?<=:) ?[(\[](?:[^:]|:(?! ?[(\[]))*[)\]]$", 0)
    inside = F.trim(tail)
    has = F.length(tail) > 0
    return F.when(has, F.left(intro, F.length(intro) - F.length(tail))).otherwise(intro), F.when(has, F.substr(inside, F.lit(2), F.length(inside) - 2))


def fix_glyphs(s: Column) -> Column:
    """Letters that the gazettes' fonts encode wrongly."""
    return F.translate(s, "ÕõÛû", "ŐőŰű")


def is_bold_font(font: Column) -> Column:
    return font.rlike("[bB]old")


def latin2_char(number: Column) -> Column:
    """The character of a byte in ISO-8859-2; null for numbers that are no byte."""
    page = F.array(*(F.lit(bytes([b]).decode("iso8859_2")) for b in range(256)))
    return F.when(number.between(0, 255), F.get(page, number.cast("int")))


def fix_glyph_case(drawn: Column, code: Column) -> Column:
    """The letter of a glyph's code in Latin-2 where the drawn one differs from it only by case; else the drawn one."""
    coded = latin2_char(code)
    return F.when((F.upper(drawn) == F.upper(coded)) & (drawn != coded), coded).otherwise(drawn)


_PART = "array<struct<dx:double,content:string,bold:boolean>>"


def _placed(parts: Column) -> Column:
    """Parts with the position of their first character and where they begin on the page."""
    kind = "struct<at:int,x:double,out:array<struct<at:int,x:double,content:string,bold:boolean>>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0.0).alias("x"), F.array().cast("array<struct<at:int,x:double,content:string,bold:boolean>>").alias("out")).cast(kind)
    step = lambda a, p: F.struct((a["at"] + F.length(p["content"])).alias("at"), (a["x"] + p["dx"]).alias("x"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), (a["x"] + p["dx"]).alias("x"), p["content"].alias("content"), p["bold"].alias("bold")))).alias("out")).cast(kind)
    return F.aggregate(parts, zero, step)["out"]


def _rebased(placed: Column) -> Column:
    """Placed parts as parts again, each by its distance from the one before."""
    return F.transform(placed, lambda p, i: F.struct((p["x"] - F.when(i > 0, F.get(placed, i - 1)["x"]).otherwise(F.lit(0.0))).alias("dx"), p["content"].alias("content"), p["bold"].alias("bold"))).cast(_PART)


def slice_line(parts: Column, start: int, end: int | None = None) -> Column:
    """The parts between two character positions, which may count from the end, at the places where they stood; null if a position falls
    inside a part of several characters."""
    n = F.length(line_content(parts))
    lo = F.lit(start) if start >= 0 else F.greatest(F.lit(0), n + start)
    hi = n if end is None else F.least(n, F.lit(end)) if end >= 0 else n + end
    inside = lambda p, c: (p["at"] < c) & (p["at"] + F.length(p["content"]) > c)
    placed = _placed(parts)
    kept = F.filter(placed, lambda p: (p["at"] >= lo) & (p["at"] < hi))
    return F.when(~F.exists(placed, lambda p: inside(p, lo) | inside(p, hi)), _rebased(kept))


def concat_lines(lines: Column) -> Column:
    """An array of lines' parts as one line; every part stays where it stood, and bold."""
    return _rebased(F.flatten(F.transform(lines, _placed)))


def count_sublists(haystack: Column, needle: Column) -> Column:
    """How often an array stands in another; the last place where it could is not tested."""
    starts = F.greatest(F.size(haystack) - F.size(needle), F.lit(0))
    at = F.when(starts > 0, F.sequence(F.lit(1), starts)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0), lambda a, i: a + F.when(F.slice(haystack, i, F.size(needle)) == needle, 1).otherwise(0))


def split_list(haystack: Column, needle: Column) -> Column:
    """The stretches of an array between the elements equal to needle."""
    zero = F.array(F.array().cast("array<string>"))
    last = lambda a: F.element_at(a, -1)
    return F.aggregate(haystack, zero, lambda a, x: F.when(x == needle, F.concat(a, zero)).otherwise(F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.concat(last(a), F.array(x))))))
