"""Dates as Column expressions. A text that is no date, or names none of the calendar, gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexweave.functions.numerals import month_number
from lexweave.kernels.numerals import MONTHS

_LONG = rf"^([0-9]{{4}})\. ({'|'.join(MONTHS)}) ([0-9]{{1,2}})\b"


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.format_string("%s-%s-%s", y, m, d), "y-M-d")


def hungarian_date(s: Column) -> Column:
    """`2011. június 28., kedd` as a date."""
    part = lambda i: F.regexp_extract(s, _LONG, i)
    return F.when(s.rlike(_LONG), _made(part(1), month_number(part(2)).cast("string"), part(3)))


def simple_date(s: Column) -> Column:
    """`2011.6.28.` or `2011/6/28` as a date."""
    p = r"^([0-9]{4})[./]\s*([0-9]{1,2})[./]\s*([0-9]{1,2})\.?$"
    return F.when(s.rlike(p), _made(*(F.regexp_extract(s, p, i) for i in (1, 2, 3))))
