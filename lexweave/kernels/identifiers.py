"""Order and succession of element identifiers, free of Spark. functions.identifiers has the same as Column expressions."""

from __future__ import annotations

import re

#: Steps of the Hungarian alphabet that aren't steps of the code points.
HUNGARIAN_STEPS = (("g", "gy"), ("gy", "h"), ("n", "ny"), ("ny", "o"), ("s", "sz"), ("sz", "t"), ("t", "ty"), ("ty", "u"))
STEPS = frozenset(HUNGARIAN_STEPS) | {(a.upper(), b.upper()) for a, b in HUNGARIAN_STEPS}
_NUMBER = re.compile(r"(\d+)/?([a-zA-Z]*)\Z")
_ARTICLE = re.compile(r"(?:(\d+):)?(.+)\Z")


def next_letter(a: str, b: str) -> bool:
    """Does letter b follow a, by the Hungarian alphabet or by code point?"""
    return (a, b) in STEPS or (len(a) == len(b) == 1 and ord(b) == ord(a) + 1)


def next_number(a: str, b: str) -> bool:
    """Does b follow a: 1, 2; 1, 1a; 1a, 1b; 1a, 2?"""
    x, y = _NUMBER.match(a), _NUMBER.match(b)
    if not x or not y:
        return False
    step = int(y[1]) - int(x[1])
    if step == 1:
        return not y[2]
    return step == 0 and (y[2] in ("a", "A") if not x[2] else next_letter(x[2], y[2]))


def next_identifier(kind: str, a: str, b: str) -> bool:
    """Does identifier b follow a among siblings of a kind?"""
    if kind == "Article":
        x, y = _ARTICLE.match(a), _ARTICLE.match(b)
        if x[1] == y[1]:
            return next_number(x[2], y[2])
        return bool(x[1] and y[1]) and int(y[1]) == int(x[1]) + 1 and y[2] == "1"
    if kind == "AlphabeticPoint":
        return next_letter(a, b)
    if kind == "AlphabeticSubpoint":
        if len(a) > 1 and len(b) > 1 and (a, b) not in STEPS:
            return a[0] == b[0] and next_letter(a[1:], b[1:])
        return next_letter(a, b)
    return next_number(a, b)


def natural_key(identifier: str) -> tuple:
    """Compares identifiers so that 1/A < 2 < 2a < 10 < a."""
    return tuple((1, "", int(x)) if x.isdigit() else (2, x, 0) for x in re.findall(r"\d+|\D+", identifier))
