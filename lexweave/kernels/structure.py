"""From lines of text to elements (articles, paragraphs, points, subpoints, quoted blocks); free of Spark.

Every kind of element is a row of KINDS: how its headers are written, which identifier comes first, what its parent needs, and which
kinds may stand below it. One routine works on ranges of lines for all of them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence
from typing import Any, NamedTuple

from lexweave.kernels.identifiers import next_identifier
from lexweave.kernels.numerals import ordinal, roman_to_arabic

OPENING, CLOSING = "„“", "”"
#: Points an indent may differ and count as equal; right margin beyond which a line isn't justified; width of a character.
SIMILAR_INDENT = 1.0
RAGGED_MARGIN = 20.0
CHAR_WIDTH = 5.0
#: Parts of an act that have a name instead of a number.
SPECIAL_PARTS = ("ÁLTALÁNOS RÉSZ", "KÜLÖNÖS RÉSZ", "ZÁRÓ RÉSZ")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZÉÁŐÚŰÖÜÓÍ")


class Line(NamedTuple):
    content: str
    indent: float = 0.0
    margin_right: float = 0.0
    bold: bool = False
    #: (position, extra room before the character there) wherever characters stand further apart than CHAR_WIDTH.
    gaps: tuple[tuple[int, float], ...] = ()

    def cut(self, start: int, end: int | None = None) -> Line:
        """Part of the line; the indent moves with what is cut off."""
        indent = self.indent + CHAR_WIDTH * start + sum(w for p, w in self.gaps if p <= start)
        return self._replace(content=self.content[start:end], indent=indent, gaps=tuple((p - start, w) for p, w in self.gaps if p > start))


class StructureError(ValueError):
    """Lines that make no element."""


class Kind(NamedTuple):
    header: str
    first: str
    below: tuple[str, ...]
    needs_intro: bool = True
    needs_two: bool = True
    wrap_up: bool = True


_LETTER = r"([a-z]|ny|sz)\) "
_NUMBER = r"(\d+(?:/?[a-z])?)\. "
KINDS = {
    "Paragraph": Kind(r"\((\d+[a-z]?)\) ", "1", ("QuotedBlock", "AlphabeticPoint", "NumericPoint"), False, False, False),
    "AlphabeticPoint": Kind(_LETTER, "a", ("NumericSubpoint", "AlphabeticSubpoint")),
    "NumericPoint": Kind(_NUMBER, "1", ("AlphabeticSubpoint",)),
    "AlphabeticSubpoint": Kind(_LETTER, "a", ()),
    "NumericSubpoint": Kind(_NUMBER, "1", (), wrap_up=False),
}
MARKS = {"Paragraph": "({}) ", "NumericPoint": "{}. ", "NumericSubpoint": "{}. ", "AlphabeticPoint": "{}) ", "AlphabeticSubpoint": "{}) "}
ARTICLE = re.compile(r"((?:\d+:)?\d+(?:/[A-Z])?)\. ?§ +(.*)$")
HEADINGS = {"Book": re.compile(r"(.*) KÖNYV$"), "Part": re.compile(r"(.*) RÉSZ$"), "Title": re.compile(r"(.*)\. CÍM$"), "Chapter": re.compile(r"(.*)\. fejezet$", re.I), "Subtitle": re.compile(r"(\d+(?:/[A-Z])?)\. ")}


def element(kind: str, identifier: str | None, **fields: Any) -> dict[str, Any]:
    """An element with its children."""
    return {"kind": kind, "identifier": identifier, "title": None, "special": None, "text": None, "intro": None, "wrap_up": None, "lines": None, "children": []} | fields


@functools.lru_cache(maxsize=50_000)
def quote_change(s: str) -> int:
    """Quotes opened less quotes closed."""
    return sum(s.count(c) for c in OPENING) - s.count(CLOSING)


def quote_levels(lines: Sequence[Line]) -> list[int]:
    """The quote level before each line; unbalanced quotes are an error."""
    out, level = [], 0
    for line in lines:
        out.append(level)
        level += quote_change(line.content)
        if level < 0:
            raise StructureError(f"quote closed that wasn't opened: {line.content[:80]}")
    if level:
        raise StructureError(f"{level} quotes not closed")
    return out


def joined(lines: Sequence[Line] | Sequence[str]) -> str:
    """Lines as running text: a space between them, none after a hyphen; empty lines left out."""
    out = ""
    for x in lines:
        s = x if isinstance(x, str) else x.content
        if s:
            out += s if not out or out.endswith("-") else " " + s
    return out


@functools.lru_cache(maxsize=1_000)
def _header(kind: str, prefix: str) -> re.Pattern:
    if kind == "AlphabeticSubpoint" and prefix:
        return re.compile(rf"({re.escape(prefix)}[a-z]|ny|sz)\) ")
    return re.compile(KINDS[kind].header)


def headers(lines: Sequence[Line], kind: str, prefix: str = "") -> list[int]:
    """Where the elements of a kind begin: outside quotes, not indented further than the one before, identifiers in succession."""
    pattern, out, last, indent = _header(kind, prefix), [], None, 0.0
    for i, (level, line) in enumerate(zip(quote_levels(lines), lines, strict=True)):
        if level or (last is not None and line.indent >= indent + SIMILAR_INDENT):
            continue
        m = pattern.match(line.content)
        if m and (m[1] == prefix + KINDS[kind].first if last is None else next_identifier(kind, last, m[1])):
            out.append(i)
            last, indent = m[1], line.indent
    return out


def _quoted(lines: Sequence[Line]) -> tuple[list[dict[str, Any]], str | None] | None:
    """The quoted blocks at the start of lines, and what follows them; None if the last isn't closed."""
    levels, at, blocks = quote_levels(lines), 0, []
    while at < len(lines):
        line = lines[at]
        if not line.content:
            at += 1
            continue
        if levels[at] or line.content[0] not in OPENING:
            break
        end = next((k for k in range(at, len(lines)) if lines[k].content.endswith(CLOSING) and (k == at or levels[k] + quote_change(lines[k].content) == 0)), None)
        if end is None:
            return None
        block = [line.cut(1, -1)] if end == at else [line.cut(1), *lines[at + 1 : end], lines[end].cut(0, -1)]
        blocks.append(element("QuotedBlock", None, lines=block))
        at = end + 1
    return blocks, joined(lines[at:]) or None


def _last_item(lines: Sequence[Line], kind: str, indented: bool) -> tuple[Sequence[Line], str | None]:
    """The last item of a list, and the wrap-up that follows it."""
    if not KINDS[kind].wrap_up:
        return lines, None
    lines = [x for x in lines if x.content]
    if indented:
        cut = next((i for i in range(1, len(lines)) if lines[i].indent < lines[0].indent + SIMILAR_INDENT), None)
    else:
        cut = next((i for i in range(len(lines) - 1, 0, -1) if lines[i - 1].margin_right > RAGGED_MARGIN), None)
    return (lines, None) if cut is None else (lines[:cut], joined(lines[cut:]))


def _items(lines: Sequence[Line], kind: str, prefix: str, indented: bool) -> tuple[list[dict[str, Any]], str | None] | None:
    """The elements of a kind that lines consist of, and the wrap-up; None if there are too few."""
    starts = headers(lines, kind, prefix)
    if len(starts) < 1 + KINDS[kind].needs_two:
        return None
    found = [sub_element(lines[a:b], kind, prefix, indented) for a, b in zip(starts, starts[1:], strict=False)]
    rest, wrap_up = _last_item(lines[starts[-1] :], kind, indented)
    return [*found, sub_element(rest, kind, prefix, indented)], wrap_up


def _children(lines: Sequence[Line], kind: str, identifier: str | None, indented: bool) -> tuple[str | None, list[dict[str, Any]], str | None] | None:
    """intro, children and wrap-up, by the kind whose first header comes first and that makes a list; None if none does."""
    levels, options = quote_levels(lines), []
    for below in KINDS[kind].below:
        if below == "QuotedBlock":
            first = next((i for i, x in enumerate(lines) if not levels[i] and x.content and x.content[0] in OPENING), None)
            prefix = ""
        else:
            prefix = identifier or "" if below == "AlphabeticSubpoint" and kind == "AlphabeticPoint" else ""
            first = next(iter(headers(lines, below, prefix)), None)
        if first is not None and not (first == 0 and (below == "QuotedBlock" or KINDS[below].needs_intro)):
            options.append((first, below, prefix))
    for first, below, prefix in sorted(options, key=lambda o: o[0]):
        got = _quoted(lines[first:]) if below == "QuotedBlock" else _items(lines[first:], below, prefix, indented)
        if got is not None:
            return (joined(lines[:first]) if first else None), *got
    return None


def sub_element(lines: Sequence[Line], kind: str, prefix: str = "", indented: bool = True) -> dict[str, Any]:
    """One paragraph, point or subpoint from its lines."""
    m = _header(kind, prefix).match(lines[0].content)
    identifier = m[1] if m else None
    lines = [lines[0].cut(m.end() if m else 0), *lines[1:]]
    got = _children(lines, kind, identifier, indented)
    if got is None:
        return element(kind, identifier, text=joined(lines))
    intro, children, wrap_up = got
    return element(kind, identifier, intro=intro, children=children, wrap_up=wrap_up)


def article(lines: Sequence[Line], indented: bool = True) -> dict[str, Any]:
    """One article: its title in brackets, of up to three lines, and its paragraphs."""
    m = ARTICLE.match(lines[0].content)
    if not m:
        raise StructureError(f"no article: {lines[0].content[:80]}")
    body, title = [lines[0].cut(m.start(2)), *lines[1:]], None
    if body[0].content.startswith("["):
        end = next((i for i in range(min(3, len(body))) if body[i].content.endswith("]")), None)
        if end is None:
            raise StructureError("article title too long")
        title = joined(body[: end + 1])[1:-1]
        body = body[end + 1 :]
    if body and not body[0].content:
        body = body[1:]
    if not body:
        return element("Article", m[1], title=title)
    first = re.match(KINDS["Paragraph"].header, body[0].content)
    if first and first[1] == "1":
        return element("Article", m[1], title=title, children=_items(body, "Paragraph", "", indented)[0])
    return element("Article", m[1], title=title, children=[sub_element(body, "Paragraph", "", indented)])


def heading(line: Line, kind: str) -> tuple[str, bool] | None:
    """(identifier, special) if the line is a heading of the kind."""
    if kind == "Part" and line.content in SPECIAL_PARTS:
        return str(SPECIAL_PARTS.index(line.content) + 1), True
    m = HEADINGS[kind].match(line.content)
    try:
        if m:
            return (str(ordinal(m[1])) if kind in ("Book", "Part") else m[1] if kind == "Subtitle" else roman_to_arabic(m[1])), False
    except ValueError:
        pass
    return None


class Walk:
    """Accepts headings line by line: numbered ones begin with 1 or continue, articles keep their indent, subtitles are bold."""

    def __init__(self, strict: bool = True):
        self.strict, self.last, self.indent = strict, dict.fromkeys(HEADINGS, "0"), None

    def accept(self, line: Line, after_empty: bool) -> tuple[str, str, bool] | None:
        """(kind, identifier, special) if an element of the act begins with the line."""
        if not line.content:
            return None
        m = ARTICLE.match(line.content)
        if m and (self.indent is None or abs(line.indent - self.indent) < SIMILAR_INDENT):
            self.indent = line.indent
            return "Article", m[1], False
        for kind in HEADINGS:
            got = heading(line, kind)
            if kind == "Subtitle":
                upper = line.content[0] in UPPER
                if line.bold and (upper and (after_empty or not self.strict) or got and (not self.strict or got[0] == "1" or next_identifier("", self.last[kind], got[0]))):
                    self.last[kind] = got[0] if got else "0"
                    return kind, got[0] if got else "", False
            elif got and (not self.strict or got[0] == "1" or next_identifier("", self.last[kind], got[0])):
                self.last[kind] = got[0]
                return kind, *got
        return None


def structural(lines: Sequence[Line], kind: str, identifier: str, special: bool, indented: bool = True) -> dict[str, Any]:
    """An article or a heading from its lines."""
    if kind == "Article":
        return article(lines, indented)
    title = joined(lines if kind == "Subtitle" else lines[1:])
    if kind == "Subtitle" and identifier:
        title = title.split(". ", 1)[1]
    return element(kind, identifier, title="" if special else title, special=special if kind == "Part" else None)


def act(lines: Sequence[Line], strict: bool = True, indented: bool = True) -> tuple[str, list[dict[str, Any]]]:
    """The preamble and the elements of an act, or of a block that replaces some of them."""
    levels, walk = quote_levels(lines), Walk(strict)
    begins: list[tuple[int, tuple[str, str, bool]]] = []
    before = Line("")
    for i, line in enumerate(lines):
        if not levels[i]:
            got = walk.accept(line, not before.content)
            before = line
            if got:
                begins.append((i, got))
    if not begins:
        raise StructureError("no article or heading")
    ends = [i for i, _ in begins[1:]] + [len(lines)]
    return joined(lines[: begins[0][0]]), [structural(lines[i:e], *got, indented) for (i, got), e in zip(begins, ends, strict=True)]


def amendment_block(lines: Sequence[Line], kind: str, expected: str) -> list[dict[str, Any]]:
    """The elements of a quoted block that amends (from `expected` on) elements of a kind."""
    prefix = expected[:-1] if kind == "AlphabeticSubpoint" and len(expected) > 1 else ""
    pattern = ARTICLE if kind == "Article" else _header(kind, prefix)
    starts, last = [0], expected
    for i, (level, line) in enumerate(zip(quote_levels(lines), lines, strict=True)):
        m = pattern.match(line.content)
        if i and not level and m and next_identifier(kind, last, m[1]):
            starts.append(i)
            last = m[1]
    ends = [*starts[1:], len(lines)]
    return [article(lines[a:b], False) if kind == "Article" else sub_element(lines[a:b], kind, prefix, False) for a, b in zip(starts, ends, strict=True)]


_SLOT = {"Article": 0, "Paragraph": 1, "AlphabeticPoint": 2, "NumericPoint": 2, "AlphabeticSubpoint": 3, "NumericSubpoint": 3}


def flatten(elements: Sequence[dict[str, Any]], ids: tuple[str, str, str, str] = ("", "", "", ""), parent: str | None = None, depth: int = 0, path: tuple[int, ...] = (), inside: str = "") -> list[dict[str, Any]]:
    """Elements and all below them as rows with element_id, parent_id, ord, depth and path."""
    rows: list[dict[str, Any]] = []
    for n, e in enumerate(elements, 1):
        slot = _SLOT.get(e["kind"])
        if slot is not None:
            own = (*ids[:slot], (e["identifier"] or "0").replace("/", "slash").replace(":", "colon"), *[""] * (3 - slot))
            name = inside + "_".join(own)
        else:
            own, name = ids, f"{inside}{e['kind'].lower()}-{n}" if parent is None or inside else f"{parent}.{e['kind'].lower()}-{n}"
        row = {k: v for k, v in e.items() if k != "children"} | {"element_id": name, "parent_id": parent, "ord": n, "depth": depth, "path": [*path, n], "in_amendment": bool(inside)}
        rows.append(row)
        below = f"{name}/" if e["kind"] == "BlockAmendmentContainer" else inside
        rows += flatten(e["children"], ("", "", "", "") if e["kind"] == "BlockAmendmentContainer" else own, name, depth + 1, (*path, n), below)
    return rows
