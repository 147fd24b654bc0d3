"""Citations, abbreviations, amendments, repeals and enforcement dates in a sentence of legal prose; free of Spark.

A cascade of patterns: identifiers make lists with the word of their level (article, paragraph, point, subpoint), levels make a
reference, references stand in the templates of amending, repealing and enforcing sentences. A sentence that fits no template is scanned
from left to right for quotes, acts and references. Positions are character offsets, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import regex

from lexweave.kernels.identifiers import natural_key, next_identifier
from lexweave.kernels.numerals import MONTHS, ORDINALS, month, ordinal, roman_to_arabic

Span = tuple[str, str]


class Ref(NamedTuple):
    """A place in an act; each level is None or (first, last), alike for a single identifier."""

    act: str | None = None
    article: Span | None = None
    paragraph: Span | None = None
    point: Span | None = None
    subpoint: Span | None = None


class Citation(NamedTuple):
    start: int
    end: int
    ref: Ref


class Abbreviation(NamedTuple):
    abbreviation: str
    act: str


class Structural(NamedTuple):
    """A heading of an act, or a place before or after an article."""

    act: str | None = None
    book: str | None = None
    part: str | None = None
    title: str | None = None
    chapter: str | None = None
    subtitle: str | None = None
    position: str | None = None
    article: str | None = None


class Record(NamedTuple):
    """What a sentence does: kind, and the fields that its kind has."""

    kind: str
    ref: Ref | None = None
    structural: Structural | None = None
    pure_insertion: bool = False
    date_kind: str | None = None
    date: tuple[int, int, int] | None = None
    days: int | None = None
    day: int | None = None
    months: int | None = None
    repeal_date: tuple[int, int, int] | None = None
    original: str | None = None
    replacement: str | None = None


class Analysis(NamedTuple):
    citations: tuple[Citation, ...]
    abbreviations: tuple[Abbreviation, ...]
    records: tuple[Record, ...]


_LOW, _UP = "a-zéáőúöüóíű", "A-ZÉÁŐÚÖÜÓÍŰ"
_DASH, _AZ = "[−–-]", r"az?\s+"
_SEPARATOR = rf"(?:[,;]?\s*(?:és|valamint|illetve|vagy)(?![{_LOW}{_UP}])|[,;])"
_BETWEEN = rf"\s*(?:{_SEPARATOR}\s*(?:{_AZ})?)?\s*"
_NOT_IN_WORD, _NOT_IN_NUMBER = rf"(?<![{_LOW}{_UP}-])", r"(?<!\d)"


class _Level(NamedTuple):
    """How a level's identifiers are written; `kind` tells which identifiers follow each other, empty if none are joined."""

    slot: int
    kind: str
    identifier: str
    single: str
    span: str
    word: str
    before: str


def _levels() -> tuple[_Level, ...]:
    article, paragraph, letter, number = r"(?:\d+\s*:\s*)?\d+(?:\s*/\s*[A-Z])?", r"\d+[a-z]?", "(?:ny|sz|[a-z])", "\\d+(?:/?[a-z])?"
    sign = rf"§(?:-[{_LOW}]+)?"
    point, sub = rf"pont[{_LOW}]*", rf"alpont[{_LOW}]*"
    return (
        _Level(1, "Article", article, rf"{article}\s*\.", rf"{article}\s*(?:\.\s*{sign}\s*)?{_DASH}\s*{article}\s*\.", sign, _NOT_IN_NUMBER),
        _Level(2, "Paragraph", paragraph, rf"\(\s*{paragraph}\s*\)", rf"\(\s*{paragraph}\s*\)\s*{_DASH}\s*\(\s*{paragraph}\s*\)", rf"bekezdés[{_LOW}]*", ""),
        _Level(3, "AlphabeticPoint", letter, rf"{letter}\s*\)", rf"{letter}\s*\)?\s*{_DASH}\s*{letter}\s*\)", point, _NOT_IN_WORD),
        _Level(3, "NumericPoint", number, rf"{number}\s*\.", rf"{number}\s*{_DASH}\s*{number}\s*\.", point, _NOT_IN_NUMBER),
        _Level(4, "AlphabeticSubpoint", "[a-z]{1,2}", r"[a-z]{1,2}\s*\)", rf"[a-z]{{1,2}}\s*\)\s*{_DASH}\s*[a-z]{{1,2}}\s*\)", sub, _NOT_IN_WORD),
        _Level(4, "", r"\d+", r"\d+\s*\.", rf"\d+\s*{_DASH}\s*\d+\s*\.", sub, _NOT_IN_NUMBER),
    )


LEVELS = _levels()


def _list(i: int) -> str:
    level = LEVELS[i]
    item = rf"(?P<l{i}>{level.span}|{level.single})"
    return rf"(?:{level.before}{item}(?:{_BETWEEN}{item})*\s*{level.word})"


_ARTICLE, _PARAGRAPH, _POINT, _SUBPOINT = _list(0), _list(1), f"(?:{_list(2)}|{_list(3)})", f"(?:{_list(4)}|{_list(5)})"
_BELOW_POINT = rf"{_POINT}(?:\s*{_SUBPOINT})?"
_BELOW_PARAGRAPH = rf"{_PARAGRAPH}(?:\s*{_BELOW_POINT})?"
_REFERENCE = rf"(?:{_ARTICLE}(?:\s*(?:{_BELOW_PARAGRAPH}|{_BELOW_POINT}))?|{_BELOW_PARAGRAPH}|{_BELOW_POINT}|{_SUBPOINT})"
_ABBREVIATION = rf"(?:{_NOT_IN_WORD}(?:[{_UP}][{_LOW}]+\.?\s?(?:tv\.|vhr\.)|[{_UP}][{_LOW}]+\.))"
_ACT_ID = rf"{_NOT_IN_NUMBER}(?P<year>\d+)\s*\.\s*évi\s*(?P<number>[IVXLCDM]+)\s*\.\s*(?:törvén[{_LOW}]+|tv\.)"
_PLAIN_ACT_ID = rf"\d+\s*\.\s*évi\s*[IVXLCDM]+\s*\.\s*(?:törvén[{_LOW}]+|tv\.)"
_HEREINAFTER = rf"\(\s*a\s+továbbiakban\s*:?\s*(?:(?P<short>{_ABBREVIATION})\s*(?:törvény)?|{_PLAIN_ACT_ID}|(?:[{_LOW}{_UP}-]+\s*)+)\s*\)"
_ACT = rf"(?:(?P<known>{_ABBREVIATION})|(?P<act>{_ACT_ID})(?:\s*{_HEREINAFTER})?)"
_PLAIN_ACT = rf"(?:{_ABBREVIATION}|{_PLAIN_ACT_ID}(?:\s*{regex.sub(r'[?]P<[a-z]+>', '?:', _HEREINAFTER)})?)"
#: The title of an act, up to its number or abbreviation.
_TITLE = rf"(?:(?!{_PLAIN_ACT}(?!\s*hatálybalépésével összefüggő)).)*+"
_QUOTE = r"(?P<q>„(?:[^„”]|(?&q))*”)"
_plain = lambda p: regex.sub(r"\?P<l\d>", "?:", p)
_REFS = rf"(?P<refs>{_plain(_REFERENCE)}(?:{_BETWEEN}{_plain(_REFERENCE)})*)"
_DATE = rf"(?P<Y>\d+)\s*\.\s*(?P<M>{'|'.join(MONTHS)})\s*(?P<D>\d+)(?:-án|-jén|-én|\.\s*napján)"
_ORDINAL = "|".join(sorted(ORDINALS, key=len, reverse=True))
_PUBLISHED = r"(?:az?\s+|(?:az\s+)?e\s+törvény\s+)?kihirdetésé?t\s+követő"


def _compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern, regex.V1)


REFERENCE = _compiled(_REFERENCE)
ACT = _compiled(_ACT)
_ITEM = tuple(_compiled(rf"({x.identifier})(?:[^−–-]*{_DASH}[^\w]*({x.identifier}))?") for x in LEVELS)


def act_of(m: regex.Match) -> tuple[str, int, int]:
    """Act id and position of a matched act."""
    if m["known"]:
        return m["known"], *m.span("known")
    return f"{m['year']}. évi {m['number']}. törvény", *m.span("act")


def _clean(identifier: str) -> str:
    return regex.sub(r"\s+", "", identifier)


def _values(m: regex.Match) -> list[list[tuple[Span, int, int]]]:
    """By level, the identifiers of a matched reference, neighbours that follow each other joined in pairs."""
    out: list[list[tuple[Span, int, int]]] = [[], [], [], []]
    for i, level in enumerate(LEVELS):
        pending: tuple[str, int, int] | None = None
        spans = m.spans(f"l{i}")
        for start, end in spans:
            x = _ITEM[i].search(m.string, start, end)
            first, last = _clean(x[1]), _clean(x[2]) if x[2] else None
            if last is not None:
                out[level.slot - 1].append(((first, last), start, end))
            elif pending and level.kind and next_identifier(level.kind, pending[0], first):
                out[level.slot - 1].append(((pending[0], first), pending[1], end))
                pending = None
            else:
                if pending:
                    out[level.slot - 1].append(((pending[0], pending[0]), *pending[1:]))
                pending = (first, start, end)
        if pending:
            out[level.slot - 1].append(((pending[0], pending[0]), *pending[1:]))
        out[level.slot - 1].sort(key=lambda v: v[1])
    return out


def expand(m: regex.Match, act: str | None = None) -> list[Citation]:
    """Every reference of a matched one: of each level all but the last item stand alone, the last carries the deeper levels."""
    out: list[Citation] = []
    given: list[Span | None] = [None] * 4
    start: int | None = m.start()
    for k, level in enumerate(_values(m)):
        for value, a, b in level[:-1]:
            given[k] = value
            out.append(Citation(a if start is None else start, b, Ref(act, *given)))
            start = None
        if level:
            given[k] = level[-1][0]
            if start is None:
                start = level[-1][1]
    out.append(Citation(m.start() if start is None else start, m.end(), Ref(act, *given)))
    return out


def relative_to(ref: Ref, other: Ref) -> Ref:
    """What a reference leaves out at its front is taken from another."""
    first = next((i for i, v in enumerate(ref) if v is not None), len(ref))
    return Ref(*other[:first], *ref[first:])


def chain(text: str, start: int, end: int, act: str | None) -> list[Citation]:
    """All references of a list; each is relative to the one before."""
    out, last = [], Ref(act)
    for m in REFERENCE.finditer(text, start, end):
        for c in expand(m):
            last = relative_to(c.ref, last)
            out.append(c._replace(ref=last))
    return out


def contains(outer: Ref, inner: Ref) -> bool:
    """Does the (range of) places hold the other, whatever their depths?"""
    key = lambda r, i: tuple((0,) if v is None else (1, *natural_key(v[i] if isinstance(v, tuple) else v)) for v in r)

    def above(a: tuple, b: tuple) -> bool:
        depth = max((i for i, v in enumerate(a) if v != (0,)), default=-1) + 1
        return a[:depth] == b[:depth] and a != b

    lo, hi, first, last = key(outer, 0), key(outer, 1), key(inner, 0), key(inner, 1)
    return (lo <= first or above(lo, first)) and (hi >= last or above(hi, last))


def unquote(q: str) -> str:
    """A quote without its outer marks and blanks."""
    return q[1:-1].strip()


# Structural places -----------------------------------------------------------------------------------------------------------------

_ORDINAL_UP = "|".join(w.capitalize() for w in sorted((w for w, n in ORDINALS.items() if n < 20), key=len, reverse=True))
_BOOK = rf"(?:(?P<book>{_ORDINAL_UP})\s+Könyv\s+)?"
_ARTICLE_ID = r"(?P<art>(?:\d+\s*:\s*)?\d+(?:\s*/\s*[A-Z])?)\s*\.\s*§(?:-[a-zéáőúöüóíű]+)?"
_ROMAN_ID = r"[IVXLCDM]+(?:\s*/?\s*[A-Z])?"
_HEADING = (
    rf"(?:(?P<subnum>\d+(?:\s*/?\s*[A-Z])?)\s*\.\s*alcím[{_LOW}]*"
    rf"|(?P<chap>{_ROMAN_ID})\s*\.\s*Fejezet[{_LOW}]*"
    rf"|{_BOOK}(?P<part>{_ORDINAL_UP})\s+Rész[{_LOW}]*"
    rf"|{_BOOK}(?P<title>{_ROMAN_ID})\s*\.\s*Cím[{_LOW}]*"
    rf"|(?:(?P<sub>„(?:[^„”]|(?&q))*”)|(?P<raw>(?:(?!alcíme|című)[^\n:])+?))\s*(?:című\s*)?alcíme)"
)
_HEADING_Q = _HEADING.replace("(?&q)", "„[^„”]*”")
_POSITION = rf"(?:[IVXLCDM]+(?:\s*/?\s*[A-Z])?\s*\.\s*Fejezet[{_LOW}]*\s*)?(?:{_AZ})?{_ARTICLE_ID}\s*(?P<where>követően|követő|megelőzően|megelőző)"


def structural_of(m: regex.Match, act: str) -> Structural:
    """The heading or place in a match."""
    g = m.groupdict()
    if g.get("where"):
        return Structural(act, position="AFTER" if g["where"].startswith("köv") else "BEFORE_WITHOUT_ARTICLE", article=_clean(g["art"]))
    book = str(ordinal(g["book"])) if g.get("book") else None
    if g.get("subnum"):
        return Structural(act, subtitle=_clean(g["subnum"]))
    if g.get("chap"):
        return Structural(act, chapter=roman_to_arabic(_clean(g["chap"])))
    if g.get("part"):
        return Structural(act, book=book, part=str(ordinal(g["part"])))
    if g.get("title"):
        return Structural(act, book=book, title=roman_to_arabic(_clean(g["title"])))
    if g.get("sub"):
        return Structural(act, subtitle=unquote(g["sub"]))
    if g.get("raw"):
        return Structural(act, subtitle=" ".join(g["raw"].split()))
    return Structural(act)


# Templates of sentences ------------------------------------------------------------------------------------------------------------

_START = rf"\s*[Aa]z?\s+{_TITLE}{_ACT}\s*"
_AMENDED = r"(?:helyébe\s+a\s+következő\s+(?:rendelkezés\s+lép|rendelkezések\s+lépnek)|a\s+következő\s+szöveggel\s+lép\s+hatályba)"
_INSERTED = r"(?:egészül\s+ki|kiegészülve\s+lép\s+hatályba)"
_NEXT = r"a\s+következő\s+"
_ART_, _PAR_, _PNT_, _SUB_ = map(_plain, (_ARTICLE, _PARAGRAPH, _POINT, _SUBPOINT))
_INSERTION = (
    rf"(?P<ins>{_NEXT}{_ART_}(?:\s*{_PAR_})?"
    rf"|(?:(?:(?:{_AZ})?{_ART_}|a\s+§)\s+)?{_NEXT}{_PAR_}"
    rf"|(?:(?:(?:{_AZ})?{_ART_}(?:\s*{_PAR_})?|a\s+§|a\s+bekezdés)\s+)?{_NEXT}{_PNT_}"
    rf"|(?:{_AZ})?{_ART_}(?:\s*{_PAR_})?\s*{_PNT_}\s+{_NEXT}{_SUB_})\s+{_INSERTED}"
)
_PLACE = rf"(?:(?:{_POSITION}|{_HEADING_Q})\s*)?"
_SUBTITLE_WORD = r"(?:alcímmel|alcímekkel|alcím-megjelölése|alcím-megjelölés|alcíme|alcím)(?:\s*cím[a-zéáőúöüóíű]*)?"
_WITH_SUBTITLE = rf"(?:{_SUBTITLE_WORD}\s+és\s+(?P<a1>{_ART_})|(?P<a2>{_ART_})\s+és\s+{_AZ}(?:azt\s+|azokat\s+)?megelőző\s+{_SUBTITLE_WORD}|{_SUBTITLE_WORD})"
_AMENDED_SUBTITLE = r"helyébe\s+a\s+következő\s+(?:rendelkezés\s+és\s+)?alcím\s+(?:és\s+rendelkezés\s+)?(?:lép|lépnek)"

BLOCK = _compiled(rf"{_START}{_PLACE}(?:(?P<amd>{_plain(_REFERENCE)})\s+{_AMENDED}(?:,?\s*(?:és|valamint|egyidejűleg)\s+{_INSERTION})?|{_INSERTION.replace('?P<ins>', '?P<only>')})\s*:\s*$")
BLOCK_SUBTITLE = _compiled(rf"{_START}{_PLACE}(?:{_WITH_SUBTITLE}\s+(?:{_AMENDED}|{_AMENDED_SUBTITLE})|(?P<new>{_NEXT}){_WITH_SUBTITLE.replace('a1', 'n1').replace('a2', 'n2')}\s+{_INSERTED})\s*:\s*$")
_HEADINGS_AMENDED = rf"(?:{_AMENDED}|helyébe\s+a\s+következő\s+(?:cím|fejezet|rész)?\s*lép)"
BLOCK_HEADING = _compiled(rf"{_START}(?P<new>{_NEXT})?{_HEADING_Q}\s+(?(new){_INSERTED}|{_HEADINGS_AMENDED})\s*:\s*$")
BLOCK_BOOK = _compiled(rf"{_START}(?P<book>{_ORDINAL_UP})\s+Könyve\s+{_NEXT}(?P<title>{_ROMAN_ID})\s*\.\s*Cím[{_LOW}]*\s+{_INSERTED}\s*:\s*$")
_PART = rf"(?:{_AZ})?(?P<o>„(?:[^„”]|(?P<q1>„(?:[^„”]|(?&q1))*”))*”)\s*szövegrész(?:ek)?\s+(?:helyébe|helyett)\s+(?:{_AZ})?(?P<r>„(?:[^„”]|(?&q1))*”)\s*(?:szöveggel|szövegrész|szöveg|(?={_SEPARATOR}))"
PART = _compiled(_PART)
_PARTS = regex.sub(r"\?P<[or]>", "?:", _PART)
TEXT = _compiled(rf"{_START}{_REFS}{_BETWEEN}(?P<parts>{_PARTS}(?:{_BETWEEN}{_PARTS.replace('(?P<q1>', '(?P<q2>').replace('q1)', 'q2)')})*)\s*lép(?:\s+hatályba)?\s*\.\s*$")
ARTICLE_TITLE = _compiled(rf"{_START}{_ARTICLE_ID}\s*cím[{_LOW}]+\s*{_PART.replace('|(?=' + _SEPARATOR + ')', '')}\s*lép(?:\s+hatályba)?\s*\.\s*$")
_EXCEPT = rf"{_DASH}\s*a\s+(?P<except>{_plain(_REFERENCE)})\s*(?:foglaltak|foglalt|meghatározott)\s+kivétel(?:lel|ével|ekkel)\s*{_DASH}"
_WHEN = rf"(?:{_DATE}|{_PUBLISHED}\s+(?:(?P<dtext>{_ORDINAL})\s+|(?P<dnum>\d+)\s*\.\s*)?napon|{_PUBLISHED}\s+(?:(?P<mtext>{_ORDINAL})\s+)?hónap\s+(?:(?P<daytext>{_ORDINAL})|(?P<daynum>\d+)\s*\.)\s*napján)"
_REPEALED_THEN = rf",\s*és\s+(?:(?:ez\s+a|e)\s+törvény\s+)?{_DATE.replace('?P<Y>', '?P<RY>').replace('?P<M>', '?P<RM>').replace('?P<D>', '?P<RD>')}\s*(?:a\s+)?hatályát\s+veszti"
ENFORCEMENT = _compiled(rf"\s*(?:(?:Ez\s+a|E)\s+törvény|Az?)\s*(?:{_EXCEPT})?\s*(?:{_REFS}{_BETWEEN})?{_WHEN}\s*lép\s+hatályba\s*(?:{_REPEALED_THEN})?\s*\.\s*$")
_REPEAL_START = rf"\s*(?:Nem\s+lép\s+hatályba|Hatályát\s+veszti)\s+{_AZ}{_TITLE}{_ACT}\s*"
_TEXTS = rf"(?P<texts>(?:(?:{_AZ})?„(?:[^„”]|(?P<q3>„(?:[^„”]|(?&q3))*”))*”\s*(?:szövegrész\s*)?(?:{_SEPARATOR}\s*(?:{_AZ})?)?\s*)*)"
REPEAL = _compiled(rf"{_REPEAL_START}{_REFS}{_BETWEEN}{_TEXTS}\s*\.\s*$")
REPEAL_HEADING = _compiled(rf"{_REPEAL_START}(?:{_POSITION}\s*(?:{_SUBTITLE_WORD})?|{_HEADING_Q})\s*\.\s*$")
QUOTE = _compiled(_QUOTE)
_TOKEN = _compiled(rf"[{_LOW}{_UP}-]+|\d+|.")
_BETWEEN_RE = _compiled(_BETWEEN)

#: Substrings of which an interesting sentence has at least one, and the length beyond which sentences are not analysed.
NEEDLES = (")", "§", "törvén", "hely", "hatály", "Hatály")
MAX_SENTENCE = 10_000


def _one(text: str, start: int, end: int, act: str) -> Citation | None:
    """The only reference between two positions, read across the words that stand between its levels."""
    parts = list(REFERENCE.finditer(text, start, end))
    if not parts:
        return None
    found = [expand(m) for m in parts]
    if any(len(f) != 1 for f in found):
        return None
    ref = Ref(act)
    for f in found:
        ref = Ref(act, *(b if b is not None else a for a, b in zip(ref[1:], f[0].ref[1:], strict=True)))
    return Citation(parts[0].start(), parts[-1].end(), ref)


def _abbreviation(m: regex.Match) -> tuple[Abbreviation, ...]:
    return (Abbreviation(m["short"], act_of(m)[0]),) if m["short"] else ()


def _block(text: str, m: regex.Match) -> Analysis:
    act, a, b = act_of(m)
    cites = [Citation(a, b, Ref(act))]
    amended = _one(text, *m.span("amd"), act) if m["amd"] else None
    group = "only" if m["only"] else "ins" if m["ins"] else None
    inserted = _one(text, *m.span(group), act) if group else None
    records: tuple[Record, ...] = ()
    if amended and inserted:
        ref = relative_to(inserted.ref._replace(act=None), amended.ref)
        inserted = inserted._replace(ref=ref)
        first = Ref(act, *(v and (v[0], v[0]) for v in ref[1:]))
        union = amended.ref if contains(amended.ref, first) else Ref(act, *((x and (x[0], y[1] if y else x[1])) or y for x, y in zip(amended.ref[1:], ref[1:], strict=True)))
        records = (Record("BlockAmendment", union),)
    elif amended:
        records = (Record("BlockAmendment", amended.ref),)
    elif inserted:
        records = (Record("BlockAmendment", inserted.ref, pure_insertion=True),)
    return Analysis((*cites, *(c for c in (amended, inserted) if c)), _abbreviation(m), records)


def _subtitle(m: regex.Match) -> Analysis:
    act = act_of(m)[0]
    article = next((m[k] for k in ("a1", "a2", "n1", "n2") if m[k]), None)
    where = structural_of(m, act)
    if article:
        first = _values(REFERENCE.match(article))[0][0][0][0]
        where = Structural(act, position="BEFORE_WITH_ARTICLE", article=first)
    return Analysis((), _abbreviation(m), (Record("BlockAmendment", structural=where, pure_insertion=bool(m["new"])),))


def _text_amendment(text: str, m: regex.Match) -> Analysis:
    act, a, b = act_of(m)
    cites = chain(text, *m.span("refs"), act)
    parts = [(unquote(p["o"]), unquote(p["r"])) for p in PART.finditer(text, *m.span("parts"))]
    return Analysis((Citation(a, b, Ref(act)), *cites), _abbreviation(m), tuple(Record("TextAmendment", c.ref, original=o, replacement=r) for c in cites for o, r in parts))


def _article_title(m: regex.Match) -> Analysis:
    act, a, b = act_of(m)
    ident = _clean(m["art"])
    ref = Ref(act, (ident, ident))
    end = m.end("art") + len(regex.match(rf"\s*\.\s*§(?:-[{_LOW}]+)?", m.string[m.end("art") :])[0])
    return Analysis((Citation(a, b, Ref(act)), Citation(m.start("art"), end, ref)), _abbreviation(m), (Record("ArticleTitleAmendment", ref, original=unquote(m["o"]), replacement=unquote(m["r"])),))


def _enforcement(text: str, m: regex.Match) -> Analysis:
    date = lambda p: (int(m[p + "Y"]), month(m[p + "M"]), int(m[p + "D"])) if m[p + "Y"] else None
    if m["Y"]:
        when = {"date_kind": "Date", "date": date("")}
    elif m["daytext"] or m["daynum"]:
        when = {"date_kind": "DayInMonthAfterPublication", "day": ordinal(m["daytext"]) if m["daytext"] else int(m["daynum"]), "months": ordinal(m["mtext"]) if m["mtext"] else 1}
    else:
        when = {"date_kind": "DaysAfterPublication", "days": ordinal(m["dtext"]) if m["dtext"] else int(m["dnum"] or 1)}
    cites = chain(text, *m.span("refs"), None) if m["refs"] else []
    but = chain(text, *m.span("except"), None) if m["except"] else []
    return Analysis((*cites, *but), (), tuple(Record("EnforcementDate", c.ref if c else None, repeal_date=date("R"), **when) for c in cites or [None]))


def _repeal(text: str, m: regex.Match) -> Analysis:
    act, a, b = act_of(m)
    cites = chain(text, *m.span("refs"), act)
    texts = [unquote(q[0]) for q in QUOTE.finditer(text, *m.span("texts"))] or [None]
    return Analysis((Citation(a, b, Ref(act)), *cites), _abbreviation(m), tuple(Record("Repeal", c.ref, original=t) for c in cites for t in texts))


def _structural_record(kind: str, m: regex.Match, cited: bool) -> Analysis:
    act, a, b = act_of(m)
    new = kind == "BlockAmendment" and (m.re is BLOCK_BOOK or bool(m.groupdict().get("new")))
    return Analysis((Citation(a, b, Ref(act)),) if cited else (), _abbreviation(m), (Record(kind, structural=structural_of(m, act), pure_insertion=new),))


def _scan(text: str) -> Analysis:
    cites: list[Citation] = []
    short: list[Abbreviation] = []
    at = 0
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        if m := QUOTE.match(text, at):
            at = m.end()
            continue
        if m := ACT.match(text, at):
            act, a, b = act_of(m)
            cites.append(Citation(a, b, Ref(act)))
            short += _abbreviation(m)
            at = m.end()
            while r := REFERENCE.match(text, len(text) - len(text[at:].lstrip())):
                cites += expand(r, act)
                at = r.end()
                between = _BETWEEN_RE.match(text, at).end()
                if not REFERENCE.match(text, between):
                    break
                at = between
            continue
        if m := REFERENCE.match(text, at):
            cites += expand(m)
            at = m.end()
            continue
        at = _TOKEN.match(text, at).end()
    return Analysis(tuple(cites), tuple(short), ())


def _templates(text: str) -> Iterator[Analysis | None]:
    """What each template that the sentence can fit makes of it: block amendments end in a colon, the others in a full stop."""
    end = text.rstrip()[-1:]
    if end == ":":
        yield (m := BLOCK.match(text)) and _block(text, m)
        if "alcím" in text:
            yield (m := BLOCK_SUBTITLE.match(text)) and _subtitle(m)
        yield (m := BLOCK_HEADING.match(text)) and _structural_record("BlockAmendment", m, False)
        if "Könyve" in text:
            yield (m := BLOCK_BOOK.match(text)) and _structural_record("BlockAmendment", m, False)
    elif end == ".":
        if "szövegrész" in text and "lép" in text:
            yield (m := TEXT.match(text)) and _text_amendment(text, m)
            yield (m := ARTICLE_TITLE.match(text)) and _article_title(m)
        if "hatályba" in text:
            yield (m := ENFORCEMENT.match(text)) and _enforcement(text, m)
        if text.lstrip().startswith(("Hatályát", "Nem lép")):
            yield (m := REPEAL.match(text)) and _repeal(text, m)
            yield (m := REPEAL_HEADING.match(text)) and _structural_record("Repeal", m, True)


#: What the templates need; each sentence is tried against those it can fit.
_AMENDING = ("lép", "egészül", "veszti")


def interesting(text: str) -> bool:
    """Is the sentence worth analysing: does it hold a needle, and isn't it too long?"""
    return len(text) <= MAX_SENTENCE and any(n in text for n in NEEDLES)


def analyze(text: str) -> Analysis:
    """Citations, abbreviations and records of one sentence."""
    if any(w in text for w in _AMENDING):
        for found in _templates(text):
            if found:
                return found
    return _scan(text)
