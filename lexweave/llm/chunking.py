"""Cutting oversized items at natural boundaries, by content-defined chunking.

A rolling hash over the characters gives landmarks that depend on the nearby text alone. Each cut is the natural boundary nearest to the
first landmark between the smallest and the largest size of a piece, taken among the boundaries of the best class found there: between
subpoints, sentences, clauses, words. So an edit moves the cuts next to it, and the following ones fall where they fell before. A
piece is smaller than the smallest size only before a run without blanks, as a cut between words is wanted wherever there is one; a cut
goes inside a word, at the landmark, where the stretch holds no blank at all.

Items within their limit never leave the JVM; each oversized one is cut by itself, in the task that reads it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the rolling hash's window, and how far apart landmarks lie on average, as a part of the largest size.
WINDOW = 16
LANDMARKS_PER_PIECE = 8
#: Smallest size of a piece, as a part of the largest.
MIN_SHARE = 0.6
SUBPOINT, SENTENCE, CLAUSE, WORD = 4, 3, 2, 1
#: Abbreviations of Hungarian legal prose (and a few English and German ones) whose full stop ends no sentence.
ABBREVIATIONS = frozenset("pl ill ún bek tv vhr ford szerk kb vö lásd ld i.e jan febr márc ápr máj jún júl aug szept okt nov dec dr id ifj özv prof mk szt sz old évf no nr art abs bzw z.b e.g cf mr mrs ca".split())

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SENTENCE = re.compile(r"[.!?…][\"”»’)\]]*\s+(?=[\"„«»‘(\[–—-]?\s*[A-ZÁÉÍÓÖŐÚÜŰ0-9„])")
_CLAUSE = re.compile(r"[;,:]\s+|\s(?=[–—]\s)|(?<=\s[–—])\s+")
_WORD = re.compile(r"\s+")
_LAST_TOKEN = re.compile(r"([^\s„\"(«]*)$")


class Piece(NamedTuple):
    """A piece of an item: characters start_pos to end_pos, of which the first `overlap` repeat the piece before."""

    piece_no: int
    start_pos: int
    end_pos: int
    overlap: int
    boundary: int


def rolling_hash(text: str, window: int = WINDOW) -> np.ndarray:
    """At each position, a mixed hash of the `window` characters that end there (fewer at the start)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(codes)
    h = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        power = np.uint64(1)
        for k in range(min(window, n)):
            h[k + 1 :] += codes[: n - k] * power
            power *= _BASE
        h ^= h >> np.uint64(31)
        h *= _MIX
        h ^= h >> np.uint64(29)
    return h


def boundaries(text: str, subpoints: tuple[int, ...] = ()) -> np.ndarray:
    """The class of the boundary before each position (0: none); blanks belong to what they follow."""
    rank = np.zeros(len(text) + 1, dtype=np.int8)
    for m in _WORD.finditer(text):
        rank[m.end()] = WORD
    for m in _CLAUSE.finditer(text):
        rank[m.end()] = CLAUSE
    for m in _SENTENCE.finditer(text):
        last = _LAST_TOKEN.search(text, max(0, m.start() - 40), m.start())[1].lower()
        if text[m.start()] != "." or not (last in ABBREVIATIONS or last.isdigit() or (len(last) == 1 and last.isalpha()) or re.fullmatch(r"[ivxlcdm]+", last)):
            rank[m.end()] = SENTENCE
    for p in subpoints:
        if 0 < p < len(text):
            rank[p] = SUBPOINT
    rank[0] = rank[len(text)] = 0
    return rank


def _inside_word(text: str, at: int, low: int) -> int:
    """at, or before the base character where at would part a combining mark from it."""
    import unicodedata

    p = at
    while p > low and (unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p if p > low else at


def split(text: str, max_chars: int, overlap_chars: int, subpoints: tuple[int, ...] = ()) -> list[Piece]:
    """Consecutive pieces of at most max_chars that together cover the text; one piece if it isn't longer.

    Each piece after the first repeats the last overlap_chars characters of the one before, or fewer to begin at a word.
    """
    n, size = len(text), max(1, max_chars)
    overlap_chars = max(0, min(overlap_chars, size // 2))
    if n <= size:
        return [Piece(1, 0, n, 0, 0)]
    rank, h = boundaries(text, subpoints), rolling_hash(text)
    reach = size - overlap_chars
    least = max(1, int(size * MIN_SHARE))
    landmark = h < np.uint64(min(2**64 - 1, 2**64 * LANDMARKS_PER_PIECE // size))
    pieces: list[Piece] = []
    start = cut = 0
    while n - start > size:
        hi = min(start + size, cut + reach) if pieces else start + size
        lo = min(hi, max(cut + min(least, reach), start + overlap_chars + 1))
        marks = np.flatnonzero(landmark[lo : hi + 1])
        mark = lo + int(marks[0] if len(marks) else np.argmin(h[lo : hi + 1]))
        best = int(rank[lo : hi + 1].max())
        if best:
            at = lo + np.flatnonzero(rank[lo : hi + 1] == best)
            end = int(at[np.argmin(np.abs(at - mark))])
        elif len(before := np.flatnonzero(rank[cut + 1 : lo])):
            end = cut + 1 + int(before[-1])
            best = int(rank[end])
        else:
            end = _inside_word(text, mark, max(cut, start))
        pieces.append(Piece(len(pieces) + 1, start, end, cut - start, best))
        # A piece shorter than the overlap is not repeated as a whole; the next one then begins at a later word, if only at its own.
        back = max(start + 1, end - overlap_chars)
        words = np.flatnonzero(rank[back:end])
        start, cut = back + int(words[0]) if len(words) else (end if end - overlap_chars <= start else back), end
    pieces.append(Piece(len(pieces) + 1, start, n, cut - start, 0))
    return pieces


def assemble(text: str | None, intro: str | None, children: str | None, wrap_up: str | None) -> tuple[str, tuple[int, ...]]:
    """An item's wording, and where its subpoints and wrap-up begin.

    It is text or, where that is null, intro, children and wrap_up joined by single spaces. Nulls are left out; a child reads
    identifier, mark and text, of which null ones are left out with the mark; children that can't be read are none.
    """
    if text is not None:
        return text, ()
    parts = [] if intro is None else [intro]
    try:
        level = json.loads(children) if children else []
    except ValueError:
        level = []
    for c in level if isinstance(level, list) else [level]:
        if isinstance(c, dict):
            ident, body = c.get("identifier"), c.get("text")
            mark = "" if ident is None else f"{ident}{'. ' if c.get('__type__') == 'NumericSubpoint' else ') '}"
            if ident is not None or body is not None:
                parts.append(mark + ("" if body is None else str(body)))
    if wrap_up is not None:
        parts.append(wrap_up)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    return " ".join(parts), tuple(starts[1:])


_IN = ("row_id", "text", "intro", "children", "wrap_up", "max_chars", "overlap_chars")
PIECES_SCHEMA = "row_id bigint, piece_no bigint, n_pieces bigint, start_pos bigint, end_pos bigint, overlap bigint, boundary string, piece string"
_NAMES = {SUBPOINT: "subpoint", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", 0: "character"}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            body, starts = assemble(r["text"], r["intro"], r["children"], r["wrap_up"])
            if len(body) > r["max_chars"]:
                found = split(body, r["max_chars"], r["overlap_chars"], starts)
                rows += [(r["row_id"], p.piece_no, len(found), p.start_pos, p.end_pos, p.overlap, "end" if p.piece_no == len(found) else _NAMES[p.boundary], body[p.start_pos : p.end_pos]) for p in found]
        columns = list(zip(*rows, strict=True)) or [()] * 8
        types = [pa.int64()] * 6 + [pa.string()] * 2
        names = [c.split()[0] for c in PIECES_SCHEMA.split(", ")]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every item longer than max_chars of its kind, with PIECES_SCHEMA.

    items: row_id, kind, text, intro, children, wrap_up. limits: kind, max_chars, overlap_chars, one row per kind.

    Defined cases: an item of exactly max_chars, an empty or null one, a null kind and a kind without limit have no piece; repeated rows
    give repeated pieces; a null overlap is none, and more than half the limit counts as half; a null limit is none. Extra columns are
    not read. An empty table gives an empty table.
    """
    item = items.select("kind", *(F.col(c).cast("bigint" if c == "row_id" else "string").alias(c) for c in _IN[:5]))
    limit = limits.select("kind", F.col("max_chars").cast("int").alias("max_chars"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("overlap_chars"))
    size = lambda c: F.coalesce(F.length(c) + 1, F.lit(0))
    # The JSON of the children is longer than they read, so this bound keeps every oversized item and few others.
    at_most = F.coalesce(F.length("text"), size("intro") + size("children") + size("wrap_up"))
    return item.join(limit, "kind").where(at_most > F.col("max_chars")).select(*_IN).mapInArrow(_cut, PIECES_SCHEMA)
