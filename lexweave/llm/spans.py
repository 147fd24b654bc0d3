"""Long exact spans shared between records, by level-wise doubling.

Windows of a quarter of the least length are looked up first; only where one also occurs in another record are windows of twice the
length made, and of those that recur again windows of the full length. Each level is one aggregation by window hash (the least and the
greatest record of a hash tell whether there are two) and one semi-join back, so no list of the records sharing a window is ever made,
however many they are, and adaptive execution may split the rows of a window that very many share. The levels end where no candidate
survives. `longest_shared` goes on doubling beyond the least length until none does.

Below the full length not every window is looked up but, of the windows inside each stretch of twice the length, the one with the least
hash. That choice depends on the stretch alone, so two records that share the stretch share the window: nothing is lost, and about a
sixteenth of the windows of the first level, and a thirtieth of those of the second, is shuffled.

Equal bodies are grouped before: copies are shared as a whole and take part in the levels as one. Bodies are known by two 64-bit hashes;
their text is shuffled once to be grouped and once a level to meet its candidates, never to be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import cut_lineage

MIN_LENGTH = 120
#: Characters hashed together; a longer body is hashed by itself.
CHUNK_CHARS = 500_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[:1] = 1
    return np.cumprod(out)


class Hasher:
    """Window hashes of a chunk of text, of any length, from prefix sums of a polynomial modulo 2**64."""

    BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

    def __init__(self, text: str, which: int = 0):
        base = self.BASES[which]
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(_U)
        values = _mix(codes + _U(0x632BE59BD9B4E019 + which))
        self.back = _powers(pow(base, -1, 1 << 64), len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, dtype=_U)
        np.cumsum(values * _powers(base, len(codes)), out=self.sums[1:])

    def windows(self, length: int) -> np.ndarray:
        """The hash of the window that begins at each position."""
        return _mix((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def lengths(min_length: int) -> tuple[int, int, int]:
    """The lengths of the levels; each is at most twice the one before."""
    return -(-min_length // 4), -(-min_length // 2), min_length


class Chunk(NamedTuple):
    """Rows of one batch whose bodies are hashed together; starts has the offsets of the bodies in text."""

    rows: slice
    text: str
    starts: np.ndarray
    sizes: np.ndarray


def _chunks(bodies: list[str]) -> Iterator[Chunk]:
    sizes = np.array([len(b) for b in bodies], dtype=np.int64)
    at = 0
    while at < len(bodies):
        end, total = at + 1, int(sizes[at])
        while end < len(bodies) and total + sizes[end] <= CHUNK_CHARS:
            total += int(sizes[end])
            end += 1
        yield Chunk(slice(at, end), "".join(bodies[at:end]), np.r_[0, np.cumsum(sizes[at:end])][:-1], sizes[at:end])
        at = end


def _owners(chunk: Chunk, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the body, offset in the text) of every window of a length that lies within one body."""
    n = np.maximum(chunk.sizes - length + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    first = np.r_[0, np.cumsum(n)][:-1]
    return owner, np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(chunk.starts, n)


def _least_windows(h: np.ndarray, at: np.ndarray, span: int) -> np.ndarray:
    """For stretches beginning at `at`: the position of the least of the first `span` window hashes, the leftmost of equal ones."""
    if not len(at):
        return at
    view = np.lib.stride_tricks.sliding_window_view(h, span)
    return at + np.concatenate([view[at[i : i + 50_000]].argmin(axis=1) for i in range(0, len(at), 50_000)])


_Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def _level(make: Callable[[Chunk, list], Iterator[_Found]], with_hits: bool, second: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, who = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            bodies = batch.column(2).to_pylist()
            hits = [np.asarray(x.values) for x in batch.column(3)] if with_hits else []
            for chunk in _chunks(bodies):
                owner, at, h = make(chunk, hits[chunk.rows])
                columns = [pa.array(ids[chunk.rows][owner]), pa.array(who[chunk.rows][owner]), pa.array((at - chunk.starts[owner]).astype(np.int32)), pa.array(h.astype(np.int64))]
                if second:
                    columns.append(pa.array(Hasher(chunk.text, 1).windows(second)[at].astype(np.int64) if len(at) else np.empty(0, np.int64)))
                yield pa.record_batch(columns, names=["body_id", "who", "pos", "h", "h2"][: len(columns)])

    return run


def _none() -> _Found:
    return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, _U)


def _marked(chunk: Chunk, hits: list) -> np.ndarray:
    mark = np.zeros(len(chunk.text) + 1, dtype=bool)
    for start, pos in zip(chunk.starts, hits, strict=True):
        mark[start + pos] = True
    return mark


def first_level(short: int, middle: int) -> Callable[[Chunk, list], _Found]:
    """The windows of length `short` with the least hash of a stretch of length `middle`."""

    def make(chunk: Chunk, _: list) -> _Found:
        owner, at = _owners(chunk, middle)
        if not len(at):
            return _none()
        h = Hasher(chunk.text).windows(short)
        least = _least_windows(h, at, middle - short + 1)
        first = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]
        return owner[first], least[first], h[least[first]]

    return make


def second_level(short: int, middle: int, full: int) -> Callable[[Chunk, list], _Found]:
    """The windows of length `middle` with the least hash of a stretch of length `full`, of which the least short windows recur."""

    def make(chunk: Chunk, hits: list) -> _Found:
        owner, at = _owners(chunk, full)
        if not len(at):
            return _none()
        hasher, mark = Hasher(chunk.text), _marked(chunk, hits)
        h = hasher.windows(short)
        # Of a stretch both the first and the last part of `middle` characters must have a short window that recurs.
        inside = mark[_least_windows(h, at, middle - short + 1)] & mark[_least_windows(h, at + full - middle, middle - short + 1)]
        owner, at = owner[inside], at[inside]
        if not len(at):
            return _none()
        h = hasher.windows(middle)
        least = _least_windows(h, at, full - middle + 1)
        first = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])]
        return owner[first], least[first], h[least[first]]

    return make


def third_level(middle: int, full: int) -> Callable[[Chunk, list], _Found]:
    """The windows of full length of which the least middle window recurs."""

    def make(chunk: Chunk, hits: list) -> _Found:
        owner, at = _owners(chunk, full)
        if not len(at):
            return _none()
        hasher = Hasher(chunk.text)
        keep = _marked(chunk, hits)[_least_windows(hasher.windows(middle), at, full - middle + 1)]
        return owner[keep], at[keep], hasher.windows(full)[at[keep]]

    return make


def doubled_level(half: int, full: int) -> Callable[[Chunk, list], _Found]:
    """The windows of length `full` of which both halves recur."""

    def make(chunk: Chunk, hits: list) -> _Found:
        owner, at = _owners(chunk, full)
        if not len(at):
            return _none()
        mark = _marked(chunk, hits)
        keep = mark[at] & mark[at + full - half]
        return owner[keep], at[keep], Hasher(chunk.text).windows(full)[at[keep]]

    return make


def _none_left(found: DataFrame) -> bool:
    """Has a written level no candidate?"""
    return found.isEmpty()


def _recurring(windows: DataFrame, keys: list[str]) -> DataFrame:
    """body_id and the positions of its windows that occur in another record too."""
    common = windows.groupBy(*keys).agg(F.min("who").alias("least"), F.max("who").alias("greatest")).where("least <> greatest").select(*keys)
    return windows.join(common, keys, "left_semi").groupBy("body_id").agg(F.collect_set("pos").alias("hits"))


def _merge(min_length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans from the positions of shared windows: the longest runs of characters that one of them covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for body_id, hits in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pos = np.sort(np.asarray(hits.values)).astype(np.int64)
                new = np.flatnonzero(np.r_[True, pos[1:] > pos[:-1] + min_length])
                ids += [body_id] * len(new)
                starts += pos[new].tolist()
                ends += (pos[np.r_[new[1:] - 1, len(pos) - 1]] + min_length).tolist()
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (ids, starts, ends)], names=["body_id", "start_pos", "end_pos"])

    return run


def shared_spans(elements: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(act_id, element_id, start_pos, end_pos, body_chars): the shared spans of every element's body.

    elements: act_id, element_id, text, intro; the body is text, or intro if text is null. A character is shared if it lies in a stretch
    of at least min_length characters that also stands in the body of another element. Rows of one (act_id, element_id) are one element.

    Defined cases: null, empty and shorter bodies have no span; rows without act_id or element_id are elements by the null; repeated
    rows change nothing; an element delivered with different bodies has the spans of each; equal bodies of different elements are
    shared as a whole; extra columns are not read; an empty table gives none. Bodies, and windows of the full length, are told apart by
    two independent 64-bit hashes.
    """
    if min_length < 8:
        raise ValueError("the least length is 8")
    rows, bodies = _bodies(elements, min_length)
    spans = _levels(bodies, min_length).mapInArrow(_merge(min_length), "body_id bigint, start_pos bigint, end_pos bigint")
    keys = bodies.select("body_id", "k1", "k2", "single", "body_chars")
    whole = keys.where("NOT single").select("k1", "k2", F.lit(0).cast("bigint").alias("start_pos"), F.col("body_chars").alias("end_pos"), "body_chars")
    partial = keys.where("single").join(spans, "body_id").select("k1", "k2", "start_pos", "end_pos", "body_chars")
    return rows.join(partial.unionByName(whole), ["k1", "k2"]).select("act_id", "element_id", "start_pos", "end_pos", "body_chars").distinct()


_WINDOWS = "body_id bigint, who bigint, pos int, h bigint"


def _bodies(elements: DataFrame, min_length: int) -> tuple[DataFrame, DataFrame]:
    """The elements' keys with the two hashes of their bodies, and the distinct bodies, written: body_id, who, body, single, k1, k2,
    body_chars."""
    body = F.coalesce(F.col("text").cast("string"), F.col("intro").cast("string"))
    plain = elements.select(F.col("act_id").cast("string").alias("act_id"), F.col("element_id").cast("string").alias("element_id"), body.alias("body")).where(F.length("body") >= min_length)
    hashed = plain.select("act_id", "element_id", F.xxhash64("body").alias("k1"), F.xxhash64(F.lit("other"), F.reverse("body")).alias("k2"), "body")
    element = F.struct("act_id", "element_id")
    # Equal bodies are combined before the one shuffle of the texts.
    by_body = hashed.groupBy("k1", "k2").agg(F.min(element).alias("one"), F.max(element).alias("other"), F.any_value("body").alias("body"))
    own = F.xxhash64(F.isnull("one.act_id"), "one.act_id", F.isnull("one.element_id"), "one.element_id")
    # A body of several elements counts as a record of its own, other than each of them.
    single = F.col("one").eqNullSafe(F.col("other"))
    who = F.when(single, own).otherwise(F.xxhash64(F.lit("copies"), "k1", "k2"))
    bodies = by_body.select(F.monotonically_increasing_id().alias("body_id"), who.alias("who"), "body", single.alias("single"), "k1", "k2", F.length("body").cast("bigint").alias("body_chars"))
    return hashed.select("act_id", "element_id", "k1", "k2").distinct(), cut_lineage(bodies)


def _levels(bodies: DataFrame, min_length: int) -> DataFrame:
    """body_id and hits: the positions of the windows of min_length that recur in another record."""
    short, middle, full = lengths(min_length)
    plain = bodies.select("body_id", "who", "body")
    found = cut_lineage(plain.mapInArrow(_level(first_level(short, middle), False, 0), _WINDOWS))
    for make, second in ((second_level(short, middle, full), 0), (third_level(middle, full), full)):
        if _none_left(found):
            break
        found = cut_lineage(plain.join(_recurring(found, ["h"]), "body_id").mapInArrow(_level(make, True, second), _WINDOWS + (", h2 bigint" if second else "")))
    if "h2" not in found.columns:
        found = found.withColumn("h2", F.lit(0).cast("bigint")).limit(0)
    return _recurring(found, ["h", "h2"])


def longest_shared(elements: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(act_id, element_id, shared_length): the greatest of min_length, twice that, four times that, … at which a stretch of the element's
    body also stands in another element. Bodies of several elements count with the greatest that fits into them.

    Doubling goes on until no window is left to be extended; a length is reached only where both halves of a window recur. Defined cases
    are those of shared_spans; elements that share nothing have no row.
    """
    rows, bodies = _bodies(elements, min_length)
    plain = bodies.select("body_id", "who", "body")
    hits, length = cut_lineage(_levels(bodies, min_length)), min_length
    reached = hits.select("body_id", F.lit(length).cast("bigint").alias("shared_length"))
    while not _none_left(hits):
        found = cut_lineage(plain.join(hits, "body_id").mapInArrow(_level(doubled_level(length, 2 * length), True, 2 * length), _WINDOWS + ", h2 bigint"))
        hits, length = cut_lineage(_recurring(found, ["h", "h2"])), 2 * length
        reached = reached.unionByName(hits.select("body_id", F.lit(length).cast("bigint").alias("shared_length")))
    # A body that several elements have is shared whole.
    fits = F.expr(f"cast({min_length} * power(2, floor(log2(body_chars / {min_length}))) as bigint)")
    whole = bodies.where("NOT single").select("k1", "k2", fits.alias("shared_length"))
    partial = bodies.where("single").join(reached, "body_id").select("k1", "k2", "shared_length")
    return rows.join(partial.unionByName(whole), ["k1", "k2"]).groupBy("act_id", "element_id").agg(F.max("shared_length").alias("shared_length"))


def shared_shares(elements: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """How much of each element's body is shared: act_id, element_id, shared_chars, body_chars and their ratio."""
    by = shared_spans(elements, min_length).groupBy("act_id", "element_id", "body_chars").agg(F.sum(F.col("end_pos") - F.col("start_pos")).alias("shared_chars"))
    return by.withColumn("share", F.col("shared_chars") / F.col("body_chars"))
