"""Encoding a corpus with a public byte-level BPE vocabulary.

Texts of ordinary length are encoded where they lie, by one Arrow UDF and without a shuffle. A long text would keep one task busy, so it
is cut into leaves that are encoded in parallel and concatenated as a tree:

* between two pre-tokens a cut is exact, and leaves end there wherever such a place exists;
* a pre-token longer than a leaf (no blank, no change of character class) is halved until its parts are leaves. At every join the last
  tokens of the left part and the first of the right are encoded again together, in a window that doubles until its outermost tokens
  are those the two sides had there. In byte-pair encoding a sequence is the encoding of its bytes if each two neighbours are that of
  theirs; inside the sides and inside the window they are, and the two agreed tokens link them, so the result is exact.

Special tokens are never produced: a marker string inside a text is ordinary text. Null and empty texts have the empty list.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which this vocabulary splits text before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut; leaves hold about as many.
LONG_CHARS = 16_384
LEAF_CHARS = 8_192


class Tokenizer(NamedTuple):
    """Where a vocabulary lies; small enough to go with every task."""

    folder: str = TOKENIZER_DIR
    file: str = VOCABULARY
    pattern: str = PRE_TOKENS


@functools.lru_cache(maxsize=4)
def encoding(tok: Tokenizer) -> tiktoken.Encoding:
    """The vocabulary, read once per worker process."""
    with open(os.path.join(tok.folder, tok.file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(tok.file, pat_str=tok.pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _splitter(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


class Leaf(NamedTuple):
    """A stretch of a text. run numbers the halves of one long pre-token; whole stretches have -1."""

    seq: int
    run: int
    text: str


def leaves(text: str, pattern: str = PRE_TOKENS, leaf_chars: int = LEAF_CHARS) -> Iterator[Leaf]:
    """Cut a text at pre-token boundaries into leaves of about leaf_chars, and longer pre-tokens into halves of halves."""
    seq, start, last, end, runs = 0, 0, 0, 0, 0
    for m in _splitter(pattern).finditer(text):
        a, b = m.span()
        if b - a > leaf_chars:
            # Blanks before the cut would run together if the leaf ended in two pre-tokens of them, so the last stands alone.
            ends = [last, a] if a > start and text[a - 1].isspace() else [a]
            for e in ends:
                if e > start:
                    yield Leaf(seq, -1, text[start:e])
                    seq, start = seq + 1, e
            parts = 1
            while (b - a) > parts * leaf_chars:
                parts *= 2
            cuts = [a + (b - a) * i // parts for i in range(parts + 1)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x:
                    yield Leaf(seq, runs, text[x:y])
                    seq += 1
            runs += 1
            start = b
        elif a - start >= leaf_chars and not text[a - 1].isspace():
            yield Leaf(seq, -1, text[start:a])
            seq, start = seq + 1, a
        last = a
        end = b
    if end > start:
        yield Leaf(seq, -1, text[start:end])


def encode_leaf(leaf_text: str, run: int, tok: Tokenizer = Tokenizer()) -> list[int]:
    """Tokens of a leaf; part of a long pre-token is merged as it stands, without splitting."""
    enc = encoding(tok)
    return enc.encode_ordinary(leaf_text) if run < 0 else enc._encode_single_piece(leaf_text)


def join_runs(left: list[int], right: list[int], tok: Tokenizer = Tokenizer(), window: int = 8) -> list[int]:
    """The encoding of two neighbouring parts of one pre-token, from theirs."""
    if not left or not right:
        return left + right
    enc = encoding(tok)
    while True:
        a, b = max(0, len(left) - window), min(len(right), window)
        again = enc._encode_single_piece(enc.decode_bytes(left[a:]) + enc.decode_bytes(right[:b]))
        if (a == 0 or again[0] == left[a]) and (b == len(right) or again[-1] == right[b - 1]):
            return left[:a] + again + right[b:]
        window *= 2


def concatenate(parts: Iterable[tuple[int, list[int]]], tok: Tokenizer = Tokenizer()) -> list[int]:
    """Tokens of a whole text from (run, tokens) of its leaves in order; the parts of a run are joined pairwise, level by level."""
    done: list[int] = []
    run, level = -1, []

    def close() -> None:
        nonlocal level
        while len(level) > 1:
            level = [join_runs(level[i], level[i + 1], tok) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        done.extend(level[0] if level else [])
        level = []

    for r, ids in parts:
        if r != run:
            close()
            run = r
        if r < 0:
            done.extend(ids)
        else:
            level.append(ids)
    close()
    return done


def _list_array(lists: Iterable[list[int]]) -> pa.Array:
    values = [np.asarray(x, dtype=np.int32) for x in lists]
    offsets = np.zeros(len(values) + 1, dtype=np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int32)))


def encode_column(text: Column, tok: Tokenizer = Tokenizer()) -> Column:
    """Token ids of each text, encoded in one piece."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(tok)
        return _list_array(enc.encode_ordinary(t) if t else [] for t in texts.to_pylist())

    return ids(text)


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tok: Tokenizer = Tokenizer(), long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and n_tokens of every row; null and empty texts have none, long ones are counted by their leaves.

    A map and not a column: filters on the count would be pushed below a column and have every text encoded twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tok)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int32())], names=["doc_id", "n_tokens"])

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = plain.where(~is_long).mapInArrow(run, "doc_id bigint, n_tokens int")
    return short.unionByName(_long_ids(plain.where(is_long), tok, leaf_chars).select("doc_id", F.size("ids").alias("n_tokens")))


def _long_ids(long: DataFrame, tok: Tokenizer, leaf_chars: int) -> DataFrame:
    """(doc_id, ids) of long texts: leaves, encoded apart, concatenated as a tree."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = list(leaves(text.as_py(), tok.pattern, leaf_chars))
                yield pa.record_batch([pa.array([doc] * len(found), pa.int64()), pa.array([key] * len(found), pa.int64()), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True))], names=["doc_id", "key", "seq", "run", "leaf"])

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array, runs: pa.Array) -> pa.Array:
        return _list_array(encode_leaf(t, r, tok) for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def tree(parts: pa.Array) -> pa.Array:
        return _list_array(concatenate(((p["run"], p["ids"]) for p in ps), tok) for ps in parts.to_pylist())

    # Rows are known by where they lie, since document ids may occur twice; a lost task gives its rows the same keys again.
    keyed = long.select("doc_id", F.monotonically_increasing_id().alias("key"), "text")
    cut_up = keyed.mapInArrow(cut, "doc_id bigint, key bigint, seq int, run int, leaf string")
    # A text's leaves lie in one input partition; without this exchange one task would encode them all.
    spread = cut_up.repartition(F.col("key"), F.col("seq"))
    encoded = spread.select("doc_id", "key", "seq", "run", ids("leaf", "run").alias("ids"))
    gathered = encoded.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("seq", "run", "ids"))).alias("parts"))
    return gathered.select("doc_id", tree("parts").alias("ids"))


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tok: Tokenizer = Tokenizer(), long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids of every row of docs.

    Defined cases: null and empty texts have the empty list; blank texts their tokens; marker strings are ordinary text; rows with equal
    texts have equal lists; rows of one id are encoded each; extra columns are not read. An empty table gives an empty table.
    """
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = plain.where(~is_long).select("doc_id", encode_column(F.col("text"), tok).alias("ids"))
    return short.unionByName(_long_ids(plain.where(is_long), tok, leaf_chars))
