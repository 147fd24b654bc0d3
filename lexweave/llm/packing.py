"""Filling containers of fixed capacity with documents.

Vector bin packing: every piece takes room in three dimensions (tokens, segments, loss-bearing tokens), a container is full when one of
them is. A container is filled by the dot-product heuristic: of the pieces that still fit, take the one whose size vector has the
largest product with what is left, each dimension weighted by the corpus' demand for it. Pieces of equal size are interchangeable, so
the choice is among distinct sizes, not pieces.

Blocks of pieces are packed where they lie, without a shuffle. Only the pieces of containers that stayed slack are gathered once more
into fewer, larger blocks and packed again, so slack doesn't add up over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.tokens import Tokenizer, count_tokens
from lexweave.session import cut_lineage


class Limits(NamedTuple):
    """What a container holds at most."""

    tokens: int = 2_048
    segments: int = 256
    loss_tokens: int = 2_048


#: Pieces packed together; bounds a task's memory and time whatever the partition's size.
BLOCK_PIECES = 50_000
#: A container with at least this share of its tokens used is kept after the first pass.
FULL_SHARE = 0.995
PIECES_SCHEMA = "doc_id bigint, piece_no int, start_token int, n_tokens int, loss_tokens int"
_COLUMNS = ("doc_id", "piece_no", "start_token", "n_tokens", "loss_tokens")


def pack_block(tokens: np.ndarray, loss: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """(container, slot) of every piece of a block; pieces must fit an empty container.

    The order of pieces doesn't matter but for ties, which go to the earlier one.
    """
    n = len(tokens)
    container, slot = np.empty(n, np.int64), np.empty(n, np.int32)
    if not n:
        return container, slot
    width = int(limits.loss_tokens) + 1
    order = np.argsort(-(tokens.astype(np.int64) * width + loss), kind="stable")
    key = tokens.astype(np.int64)[order] * width + loss[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size_t, size_l = tokens[order][first].astype(np.int64), loss[order][first].astype(np.int64)
    left = np.diff(np.r_[first, n])
    at = first.copy()
    cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.float64)
    demand = np.array([tokens.sum(), n, loss.sum()], dtype=np.float64) / cap
    weight = demand / demand.max() / cap**2
    a, b, c = weight[0] * size_t, weight[1], weight[2] * size_l
    bin_no, placed = 0, 0
    live = np.arange(len(size_t))
    while placed < n:
        rt, rs, rl = limits.tokens, limits.segments, limits.loss_tokens
        k = 0
        while rs > 0:
            fit = live[np.searchsorted(-size_t[live], -rt, side="left") :]
            if len(fit) and size_l[fit].max() > rl:
                fit = fit[size_l[fit] <= rl]
            if not len(fit):
                break
            j = fit[np.argmax(a[fit] * rt + b * rs + c[fit] * rl)]
            i = order[at[j]]
            container[i], slot[i] = bin_no, k
            at[j] += 1
            left[j] -= 1
            if not left[j]:
                live = live[live != j]
            rt, rs, rl, k, placed = rt - int(size_t[j]), rs - 1, rl - int(size_l[j]), k + 1, placed + 1
        bin_no += 1
    return container, slot


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while batch.num_rows:
            take = min(batch.num_rows, block - rows)
            held.append(batch.slice(0, take))
            batch, rows = batch.slice(take), rows + take
            if rows == block:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _pack(pieces: DataFrame, limits: Limits, level: int, block: int) -> DataFrame:
    """Adds container_id, slot and fill; the id is level, partition and number, alike whenever a lost partition is made again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = (level << 56) + (TaskContext.get().partitionId() << 32), 0
        for table in _blocks(batches, block):
            tokens, loss = (table.column(c).to_numpy().astype(np.int64) for c in ("n_tokens", "loss_tokens"))
            container, slot = pack_block(tokens, loss, limits)
            fill = np.bincount(container, weights=tokens).astype(np.int32)[container] if len(container) else np.empty(0, np.int32)
            out = table.append_column("container_id", pa.array(base + done + container)).append_column("slot", pa.array(slot)).append_column("fill", pa.array(fill))
            done += int(container.max()) + 1
            yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    return pieces.select(*_COLUMNS).mapInArrow(run, PIECES_SCHEMA + ", container_id bigint, slot int, fill int")


def cut_pieces(sizes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of (doc_id, n_tokens, loss_tokens): a document is one piece, or as few as its capacity allows if it exceeds it alone.

    The loss-bearing tokens of a cut document are taken as its last ones. Documents without tokens have no piece.
    """
    room = limits.tokens if limits.loss_tokens >= limits.tokens else limits.loss_tokens
    fits = (F.col("n_tokens") <= limits.tokens) & (F.col("loss_tokens") <= limits.loss_tokens)
    step = F.when(fits, F.col("n_tokens")).otherwise(F.lit(room))
    start = F.explode(F.sequence(F.lit(0), F.col("n_tokens") - 1, step))
    with_start = sizes.where("n_tokens > 0").select("doc_id", "n_tokens", "loss_tokens", step.alias("step"), start.alias("start_token"))
    n = F.least(F.col("step"), F.col("n_tokens") - F.col("start_token"))
    before_loss = F.col("n_tokens") - F.col("loss_tokens")
    loss = F.greatest(F.lit(0), F.col("start_token") + n - F.greatest(F.col("start_token"), before_loss))
    return with_start.select("doc_id", F.expr("cast(start_token div step as int)").alias("piece_no"), "start_token", n.cast("int").alias("n_tokens"), loss.cast("int").alias("loss_tokens"))


def pack(sizes: DataFrame, limits: Limits = Limits(), block: int = BLOCK_PIECES, full_share: float = FULL_SHARE) -> DataFrame:
    """Containers of (doc_id, n_tokens, loss_tokens) rows: container_id, slot, doc_id, piece_no, start_token, n_tokens, loss_tokens.

    Defined cases: null and non-positive sizes need no place; null loss_tokens are all tokens; more loss than tokens counts as all;
    repeated rows are placed each; an empty table gives no container. Every token lands exactly once, no container exceeds a limit.
    """
    clean = sizes.select("doc_id", F.coalesce(F.col("n_tokens"), F.lit(0)).cast("int").alias("n_tokens"), F.col("loss_tokens"))
    clean = clean.select("doc_id", "n_tokens", F.greatest(F.lit(0), F.least(F.coalesce(F.col("loss_tokens"), F.col("n_tokens")), F.col("n_tokens"))).cast("int").alias("loss_tokens"))
    # Both the kept and the slack containers are read from this; it is small (no texts) and must be the same for both.
    first = cut_lineage(_pack(cut_pieces(clean, limits), limits, 0, block))
    kept = F.col("fill") >= int(full_share * limits.tokens)
    slack = first.where(~kept).select(*_COLUMNS)
    again = _pack(slack.repartition(F.col("doc_id"), F.col("piece_no")), limits, 1, 4 * block)
    return first.where(kept).unionByName(again).select("container_id", "slot", "doc_id", "piece_no", "start_token", "n_tokens", "loss_tokens")


def pack_documents(docs: DataFrame, limits: Limits = Limits(), tok: Tokenizer = Tokenizer()) -> DataFrame:
    """Containers of whole documents; every token of plain text bears loss. Null, empty texts need no place."""
    sized = count_tokens(docs, tok=tok)
    return pack(sized.withColumn("loss_tokens", F.col("n_tokens")), limits)


#: Limits of instruction data: few examples to a container, and only answers bear loss.
INSTRUCTION_LIMITS = Limits(tokens=2_048, segments=4, loss_tokens=1_536)


def pack_instructions(docs: DataFrame, limits: Limits = INSTRUCTION_LIMITS, tok: Tokenizer = Tokenizer(), prompt: str = r"^[^\n]*\n?") -> DataFrame:
    """Containers of examples: what the pattern matches at a text's beginning (its first line) is the prompt, whose tokens bear no loss.

    Defined cases: null and empty texts need no place; a text that is all prompt bears no loss; the prompt is counted by itself and never
    with more tokens than the whole; repeated rows of one doc_id are placed each.
    """
    # Counting makes one row of each; the prompt's count meets its text's by the row's place, since ids may occur twice.
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    whole = count_tokens(keyed, "key", tok=tok).withColumnRenamed("doc_id", "key")
    heads = keyed.select("key", F.regexp_extract("text", prompt, 0).alias("head"))
    head = count_tokens(heads, "key", "head", tok=tok).select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("head_tokens"))
    sized = whole.join(head, "key").join(keyed.select("key", "doc_id"), "key")
    return pack(sized.select("doc_id", "n_tokens", (F.col("n_tokens") - F.least("n_tokens", "head_tokens")).alias("loss_tokens")), limits)
