"""Deeply nested records as flat, related tables.

Every element gets pre- and post-order numbers in one depth-first pass over its record (kernels.nested). The numbers alone carry the
hierarchy: a node is below another of the same record if its interval lies within the other's, so tables per kind can be joined by
containment without the paths. The pass is a map over records: nothing is shuffled and no record meets another.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.kernels.nested import label, link

NODES_SCHEMA = "record_id bigint, node_path string, parent_path string, kind string, identifier string, title string, text string, intro string, wrap_up string, pre int, post int, depth int, parent_pre int"
_ARROW = pa.schema([("record_id", pa.int64()), *((c, pa.string()) for c in ("node_path", "parent_path", "kind", "identifier", "title", "text", "intro", "wrap_up")), *((c, pa.int32()) for c in ("pre", "post", "depth", "parent_pre"))])
#: Nodes of one output batch; a batch is passed on as soon as it holds as many.
BATCH_NODES = 20_000


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
        out = pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, _ARROW, strict=True)], schema=_ARROW)
        rows.clear()
        return out

    for batch in batches:
        for record_id, children in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            nodes = label(children.as_py())
            for n, (path, above, depth, parent_pre) in zip(nodes, link(nodes), strict=True):
                rows.append((record_id, path, above, n.kind, n.identifier, n.title, n.text, n.intro, n.wrap_up, n.pre, n.post, depth, parent_pre))
            if len(rows) >= BATCH_NODES:
                yield flush()
    yield flush()


def flatten_nested(records: DataFrame, record_id: str = "record_id", children: str = "children") -> DataFrame:
    """One row per element below the root of each record, with NODES_SCHEMA.

    Defined cases: a null, empty or `[]` level has no elements; a level may be an array, one object, or a string of either; nulls and
    scalars in an array are no elements and take no place; a record with any unreadable level has none; `__type__` absent or null is
    `Paragraph`; a missing or null identifier is the empty string, other scalars are written as in JSON. Repeated rows give repeated
    nodes. Other columns of `records`, whatever their names, are not read.
    """
    plain = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(children).cast("string").alias("children"))
    return plain.where(F.col("children").isNotNull()).mapInArrow(_batches, NODES_SCHEMA)


def node_table(nodes: DataFrame, kind: str) -> DataFrame:
    """The table of one kind of element."""
    return nodes.where(F.col("kind") == kind)


def contains(outer: str, inner: str) -> Column:
    """Is the node of alias `inner` below the node of alias `outer`?"""
    return (F.col(f"{outer}.record_id") == F.col(f"{inner}.record_id")) & (F.col(f"{outer}.pre") < F.col(f"{inner}.pre")) & (F.col(f"{inner}.post") < F.col(f"{outer}.post"))


def link_tables(parents: DataFrame, children: DataFrame, any_depth: bool = False) -> DataFrame:
    """Parent–child (or ancestor–descendant) pairs of two node tables, by interval containment within a record."""
    on = contains("p", "c")
    if not any_depth:
        on = on & (F.col("c.parent_pre") == F.col("p.pre"))
    return parents.alias("p").join(children.alias("c"), on).select(
        F.col("c.record_id").alias("record_id"), F.col("p.node_path").alias("parent_path"), F.col("p.kind").alias("parent_kind"), F.col("p.identifier").alias("parent_identifier"),
        F.col("c.node_path").alias("node_path"), F.col("c.kind").alias("kind"), F.col("c.identifier").alias("identifier"),
    )
