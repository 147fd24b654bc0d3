"""Running values over very long ordered groups.

A window over a whole act, or a whole gazette, would put each group into one task, however long it is. Here a group is cut into blocks of
consecutive rows: values run within the blocks, in parallel, and the few totals of the blocks run over the group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000


def _blocks(df: DataFrame, keys: Sequence[str], order: str, block_rows: int) -> DataFrame:
    """Keys and block as one struct, in which nulls equal each other: window, totals and join share one partitioning."""
    return df.withColumn("_k", F.struct(*keys, F.floor(F.col(order) / block_rows).alias("_block")))


def _before(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sum of a group's blocks before each; totals: _k, _total, of every block."""
    group = Window.partitionBy(*(F.col("_k")[k] for k in keys)).orderBy(F.col("_k")["_block"]).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_k", F.coalesce(F.sum("_total").over(group), F.lit(0)).alias("_before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, inclusive: bool = True, block_rows: int = BLOCK_ROWS, also: Mapping[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """Adds `name`: the sum of value over the rows of a group before (and at, if inclusive) each row. order is an integer, dense or nearly.

    also: further columns over the same blocks, which see no row of another block.

    Defined cases: null values count 0; null keys are a group; rows of equal order take the whole of their ties' sum or none of it; an
    empty table stays empty.
    """
    block = _blocks(df.withColumn("_value", F.coalesce(value, F.lit(0)).cast("bigint")), keys, order, block_rows)
    within = Window.partitionBy("_k").orderBy(order)
    ties = F.lit(0) if inclusive else F.sum("_value").over(within.rangeBetween(0, 0))
    here = block.select(*df.columns, "_k", (F.sum("_value").over(within.rangeBetween(Window.unboundedPreceding, 0)) - ties).alias("_within"), *(f(within).alias(c) for c, f in (also or {}).items()))
    before = _before(block.groupBy("_k").agg(F.sum("_value").alias("_total")), keys)
    return here.join(before, "_k").select(*(f"`{c}`" for c in df.columns), (F.col("_within") + F.col("_before")).alias(name), *(also or {}))


def running_count(df: DataFrame, keys: Sequence[str], order: str, marks: DataFrame, name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `name`, the number of marks at or before each row, and the marks' further columns where a row has one.

    marks: keys, order and further columns, at most one row for each row of df. The totals come from the marks; of df only keys and
    order are read for them.
    """
    more = [c for c in marks.columns if c not in (*keys, order)]
    m = marks.select(F.struct(*keys).alias("_m"), F.col(order).alias("_at"), F.lit(1).alias("_one"), *more)
    block = _blocks(df, keys, order, block_rows).withColumn("_m", F.struct(*keys))
    marked = block.join(m, (block["_m"] == m["_m"]) & (F.col(order) == F.col("_at")), "left")
    within = Window.partitionBy("_k").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    here = marked.select(*df.columns, *more, "_k", F.coalesce(F.sum("_one").over(within), F.lit(0)).alias("_within"))
    every = _blocks(df.select(*keys, order), keys, order, block_rows).select("_k", F.lit(0).alias("_one"))
    own = _blocks(marks.select(*keys, order), keys, order, block_rows).select("_k", F.lit(1).alias("_one"))
    before = _before(every.unionByName(own).groupBy("_k").agg(F.sum("_one").alias("_total")), keys)
    return here.join(before, "_k").select(*(f"`{c}`" for c in df.columns), *more, (F.col("_within") + F.col("_before")).alias(name))


def previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Adds the values of the row with the next lower order, by a join on order instead of a window; orders must be dense."""
    before = df.select(*keys, (F.col(order) + 1).alias(order), *(F.col(c).alias(prefix + c) for c in columns))
    on = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys] + [F.col(f"x.{order}") == F.col(f"y.{order}")]
    return df.alias("x").join(before.alias("y"), on, "left").select(*(F.col(f"x.`{c}`") for c in df.columns), *(F.col(f"y.{prefix}{c}") for c in columns))
