"""Python over many small groups, in whole batches.

A grouped Arrow function is called once per group, which costs about a millisecond each; acts have millions of articles. Here rows are
clustered by key and sorted within partitions, batches go to Python as they come, and groups are cut out of them there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], function: Callable[[list[dict]], Iterable[dict]], schema: str, arrow: pa.Schema, batch_rows: int = 10_000) -> DataFrame:
    """The rows that function makes of each group of rows (as dicts, in order). A task holds one group at a time, however many it has."""
    names = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        out: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and any(row[k] != group[0][k] for k in names):
                    out.extend(function(group))
                    group = []
                    if len(out) >= batch_rows:
                        yield from pa.Table.from_pylist(out, schema=arrow).to_batches()
                        out = []
                group.append(row)
        if group:
            out.extend(function(group))
        yield from pa.Table.from_pylist(out, schema=arrow).to_batches()

    return df.repartition(*names).sortWithinPartitions(*names, *order).mapInArrow(run, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores, by hash of keys, if it is too small to be read by as many tasks as there are cores; else as it lies.

    For work that costs far more than moving a row. What counts is the optimizer's estimate of the size, so no files are listed and
    nothing is run. Large tables have partitions enough and aren't moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    task = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(2 * cores, *keys) if estimate < cores * task else df
