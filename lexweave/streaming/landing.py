"""Incremental runs: only what isn't done yet, and files as they land.

The reference engine works on files at hand; streaming is an addition that runs the same batch stages on every micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


def not_done(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key isn't in done; rows with a null key are kept."""
    return new.join(done.select(key).distinct(), key, "left_anti")


def run_landed(spark: SparkSession, folder: str, schema: str, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch stage to parquet files as they land in a folder, and appends its results to a table of parquet files.

    Each micro-batch is written under its number, so one that is run again after a failure overwrites its own files and nothing is
    doubled. The query ends when all landed files are done.
    """

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    landed = spark.readStream.schema(schema).parquet(folder)
    return landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
