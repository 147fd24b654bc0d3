"""Files as tables: text, JSON acts, gazette files. PDF pages need a reader that this package doesn't bring; it is a parameter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOXES_SCHEMA = "issue_id string, page_no int, x double, y double, width double, width_of_space double, content string, bold boolean"
_ARROW = pa.schema([("issue_id", pa.string()), ("page_no", pa.int32()), *((c, pa.float64()) for c in ("x", "y", "width", "width_of_space")), ("content", pa.string()), ("bold", pa.bool_())])


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name) and text, one row per file."""
    t = spark.read.text(folder, wholetext=True)
    return t.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("doc_id"), F.col("value").alias("text"))


def act_json_files(spark: SparkSession, folder: str) -> DataFrame:
    """act_id and children (JSON) of files with one act each, gzipped or not, as the nested-records operator reads them."""
    t = spark.read.text(folder, wholetext=True)
    return t.select(F.get_json_object("value", "$.identifier").alias("act_id"), F.get_json_object("value", "$.children").alias("children"))


def gazette_boxes(spark: SparkSession, folder: str, read_pdf: Callable[[bytes], Iterator[dict]]) -> DataFrame:
    """Positioned characters of PDF files, with BOXES_SCHEMA. read_pdf yields them as dicts (without issue_id) from a file's bytes.

    A file is the unit of a task's work; it is read where it lies and never sent to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = path.rsplit("/", 1)[-1]
                yield from pa.Table.from_pylist([{"issue_id": name} | b for b in read_pdf(content.as_py())], schema=_ARROW).to_batches(max_chunksize=20_000)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, BOXES_SCHEMA)
