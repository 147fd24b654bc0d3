"""Acts as files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_acts(documents: DataFrame, column: str, folder: str, compression: str = "none", acts_per_file: bool = True) -> None:
    """Acts as text. documents: act_id, part and the column.

    With acts_per_file, one folder per act, whose files are its parts in order, for as many acts as a file system bears. Without, parquet
    files of many acts each (act_id, part and the document), in order of act and part.
    """
    keyed = documents.select("act_id", "part", column)
    if acts_per_file:
        keyed.repartitionByRange("act_id", "part").sortWithinPartitions("act_id", "part").select("act_id", column).write.mode("overwrite").partitionBy("act_id").option("compression", compression).text(folder)
    else:
        keyed.repartitionByRange("act_id", "part").sortWithinPartitions("act_id", "part").write.mode("overwrite").parquet(folder)


def write_table(df: DataFrame, folder: str, mode: str = "append") -> None:
    """A table of parquet files, appended by default."""
    df.write.mode(mode).parquet(folder)
