"""Session helpers shared by the operators, tests and the bench."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "lexweave") -> SparkSession:
    """A local session for tests and the bench; on a cluster the submitter's session is used instead."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEXWEAVE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever their working folder is."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [x for x in environment.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    return spark


def shared_checkpoint_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a fresh local one only where it is unset and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lexweave-checkpoint-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session is already gone; the cluster clears its folder
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table written to the shared checkpoint folder and read back.

    Unlike checkpoint() it computes df once and keeps it columnar; a lost executor costs no recomputation of what lies before. The
    table is removed when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_checkpoint_dir(spark).rstrip('/')}/lexweave-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    atexit.register(_forget, spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder."""
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")
