"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a local one only where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        hadoop = spark.sparkContext._jsc.sc().getCheckpointDir()
        if hadoop.isDefined():
            return hadoop.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="ledgerlark-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at


def new_path(spark: SparkSession, what: str) -> str:
    """A path of its own for a table or file of this run."""
    return f"{shared_dir(spark)}/ledgerlark/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cuts the lineage: the frame as a table in the shared folder. For results that several branches read."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> None:
    """Deletes the tables that ``written`` left in the shared folder; results that read them must be done with."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/ledgerlark")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
