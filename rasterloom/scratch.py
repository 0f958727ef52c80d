"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; without one, only a local master has a folder that all its tasks see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rasterloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame) -> DataFrame:
    """Written as a compressed table in the shared folder, and read from there: lineage ends here. `forget` removes it."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's path in the shared one, for logs and checkpoints; `drop_written` removes it."""
    return f"{_own_dir(spark)}/{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/rasterloom-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(*tables: DataFrame) -> None:
    """Removes tables that `written` has made and all of whose readers are written themselves."""
    for t in tables:
        _delete(t.sparkSession, t.written_at)


def drop_written(spark: SparkSession) -> None:
    """Removes what `written` has left in this application's folder; DataFrames that read it can't be used afterwards."""
    _delete(spark, _own_dir(spark))
