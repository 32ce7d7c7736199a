"""Tables between the steps of a job, in the folder that driver and executors share.

A step that must not be evaluated twice, or whose partitions later steps name, is written and read again: lineage ends
there, and a lost executor repeats tasks of one step only. Tables of a session lie in one folder, which `clear` deletes
when their readers are done."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder if the session runs on this machine alone."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def session_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tracewell-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, read from a table of the session's folder."""
    path = f"{session_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of this session; results that read them must have been written or read before."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
