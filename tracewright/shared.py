"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and an error on a cluster."""
    global _own_dir
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tracewright-")
    return _own_dir


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back."""
    path = f"{shared_dir(df.sparkSession)}/tracewright/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stash() wrote for df, which nothing may read any more: a loop's last round once the next one is written."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stash_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
