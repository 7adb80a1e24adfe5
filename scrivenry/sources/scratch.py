"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir.  Where that is unset, below a temporary folder of this machine if
    the session runs in one process; on a cluster that is an error, as each executor would write to its own disk."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        kept, master = spark.sparkContext._jsc.sc().getCheckpointDir(), spark.sparkContext.master
        if kept.isDefined():
            root = kept.get()
        elif master.startswith("local") and not master.startswith("local-cluster"):
            root = "file://" + tempfile.mkdtemp(prefix="scrivenry-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def ends_with_session(spark: SparkSession, path: str) -> str:
    """Have a path that exists deleted when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut, and the table goes when the application ends."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(ends_with_session(df.sparkSession, path))
