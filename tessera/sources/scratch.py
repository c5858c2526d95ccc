"""Tables of one operator's run, saved in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder and Spark runs in one process, as in local tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"


class Scratch:
    """Saved tables that nothing needs once the block ends; dropped then, also by an error."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        self.spark, self.n = spark, 0
        self.folder = f"{(named or LOCAL_SHARED_DIR).rstrip('/')}/tessera-{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame) -> DataFrame:
        """df written as Parquet and read back: passes over it don't compute it again, nor does a lost executor."""
        self.n += 1
        df.write.parquet(f"{self.folder}/{self.n}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{self.n}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def keep(df: DataFrame, label: str = "kept") -> DataFrame:
    """df saved in the shared folder for results that read it later; it stays until drop() or the folder is emptied."""
    return Scratch(df.sparkSession, label).save(df)


def drop(*frames: DataFrame) -> None:
    """Delete what keep() saved, once nothing reads it any more."""
    for folder in {name.rsplit("/", 2)[0] for df in frames for name in df.inputFiles()}:
        if "/tessera-" in folder:
            path = frames[0].sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(frames[0].sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
