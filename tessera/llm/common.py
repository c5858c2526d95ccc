"""Shared plumbing of the text operators: table reading and tables saved in the shared folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
LOCAL_SHARED_DIR = "/tmp/checkpoints"

#: Rows of a table of narrow rows (ids, labels) that one task writes where a bound of its rows is known.
TASK_ROWS = 1_000_000

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the synthetic tables, through Spark's reader (the path may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a local one where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED_DIR).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tessera-{label}-{uuid.uuid4().hex}"


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and what was
    computed outlives the executors that computed it."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Saved tables of one operator's run that nothing needs once its result is saved; dropped when the block ends, also by an error."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.folder, self.n = spark, new_path(spark, label), 0

    def save(self, df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
        """df saved. With `rows`, a bound of its rows, no more tasks write it than these need: a small table
        is not cut into a file for each part of a shuffle; a large one keeps the shuffle's parts."""
        self.n += 1
        path = f"{self.folder}/{self.n}-{label}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_saved(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete the folders behind frames made by save() once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for df in frames for name in df.inputFiles()}:
        if "/tessera-" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the quick way where every character is ASCII."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def remainder(doc_id: str = "doc_id", modulus: int = 4) -> Column:
    """crc32 of the id as text, modulo; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus, F.lit(0))
