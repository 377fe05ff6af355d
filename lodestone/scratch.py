"""Tables in the shared folder that the cluster names in spark.checkpoint.dir: the lineage ends there and survives a lost executor."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[str] = []
#: ``monotonically_increasing_id`` holds the number of the partition above this bit.
PARTITION_BITS = 33


def scratch(spark: SparkSession) -> str:
    """The shared folder; where none is named, as in tests, one of our own, in local mode only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file:///tmp/checkpoints/lodestone-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses."""
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def at_exit(spark: SparkSession, at: str) -> None:
    """Delete a folder that exists when the driver ends."""
    path, fs = filesystem(spark, at)
    fs.deleteOnExit(path)


def filesystem(spark: SparkSession, at: str):
    """A path and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, at: str) -> None:
    path, fs = filesystem(spark, at)
    fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a new table in the shared folder, which goes when the driver ends or ``release`` is called."""
    spark = df.sparkSession
    at = fresh(spark, name)
    df.write.parquet(at)
    at_exit(spark, at)
    _made.append(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(df: DataFrame) -> None:
    """Delete the tables of ``written`` that this DataFrame reads; nothing may read them any more."""
    spark = df.sparkSession
    for at in {at for f in df.inputFiles() for at in _made if f.split("://")[-1].rsplit("/", 1)[0].endswith(at.rsplit("/", 1)[1])}:
        delete(spark, at)
        _made.remove(at)


def made() -> int:
    """A mark for ``release``."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete all tables that ``written`` has made after a mark."""
    while len(_made) > since:
        delete(spark, _made.pop())


def numbered(df: DataFrame, column: str, start: int = 0) -> DataFrame:
    """The rows with dense numbers from ``start`` on, in the order in which they are met (of a sorted table: its order).

    They are written once, so that numbers and values are fixed; then the numbers of a partition follow those of
    the partitions before it. Only one count a partition meets in one task.
    """
    rows = written(df.withColumn(column, F.monotonically_increasing_id()), "numbered")
    mine, part = F.col(column).bitwiseAND((1 << PARTITION_BITS) - 1), F.shiftright(column, PARTITION_BITS)
    before = Window.orderBy("_seq_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("_seq_part")).agg(F.count("*").alias("_seq_n"))
    counts = counts.select("_seq_part", F.coalesce(F.sum("_seq_n").over(before), F.lit(0)).alias("_seq_before"))
    joined = rows.withColumn("_seq_part", part).join(F.broadcast(counts), "_seq_part")  # a row a partition
    return joined.select(*(c for c in df.columns if c != column), (F.col("_seq_before") + mine + start).alias(column))
