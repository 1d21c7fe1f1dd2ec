"""Tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local session without one (tests) has a folder of its own; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "gleaner-shared")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/gleaner-{tag}-{uuid.uuid4().hex}"
    fs, p = _on(spark, path)
    fs.deleteOnExit(p)
    return path


def _on(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def count_files(spark: SparkSession, pattern: str) -> int:
    fs, p = _on(spark, pattern)
    return len(fs.globStatus(p) or [])


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Written and read again: cuts lineage, survives the loss of executors, is computed once for several readers."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(df: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing reads it any more."""
    fs, p = _on(df.sparkSession, df._written)
    fs.delete(p, True)


def numbered(df: DataFrame, name: str, order: list[Column], start: Column | None = None) -> DataFrame:
    """Rows numbered 1, 2, … in a total order (after `start`, a value for each row), without a single-partition sort.

    Range partitions are numbered within; the offset of each is the sum of the sizes before it, one row per partition.
    """
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = parts.withColumn("_own", own).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.lit(0) if start is None else start) + F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")
