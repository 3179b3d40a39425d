"""Scratch tables in the folder that all executors share.

Operators that read an intermediate result more than once write it as Parquet under
``spark.checkpoint.dir``.  That cuts the lineage, survives lost executors, and gives the
planner real sizes.  The setting is read from the session; a folder of our own is made only
where it is unset and all tasks run in the driver's process, as in local tests.  On a cluster an
unset folder is an error: executors wouldn't see each other's files.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a new local one only if it names none and runs locally."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master {master})")
        named = "file://" + tempfile.mkdtemp(prefix="manloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  Removed when the driver's JVM ends, or
    by ``drop``."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/manloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    kept = spark.read.schema(df.schema).parquet(where)
    kept.kept_at = where
    return kept


def written_text(lines: DataFrame, name: str, by: str) -> str:
    """Writes the one text column of ``lines`` below the shared folder, a folder for each value of
    ``by``, and gives the place.  Removed when the driver's JVM ends."""
    spark = lines.sparkSession
    where = f"{shared_folder(spark)}/manloom/{name}-{uuid.uuid4().hex}"
    lines.write.partitionBy(by).text(where)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return where


def drop(kept: DataFrame) -> None:
    """Removes a table that ``keep`` wrote, when nothing reads it any more: a loop's last level."""
    spark = kept.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Deals rows by key over as many tasks as shuffles have, however few bytes they are: for rows that
    take long to work on.  Joins, windows and groups by these keys need no dealing of their own then."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds the global row number (from 1) in ``order`` without one task for all rows: range
    partitions count by themselves and are shifted by the counts of those before them."""
    dealt = keep(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    shifts = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return numbered.join(F.broadcast(shifts), "_part").withColumn(name, F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")
