"""Transcripts that arrive as files, put into the catalog as they come.

The batch operators have no event time; what streams is the arrival of recorded answers.  Each
micro-batch is parsed and merged by key, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.help import parse_help

SCHEMA = "prefix string, output string, taken_at timestamp"


def arriving_help(spark: SparkSession, folder: str, *, files_per_batch: int = 100) -> DataFrame:
    """JSON lines of answers as a stream."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def options_seen(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Answers per prefix and hour, for watching a scan; late ones count up to ``late``."""
    told = stream.withWatermark("taken_at", late)
    return told.groupBy(F.window("taken_at", "1 hour"), "prefix").agg(F.count("*").alias("answers"))


def upsert_options(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes each batch's options to a folder of its own below ``target``, by batch number; a
    repeated batch overwrites its own folder.  ``latest_options`` reads the newest of each prefix."""

    def put(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("prefix").agg(F.max_by("output", "taken_at").alias("output"), F.max("taken_at").alias("taken_at"))
        parse_help(newest).join(newest.select("prefix", "taken_at"), "prefix").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_options(spark: SparkSession, target: str) -> DataFrame:
    """The options of the newest answer to each prefix."""
    rows = spark.read.parquet(target)
    newest = rows.groupBy("prefix").agg(F.max(F.struct("taken_at", "batch")).alias("v")).select("prefix", F.col("v.taken_at").alias("taken_at"), F.col("v.batch").alias("batch"))
    return rows.join(newest, ["prefix", "taken_at", "batch"], "left_semi").select("prefix", "pos", "token", "kind", "description")
