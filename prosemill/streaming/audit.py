"""Streaming views of the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "timestamp timestamp, event string, path string, beforeHash string, candidateHash string, afterHash string, proposalCount bigint, code string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The log's events as a stream, an hour late at most."""
    return spark.readStream.schema(SCHEMA).json(folder).withWatermark("timestamp", "1 hour")


def hourly(stream: DataFrame) -> DataFrame:
    """(hour, event, n) in tumbling windows."""
    return stream.groupBy(F.window("timestamp", "1 hour"), "event").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event", "n")


def unfinished(stream: DataFrame, within: str = "10 minutes") -> DataFrame:
    """Intents that neither complete nor abort in time: a stream-stream left outer join."""
    intents = stream.where("event = 'write_intent'").select(F.col("timestamp").alias("begun"), F.col("path").alias("p"), "candidateHash", "proposalCount")
    ends = stream.where("event <> 'write_intent'").select(F.col("timestamp").alias("ended"), "path", F.coalesce("afterHash", "candidateHash").alias("hash"), "event")
    met = (F.col("p") == F.col("path")) & (F.col("candidateHash") == F.col("hash")) & (F.col("ended") >= F.col("begun")) & (F.col("ended") <= F.col("begun") + F.expr(f"interval {within}"))
    return intents.join(ends, met, "left_outer").where("event is null").select("begun", F.col("p").alias("path"), "candidateHash", "proposalCount")
