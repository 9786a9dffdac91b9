"""Labelled files and predictions: read, compared, written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CORRECTION = "struct<segmentHint:string,original:string,replacement:string,category:string>"


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(path, dialect, original, replacement, category, hint): a row for each correction of JSON files of labelled files."""
    files = spark.read.option("multiLine", True).schema(f"path string, dialect string, corrections array<{CORRECTION}>, cleanSegmentCount bigint").json(path)
    each = files.select("path", "dialect", F.explode("corrections").alias("c"))
    return each.select("path", "dialect", "c.original", "c.replacement", "c.category", F.col("c.segmentHint").alias("hint"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(path, original, replacement, category)."""
    files = spark.read.option("multiLine", True).schema("path string, proposals array<struct<original:string,replacement:string,category:string>>").json(path)
    return files.select("path", F.explode("proposals").alias("p")).select("path", "p.*")


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line; later runs add files."""
    results.write.mode("append").json(path)


def not_eligible(expectations: DataFrame, entries: DataFrame) -> DataFrame:
    """Expectations whose file is not among the eligible ones."""
    return expectations.join(entries.where("state = 'eligible'").select("path"), "path", "left_anti").withColumn("code", F.lit("not_eligible"))
