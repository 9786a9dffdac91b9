"""Segments of prose: lines with byte provenance, neighbours, suppression, islands and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import byte_length, has_letter


def lines(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, body, start_byte, end_byte): the LF-separated lines of each text, numbered from 1, without their ends."""
    split = files.select(key, F.posexplode(F.split(text, "\n")).alias("at", "body"))
    before = F.sum(byte_length("body") + 1).over(Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    return split.select(key, (F.col("at") + 1).cast("long").alias("line"), "body", F.coalesce(before, F.lit(0)).cast("long").alias("start_byte")).withColumn("end_byte", F.col("start_byte") + byte_length("body"))


def segments(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines with a letter, numbered in kept order as ``segment``."""
    kept = lines(files, key, text).where(has_letter("body"))
    return kept.withColumn("segment", F.row_number().over(Window.partitionBy(key).orderBy("start_byte")).cast("long"))


def with_context(rows: DataFrame, key: str, order: str, text: str, most: int = 500) -> DataFrame:
    """Adds ``context``: the texts before and after, ``most`` characters of each, missing ones left out."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("context", F.array_compact(F.array(F.substring(F.lag(text).over(w), 1, most), F.substring(F.lead(text).over(w), 1, most))))


def suppressed(rows: DataFrame, key: str, directive: Column) -> DataFrame:
    """Adds ``disabled`` to lines. ``directive`` is disable, enable, next or null.

    A line is off from a disable to the next enable, both included, to the end
    of the file without one, and after a next.
    """
    w = Window.partitionBy(key).orderBy("line")
    rows = rows.withColumn("directive", directive)
    now = F.last(F.when(F.col("directive").isin("disable", "enable"), F.col("directive")), ignorenulls=True).over(w)
    rows = rows.withColumn("state", now)
    before = F.lag("state").over(w)
    off = (F.coalesce(F.col("state") == "disable", F.lit(False))) | ((F.col("directive") == "enable") & (before == "disable")) | (F.lag("directive").over(w) == "next")
    return rows.withColumn("disabled", F.coalesce(off, F.lit(False))).drop("state")


def directive_diagnostics(rows: DataFrame, key: str) -> DataFrame:
    """(key, line, code): nested_disable, unmatched_enable and disable_to_eof, from rows with ``directive``."""
    w = Window.partitionBy(key).orderBy("line")
    marks = rows.where(F.col("directive").isin("disable", "enable")).withColumn("before", F.lag("directive").over(w)).withColumn("after", F.lead("directive").over(w))
    nested = marks.where("directive = 'disable' and before = 'disable'").select(key, "line", F.lit("nested_disable").alias("code"))
    unmatched = marks.where("directive = 'enable' and coalesce(before, 'enable') = 'enable'").select(key, "line", F.lit("unmatched_enable").alias("code"))
    # the last run of disables has no end; it counts from its first line
    opened = marks.where("directive = 'disable' and coalesce(before, 'enable') = 'enable'")
    last = marks.groupBy(key).agg(F.max_by("directive", "line").alias("last"))
    to_end = opened.groupBy(key).agg(F.max("line").alias("line")).join(last.where("last = 'disable'"), key).select(key, "line", F.lit("disable_to_eof").alias("code"))
    return nested.unionByName(unmatched).unionByName(to_end)


def islands(rows: DataFrame, key: str, order: str, status: str) -> DataFrame:
    """Runs of equal status: (key, island, status, first, last, n)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce((~F.col(status).eqNullSafe(F.lag(status).over(w))).cast("int"), F.lit(1))
    marked = rows.withColumn("island", F.sum(F.when(F.row_number().over(w) == 1, 1).otherwise(changed)).over(w))
    return marked.groupBy(key, "island", status).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def fenced(rows: DataFrame, key: str, order: str, fence: Column) -> DataFrame:
    """Adds ``in_fence``: whether a line stands between fences or is one; fences toggle."""
    w = Window.partitionBy(key).orderBy(order)
    seen = F.sum(fence.cast("int")).over(w)
    return rows.withColumn("in_fence", ((seen % 2) == 1) | fence)
