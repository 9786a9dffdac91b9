"""Proposals out of Markdown reports: rows of pipe tables whose header names an original and a replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_BAR = "\x01"


def cells(line: Column) -> Column:
    """The trimmed cells of a table row; escaped bars, and bars in code spans, don't part cells."""
    spans = F.regexp_extract_all(line, F.lit("`[^`]*`"), F.lit(0))
    kept = F.aggregate(spans, F.replace(line, F.lit("\\|"), F.lit(_BAR)), lambda acc, s: F.replace(acc, s, F.replace(s, F.lit("|"), F.lit(_BAR))))
    inner = F.regexp_replace(F.trim(kept), "\\A\\||\\|\\z", "")
    return F.transform(F.split(inner, "\\|"), lambda c: F.replace(F.regexp_replace(F.trim(c), "\\A`([^`]*)`\\z", "$1"), F.lit(_BAR), F.lit("|")))


def proposals(reports: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, original, replacement, category). The header in force is the last one of an unbroken run of table lines."""
    rows = reports.select(key, F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line", "body"))
    rows = rows.withColumn("in_table", F.trim("body").startswith("|"))
    w = Window.partitionBy(key).orderBy("line")
    starts = F.col("in_table") & ~F.coalesce(F.lag("in_table").over(w), F.lit(False))
    rows = rows.withColumn("starts", starts).withColumn("cells", F.when(F.col("in_table"), cells(F.col("body"))))
    rows = rows.withColumn("header", F.last(F.when(F.col("starts"), F.transform("cells", F.lower)), ignorenulls=True).over(w))
    rule = F.forall("cells", lambda c: c.rlike("\\A:?-+:?\\z"))
    data = rows.where(F.col("in_table") & ~F.col("starts") & ~rule & F.array_contains("header", "original") & F.array_contains("header", "replacement"))
    at = lambda name: F.get("cells", (F.array_position("header", name) - 1).cast("int"))
    return data.select(key, "line", at("original").alias("original"), at("replacement").alias("replacement"), F.when(F.array_contains("header", "category"), at("category")).otherwise("other").alias("category")).where("original <> ''")
