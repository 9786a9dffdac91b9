"""Digests, pages and guards of a conversation about one scan."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import utf16_order
from . import paging
from .lineage import checkpointed

SCREEN_PAGE = 16
#: Paths of a scan that is paged by cursor; ``pages`` takes any number.
MOST_PATHS = 100_000
VERSION = 1


class ProtocolError(ValueError):
    """A request that doesn't fit what it goes on from: invalid_cursor, policy_mismatch, scope_mismatch, snapshot_mismatch, record_too_large, scope_too_large or invalid_glossary."""


def canonical(value: object) -> str:
    """JSON without spaces, keys as given, absent values left out."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if v is not None}
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=list)


def policy_digest(root: str, preferences: dict) -> str:
    return hashlib.sha256(canonical({"root": root, "preferences": preferences, "version": VERSION}).encode()).hexdigest()


def row_digest(*columns: Column | str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def scope_digest(entries: DataFrame, policy: str, key: str = "path") -> str:
    """One digest of a scan and its policy. Rows are digested in tasks; their digests, in order of path, in one row (a scan has a bounded number of paths)."""
    if entries.limit(MOST_PATHS + 1).count() > MOST_PATHS:
        raise ProtocolError("scope_too_large")
    rows = entries.select(utf16_order(key).alias("o"), row_digest(*entries.columns).alias("d"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("o", "d"))), lambda x: x["d"])
    return rows.agg(F.sha2(F.concat_ws("", every, F.lit(policy)), 256).alias("digest")).first().digest


def guard(cursor: int, given: str | None, now: str, code: str) -> None:
    """A later page must name the digest that it goes on from; a named one must be the present one."""
    if cursor < 0:
        raise ProtocolError("invalid_cursor")
    if cursor > 0 and not given or given and given != now:
        raise ProtocolError(code)


def page(entries: DataFrame, cursor: int, size: int = SCREEN_PAGE, key: str = "path") -> tuple[DataFrame, int | None, int]:
    """(rows, next cursor, total): ``size`` rows from ``cursor`` on, by path in UTF-16 order."""
    total = entries.count()
    if not 0 <= cursor <= total:
        raise ProtocolError("invalid_cursor")
    ranked = entries.withColumn("ord", F.row_number().over(Window.orderBy(utf16_order(key))) - 1)
    end = min(cursor + size, total)
    return ranked.where((F.col("ord") >= cursor) & (F.col("ord") < end)), end if end < total else None, total


def pages(entries: DataFrame, size: int = SCREEN_PAGE, key: str = "path") -> DataFrame:
    """Adds ``page`` to all rows: ``size`` rows a page, by path in UTF-16 order.

    Rows are ranked within ranges of the key and ranges start where those
    before end, so that no task sees all rows. Bounds of ranges are drawn anew
    whenever rows are dealt, so the dealt rows are stored before they are counted.
    """
    dealt = checkpointed(entries.withColumn("o", utf16_order(key)).repartitionByRange("o").withColumn("block", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("block").orderBy("o"))
    counts = dealt.groupBy("block").agg(F.count("*").alias("m"))
    before = F.coalesce(F.sum("m").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(counts.select("block", before.alias("start")))  # a row a partition
    return dealt.withColumn("place", place).join(starts, "block").withColumn("page", F.floor((F.col("start") + F.col("place") - 1) / size).cast("long")).drop("o", "block", "place", "start")


def check_glossary(terms: list) -> None:
    wrong = [i for i, t in enumerate(terms) if not isinstance(t, str) or not 1 <= len(t) <= 256 or not well_formed(t)]
    if wrong:
        raise ProtocolError("invalid_glossary", wrong)


def well_formed(text: str) -> bool:
    """Whether a text has no lone surrogate."""
    try:
        text.encode()
    except UnicodeEncodeError:
        return False
    return True


def records(prepared: DataFrame, diagnostics: DataFrame, notices: DataFrame) -> DataFrame:
    """(path, ord, kind, segment, part, text, context, line, code, json, characters, json_bytes): what is sent of each file, in order.

    First come segments, those that cannot be cut as ``skipped`` with their
    code, then diagnostics by line, then notices. ``prepared`` has (path,
    segment, part, start_byte, text, context, code).
    """
    null = lambda t: F.lit(None).cast(t)
    oversized = F.col("code").isNotNull()
    parts = [
        prepared.select("path", F.lit(0).alias("group"), F.col("start_byte").alias("place"), F.when(oversized, "skipped").otherwise("segment").alias("kind"), "segment", "part", F.when(~oversized, F.col("text")).alias("text"), F.when(~oversized, F.col("context")).alias("context"), null("long").alias("line"), "code"),
        diagnostics.select("path", F.lit(1).alias("group"), F.col("line").alias("place"), F.lit("diagnostic").alias("kind"), null("long").alias("segment"), null("long").alias("part"), null("string").alias("text"), null("array<string>").alias("context"), "line", "code"),
        notices.select("path", F.lit(2).alias("group"), F.lit(0).cast("long").alias("place"), F.lit("notice").alias("kind"), null("long").alias("segment"), null("long").alias("part"), null("string").alias("text"), null("array<string>").alias("context"), null("long").alias("line"), "code"),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    ordered = every.withColumn("ord", (F.row_number().over(Window.partitionBy("path").orderBy("group", "place", "code")) - 1).cast("long"))
    sent = paging.record_json("kind", "segment", "part", "text", "context", "line", "code")
    return paging.with_sizes(ordered.drop("group", "place").withColumn("json", sent), "text", "context")


def response(segments: DataFrame, diagnostics: DataFrame, notices: DataFrame) -> DataFrame:
    """(path, ord, kind, segment, text, line, code): segments of a file, then its diagnostics, then its notices."""
    rows = [
        segments.select("path", F.lit(0).alias("group"), F.col("start_byte").alias("place"), F.lit("segment").alias("kind"), "segment", "text", "line", F.lit(None).cast("string").alias("code")),
        diagnostics.select("path", F.lit(1).alias("group"), F.col("line").alias("place"), F.lit("diagnostic").alias("kind"), F.lit(None).cast("long").alias("segment"), F.lit(None).cast("string").alias("text"), "line", "code"),
        notices.select("path", F.lit(2).alias("group"), F.lit(0).cast("long").alias("place"), F.lit("notice").alias("kind"), F.lit(None).cast("long").alias("segment"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("line"), "code"),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    order = Window.partitionBy("path").orderBy("group", "place", "code")
    return every.withColumn("ord", F.row_number().over(order).cast("long")).select("path", "ord", "kind", "segment", "text", "line", "code")
