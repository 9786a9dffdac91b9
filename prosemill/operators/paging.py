"""Pages of records under several budgets, filled greedily in order.

Where a page starts depends on where the one before it ended, so records of one
key are read in order. Tasks carry what the open page holds from record to
record and from batch to batch; neither a page nor a key is ever held whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import byte_length


@dataclass(frozen=True)
class Budget:
    """What a page may hold."""

    records: int = 32
    characters: int = 12_000
    json_bytes: int = 96 * 1024


def record_json(*columns: Column | str) -> Column:
    """The record as it is sent; absent values are left out."""
    return F.to_json(F.struct(*columns))


def paged(records: DataFrame, key: str, order: str, characters: str, json_bytes: str, budget: Budget = Budget(), skip_oversized: bool = False) -> DataFrame:
    """(key, order, characters, json_bytes, page, code) of records, pages numbered from 0 by key.

    A page ends before the record that would pass one of the budgets. A record
    that passes one by itself gets record_too_large and no page, and the next
    one starts a page; with ``skip_oversized`` it gets oversized_segment, takes a
    place on the page that is open, and nothing of its other budgets. Null sizes
    count 0; rows are told apart by ``order`` within a key.
    """
    rows = records.select(key, order, F.coalesce(F.col(characters), F.lit(0)).cast("long").alias("characters"), F.coalesce(F.col(json_bytes), F.lit(0)).cast("long").alias("json_bytes"))
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, page, n, chars, size, closed = object(), 0, 0, 0, 0, False
        for batch in batches:
            pages, codes = [], []
            for k, c, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if k != now:
                    now, page, n, chars, size, closed = k, 0, 0, 0, 0, False
                large = c > budget.characters or b > budget.json_bytes
                if large and not skip_oversized:
                    pages.append(None)
                    codes.append("record_too_large")
                    closed = n > 0
                    continue
                full = n >= budget.records or not large and (chars + c > budget.characters or size + b > budget.json_bytes)
                if n and (full or closed):
                    page, n, chars, size = page + 1, 0, 0, 0
                closed = False
                n += 1
                if not large:
                    chars, size = chars + c, size + b
                pages.append(page)
                codes.append("oversized_segment" if large else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pages, pa.int64()), pa.array(codes, pa.string())], names=[*batch.schema.names, "page", "code"])

    # keys stay together and in order; one with very many records streams through its task
    dealt = rows.repartition(key).sortWithinPartitions(key, order)
    return dealt.mapInArrow(run, f"`{key}` {types[key]}, `{order}` {types[order]}, characters long, json_bytes long, page long, code string")


def page_starts(pages: DataFrame, key: str, order: str) -> DataFrame:
    """(key, page, cursor, next_cursor, records, characters, json_bytes): where each page starts, and where a request for the next one goes on.

    Cursors are the first record's ``order``. ``next_cursor`` is null on the last page.
    """
    kept = F.col("code").isNull()
    sums = pages.where("page is not null").groupBy(key, "page").agg(
        F.min(order).alias("cursor"), F.count("*").alias("records"), F.sum(F.when(kept, F.col("characters")).otherwise(0)).alias("characters"), F.sum(F.when(kept, F.col("json_bytes")).otherwise(0)).alias("json_bytes")
    )
    following = F.lead("cursor").over(Window.partitionBy(key).orderBy("page"))
    return sums.select(key, "page", "cursor", following.alias("next_cursor"), "records", "characters", "json_bytes")


def with_sizes(records: DataFrame, text: str, context: str) -> DataFrame:
    """Adds ``characters`` of a record's text and context, and ``json_bytes`` of its columns ``json``."""
    own = F.length(F.coalesce(F.col(text), F.lit("")))
    around = F.aggregate(F.coalesce(F.col(context), F.array().cast("array<string>")), F.lit(0), lambda a, x: a + F.length(x))
    return records.withColumn("characters", (own + around).cast("long")).withColumn("json_bytes", byte_length("json"))
