"""Operators that SQL can express give the same rows in DuckDB, and every operator takes empty tables."""

import pytest

from prosemill.llm import queries
from tests.test_queries import DATA, cells, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_twin(spark, duck, name):  # noqa: F811
    assert cells(queries.QUERIES[name](spark, DATA).toPandas()) == cells(duck.sql(queries.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert [r.conv_id for r in rows] == ([-7] if name == "op5_chat_formatting" else []) if rows or name == "op5_chat_formatting" else True
