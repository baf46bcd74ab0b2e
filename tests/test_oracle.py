"""Every registered query against its SQL statement in DuckDB."""

import os

import duckdb
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF_DIR}/{table}.parquet')"
        )
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is not None, str(v)) for v in row])


# Answers that may miss some rows; `tests/test_vector_index.py` measures how many.
APPROXIMATE = {"vector_topk_ivf"}


def test_every_query_has_a_statement():
    assert set(entry.TABLE_QUERIES) - APPROXIMATE == set(entry.ORACLE)


@pytest.mark.parametrize("name", sorted(entry.ORACLE))
def test_query_equals_sql(spark, duck, name):
    result = entry.queries()[name](spark, SF_DIR)
    columns = sorted(result.columns)
    got = [tuple(row[c] for c in columns) for row in result.collect()]

    cursor = duck.execute(entry.oracle_sql()[name])
    described = {d[0]: str(d[1]) for d in cursor.description}
    names = [d[0] for d in cursor.description]
    expected = [tuple(row[names.index(c)] for c in columns) for row in cursor.fetchall()]

    assert sorted(names) == columns
    assert {f.name: TYPES[f.dataType.simpleString()] for f in result.schema} == described
    assert len(got) > 0
    assert _sorted(got) == _sorted(expected)


def test_entry_is_lazy_and_stable(spark):
    result = entry.entry(spark)
    assert isinstance(result, DataFrame)
    assert "total_spend" in result.columns
    assert result.count() > 0
