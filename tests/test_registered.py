"""Every registered query against its SQL, with fewer seeds than registered."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as registered
import oracle_queries
from tests.conftest import MEDIUM

REPLICATES, ROWS = 101, 3
QUERIES = {
    **registered.source_queries(),
    **registered.row_queries(range(1, ROWS + 1)),
    **registered.simulation_queries(range(1, REPLICATES + 1)),
}
SQL = oracle_queries.build(REPLICATES, ROWS, registered.SINGLE_SEED)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("customer", "nation", "orders"):
        con.execute(f"create view {table} as select * from '{MEDIUM}/{table}.parquet'")
    return con


def test_same_keys():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(registered.queries())
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, MEDIUM)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    at = [names.index(c) for c in columns]
    expected = sorted(repr(tuple(row[i] for i in at)) for row in cursor.fetchall())
    got = sorted(repr(tuple(row)) for row in df.select(*columns).collect())
    assert got == expected
    assert got


def test_entry(spark):
    assert registered.entry(spark).count() == 4


@pytest.mark.parametrize("gone", ["lacuna.llm", "corpus_pipeline"])
def test_entry_without_the_training_data_operators(gone):
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run(
        [sys.executable, "-c", code], capture_output=True, text=True, check=True
    ).stdout.split()
    assert set(out) == set(QUERIES)
