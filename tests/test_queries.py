"""Every registered query against its SQL, all values compared."""

import duckdb
import pytest

import __spark_entry__ as contract
from ridgeline.plans import oracle, queries

from conftest import SF_DIR

# The queries of the optional subpackage are tested with it.
QUERIES = queries.queries()
ORACLES = oracle.oracle_sql(queries.NUM_BLOCKS)
TABLES = ["orders", "lineitem", "part", "events", "customer"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(frame.itertuples(index=False, name=None))


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_builtin_comparison_is_close(spark):
    rows = {r["engine"]: r["rmse"] for r in QUERIES["compare_builtin"](spark, SF_DIR).collect()}
    assert rows["ridgeline"] == pytest.approx(rows["builtin"], rel=0.05)


def test_metrics_and_entry(spark):
    assert QUERIES["fit_metrics"](spark, SF_DIR).count() == 4
    assert contract.entry(spark).columns == ["n", "mse", "rmse"]
