"""Every query that SQL can express gives the same rows in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = [name.split(".")[0] for name in sorted(os.listdir(SF_DIR))]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'"
        )
    return connection


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return frame.sort_values(list(frame.columns), key=lambda c: c.map(repr)).reset_index(
        drop=True
    )


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    ours = canonical(queries()[name](spark, SF_DIR).toPandas())
    theirs = canonical(duck.sql(oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) > 0
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, rtol=0, atol=1e-9)
