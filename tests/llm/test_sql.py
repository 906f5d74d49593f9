"""Every SQL statement of the corpus operators against its query."""

import os

import duckdb
import pytest

from nearfield.llm.oracles import oracle
from nearfield.llm.registered import registered


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle()))
def test_matches_sql(spark, sql, sf_dir, name):
    got, want = registered()[name](spark, sf_dir).toPandas(), sql.execute(oracle()[name]).fetchdf()
    columns = sorted(want.columns)
    assert set(columns) <= set(got.columns)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    want = want.sort_values(columns)[columns].reset_index(drop=True)
    assert len(got) == len(want) > 0
    for column in columns:
        same = (got[column] == want[column]) | (got[column].isna() & want[column].isna())
        assert same.all(), (column, got[~same].head(3), want[~same].head(3))
