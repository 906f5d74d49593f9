"""Every registered query against its SQL, and the shape of the plans."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry_points
from nearfield.oracles import oracle
from nearfield.registered import registered

QUERIES, SQL = registered(), oracle()


@pytest.fixture(scope="module")
def sql(sf_dir):
    connection = duckdb.connect()
    for name in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return connection


def test_names():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"kmeans_ivf_search", "tfidf_svd_embed"}


def test_all_are_offered():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sql, sf_dir, name):
    result = QUERIES[name](spark, sf_dir)
    for plan in (result._jdf.queryExecution().executedPlan().toString(),):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got, want = result.toPandas(), sql.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    got = got[columns].sort_values(columns).reset_index(drop=True)
    want = want[columns].sort_values(columns).reset_index(drop=True)
    assert len(got) == len(want) > 0
    for column in columns:
        a, b = got[column], want[column]
        same = (a == b) | (a.isna() & b.isna())
        assert same.all(), (column, got[~same].head(3), want[~same].head(3))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only_queries(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    assert len(rows) > 0 and not rows.isna().any().any()
    if name == "tfidf_svd_embed":
        assert len({len(v) for v in rows["embedding"]}) == 1
        assert np.isfinite(np.stack(rows["embedding"])).all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_plan(spark, sf_dir):
    plan = plan_of(QUERIES["exact_knn_l2"](spark, sf_dir))
    # One shuffle, of whole per-task lists; only the two needed columns are read.
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan
    assert plan.index("Generate inline") < plan.index("Exchange") < plan.index("MapInArrow")
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan


def test_projections_do_not_shuffle(spark, sf_dir):
    for name in ("quantize_i8", "scale_u8", "round_f16", "round_robin_shards", "fixed_batches", "path_extension", "format_memory"):
        plan = plan_of(QUERIES[name](spark, sf_dir))
        assert "Exchange" not in plan and "ArrowEvalPython" not in plan and "MapInArrow" not in plan, name
