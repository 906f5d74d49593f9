from __future__ import annotations

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def embeddings(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


@pytest.fixture
def rng():
    return np.random.default_rng(7)


def table_of(spark, ids, vectors, id_name="row_id"):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, f"{id_name} bigint, vector array<float>")


def brute_force(ids, base, queries, k, metric="l2"):
    """Expected (ids, distances) per query by plain float64 arithmetic."""
    base, queries = np.asarray(base, np.float64), np.asarray(queries, np.float64)
    result = []
    for q in queries:
        if metric == "l2":
            d = ((base - q) ** 2).sum(axis=1)
        elif metric == "ip":
            d = 1 - base @ q
        else:
            with np.errstate(invalid="ignore", divide="ignore"):
                d = 1 - (base @ q) / (np.sqrt((base**2).sum(axis=1)) * np.sqrt((q**2).sum()))
        usable = np.flatnonzero(np.isfinite(d))
        order = usable[np.lexsort((np.asarray(ids)[usable], d[usable]))][:k]
        result.append((np.asarray(ids)[order], d[order]))
    return result


def lists_of(hits):
    """query -> ([ids], [distances]) in rank order; checks that ranks run from 1."""
    found: dict = {}
    for row in sorted(hits.collect(), key=lambda r: (r["query_id"], r["rank"])):
        ids, distances = found.setdefault(row["query_id"], ([], []))
        ids.append(row["neighbor_id"])
        distances.append(row["distance"])
        assert row["rank"] == len(ids)
    return found


def assert_lists(hits, query_ids, expected):
    found = lists_of(hits)
    for query_id, (ids, distances) in zip(query_ids, expected):
        got = found.get(query_id, ([], []))
        assert got[0] == list(ids), query_id
        np.testing.assert_allclose(got[1], distances, rtol=1e-9, atol=1e-12)
    assert set(found) <= set(query_ids)
