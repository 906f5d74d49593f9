import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from nearfield.llm import feistel
from tests.llm.conftest import ODD, clashing, same_rows


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 10, 97, 1000, 1009])
def test_permutation(spark, n):
    got = [r[0] for r in spark.range(n).select(feistel.permuted(F.col("id"), n, 5)).collect()]
    assert sorted(got) == list(range(n))


def test_shuffles_and_depends_on_seed(spark):
    a, b = ([r[0] for r in spark.range(1000).orderBy("id").select(feistel.permuted(F.col("id"), 1000, s)).collect()] for s in (1, 2))
    assert a != b and sum(abs(x - i) for i, x in enumerate(a)) > 200_000


def check(rows, got, n_shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(
        (d is None, d or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows
    )
    counts = Counter(r["shard"] for r in got)
    sizes = [counts.get(s, 0) for s in range(n_shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    assert sorted(r["row_number"] for r in got) == list(range(len(rows)))


def test_whole_table(docs, rows):
    first = feistel.shards(docs, 40)
    check(rows, first.collect(), 40)
    same_rows(first, feistel.shards(docs.repartition(5), 40))


def test_odd_rows(odd, none):
    check(ODD, feistel.shards(odd, 4).collect(), 4)
    same_rows(feistel.shards(odd, 4), feistel.shards(clashing(odd), 4))
    assert feistel.shards(none, 4).count() == 0


def test_native(docs):
    plan = feistel.shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
