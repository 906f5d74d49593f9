import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import batch, shards
from tests.conftest import table_of


@pytest.mark.parametrize(("n", "parts"), [(100, 7), (7, 7), (3, 7), (21, 4)])
def test_contiguous_ranges(spark, n, parts):
    rows = shards.contiguous(spark.range(n).withColumnRenamed("id", "row_id"), parts).orderBy("row_id").collect()
    base, extra = divmod(n, parts)
    want = [t for t in range(parts) for _ in range(base + (t < extra))]
    assert [r["range_id"] for r in rows] == want


def test_round_robin_and_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert [r["shard_id"] for r in shards.round_robin(df, 4).orderBy("row_id").collect()] == [i % 4 for i in range(10)]
    assert [r["batch_id"] for r in shards.batches(df, 4).orderBy("row_id").collect()] == [i // 4 for i in range(10)]
    assert shards.default_num_shards(spark) == 4


@pytest.mark.parametrize("chunks", [None, 1, 5, 60])
def test_position_within_a_hot_group(spark, chunks):
    sparse = F.when(F.col("id") < 600, F.col("id")).otherwise(F.col("id") * 10**12)
    df = spark.range(0, 900, 3).select(sparse.alias("row_id"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 5).alias("g"))
    placed = shards.position_within(df, "g", "position", chunks).collect()
    want, seen = {}, collections.Counter()
    for r in sorted(df.collect()):
        want[r["row_id"]] = seen[r["g"]]
        seen[r["g"]] += 1
    assert {r["row_id"]: r["position"] for r in placed} == want


def test_semantic_shards_respect_the_cap(spark):
    cells = spark.range(200).select(F.col("id").alias("row_id"), F.when(F.col("id") < 150, 3).otherwise(F.col("id") % 3).alias("cell_id"))
    placed = shards.semantic(cells, 40)
    sizes = {r["shard_id"]: r["count"] for r in placed.groupBy("shard_id").count().collect()}
    assert sum(sizes.values()) == 200 and max(sizes.values()) <= 40 and set(sizes) == set(range(7))
    assert placed.groupBy("shard_id").agg(F.countDistinct("cell_id").alias("n")).filter("n > 1").count() == 0


def sharded(spark, n=300):
    vectors = np.random.default_rng(1).normal(size=(n, 4))
    hot = F.when(F.col("row_id") % 3 == 0, 9).otherwise(F.col("row_id") % 4).cast("int")
    return table_of(spark, range(n), vectors).select(
        F.col("row_id").alias("id"), F.col("vector").cast("array<double>").alias("embedding"), hot.alias("shard_id")
    )


def test_write_shards(spark, tmp_path):
    df = sharded(spark)
    metadata = shards.write_shards(df, str(tmp_path / "out"))
    stored = shards.read_shards(spark, str(tmp_path / "out"))
    assert stored.schema["embedding"].dataType.simpleString() == "array<float>"
    close = stored.join(df.withColumnRenamed("embedding", "e"), ["id", "shard_id"])
    assert close.filter("cast(e as array<float>) = embedding").count() == 300
    want = {r["shard_id"]: (r["n"], r["low"], r["high"]) for r in df.groupBy("shard_id").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
    assert {r["shard_id"]: (r["n_vectors"], r["min_id"], r["max_id"]) for r in metadata.collect()} == want
    document = json.loads(shards.metadata_document(metadata))
    assert document["total_shards"] == len(want) and document["shards"][0]["index_path"] == "shard_id=0"
    assert document["shards"][0]["created_at"] > 1_600_000_000_000
    plan = shards.shard_filter(stored, 9)._jdf.queryExecution().executedPlan().toString()
    assert "shard_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_hot_shard_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        df = sharded(spark, 6000).repartition(8).withColumn("shard_id", F.when(F.col("id") % 3 > 0, 1).otherwise(2))
        shards.write_shards(df, str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list((tmp_path / "out" / "vectors" / "shard_id=1").glob("*.parquet"))) > 1
    assert shards.read_shards(spark, str(tmp_path / "out")).count() == 6000


def test_other_dimensions_are_refused(spark, tmp_path):
    odd = spark.createDataFrame([(1000, [1.0], 0)], "id bigint, embedding array<double>, shard_id int")
    with pytest.raises(Exception, match="does not have"):
        shards.write_shards(sharded(spark).unionByName(odd), str(tmp_path / "a"))
    with pytest.raises(ValueError, match="no vectors"):
        shards.write_shards(sharded(spark).limit(0), str(tmp_path / "b"))
    report = {r["dims"]: r["n_vectors"] for r in shards.dims_report(sharded(spark).unionByName(odd)).collect()}
    assert report == {4: 300, 1: 1}


def test_stats_and_distinct(spark):
    df = sharded(spark)
    local = df.toPandas()
    want = {}
    for shard, group in local.groupby("shard_id"):
        mean = np.stack(group["embedding"]).astype(np.float32).astype(float).mean(axis=0)
        want[shard] = (len(group), np.linalg.norm(mean))
    rows = {r["shard_id"]: (r["n_vectors"], r["centroid_norm"]) for r in shards.shard_stats(df.repartition(6)).collect()}
    assert set(rows) == set(want) == {r[0] for r in shards.distinct_shards(df).collect()}
    for shard, (n, norm) in want.items():
        assert rows[shard][0] == n and rows[shard][1] == pytest.approx(norm)


def test_batches_of_a_user_function(spark, rng):
    vectors = rng.uniform(-1, 1, size=(250, 3)).astype(np.float32)
    df = table_of(spark, range(250), vectors).repartition(7)

    def info(rows: batch.VectorBatch) -> dict:
        assert (rows.keys == np.arange(rows.start_index, rows.start_index + len(rows))).all()
        return {"n": len(rows), "total": float(rows.vectors.sum()), "dims": rows.dimensions}

    rows = batch.apply_to_batches(df, info, "n int, total double, dims int", 64).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["n"], r["dims"]) for r in rows] == [(0, 64, 3), (1, 64, 3), (2, 64, 3), (3, 58, 3)]
    np.testing.assert_allclose([r["total"] for r in rows], [vectors[i : i + 64].sum() for i in range(0, 250, 64)], rtol=1e-5)

    def codes(rows: batch.VectorBatch) -> dict:
        assert rows.vectors is None and rows.byte_vectors.dtype == np.int8
        return {"total": int(rows.byte_vectors.astype(int).sum())}

    total = batch.apply_to_batches(df, codes, "total bigint", 100, as_bytes=True).agg(F.sum("total")).first()[0]
    assert total == np.floor(vectors.astype("f4") * np.float32(127) + 0.5).astype(int).sum()


@pytest.mark.parametrize("held", [64, 1])
def test_only_rows_of_shared_batches_are_exchanged(spark, rng, monkeypatch, held):
    """Four partitions in row order: what moves of the vectors are the batches at their edges."""
    monkeypatch.setattr(batch, "_HELD_BATCHES", held)
    df = table_of(spark, range(4000), rng.normal(size=(4000, 3))).repartitionByRange(4, "row_id").sortWithinPartitions("row_id")
    got = batch.apply_to_batches(df, lambda rows: {"n": len(rows), "first": int(rows.keys[0])}, "n int, first bigint", 100)
    assert sorted(tuple(r) for r in got.collect()) == [(i, 100, 100 * i) for i in range(40)]
    local = batch.local_batches(df, lambda rows: {"n": len(rows)}, "n int", 100, False)
    moved = local.filter("vector IS NOT NULL").count()
    assert moved <= 4 * 2 * 100 and local.filter("out IS NOT NULL").count() >= 40 - 8


def test_rows_out_of_order(spark, rng):
    """No partition has a whole batch, and more batches come than a task keeps."""
    df = table_of(spark, range(3000), rng.normal(size=(3000, 2))).repartition(5)
    got = batch.apply_to_batches(df, lambda rows: {"n": len(rows), "ordered": bool((np.diff(rows.keys) == 1).all())}, "n int, ordered boolean", 10)
    assert sorted(tuple(r) for r in got.collect()) == [(i, 10, True) for i in range(300)]


def test_a_failing_batch_fails_the_job(spark, rng):
    def fail(rows):
        raise RuntimeError("no such batch")

    with pytest.raises(Exception, match="no such batch"):
        batch.apply_to_batches(table_of(spark, range(5), rng.normal(size=(5, 2))), fail, "x int", 2).collect()


def test_semantic_moves_no_vectors(spark, rng):
    cells = table_of(spark, range(500), rng.normal(size=(500, 2))).withColumn("cell_id", F.when(F.col("row_id") % 7 == 0, 1).otherwise(4))
    placed = shards.semantic(cells, 40)
    assert "Exchange" not in placed._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r["cell_id"], r["row_id"], r["shard_id"]) for r in placed.collect())
    assert len(rows) == 500
    want, shard = [], -1
    for cell in (1, 4):
        own = [r for r in rows if r[0] == cell]
        for i, (_, row, _) in enumerate(own):
            shard += i % 40 == 0
            want.append((cell, row, shard))
    assert rows == want


def test_semantic_keeps_rows_without_a_cell(spark):
    """NULL and zero vectors under cosine have no nearest centroid; rows in are rows out."""
    from nearfield.operators import ivf

    rows = [(i, [float(i % 3 - 1), float(i % 5)]) for i in range(40)] + [(100, None), (101, [0.0, 0.0]), (102, None)]
    base = spark.createDataFrame(rows, "row_id bigint, vector array<float>")
    centroids = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cell_id int, centroid array<float>")
    for cap in (1, 2, 30):
        got = shards.semantic(ivf.assign_cells(base, centroids, "cos"), cap)
        placed = {r["row_id"]: (r["cell_id"], r["shard_id"]) for r in got.collect()}
        assert set(placed) == {r[0] for r in rows}
        assert all(placed[i][0] == shards.REST_CELL for i in (100, 101, 102))
        sizes = {}
        for _, shard in placed.values():
            sizes[shard] = sizes.get(shard, 0) + 1
        assert max(sizes.values()) <= cap
