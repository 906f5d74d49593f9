"""Sharding, batching and the per-shard tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.operators.batch import vector_means
from nearfield.session import materialize, spread_by


def default_num_shards(spark: SparkSession) -> int:
    """Executor instances, at least four."""
    return max(int(spark.conf.get("spark.executor.instances", "4")), 4)


def round_robin(df: DataFrame, num_shards: int) -> DataFrame:
    return df.withColumn("shard_id", F.pmod("row_id", F.lit(num_shards)).cast("int"))


def contiguous(df: DataFrame, num_ranges: int) -> DataFrame:
    """Even ranges of row positions; the first ``N mod T`` ranges get one row more."""
    total = df.select(F.count("*")).scalar()
    row = F.col("row_id")
    return (
        df.withColumn("size", F.floor(total / num_ranges).cast("bigint"))
        .withColumn("extra", F.pmod(total, F.lit(num_ranges)))
        .withColumn("head", F.col("extra") * (F.col("size") + 1))
        .withColumn(
            "range_id",
            F.when(row < F.col("head"), F.floor(row / (F.col("size") + 1)))
            .otherwise(F.col("extra") + F.floor((row - F.col("head")) / F.greatest(F.col("size"), F.lit(1))))
            .cast("int"),
        )
        .drop("size", "extra", "head")
    )


def batches(df: DataFrame, batch_size: int) -> DataFrame:
    return df.withColumn("batch_id", F.floor(F.col("row_id") / batch_size).cast("bigint"))


def position_within(df: DataFrame, group: str, output: str, chunks: int | None = None) -> DataFrame:
    """0-based position of ``row_id`` inside its group, however large the group is.

    Rows are cut into ranges of (group, row_id) of about equal size and numbered
    inside each range; the sizes of a group's earlier ranges are added.  The
    ranges are stored, so that all steps see the same ones.
    """
    keys = [group, "row_id"]
    ranged = df.repartitionByRange(chunks, *keys) if chunks else df.repartitionByRange(*keys)
    chunked = materialize(ranged.withColumn("chunk", F.spark_partition_id()), "ranges")
    sizes = chunked.groupBy(group, "chunk").agg(F.count("*").alias("chunk_rows"))
    # One row per range a group reaches into.
    before = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "chunk", F.coalesce(F.sum("chunk_rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "chunk").orderBy("row_id")
    return (
        chunked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, [group, "chunk"])
        .withColumn(output, F.col("offset") + F.col("inside"))
        .drop("chunk", "inside", "offset")
    )


# Holds the rows that no centroid is nearest to.
REST_CELL = -1


def semantic(assigned: DataFrame, max_vectors_per_shard: int) -> DataFrame:
    """Shards from clusters: one per ``cell_id``, split where a cell exceeds the cap.

    Shards are numbered by (cell, part).  Rows without a cell are kept in a rest
    cell, numbered -1, which comes first.  The assignment is stored once, as its
    cell sizes are needed before the rows can be placed.  Only (cell, row_id) pairs of large
    cells are ranked, to find the first row of every part; the vectors stay where they are.
    """
    cap = max_vectors_per_shard
    assigned = materialize(assigned.withColumn("cell_id", F.coalesce("cell_id", F.lit(REST_CELL)).cast("bigint")), "cells")
    sizes = materialize(assigned.groupBy("cell_id").agg(F.count("*").alias("cell_rows")), "sizes")
    large = assigned.select("cell_id", F.col("row_id").cast("bigint").alias("row_id")).join(
        F.broadcast(sizes.filter(F.col("cell_rows") > cap).select("cell_id")), "cell_id"
    )
    heads = position_within(large, "cell_id", "position").filter(F.col("position") % cap == 0)
    # One row per shard.
    heads = heads.select("cell_id", "row_id").unionByName(sizes.filter(F.col("cell_rows") <= cap).select("cell_id", F.lit(_LOWEST).alias("row_id")))
    return _placed(assigned, np.array(sorted(tuple(r) for r in heads.collect()), np.int64).reshape(-1, 2))


_LOWEST = -(1 << 63)


def _placed(assigned: DataFrame, heads: np.ndarray) -> DataFrame:
    """Add ``shard_id``: the last of ``heads`` (cell, first row; sorted) of the row's cell that is not after the row."""
    cells, begins = np.unique(heads[:, 0], return_index=True)
    ends = np.append(begins[1:], len(heads))

    @F.pandas_udf("int")
    def shard(cell: pd.Series, row: pd.Series) -> pd.Series:
        found = np.empty(len(cell), np.int32)
        owner, rows = np.searchsorted(cells, cell.to_numpy()), row.to_numpy()
        for own in np.unique(owner):
            mine = owner == own
            a, b = begins[own], ends[own]
            found[mine] = a + np.searchsorted(heads[a:b, 1], rows[mine], side="right") - 1
        return pd.Series(found)

    return assigned.withColumn("shard_id", shard("cell_id", F.col("row_id").cast("bigint")))


def shard_filter(df: DataFrame, shard_id: int) -> DataFrame:
    return df.filter(F.col("shard_id") == shard_id).select("id", "embedding")


def distinct_shards(df: DataFrame) -> DataFrame:
    return df.select("shard_id").distinct()


def validate_dims(df: DataFrame, dims: int, column: str = "embedding") -> DataFrame:
    """Pass rows through; a vector of another length raises."""
    ok = F.size(column) == dims
    message = F.concat(F.lit(f"a vector does not have {dims} elements but "), F.size(column).cast("string"))
    checked = F.when(ok, F.col(column)).otherwise(F.raise_error(message).cast(df.schema[column].dataType))
    return df.withColumn(column, checked)


def dims_report(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.groupBy(F.size(column).alias("dims")).agg(F.count("*").alias("n_vectors"))


def shard_stats(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Size and mean-vector norm of every shard, from per-task partial sums."""
    means = vector_means(df, "shard_id", column)
    squares = F.aggregate("mean", F.lit(0.0), lambda acc, x: acc + x * x)
    return means.select("shard_id", F.col("n").alias("n_vectors"), F.sqrt(squares).alias("centroid_norm"))


def shard_metadata(df: DataFrame) -> DataFrame:
    return (
        df.groupBy("shard_id")
        .agg(F.count("*").alias("n_vectors"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
        .withColumn("index_path", F.concat(F.lit("shard_id="), F.col("shard_id").cast("string")))
    )


def write_shards(df: DataFrame, path: str) -> DataFrame:
    """Write ``id, embedding`` by shard in one pass plus the shard metadata; returns the metadata.

    Dimensions are taken from the first row; any other length raises.
    """
    first = df.select(F.size("embedding").alias("dims")).first()
    if first is None:
        raise ValueError("no vectors to write")
    rows = validate_dims(df.select("id", "embedding", "shard_id"), first["dims"])
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<float>"))
    vectors = f"{path}/vectors"
    spread_by(rows, "shard_id").sortWithinPartitions("shard_id", "id").write.mode("overwrite").partitionBy("shard_id").parquet(vectors)
    stored = df.sparkSession.read.parquet(vectors)
    metadata = shard_metadata(stored).withColumn("created_at", F.unix_millis(F.current_timestamp()))
    metadata.coalesce(1).write.mode("overwrite").json(f"{path}/metadata")
    return read_shard_metadata(df.sparkSession, path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")


def read_shard_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "shard_id int, n_vectors bigint, min_id bigint, max_id bigint, index_path string, created_at bigint"
    return spark.read.schema(schema).json(f"{path}/metadata")


def metadata_document(metadata: DataFrame) -> str:
    """The metadata as one JSON document; one entry per shard."""
    rows = metadata.select("shard_id", "index_path", "created_at").orderBy("shard_id").collect()
    return json.dumps({"shards": [r.asDict() for r in rows], "total_shards": len(rows)}, indent=2)
