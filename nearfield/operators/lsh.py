"""Hashing index: several tables of signed random projections, probed at several buckets each.

A vector's code in a table has one bit per projection, its sign.  A query looks into the bucket of its
own code and, table by table, into those that differ in one of the bits whose
projections are nearest to zero.  Buckets are the cells of :mod:`pairing`, so the queries stay a table, a
crowded bucket is cut into parts, and only K hits per query and part leave a group.

Each row is stored once per table.  Distances of the hits are exact; hits may be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from nearfield.functions.distance import check_metric
from nearfield.operators.kernel import to_matrix
from nearfield.operators.knn import rank_hits
from nearfield.operators.pairing import paired_lists
from nearfield.session import materialize, ship_package, spread_by

_PRIME = 2147483647


def planes(tables: int, bits: int, dims: int) -> np.ndarray:
    """(tables, bits, dims) signs, by an arithmetic rule on the three positions."""
    t, b, d = np.meshgrid(np.arange(tables), np.arange(bits), np.arange(dims), indexing="ij")
    mixed = (t * 1000003 + b * 10007 + d * 101 + 12345) % _PRIME
    for _ in range(3):
        mixed = (mixed * mixed % _PRIME + mixed * 48271 + 11) % _PRIME
    return np.where(mixed // 65536 % 2 == 0, 1.0, -1.0)


def buckets(vectors: np.ndarray, tables: int, bits: int, flips: int) -> np.ndarray:
    """(rows, tables, 1 + flips) bucket numbers, the row's own first, then by the flipped projection."""
    projected = np.einsum("nd,tbd->ntb", vectors.astype(np.float64), planes(tables, bits, vectors.shape[1]))
    own = ((projected > 0) * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
    weakest = np.argsort(np.abs(projected), axis=2, kind="stable")[:, :, :flips]
    return np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << weakest)], axis=2)


def with_buckets(df: DataFrame, tables: int, bits: int, flips: int, output: str) -> DataFrame:
    """Add ``output``: the buckets of ``vector`` in all tables; ``flips`` more of each table."""
    if not 0 <= flips <= bits:
        raise ValueError(f"flips must be from 0 to the number of bits, got {flips}")
    ship_package(df.sparkSession)
    position = df.columns.index("vector")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = buckets(to_matrix(batch.column(position)), tables, bits, flips).reshape(batch.num_rows, -1)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * found.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, output])

    return df.mapInArrow(hashed, StructType([*df.schema.fields, StructField(output, ArrayType(LongType()))]))


def build_lsh(base: DataFrame, path: str, tables: int = 12, bits: int = 6) -> DataFrame:
    """Write and reopen the index: ``row_id, vector, cell_id``, one row per table and vector; null vectors are left out."""
    rows = base.select("row_id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull())
    rows = with_buckets(rows, tables, bits, 0, "cells").select("row_id", "vector", F.explode("cells").alias("cell_id"))
    spread_by(rows, "cell_id").sortWithinPartitions("cell_id", "row_id").write.mode("overwrite").parquet(path)
    return base.sparkSession.read.schema(rows.schema).parquet(path)


def search_lsh(
    index: DataFrame, queries: DataFrame, k: int = 10, tables: int = 12, bits: int = 6, flips: int = 4, metric: str = "l2", exclude_self: bool = False
) -> DataFrame:
    """Approximate top-K of every query among the rows that share a probed bucket with it."""
    check_metric(metric)
    asked = queries.select("query_id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull())
    asked = materialize(with_buckets(asked, tables, bits, flips, "cells"), "queries")
    rows = index.select("row_id", "vector", "cell_id", F.lit(0).cast("bigint").alias("shard_id"))
    lists = paired_lists(rows, asked, k + 1 if exclude_self else k, metric, ["f32"])
    pairs = F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))
    hits = lists.select("query_id", F.inline(pairs))
    if exclude_self:
        hits = hits.filter(F.col("query_id") != F.col("neighbor_id"))
    # A neighbour met in several tables has the same distance in each.
    return rank_hits(hits.groupBy("query_id", "neighbor_id").agg(F.min("distance").alias("distance")), k)
