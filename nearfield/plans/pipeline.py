"""Text corpus to sharded vectors, and search by a single vector."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators import embed, ivf, knn, shards
from nearfield.session import materialize
from nearfield.sources import files


@dataclass
class PipelineConfig:
    """Settings of the pipeline file, with its defaults."""

    input_path: str
    output_path: str
    tfidf_features: int = 1024
    svd_components: int = 512
    min_doc_freq: int = 2
    max_vectors_per_shard: int = 1_000_000_000
    clustering_sample_rate: float = 0.01
    kmeans_iterations: int = 10
    default_top_k: int = 10
    num_clusters: int = 16

    @classmethod
    def load(cls, path: str) -> "PipelineConfig":
        with files.open_read(path) as source:
            document = json.loads(source.read())
        known = cls.__dataclass_fields__
        flat = {k: v for part in document.values() for k, v in part.items() if k in known}
        return cls(**flat)


def text_to_shards(spark: SparkSession, config: PipelineConfig) -> DataFrame:
    """Embed ``doc_id, text``, cluster, cut to the shard cap and write; returns the shard metadata."""
    documents = spark.read.parquet(config.input_path).select("doc_id", "text")
    embedded = embed.tfidf_svd(documents, config.tfidf_features, config.svd_components, config.min_doc_freq)
    vectors = materialize(embedded.select(F.col("doc_id").alias("row_id"), F.col("embedding").alias("vector")), "embedded")
    centroids = ivf.train_centroids(vectors, config.num_clusters, config.clustering_sample_rate, config.kmeans_iterations)
    placed = shards.semantic(ivf.assign_cells(vectors, centroids), config.max_vectors_per_shard)
    rows = placed.select(F.col("row_id").alias("id"), F.col("vector").alias("embedding"), "shard_id")
    return shards.write_shards(rows, config.output_path)


def query_by_vector(
    spark: SparkSession, base: DataFrame, json_path: str, k: int = PipelineConfig.default_top_k, metric: str = "l2"
) -> DataFrame:
    """Top-K for the vectors of a JSON file ``{"query": ..., "vector": [...]}`` (one object or several).

    Pass ``config.default_top_k`` as ``k`` to follow a pipeline file.
    """
    asked = spark.read.schema("query string, vector array<double>").option("multiLine", True).json(json_path)
    rows = asked.select("query", "vector").withColumn("query_id", F.xxhash64("query", F.col("vector").cast("string")))
    hits = knn.exact_knn(base, rows.dropDuplicates(["query_id"]), k, metric)
    return hits.join(rows.select("query_id", "query"), "query_id").select("query", "neighbor_id", "distance", "rank")
