"""Registered queries: every operator run over the whole test tables.

The query set is the whole ``embeddings`` table, as is the base table.  Index
centroids are the mean vectors of the labels, so that SQL can build the same
index.  Evaluation queries leave out the trivial self match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import distance, quantize, text
from nearfield.operators import batch, embed, evaluate, ivf, knn, lsh, report, shards, successor, twolevel
from nearfield.plans import evaluation, pipeline
from nearfield.session import materialize, scratch_path
from nearfield.sources import catalog, vecbin

Query = Callable[[SparkSession, str], DataFrame]
KS = (1, 10, 100)
N_SHARDS = 8
N_LABELS = 10

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def registered() -> dict[str, Query]:
    return dict(_QUERIES)


# Inputs ---------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Base table and query set, both the whole embeddings table."""
    rows = table(spark, sf_dir, "embeddings")
    base = rows.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"), "label")
    return base, rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def base_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(spark, sf_dir)[0]


def asked_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors_of(spark, sf_dir)[1]


def sharded_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), "embedding", F.col("label").alias("shard_id"))


def centroids_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = batch.vector_means(base_of(spark, sf_dir), "label", "vector")
    return means.select(F.col("label").alias("cell_id"), F.col("mean").cast("array<float>").alias("centroid"))


def id_map_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External ids for the rows that ``labels`` covers; the others keep their position."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("row_id"), (F.col("doc_id") * 10 + 7).alias("external_id")
    )


def truth_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_knn(*vectors_of(spark, sf_dir), max(KS), exclude_self=True)


def coarse_hits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_knn(*vectors_of(spark, sf_dir), max(KS), precision="i8", exclude_self=True)


def index_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    centroids = materialize(centroids_of(spark, sf_dir), "centroids")
    base = shards.round_robin(base_of(spark, sf_dir).select("row_id", "vector"), N_SHARDS)
    return ivf.build_ivf(base, centroids, scratch_path(spark, "index")), centroids


def hits_out(hits: DataFrame, *extra: str) -> DataFrame:
    return hits.select("query_id", "neighbor_id", r6("distance"), F.col("rank").cast("int").alias("rank"), *extra)


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def elements(df: DataFrame, key: str, column: str, kind: str = "double") -> DataFrame:
    """One row per vector element, so that results compare as scalars."""
    flat = df.select(F.col(key), F.posexplode(column).alias("i", "value"))
    value = F.col("value").cast(kind)
    return flat.select(key, "i", (F.round(value, 6) if kind == "double" else value).alias("value"))


def written(spark: SparkSession, sf_dir: str, extension: str, vector: Column | None = None) -> str:
    """The embeddings as a folder of binary matrix files."""
    path = scratch_path(spark, "matrix")
    rows = base_of(spark, sf_dir)
    vecbin.write_vectors(rows.withColumn("vector", vector) if vector is not None else rows, path, extension)
    return path


# Search ---------------------------------------------------------------------


@query
def exact_knn_l2(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "l2"))


@query
def exact_knn_ip(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "ip"))


@query
def exact_knn_cos(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "cos"))


@query
def exact_knn_blocks(spark, sf_dir):
    """The same lists when the query set is searched block by block."""
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, block_rows=300))


@query
def precision_i8_topk(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "l2", "i8"))


@query
def precision_f16_topk(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "l2", "f16"))


@query
def precision_bf16_topk(spark, sf_dir):
    return hits_out(knn.exact_knn(*vectors_of(spark, sf_dir), 10, "l2", "bf16"))


@query
def shard_local_topk(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    base = shards.round_robin(base, N_SHARDS)
    hits = knn.shard_local_topk(base, asked, 10, N_SHARDS)
    return hits_out(hits, F.col("shard_id").cast("int").alias("shard_id"))


@query
def sharded_search(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    base = shards.round_robin(base, N_SHARDS)
    return hits_out(knn.sharded_knn(base, asked, 10, N_SHARDS))


@query
def merge_topk(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    low = knn.exact_knn(base.filter(F.col("label") < N_LABELS // 2), asked, 10)
    high = knn.exact_knn(base.filter(F.col("label") >= N_LABELS // 2), asked, 10)
    return hits_out(knn.merge_parts([low, high], 10))


@query
def late_materialize(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    hits = knn.exact_knn(base, asked, 10)
    found = knn.with_payload(hits, base, ["label"])
    return hits_out(found, "label")


@query
def rerank_i8(spark, sf_dir):
    return hits_out(knn.quantized_knn(*vectors_of(spark, sf_dir), 10, "l2", oversample=2))


@query
def ivf_build(spark, sf_dir):
    index, _ = index_of(spark, sf_dir)
    return ivf.index_cells(index)


@query
def ivf_search(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=3))


@query
def ivf_search_blocks(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=3, block_rows=300))


@query
def ivf_search_table(spark, sf_dir):
    """The same lists when no query passes through the driver: a table of queries meets the probed cells in a join."""
    index, centroids = index_of(spark, sf_dir)
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=3, block_rows=64))


@query
def ivf_two_level(spark, sf_dir):
    """K-means cells inside k-means cells; probing all must give the exact answer."""
    base = base_of(spark, sf_dir).select("row_id", "vector")
    coarse, fine = twolevel.train_two_level(base, N_LABELS, 8)
    path = twolevel.build_two_level(base, coarse, fine, scratch_path(spark, "index"))
    return hits_out(twolevel.search_two_level(path, coarse, fine, asked_of(spark, sf_dir), 10, N_LABELS, 8 * N_LABELS))


@query
def lsh_search(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    index = lsh.build_lsh(base, scratch_path(spark, "index"))
    return hits_out(lsh.search_lsh(index, asked, 10))


@query
def sharded_ivf_search(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    return hits_out(ivf.sharded_ivf(index, centroids, asked_of(spark, sf_dir), 10, 3, N_SHARDS))


@query
def ivf_search_ip(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=3, metric="ip"))


@query
def nprobe_sweep(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    scores = evaluation.nprobe_sweep(
        index, centroids, asked_of(spark, sf_dir), truth_of(spark, sf_dir), [1, 2, 4, N_LABELS], 10, exclude_self=True
    )
    return scores.select("nprobe", "k", r6("recall"), r6("ndcg"), r6("overlap"), "n_evaluated")


@query
def kmeans_ivf_search(spark, sf_dir):
    base = base_of(spark, sf_dir).select("row_id", "vector")
    centroids = ivf.train_centroids(base, 16)
    index = ivf.build_ivf(base, centroids, scratch_path(spark, "index"))
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=4))


@query
def kmeans_ivf_full_probe(spark, sf_dir):
    """Probing every cell must give the exact answer, whatever the centroids are."""
    base = base_of(spark, sf_dir).select("row_id", "vector")
    centroids = ivf.train_centroids(base, 16)
    index = ivf.build_ivf(base, centroids, scratch_path(spark, "index"))
    return hits_out(ivf.search_ivf(index, centroids, asked_of(spark, sf_dir), 10, nprobe=16))


@query
def kmeans_ivf_checks(spark, sf_dir):
    """What holds for any centroids: more probes never worsen a best distance, and distances are those of the pairs."""
    base, asked = vectors_of(spark, sf_dir)
    centroids = ivf.train_centroids(base, 16)
    index = ivf.build_ivf(base.select("row_id", "vector"), centroids, scratch_path(spark, "index"))
    runs = None
    for nprobe in (1, 4, 16):
        hits = ivf.search_ivf(index, centroids, asked, 10, nprobe).withColumn("nprobe", F.lit(nprobe))
        runs = hits if runs is None else runs.unionByName(hits)
    runs = materialize(runs, "runs")
    best = runs.filter(F.col("rank") == 1).withColumn(
        "fewer", F.lag("distance").over(Window.partitionBy("query_id").orderBy("nprobe"))
    )
    worse = best.groupBy("nprobe").agg(
        F.count("*").alias("n_queries"), F.count_if(F.col("distance") > F.col("fewer")).alias("n_worse")
    )
    pairs = runs.join(asked, "query_id").join(
        base.select(F.col("row_id").alias("neighbor_id"), F.col("vector").alias("found")), "neighbor_id"
    )
    gap = F.abs(distance.l2sq(F.col("vector"), F.col("found")) - F.col("distance"))
    return worse.join(pairs.groupBy("nprobe").agg(F.count_if(gap > 1e-9).alias("n_wrong")), "nprobe")


@query
def query_by_vector(spark, sf_dir):
    means = batch.vector_means(base_of(spark, sf_dir), "label", "vector")
    rows = means.select(F.concat(F.lit("label "), F.col("label").cast("string")).alias("query"), F.col("mean").alias("vector"))
    path = scratch_path(spark, "asked")
    # One vector per label: the file holds as many objects as there are labels.
    rows.agg(F.to_json(F.collect_list(F.struct("query", "vector")))).coalesce(1).write.text(path)
    found = pipeline.query_by_vector(spark, base_of(spark, sf_dir), path, 10)
    return found.select("query", "neighbor_id", r6("distance"), F.col("rank").cast("int").alias("rank"))


@query
def search_observed(spark, sf_dir):
    hits, seen = batch.observe_hits(knn.exact_knn(*vectors_of(spark, sf_dir), 10))
    hits.write.format("noop").mode("overwrite").save()
    metrics = seen.get
    row = [(metrics["n_hits"], metrics["max_rank"], metrics["max_distance"])]
    seen_rows = spark.createDataFrame(row, "n_hits bigint, max_rank int, max_distance double")
    return seen_rows.select("n_hits", "max_rank", r6("max_distance"))


# Hit-list functions -----------------------------------------------------------


@query
def rank_score(spark, sf_dir):
    hits = knn.exact_knn(*vectors_of(spark, sf_dir), 10)
    return hits.select("query_id", "neighbor_id", F.round(distance.rank_score(F.col("rank")), 6).alias("score"))


@query
def map_external_ids(spark, sf_dir):
    hits = knn.exact_knn(*vectors_of(spark, sf_dir), 10)
    return hits_out(knn.map_external_ids(hits, id_map_of(spark, sf_dir)))


@query
def checked_int_ids(spark, sf_dir):
    hits = knn.exact_knn(*vectors_of(spark, sf_dir), 10)
    return knn.checked_int_ids(hits).select("query_id", "neighbor_id", F.col("rank").cast("int").alias("rank"))


@query
def truncate_at_k(spark, sf_dir):
    return hits_out(knn.truncate_at_k(knn.exact_knn(*vectors_of(spark, sf_dir), 100), 5))


@query
def limit_base(spark, sf_dir):
    base = evaluation.limit_base(base_of(spark, sf_dir), 300)
    return hits_out(knn.exact_knn(base, asked_of(spark, sf_dir), 10))


@query
def limit_queries(spark, sf_dir):
    asked = evaluation.limit_queries(asked_of(spark, sf_dir), 50)
    return hits_out(knn.exact_knn(base_of(spark, sf_dir), asked, 10))


@query
def evaluable_queries(spark, sf_dir):
    truth = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("query_id"))
    return evaluate.evaluable_queries(asked_of(spark, sf_dir), truth).select("query_id")


# Vector functions -------------------------------------------------------------


def _with_label_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = batch.vector_means(base_of(spark, sf_dir), "label", "vector").select("label", "mean")
    return base_of(spark, sf_dir).join(means, "label")


@query
def dist_l2sq(spark, sf_dir):
    pairs = _with_label_mean(spark, sf_dir)
    return pairs.select("row_id", F.round(distance.l2sq(F.col("vector"), F.col("mean")), 6).alias("distance"))


@query
def dist_ip(spark, sf_dir):
    pairs = _with_label_mean(spark, sf_dir)
    return pairs.select("row_id", F.round(distance.ip(F.col("vector"), F.col("mean")), 6).alias("distance"))


@query
def dist_cos(spark, sf_dir):
    pairs = _with_label_mean(spark, sf_dir)
    return pairs.select("row_id", F.round(distance.cos(F.col("vector"), F.col("mean")), 6).alias("distance"))


def _stretched(by: float) -> Column:
    return F.transform("vector", lambda x: x * F.lit(by).cast("float"))


@query
def quantize_i8(spark, sf_dir):
    codes = base_of(spark, sf_dir).withColumn("codes", quantize.quantize_i8(_stretched(3.0)))
    return elements(codes, "row_id", "codes", "int")


@query
def quantize_i8_wrap(spark, sf_dir):
    codes = base_of(spark, sf_dir).withColumn("codes", quantize.quantize_i8(_stretched(3.0), overflow="wrap"))
    return elements(codes, "row_id", "codes", "int")


@query
def dequantize_i8(spark, sf_dir):
    rows = base_of(spark, sf_dir).withColumn("restored", quantize.dequantize_i8(quantize.quantize_i8(F.col("vector"))))
    return elements(rows, "row_id", "restored")


@query
def scale_u8(spark, sf_dir):
    rows = base_of(spark, sf_dir).withColumn("scaled", quantize.scale_u8(quantize.quantize_i8(F.col("vector"))))
    return elements(rows, "row_id", "scaled")


@query
def round_f16(spark, sf_dir):
    rows = base_of(spark, sf_dir).withColumn("rounded", quantize.round_precision(F.col("vector"), "f16"))
    return elements(rows, "row_id", "rounded")


@query
def round_bf16(spark, sf_dir):
    rows = base_of(spark, sf_dir).withColumn("rounded", quantize.round_precision(F.col("vector"), "bf16"))
    return elements(rows, "row_id", "rounded")


@query
def cast_f32(spark, sf_dir):
    wide = base_of(spark, sf_dir).withColumn("wide", F.transform("vector", lambda x: x.cast("double") / 3))
    return elements(wide.withColumn("narrow", quantize.cast_f32(F.col("wide"))), "row_id", "narrow")


@query
def validate_dims(spark, sf_dir):
    checked = shards.validate_dims(table(spark, sf_dir, "embeddings"), 64)
    return shards.dims_report(checked)


@query
def format_memory(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", text.format_memory(F.col("n_chars") * 100003).alias("memory"))


@query
def path_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.path_extension(F.col("url")).alias("extension"))


@query
def storage_estimate(spark, sf_dir):
    return report.storage_estimate(table(spark, sf_dir, "embeddings"), factor=2.0)


# Sharding and batches -----------------------------------------------------------


@query
def round_robin_shards(spark, sf_dir):
    return shards.round_robin(base_of(spark, sf_dir), N_SHARDS).select("row_id", "shard_id")


@query
def contiguous_ranges(spark, sf_dir):
    return shards.contiguous(base_of(spark, sf_dir), 7).select("row_id", "range_id")


@query
def fixed_batches(spark, sf_dir):
    return shards.batches(base_of(spark, sf_dir), 128).select("row_id", "batch_id")


@query
def semantic_shards(spark, sf_dir):
    assigned = ivf.assign_cells(base_of(spark, sf_dir).select("row_id", "vector"), centroids_of(spark, sf_dir))
    return shards.semantic(assigned, 30).select("row_id", "cell_id", "shard_id")


@query
def semantic_shards_all_rows(spark, sf_dir):
    """Zero and missing vectors have no cell under cosine and are kept all the same."""
    base, number = base_of(spark, sf_dir), F.col("row_id") % 10
    vector = F.when(number == 3, _stretched(0.0)).when(number != 7, F.col("vector"))
    assigned = ivf.assign_cells(base.select("row_id", vector.alias("vector")), centroids_of(spark, sf_dir), "cos")
    return shards.semantic(assigned, 30).select("row_id", "cell_id", "shard_id")


@query
def shard_filter(spark, sf_dir):
    path = scratch_path(spark, "shards")
    shards.write_shards(sharded_of(spark, sf_dir), path)
    return elements(shards.shard_filter(shards.read_shards(spark, path), 3), "id", "embedding")


@query
def shard_stats(spark, sf_dir):
    return shards.shard_stats(sharded_of(spark, sf_dir)).select("shard_id", "n_vectors", r6("centroid_norm"))


@query
def distinct_shards(spark, sf_dir):
    return shards.distinct_shards(sharded_of(spark, sf_dir))


@query
def map_vector_batches(spark, sf_dir):
    def total(rows: batch.VectorBatch) -> dict:
        return {"start_index": rows.start_index, "n_vectors": len(rows), "total": float(rows.vectors.astype("f8").sum())}

    done = batch.apply_to_batches(base_of(spark, sf_dir), total, "start_index bigint, n_vectors bigint, total double", 128)
    return done.select("batch_id", "start_index", "n_vectors", r6("total"))


@query
def map_byte_batches(spark, sf_dir):
    def total(rows: batch.VectorBatch) -> dict:
        return {"n_vectors": len(rows), "total": int(rows.byte_vectors.astype("i8").sum())}

    return batch.apply_to_batches(base_of(spark, sf_dir), total, "n_vectors bigint, total bigint", 128, as_bytes=True)


# Sources and sinks ----------------------------------------------------------------


@query
def read_vectors(spark, sf_dir):
    return elements(vecbin.read_vectors(spark, written(spark, sf_dir, ".fbin")), "row_id", "vector")


@query
def read_slice(spark, sf_dir):
    rows = vecbin.read_vectors(spark, written(spark, sf_dir, ".fbin"), start_row=100, max_rows=250)
    return elements(rows, "row_id", "vector")


@query
def read_one_shard(spark, sf_dir):
    path = scratch_path(spark, "shard-files")
    vecbin.write_shard_files(sharded_of(spark, sf_dir), path)
    return elements(vecbin.read_shard_files(spark, path, shard=3), "id", "embedding")


@query
def decode_f64(spark, sf_dir):
    path = written(spark, sf_dir, ".dbin", F.transform("vector", lambda x: x.cast("double") / 3))
    return elements(vecbin.read_vectors(spark, path), "row_id", "vector")


@query
def decode_f16(spark, sf_dir):
    return elements(vecbin.read_vectors(spark, written(spark, sf_dir, ".hbin")), "row_id", "vector")


@query
def decode_i8(spark, sf_dir):
    path = written(spark, sf_dir, ".i8bin", quantize.quantize_i8(F.col("vector")))
    return elements(vecbin.read_vectors(spark, path), "row_id", "vector")


@query
def decode_u8(spark, sf_dir):
    unsigned = F.transform(quantize.quantize_i8(F.col("vector")), lambda c: F.pmod(c.cast("int"), F.lit(256)))
    return elements(vecbin.read_vectors(spark, written(spark, sf_dir, ".u8bin", unsigned)), "row_id", "vector")


@query
def vector_info(spark, sf_dir):
    found = vecbin.vector_info(spark, [written(spark, sf_dir, ".fbin")])
    return found.groupBy("type").agg(F.sum("rows").alias("rows"), F.max("dims").alias("dims"))


def _truth_files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    # The lists are written as they were ranked; both files come from one search.
    stored = scratch_path(spark, "truth")
    knn.exact_knn(*vectors_of(spark, sf_dir), 100).write.parquet(stored)
    truth = spark.read.parquet(stored)
    ids, distances = scratch_path(spark, "truth-ids"), scratch_path(spark, "truth-distances")
    vecbin.write_truth(truth, ids, "neighbor_id", ".ibin")
    vecbin.write_truth(truth, distances, "distance", ".f32bin")
    return ids, distances


@query
def read_truth(spark, sf_dir):
    return vecbin.read_truth(spark, _truth_files(spark, sf_dir)[0])


@query
def truth_with_distance(spark, sf_dir):
    rows = vecbin.read_truth_with_distance(spark, *_truth_files(spark, sf_dir))
    return rows.select("query_id", "rank", "neighbor_id", F.round(F.col("distance").cast("double"), 5).alias("distance"))


@query
def read_ids(spark, sf_dir):
    path = scratch_path(spark, "ids")
    rows = base_of(spark, sf_dir).select("row_id", F.array((F.col("row_id") * 10 + 7).cast("int")).alias("vector"))
    vecbin.write_vectors(rows, path, ".i32bin")
    return vecbin.read_ids(spark, path)


@query
def write_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    shards.write_shards(sharded_of(spark, sf_dir), path)
    stored = shards.read_shards(spark, path)
    return elements(stored.withColumn("key", F.col("shard_id") * 1000000 + F.col("id")), "key", "embedding")


@query
def write_shard_files(spark, sf_dir):
    path = scratch_path(spark, "shard-files")
    vecbin.write_shard_files(sharded_of(spark, sf_dir), path)
    stored = vecbin.read_shard_files(spark, path)
    return elements(stored.withColumn("key", F.col("shard_id") * 1000000 + F.col("id")), "key", "embedding")


@query
def shard_metadata(spark, sf_dir):
    metadata = shards.write_shards(sharded_of(spark, sf_dir), scratch_path(spark, "shards"))
    return metadata.select("shard_id", "index_path", "n_vectors", "min_id", "max_id")


# Scores and reports -------------------------------------------------------------


@query
def recall_at_k(spark, sf_dir):
    return evaluate.recall_at_k(coarse_hits_of(spark, sf_dir), truth_of(spark, sf_dir), KS)


@query
def ndcg_at_k(spark, sf_dir):
    return evaluate.ndcg_at_k(coarse_hits_of(spark, sf_dir), truth_of(spark, sf_dir), KS).select("query_id", "k", r6("ndcg"))


@query
def overlap_recall(spark, sf_dir):
    scores = evaluate.overlap_recall(coarse_hits_of(spark, sf_dir), truth_of(spark, sf_dir), KS)
    return scores.select("query_id", "k", r6("overlap"))


@query
def eval_summary(spark, sf_dir):
    scores = evaluate.eval_summary(coarse_hits_of(spark, sf_dir), truth_of(spark, sf_dir), KS)
    return scores.select("k", r6("recall"), r6("ndcg"), r6("overlap"), "n_evaluated")


@query
def fill_ratio(spark, sf_dir):
    index, centroids = index_of(spark, sf_dir)
    asked = asked_of(spark, sf_dir)
    hits = ivf.search_ivf(index, centroids, asked, max(KS), nprobe=1)
    return evaluate.fill_ratio(hits, asked, KS).select("query_id", "k", r6("fill_ratio"))


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.precision_sweep(
        *vectors_of(spark, sf_dir), truth_of(spark, sf_dir), KS, exclude_self=True
    )


@query
def precision_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("precision", "k", r6("recall"), r6("ndcg"), r6("overlap"), "n_evaluated")


@query
def results_pivot(spark, sf_dir):
    wide = report.results_pivot(_sweep(spark, sf_dir).withColumn("engine", F.lit("flat")), KS)
    return wide.select("engine", "precision", *[r6(f"{m}_at_{k}") for k in KS for m in ("recall", "ndcg")])


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows of the precision sweep; times are left at 0 to keep the rows reproducible."""
    maps = evaluate.metric_maps(_sweep(spark, sf_dir), ["precision"])
    sizes = report.storage_estimate(table(spark, sf_dir, "embeddings"))
    zero = F.lit(0).cast("bigint")
    return maps.join(sizes, "precision").select(
        zero.alias("timestamp"),
        F.lit("embeddings").alias("dataset"),
        F.lit("CLUSTER").alias("mode"),
        F.lit("flat").alias("engine"),
        "precision",
        zero.alias("indexing_time_ms"),
        zero.alias("search_time_ms"),
        zero.alias("pure_search_time_ms"),
        zero.alias("id_lookup_time_ms"),
        F.col("n_vectors").alias("num_queries"),
        F.col("n_vectors").alias("num_vectors"),
        F.col("total_bytes").alias("memory_bytes"),
        "recall_at_k",
        "ndcg_at_k",
    )


@query
def summary_rows(spark, sf_dir):
    path = scratch_path(spark, "summary")
    report.append_summary(_runs(spark, sf_dir), path)
    return report.read_summary(spark, path)


@query
def quality_table(spark, sf_dir):
    shown = report.quality_table(_runs(spark, sf_dir))
    names = {"Engine": "engine", "Precision": "precision", "Recall@10": "recall_10", "NDCG@10": "ndcg_10"}
    names |= {"Recall@100": "recall_100", "NDCG@100": "ndcg_100"}
    return shown.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


@query
def run_listing(spark, sf_dir):
    return report.run_listing(_runs(spark, sf_dir))


def _event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run per user: events are insertions, views are queries, values are milliseconds."""
    events = table(spark, sf_dir, "events")
    cost = F.floor(F.col("value")).cast("bigint")

    def spent(kind: str) -> Column:
        return F.sum(F.when(F.col("event_type") == kind, cost).otherwise(0))

    return events.groupBy("user_id").agg(
        F.count("*").alias("num_vectors"),
        F.sum(F.when(F.col("event_type") == "view", 1).otherwise(0)).alias("num_queries"),
        spent("signup").alias("indexing_time_ms"),
        (spent("view") + spent("click")).alias("search_time_ms"),
        spent("view").alias("pure_search_time_ms"),
        spent("click").alias("id_lookup_time_ms"),
        F.sum(cost * 1000003).alias("memory_bytes"),
        F.lit("flat").alias("engine"),
        F.concat(F.lit("user "), F.first("user_id").cast("string")).alias("precision"),
    )


@query
def throughput_rates(spark, sf_dir):
    rated = report.throughput_rates(_event_runs(spark, sf_dir), cores=8)
    rates = ["throughput_ips", "throughput_qps", "pure_search_qps", "id_lookup_qps"]
    rates += ["ips_per_core", "qps_per_core", "lookup_overhead_pct"]
    return rated.select("user_id", *[r6(n) for n in rates])


@query
def performance_table(spark, sf_dir):
    shown = report.performance_table(_event_runs(spark, sf_dir))
    return shown.select(
        F.col("Engine").alias("engine"), F.col("Precision").alias("run"), F.col("IPS").alias("ips"), F.col("QPS").alias("qps"),
        F.col("Memory").alias("memory"),
    )


@query
def union_results(spark, sf_dir):
    base, asked = vectors_of(spark, sf_dir)
    base = shards.round_robin(base, N_SHARDS)
    truth = knn.exact_knn(base, asked, 10)
    local = evaluate.eval_summary(knn.exact_knn(base, asked, 10, precision="i8"), truth, (1, 10))
    spread = evaluate.eval_summary(knn.sharded_knn(base, asked, 10, N_SHARDS), truth, (1, 10))
    merged = report.union_results(
        local.withColumn("mode", F.lit("local")),
        spread.withColumn("mode", F.lit("cluster")).withColumn("num_shards", F.lit(N_SHARDS)),
    )
    shards_or_none = F.coalesce("num_shards", F.lit(-1)).alias("num_shards")
    return merged.select("mode", "k", r6("recall"), r6("ndcg"), "n_evaluated", shards_or_none)


# Text ---------------------------------------------------------------------------


@query
def tfidf_terms(spark, sf_dir):
    vocab = embed.vocabulary(table(spark, sf_dir, "documents"))
    return vocab.select(
        "term", F.col("term_id").cast("int").alias("term_id"), F.col("df").cast("bigint").alias("df"),
        F.col("total").cast("bigint").alias("total"), r6("idf"),
    )


@query
def tfidf_weights(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    counts = materialize(embed.term_counts(documents), "counts")
    weights = embed.tfidf(counts, embed.vocabulary(counts))
    return weights.select("doc_id", F.col("term_id").cast("int").alias("term_id"), "tf", r6("weight"))


@query
def tfidf_svd_embed(spark, sf_dir):
    return embed.tfidf_svd(table(spark, sf_dir, "documents"))


@query
def tfidf_svd_products(spark, sf_dir):
    """With as many components as terms, embeddings keep the products of the weight rows.

    Each document with itself and with the next number; the products of the weights are
    returned, and whether those of the embeddings equal them.
    """
    documents, features = successor.in_order(table(spark, sf_dir, "documents").select("doc_id", "text")), 1024
    return _products(documents, features, embed.tfidf_svd(documents, features, features))


@query
def tfidf_svd_wide(spark, sf_dir):
    """The same over sixteen times the vocabulary; 1,034 columns of the sketch are as many as 1,000 documents can span."""
    documents, features = successor.in_order(table(spark, sf_dir, "documents").select("doc_id", "text")), 16384
    return _products(documents, features, embed.tfidf_svd_wide(documents, features, 1024))


def _products(documents: DataFrame, features: int, embedded: DataFrame) -> DataFrame:
    weights = embed.tfidf(documents, embed.vocabulary(documents, features)).select("doc_id", "term_id", "weight")
    if successor.numbered(documents):
        # Neither the weights nor the embeddings move.
        sums = successor.sparse_products(weights).select("doc_id", F.col("own").alias("square"), F.col("other").alias("product"))
        found = successor.dense_products(embedded).withColumns({name: F.coalesce(name, F.lit(0.0)) for name in ("other", "size")})
    else:
        sums, found = _joined_products(weights, materialize(embedded, "embedded"))
    expected = {name: F.coalesce(name, F.lit(0.0)) for name in ("square", "product")}
    bound = 1e-4 * F.greatest(F.lit(1.0), F.col("square"), F.sqrt(F.col("square") * F.col("size")))
    checked = found.join(sums, "doc_id", "left").withColumns(expected)
    same = (F.abs(F.col("own") - F.col("square")) <= bound) & (F.abs(F.col("other") - F.col("product")) <= bound)
    return checked.select("doc_id", F.round("square", 3).alias("square"), F.round("product", 3).alias("product"), same.alias("same"))


def _joined_products(weights: DataFrame, embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where several documents share a number, each meets all of the next."""
    after = weights.select((F.col("doc_id") - 1).alias("doc_id"), "term_id", F.col("weight").alias("next"))
    sums = weights.join(after, ["doc_id", "term_id"], "left").groupBy("doc_id").agg(
        F.sum(F.col("weight") * F.col("weight")).alias("square"),
        F.sum(F.col("weight") * F.coalesce("next", F.lit(0.0))).alias("product"),
    )
    later = embedded.select((F.col("doc_id") - 1).alias("doc_id"), F.col("embedding").alias("next"))

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)

    found = embedded.join(later, "doc_id", "left").select(
        "doc_id",
        dot("embedding", "embedding").alias("own"),
        F.coalesce(dot("embedding", "next"), F.lit(0.0)).alias("other"),
        F.coalesce(dot("next", "next"), F.lit(0.0)).alias("size"),
    )
    return sums, found


@query
def text_to_shards(spark, sf_dir):
    cap = 200
    config = pipeline.PipelineConfig(
        f"{sf_dir}/documents.parquet", scratch_path(spark, "vectors"), svd_components=64, max_vectors_per_shard=cap,
        clustering_sample_rate=1.0,
    )
    metadata = pipeline.text_to_shards(spark, config)
    return metadata.agg(
        F.sum("n_vectors").alias("n_vectors"),
        (F.max("n_vectors") <= cap).alias("within_cap"),
        F.min("min_id").alias("min_id"),
        F.max("max_id").alias("max_id"),
    )


# Whole jobs -----------------------------------------------------------------------


@query
def run_evaluation(spark, sf_dir):
    return _evaluated(spark, sf_dir, "cluster")


@query
def run_evaluation_local(spark, sf_dir):
    return _evaluated(spark, sf_dir, "local")


def _evaluated(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    """The embeddings as dataset files, then every engine and precision.

    The index search probes all cells here, so its scores are reproducible.
    """
    root = scratch_path(spark, "datasets")
    folder = f"{root}/embeddings"
    base = base_of(spark, sf_dir).select("row_id", "vector")
    vecbin.write_vectors(base, f"{folder}/base.fbin", ".fbin")
    vecbin.write_vectors(base, f"{folder}/query.fbin", ".fbin")
    vecbin.write_truth(knn.exact_knn(base, asked_of(spark, sf_dir), 100), f"{folder}/groundtruth.ibin")
    definition = catalog.DatasetDefinition("embeddings", 64, "l2", "fbin", "ibin", None, 0, 100)
    dataset = catalog.load_dataset(spark, "embeddings", root, definition)
    config = evaluation.EvaluationConfig(mode, nlist=16, nprobe=16, num_queries=-1)
    runs = evaluation.run_evaluation(spark, dataset, config)
    scores = runs.select("*", F.explode("recall_at_k").alias("k", "recall"))
    return scores.select(
        "engine",
        "precision",
        "k",
        r6("recall"),
        F.round(F.element_at("ndcg_at_k", F.col("k")), 6).alias("ndcg"),
        "num_queries",
        "num_vectors",
        "dimensions",
        "memory_bytes",
    )
