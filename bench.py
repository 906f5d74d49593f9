"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

``queries`` holds seconds per query (best of two runs, results written to the
noop sink).  ``search`` repeats index build and search on a table enlarged from
the embeddings, in the units of the published figures: insertions and queries
per second, with recall and NDCG.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from nearfield.operators import evaluate, ivf, knn  # noqa: E402
from nearfield.registered import registered  # noqa: E402
from nearfield.session import scratch_path  # noqa: E402

HEADLINE = (
    "exact_knn_l2",
    "exact_knn_ip",
    "exact_knn_cos",
    "precision_i8_topk",
    "sharded_search",
    "shard_local_topk",
    "ivf_build",
    "ivf_search",
    "late_materialize",
    "map_external_ids",
    "rerank_i8",
    "eval_summary",
    "precision_sweep",
    "quantize_i8",
    "read_vectors",
    "write_shards",
    "shard_stats",
    "map_vector_batches",
    "tfidf_terms",
    "tfidf_weights",
    "tfidf_svd_embed",
)
COPIES = 50
QUERY_COPIES = 5
NLIST = 128
K = 100


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    started = time.perf_counter()
    action()
    return time.perf_counter() - started


def enlarged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding COPIES times, each coordinate moved by a hash of (id, copy, position)."""

    def moved(x, i):
        return (x + (F.pmod(F.hash("vec_id", "copy", i), F.lit(2001)) - 1000) / F.lit(8000.0)).cast("float")

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    path = scratch_path(spark, "enlarged")
    rows.select(
        (F.col("vec_id") * COPIES + F.col("copy")).alias("row_id"), F.transform("embedding", moved).alias("vector")
    ).repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.parquet(path)


def search_rates(spark: SparkSession, sf_dir: str) -> dict:
    base = enlarged(spark, sf_dir)
    asked = base.filter(F.col("row_id") % COPIES < QUERY_COPIES).withColumnRenamed("row_id", "query_id")
    n, n_queries = base.count(), asked.count()
    rates: dict = {"vectors": n, "queries": n_queries, "k": K, "nlist": NLIST}
    truth_path = scratch_path(spark, "truth")
    knn.exact_knn(base, asked, K, exclude_self=True).write.parquet(truth_path)
    truth = spark.read.parquet(truth_path)

    def scored(name: str, search) -> None:
        path = scratch_path(spark, "hits")
        run(search())
        seconds = timed(lambda: search().write.parquet(path))
        summary = evaluate.eval_summary(spark.read.parquet(path), truth, (1, 10, K)).collect()
        rates[name] = {
            "qps": round(n_queries / seconds, 1),
            "recall": {r["k"]: round(r["recall"], 4) for r in summary},
            "ndcg": {r["k"]: round(r["ndcg"], 4) for r in summary},
        }

    for precision in ("f32", "f16", "bf16", "i8"):
        scored(f"flat_{precision}", lambda: knn.exact_knn(base, asked, K, precision=precision, exclude_self=True))
    centroids = ivf.train_centroids(base, NLIST, sample_rate=0.1)
    paths = [scratch_path(spark, "index") for _ in range(2)]
    seconds = min(timed(lambda: ivf.build_ivf(base, centroids, path)) for path in paths)
    rates["ivf_build_ips"] = round(n / seconds, 1)
    index = ivf.read_index(spark, paths[-1])
    for nprobe in (1, 4, 8):
        scored(f"ivf_nprobe_{nprobe}", lambda: ivf.search_ivf(index, centroids, asked, K, nprobe, exclude_self=True))
    return rates


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    known = registered()
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(min(timed(lambda: run(known[name](spark, sf_dir))) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
        "search": search_rates(spark, sf_dir),
    }
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
