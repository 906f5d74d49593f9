import collections
import json
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import registered
from nearfield.operators import embed, successor, widesvd
from nearfield.plans import evaluation, pipeline
from nearfield.sources import catalog, vecbin
from tests.conftest import table_of

TEXTS = ["the cat sat", "The dog  sat\tdown", "a cat and a dog", "", "unique words only", "the the the end"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


def weights_of(texts, features, min_df):
    tokens = [t.lower().split() for t in texts]
    df = collections.Counter(w for t in tokens for w in set(t))
    total = collections.Counter(w for t in tokens for w in t)
    kept = sorted((w for w in df if df[w] >= min_df), key=lambda w: (-total[w], w))[:features]
    matrix = np.zeros((len(texts), len(kept)))
    for d, t in enumerate(tokens):
        for w in t:
            if w in kept:
                matrix[d, kept.index(w)] += math.log((len(texts) + 1) / (df[w] + 1))
    return kept, df, total, matrix


def test_vocabulary_and_weights(documents):
    kept, df, total, matrix = weights_of(TEXTS, 4, 2)
    vocab = embed.vocabulary(documents, 4, 2)
    rows = vocab.orderBy("term_id").collect()
    assert [(r["term"], r["df"], r["total"]) for r in rows] == [(w, df[w], total[w]) for w in kept]
    got = np.zeros_like(matrix)
    for r in embed.tfidf(documents, vocab).collect():
        got[r["doc_id"], r["term_id"]] = r["weight"]
    np.testing.assert_allclose(got, matrix)


def test_svd_equals_numpy(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(3)
    vocab = embed.vocabulary(documents, 50)
    weights = embed.tfidf(documents, vocab)
    matrix = np.zeros((documents.count(), 50))
    for r in weights.collect():
        matrix[r["doc_id"], r["term_id"]] = r["weight"]
    rows = embed.sparse_rows(documents, vocab)
    np.testing.assert_allclose(embed.gram_matrix(rows, 50), matrix.T @ matrix, rtol=1e-9)
    values = np.linalg.svd(matrix, compute_uv=False)
    embedded = embed.svd_embed(rows, 50, 8).orderBy("doc_id").collect()
    got = np.array([r["embedding"] for r in embedded])
    assert got.shape == (len(matrix), 8)
    np.testing.assert_allclose(np.linalg.norm(got, axis=0), values[:8], rtol=1e-4)
    full = np.array([r["embedding"] for r in embed.svd_embed(rows, 50, 50).orderBy("doc_id").collect()])
    np.testing.assert_allclose(full @ full.T, matrix @ matrix.T, rtol=1e-3, atol=1e-2)


def test_every_document_is_embedded(documents):
    rows = embed.tfidf_svd(documents, 4, 3, 2).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(6))
    assert rows[3]["embedding"] == [0.0] * len(rows[0]["embedding"]) and any(rows[0]["embedding"])


def test_text_to_shards(spark, sf_dir, tmp_path):
    settings = {
        "pipeline": {"input_path": f"{sf_dir}/documents.parquet", "output_path": str(tmp_path / "out"), "vector_dimensions": 512},
        "embedding": {"model_type": "tfidf_svd", "tfidf_features": 200, "svd_components": 16, "min_doc_freq": 2},
        "sharding": {"max_vectors_per_shard": 30, "clustering_sample_rate": 1.0, "kmeans_iterations": 5},
        "query": {"default_top_k": 10},
    }
    (tmp_path / "config.json").write_text(json.dumps(settings))
    config = pipeline.PipelineConfig.load(str(tmp_path / "config.json"))
    assert (config.svd_components, config.default_top_k, config.kmeans_iterations) == (16, 10, 5)
    metadata = pipeline.text_to_shards(spark, config).collect()
    assert sum(r["n_vectors"] for r in metadata) == 200 and max(r["n_vectors"] for r in metadata) <= 30


def test_query_by_vector_file(spark, tmp_path, rng):
    base = rng.normal(size=(50, 32)).astype(np.float32)
    (tmp_path / "q.json").write_text(json.dumps({"query": "example", "vector": base[7].astype(float).tolist()}, indent=2))
    hits = pipeline.query_by_vector(spark, table_of(spark, range(50), base), str(tmp_path / "q.json"))
    first = hits.filter("rank = 1").first()
    assert hits.count() == 10 and first["query"] == "example" and first["neighbor_id"] == 7


def test_run_evaluation(spark, embeddings, tmp_path):
    base = embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    folder = tmp_path / "mine"
    vecbin.write_vectors(base, str(folder / "base.fbin"))
    vecbin.write_vectors(base.filter("row_id < 60"), str(folder / "query.fbin"))
    ids = base.select("row_id", F.array((F.col("row_id") * 10 + 7).cast("int")).alias("vector"))
    vecbin.write_vectors(ids, str(folder / "ids.i32bin"), ".i32bin")
    queries = base.filter("row_id < 60").withColumnRenamed("row_id", "query_id")
    truth = evaluation.knn.exact_knn(base, queries, 20).withColumn("neighbor_id", F.col("neighbor_id") * 10 + 7)
    vecbin.write_truth(truth, str(folder / "groundtruth.ibin"))
    definition = catalog.DatasetDefinition("mine", 64, "l2", "fbin", "ibin", "i32bin", 0, 20)
    dataset = catalog.load_dataset(spark, "mine", str(tmp_path), definition)
    config = evaluation.EvaluationConfig(precisions=["f32", "I8"], k_values=(1, 10), num_queries=50, nlist=8, nprobe=2)
    runs = {(r["engine"], r["precision"]): r for r in evaluation.run_evaluation(spark, dataset, config).collect()}
    assert set(runs) == {(e, p) for e in ("flat", "ivf") for p in ("f32", "i8")}
    exact = runs["flat", "f32"]
    assert exact["recall_at_k"] == {1: 1.0, 10: 1.0} and exact["ndcg_at_k"] == {1: 1.0, 10: pytest.approx(1.0)}
    assert (exact["num_queries"], exact["num_vectors"], exact["dimensions"]) == (50, embeddings.count(), 64)
    assert exact["search_time_ms"] >= exact["id_lookup_time_ms"] > 0
    assert runs["ivf", "f32"]["recall_at_k"][1] == 1.0 and runs["ivf", "f32"]["ndcg_at_k"][10] < 1.0
    assert runs["ivf", "i8"]["memory_bytes"] * 4 == runs["ivf", "f32"]["memory_bytes"]


def test_bad_settings():
    for bad in ({"engines": ["graph"]}, {"mode": "distributed"}, {"precisions": ["f8"]}):
        with pytest.raises(ValueError):
            evaluation.EvaluationConfig(**bad)
    assert evaluation.EvaluationConfig(k_values=(3, 7)).max_k == 7


def test_limits(spark):
    rows = spark.range(10).select(F.col("id").alias("row_id"), F.col("id").alias("query_id"))
    assert evaluation.limit_base(rows, 4).count() == 4 and evaluation.limit_base(rows, -1).count() == 10
    assert evaluation.limit_queries(rows, 3).count() == 3 and evaluation.limit_queries(rows, 99).count() == 10


def sparse(spark, matrix):
    rows = [(i, np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist()) for i, r in enumerate(matrix)]
    return spark.createDataFrame(rows, "doc_id bigint, terms array<int>, weights array<double>").repartition(5)


def embedded(df):
    return np.array([r["embedding"] for r in df.orderBy("doc_id").collect()])


def test_wide_svd_of_low_rank_is_exact(spark, rng):
    """Rank 12 over 3,000 terms, with empty rows: products and singular values are those of the rows."""
    matrix = (rng.normal(size=(90, 12)) @ rng.normal(size=(12, 3000))) * (rng.random((1, 3000)) < 0.4)
    matrix[:5] = 0
    got = embedded(widesvd.svd_embed_wide(sparse(spark, matrix), 20))
    assert got.shape == (90, 20) and (got[:, 12:] == 0).all()
    np.testing.assert_allclose(got @ got.T, matrix @ matrix.T, rtol=1e-4, atol=1e-2)
    np.testing.assert_allclose(np.linalg.norm(got[:, :12], axis=0), np.linalg.svd(matrix)[1][:12], rtol=1e-5)


def test_wide_svd_by_power_rounds(spark, rng):
    """Full rank: the leading singular values come out, the closer the more rounds; pieces of the products do not matter."""
    u, _ = np.linalg.qr(rng.normal(size=(300, 60)))
    v, _ = np.linalg.qr(rng.normal(size=(800, 60)))
    values = 100 * 0.93 ** np.arange(60)
    rows = sparse(spark, (u * values) @ v.T)
    errors = []
    for power in (0, 1, 2):
        got = embedded(widesvd.svd_embed_wide(rows, 10, 5, power))
        assert got.shape == (300, 10)
        errors.append(np.abs(np.linalg.norm(got, axis=0) / values[:10] - 1).max())
    assert errors[2] < 0.02 and errors[2] < errors[1] < errors[0]


def test_wide_svd_in_pieces(spark, rng, monkeypatch):
    matrix = rng.normal(size=(40, 50)) * (rng.random((40, 50)) < 0.5)
    whole = embedded(widesvd.svd_embed_wide(sparse(spark, matrix), 6, 4, 1))
    monkeypatch.setattr(widesvd, "_HELD_BYTES", 10 * 8 * 7)
    np.testing.assert_allclose(embedded(widesvd.svd_embed_wide(sparse(spark, matrix), 6, 4, 1)), whole, rtol=1e-3, atol=1e-4)


@pytest.mark.parametrize("power", [0, 1])
def test_wide_svd_stores_nothing_as_long_as_the_rows(spark, rng, monkeypatch, power):
    """What is written depends on the vocabulary: no sketch of the rows, and a task's sums move once."""
    matrix = rng.normal(size=(500, 40)) * (rng.random((500, 40)) < 0.3)
    monkeypatch.setattr(widesvd, "_RUN_ROWS", 16)
    monkeypatch.setattr(widesvd, "_DENSE_TERMS", 5)
    stored, keep = [], widesvd.materialize
    monkeypatch.setattr(widesvd, "materialize", lambda df, label: stored.append(keep(df, label)) or stored[-1])
    monkeypatch.setattr(widesvd, "discard", lambda *tables: None)
    got = embedded(widesvd.svd_embed_wide(sparse(spark, matrix), 6, 3, power))
    assert max(t.count() for t in stored) <= 40 + 9 * 8
    assert np.linalg.norm(got[:, 0]) <= np.linalg.svd(matrix)[1][0] * (1 + 1e-6)


def test_runs_multiply_as_dense_rows(rng, monkeypatch):
    """Frequent and rare terms, rows without terms and rows longer than a slice."""
    monkeypatch.setattr(widesvd, "_GATHERED", 3)
    monkeypatch.setattr(widesvd, "_RUN_ENTRIES", 60)
    matrix = rng.normal(size=(50, 30)) * (rng.random((50, 30)) < np.linspace(1, 0.01, 30))
    matrix[[0, 7, 8, 49]] = 0
    rows = [np.flatnonzero(r) for r in matrix]
    batch = pa.RecordBatch.from_pydict({"terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), "weights": pa.array([m[r].tolist() for m, r in zip(matrix, rows)], pa.list_(pa.float64()))})
    table, total, start = rng.normal(size=(30, 4)), np.zeros((30, 4)), 0
    parts = list(widesvd._runs(batch))
    for part in parts:
        run, mine = widesvd._Run(part), matrix[start : start + part.num_rows]
        np.testing.assert_allclose(run.times(table), mine @ table, atol=1e-12)
        run.add_transposed(mine @ table, total)
        start += part.num_rows
    assert start == 50 and len(parts) > 5
    np.testing.assert_allclose(total, matrix.T @ matrix @ table, atol=1e-12)


def test_tall_skinny_qr(spark, rng, monkeypatch):
    """Many small factors, stacked in several steps."""
    matrix = rng.normal(size=(700, 6))
    rows = spark.createDataFrame([(x.tolist(),) for x in matrix], "x array<double>").repartition(30)
    monkeypatch.setattr(widesvd, "parallelism", lambda _: 30)
    monkeypatch.setattr(widesvd, "_FAN_IN", 3)
    r = widesvd.triangular_factor(rows, "x", 6)
    np.testing.assert_allclose(r.T @ r, matrix.T @ matrix, rtol=1e-9, atol=1e-9)


def test_wide_svd_of_nothing(spark):
    rows = spark.createDataFrame([], "doc_id bigint, terms array<int>, weights array<double>")
    assert widesvd.svd_embed_wide(rows, 3).count() == 0
    zero = spark.createDataFrame([(1, [], []), (2, None, None)], "doc_id bigint, terms array<int>, weights array<double>")
    assert (embedded(widesvd.svd_embed_wide(zero, 3)) == 0).all()


@pytest.mark.parametrize("step", ["counts", "rows"])
def test_steps_on_words_hold_a_bounded_slice(spark, step):
    """However many texts an Arrow batch has, few are taken apart at a time, and none is lost."""
    texts = [f"w{i} " * 40 + "x" * (20 if i % 50 else 1 << 14) for i in range(8000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})

    class Captured:
        sparkSession, columns, schema = spark, ["doc_id", "terms", "times"], spark.createDataFrame([], "doc_id bigint").schema

        def select(self, *_):
            return self

        def mapInArrow(self, function, _):
            return function

    found = list(embed.term_counts(Captured())(iter([batch])))
    if step == "rows":
        whole = pa.concat_tables([pa.Table.from_batches([x]) for x in found]).combine_chunks().to_batches()[0]
        whole = pa.RecordBatch.from_pydict({"doc_id": whole["doc_id"], "terms": pa.array([[f"w{i}_{j}" for j in range(40)] for i in range(whole.num_rows)]), "times": pa.array([[1] * 40] * whole.num_rows, pa.list_(pa.int32()))})
        vocab = spark.createDataFrame([("w1_1", 0, 1.0)], "term string, term_id int, idf double")
        found = list(embed.sparse_rows(Captured(), vocab)(iter([whole])))
    assert [i for x in found for i in x["doc_id"].to_pylist()] == list(range(len(texts)))
    assert max(x.num_rows for x in found) <= 7000 and len(found) > 1


def entries_of(vectors):
    return [(i, t, float(w)) for i, v in vectors.items() for t, w in enumerate(v) if w]


@pytest.mark.parametrize("order", ["stored", "shuffled"])
def test_successors_by_brute_force(spark, rng, monkeypatch, order):
    """Gaps, runs over several tasks and batches, rows of zeros; in any order of the rows."""
    monkeypatch.setattr(successor, "_STEP", 7)
    ids = [i for i in range(-3, 120) if i % 11 not in (4, 6)]
    vectors = {i: rng.normal(size=9) * (rng.random(9) < 0.6) for i in ids}
    vectors[5] = np.zeros(9)
    if order == "shuffled":
        ids = rng.permutation(ids).tolist()
    dense = [(i, vectors[i].tolist()) for i in ids]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(dense, 5), "doc_id bigint, embedding array<double>")
    sparse_rows = rows.select("doc_id", F.posexplode("embedding").alias("term_id", "weight")).filter("weight != 0")
    monkeypatch.setattr(successor, "_DESCENTS", -1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        for found, size in ((successor.dense_products(rows), len(ids)), (successor.sparse_products(sparse_rows), len([i for i in ids if vectors[i].any()]))):
            got = {r["doc_id"]: r for r in found.collect()}
            assert len(got) == size == found.count()
            for i, r in got.items():
                after = vectors.get(i + 1, np.zeros(9))
                np.testing.assert_allclose([r["own"], r["other"] or 0.0, r["size"] or 0.0], [vectors[i] @ vectors[i], vectors[i] @ after, after @ after], atol=1e-12)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_out_of_order_are_dealt_by_ranges(spark):
    rows = spark.createDataFrame(spark.sparkContext.parallelize([(i * 37 % 100, "a") for i in range(100)], 3), "doc_id bigint, text string")
    assert successor.in_order(rows) is not rows and successor.in_order(rows.sort("doc_id")).count() == 100
    in_order = spark.createDataFrame(spark.sparkContext.parallelize([(i, "a") for i in range(100)], 3), "doc_id bigint, text string")
    assert successor.in_order(in_order) is in_order and successor.numbered(in_order)
    assert not successor.numbered(in_order.unionByName(rows)) and not successor.numbered(in_order.unionByName(rows.limit(1).selectExpr("CAST(NULL AS bigint) doc_id", "text")))


def test_products_of_neighbours_move_no_embeddings(spark, sf_dir, monkeypatch):
    """The same rows as by joins, which store the embeddings and move them and the weights twice."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels, keep = [], registered.materialize
    monkeypatch.setattr(registered, "materialize", lambda df, label: labels.append(label) or keep(df, label))

    def run():
        return sorted(map(tuple, registered._products(documents, 300, embed.tfidf_svd(documents, 300, 300)).collect()))

    got = run()
    assert "embedded" not in labels
    monkeypatch.setattr(successor, "numbered", lambda _: False)
    assert got == run() and "embedded" in labels and all(r[3] for r in got)
