import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.operators import bitmap, ivf, knn, lsh, pairing, shards, twolevel
from nearfield.session import scratch_path
from tests.conftest import assert_lists, brute_force, lists_of, table_of


@pytest.fixture(scope="module")
def data(spark):
    values = np.random.default_rng(11)
    base = values.normal(size=(900, 8)).astype(np.float32)
    base[::3] = base[0]  # a third of the rows are copies of one vector
    queries = np.vstack([base[0], values.normal(size=(40, 8)).astype(np.float32)])
    return (
        base,
        queries,
        table_of(spark, range(900), base).repartition(5),
        table_of(spark, range(41), queries, "query_id"),
    )


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
def test_exact(data, metric):
    base, queries, b, q = data
    assert_lists(knn.exact_knn(b, q, 12, metric), range(41), brute_force(range(900), base, queries, 12, metric))


def test_k_larger_than_the_base(data, spark):
    base, queries, _, q = data
    small = table_of(spark, range(6), base[:6])
    hits = knn.exact_knn(small, q, 100)
    assert hits.count() == 41 * 6
    assert_lists(hits, range(41), brute_force(range(6), base[:6], queries, 100))


def test_unknown_metric_and_bad_k(data):
    _, _, b, q = data
    with pytest.raises(ValueError, match="not one of the metrics"):
        knn.exact_knn(b, q, 5, "hamming")
    with pytest.raises(ValueError, match="k must be"):
        knn.exact_knn(b, q, 0)
    with pytest.raises(ValueError, match="Unknown precision"):
        knn.exact_knn(b, q, 5, precision="f8")


def test_no_queries_and_no_base(data):
    _, _, b, q = data
    empty = knn.exact_knn(b, q.limit(0), 5)
    assert empty.count() == 0 and empty.columns == ["query_id", "neighbor_id", "distance", "rank"]
    assert knn.exact_knn(b.limit(0), q, 5).count() == 0


def test_null_vectors_are_left_out(data, spark):
    base, queries, b, q = data
    extra = spark.createDataFrame([(5000, None)], "row_id bigint, vector array<float>")
    assert_lists(knn.exact_knn(b.unionByName(extra), q, 5), range(41), brute_force(range(900), base, queries, 5))


def test_many_query_blocks(data):
    base, queries, b, q = data
    assert_lists(knn.exact_knn(b, q, 12, block_rows=10), range(41), brute_force(range(900), base, queries, 12))


def test_blocks_of_three(data):
    base, queries, b, q = data
    assert_lists(knn.exact_knn(b, q, 3, block_rows=3), range(41), brute_force(range(900), base, queries, 3))


def test_repeated_query_ids_are_refused_on_every_path(spark, data, centroids):
    _, _, b, _ = data
    same = table_of(spark, [*range(49), 7], np.random.default_rng(1).normal(size=(50, 8)), "query_id")
    for block_rows in (None, 10):
        with pytest.raises(ValueError, match="unique"):
            knn.exact_knn(b, same, 3, block_rows=block_rows)
        with pytest.raises(ValueError, match="unique"):
            ivf.search_ivf(b.withColumn("cell_id", F.lit(0)), centroids[0], same, 3, 2, block_rows=block_rows)


def test_repeated_query_ids_are_refused(spark, data):
    with pytest.raises(ValueError, match="unique"):
        knn.exact_knn(data[2], table_of(spark, [1, 1], np.zeros((2, 8)), "query_id"), 3)


def test_two_step_merge(data, monkeypatch):
    base, queries, b, q = data
    monkeypatch.setattr(knn, "_SALT_ABOVE", 1)
    assert_lists(knn.exact_knn(b, q, 12), range(41), brute_force(range(900), base, queries, 12))


def test_exclude_self(data):
    base, _, b, _ = data
    q = b.select(F.col("row_id").alias("query_id"), "vector")
    found = lists_of(knn.exact_knn(b, q, 10, exclude_self=True))
    for i in (0, 3, 897, 1, 2):
        others = np.array([j for j in range(900) if j != i])
        want, _ = brute_force(others, base[others], base[[i]], 10)[0]
        assert found[i][0] == list(want)


def test_self_is_first(embeddings):
    base = embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    q = embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    first = knn.exact_knn(base, q, 1)
    assert first.filter("query_id <> neighbor_id or distance > 1e-12").count() == 0
    assert first.count() == embeddings.count()


def test_smoke_single_vector(spark, rng):
    vector = rng.uniform(size=(1, 128)).astype(np.float32)
    hits = knn.exact_knn(table_of(spark, [1], vector), table_of(spark, [0], vector, "query_id"), 1, "cos").collect()
    assert [(h["neighbor_id"], h["rank"]) for h in hits] == [(1, 1)]


@pytest.mark.parametrize("num_shards", [1, 4])
def test_sharded_equals_unsharded(data, num_shards):
    base, queries, b, q = data
    hits = knn.sharded_knn(shards.round_robin(b, num_shards), q, 12, num_shards)
    assert_lists(hits, range(41), brute_force(range(900), base, queries, 12))


def test_shard_lists_when_few_states_fit(data, monkeypatch):
    base, queries, b, q = data
    monkeypatch.setattr(knn, "_max_states", lambda *_: 1)
    local = knn.shard_local_topk(shards.round_robin(b, 6), q, 5, 6)
    assert local.count() == 41 * 6 * 5
    for shard in range(6):
        ids = np.arange(shard, 900, 6)
        part = local.filter(F.col("shard_id") == shard)
        assert_lists(part, range(41), brute_force(ids, base[ids], queries, 5))


def test_merge_of_separate_parts(data):
    base, queries, b, q = data
    parts = [knn.exact_knn(b.filter(F.col("row_id") % 3 == r), q, 12) for r in range(3)]
    assert_lists(knn.merge_parts(parts, 12), range(41), brute_force(range(900), base, queries, 12))
    with pytest.raises(ValueError):
        knn.merge_parts([], 5)


def test_precisions_in_one_scan(data):
    _, _, b, q = data
    together = knn.precision_knn(b, q, 7)
    for precision in ("f32", "f16", "bf16", "i8"):
        alone = knn.exact_knn(b, q, 7, precision=precision)
        assert lists_of(together.filter(F.col("precision") == precision)) == lists_of(alone)


def test_payload_and_external_ids(data, spark):
    _, _, b, q = data
    hits = knn.exact_knn(b, q, 4)
    found = knn.with_payload(hits, b.withColumn("tag", F.col("row_id") * 2), ["tag"])
    assert found.count() == 41 * 4 and found.filter("tag <> neighbor_id * 2").count() == 0
    id_map = spark.createDataFrame([(i, i * 10 + 7) for i in range(400)], "row_id bigint, external_id bigint")
    before = hits.withColumnRenamed("neighbor_id", "position")
    joined = knn.map_external_ids(hits, id_map).join(before, ["query_id", "rank"])
    wrong = joined.filter(F.expr("neighbor_id <> if(position < 400, position * 10 + 7, position)"))
    assert joined.count() == 41 * 4 and wrong.count() == 0


@pytest.mark.parametrize("words", [bitmap.BITMAP_WORDS, 64, 1])
def test_a_list_cuts_a_table_in_place(spark, words):
    """No listed row is lost however full the bitmap is; an ample one lets hardly any other row pass."""
    table = spark.range(20000).select((F.col("id") * 7919).alias("row_id"), F.lit("x").alias("word"), F.col("id").alias("place"))
    ids = spark.range(0, 20000, 97).select((F.col("id") * 7919).alias("wanted"))
    cut = bitmap.only_listed(table, "row_id", ids.union(ids), words)
    assert cut.columns == table.columns
    rows = cut.collect()
    assert all(r["word"] == "x" and r["place"] * 7919 == r["row_id"] for r in rows)
    kept, wanted = [r["row_id"] for r in rows], {r[0] for r in ids.collect()}
    assert wanted <= set(kept) and len(kept) == len(set(kept))
    if words == bitmap.BITMAP_WORDS:
        assert len(kept) <= len(wanted) + 5
    both = bitmap.with_listed(table, "row_id", ids, "listed", words)
    assert both.count() == 20000 and both.filter("listed").count() == len(kept)
    assert bitmap.only_listed(table, "row_id", ids.limit(0), words).count() == 0


def test_only_listed_base_rows_are_shuffled(spark, data):
    """Without any broadcast of a list, what moves of the base has passed the bitmap."""
    _, _, b, q = data
    hits = knn.exact_knn(b, q, 2)
    wide = b.withColumn("tag", F.col("row_id") * 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (knn.with_payload(hits, wide, ["tag"]), knn.rerank(hits, wide, q, 2)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and plan.count("BroadcastHashJoin") == 1 and found.count() == 82
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checked_ids(spark):
    good = spark.createDataFrame([(1, 2**31 - 1, 0.5, 1)], "query_id bigint, neighbor_id bigint, distance double, rank int")
    assert knn.checked_int_ids(good).schema["neighbor_id"].dataType.simpleString() == "int"
    assert knn.checked_int_ids(good).first()["neighbor_id"] == 2**31 - 1
    bad = good.withColumn("neighbor_id", F.lit(2**31))
    with pytest.raises(Exception, match="out of int range"):
        knn.checked_int_ids(bad).collect()


def test_quantized_search_keeps_full_distances(data):
    base, queries, b, q = data
    want = brute_force(range(900), base, queries, 5)
    found = lists_of(knn.quantized_knn(b, q, 5, oversample=180))
    for i, (ids, distances) in enumerate(want):
        assert found[i][0] == list(ids)
        np.testing.assert_allclose(found[i][1], distances, rtol=1e-9, atol=1e-12)


# Inverted file ------------------------------------------------------------------


@pytest.fixture(scope="module")
def centroids(spark, data):
    values = np.random.default_rng(5)
    cells = np.vstack([data[0][0], values.normal(size=(9, 8))])
    return table_of(spark, range(10), cells, "cell_id").withColumnRenamed("vector", "centroid"), cells.astype(np.float32)


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
def test_probing_all_cells_is_exact(spark, data, centroids, metric):
    base, queries, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"), metric)
    hits = ivf.search_ivf(index, centroids[0], q, 12, 10, metric)
    assert_lists(hits, range(41), brute_force(range(900), base, queries, 12, metric))


def test_cells_and_probes(spark, data, centroids):
    base, queries, b, q = data
    nearest = [ids[0] for ids, _ in brute_force(range(10), centroids[1], base, 1)]
    assigned = {r["row_id"]: r["cell_id"] for r in ivf.assign_cells(b, centroids[0]).collect()}
    assert [assigned[i] for i in range(900)] == nearest
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    probes = brute_force(range(10), centroids[1], queries, 3)
    found = lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3))
    for i, (cells, _) in enumerate(probes):
        rows = np.array([r for r in range(900) if nearest[r] in cells])
        want = brute_force(rows, base[rows], queries[[i]], 8)[0][0] if len(rows) else []
        assert found.get(i, ([], []))[0] == list(want)


def test_sharded_index_search(spark, data, centroids):
    _, _, b, q = data
    index = ivf.build_ivf(shards.round_robin(b, 5), centroids[0], scratch_path(spark, "index"))
    whole = lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3))
    assert lists_of(ivf.sharded_ivf(index, centroids[0], q, 8, 3, 5)) == whole


def test_blocked_index_search(spark, data, centroids):
    _, _, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    whole = lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3))
    assert lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3, block_rows=12)) == whole


def test_more_probes_find_no_less(spark, data, centroids):
    base, queries, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    truth = brute_force(range(900), base, queries, 10)
    shares = []
    for nprobe in (1, 3, 6, 10):
        found = lists_of(ivf.search_ivf(index, centroids[0], q, 10, nprobe))
        shares.append(sum(len(set(found.get(i, ([], []))[0]) & set(t)) for i, (t, _) in enumerate(truth)))
    assert shares == sorted(shares) and shares[-1] == 41 * 10


def test_unprobed_cells_are_not_read(spark, data, centroids):
    _, _, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    hits = ivf.search_ivf(index, centroids[0], q.filter("query_id = 0"), 8, 1)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell_id" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_kmeans_centroids(spark, data):
    _, _, b, _ = data
    trained = ivf.train_centroids(b, 7, sample_rate=1.0)
    assert trained.count() <= 7 and trained.columns == ["cell_id", "centroid"]
    assert ivf.assign_cells(b, trained).filter("cell_id is null").count() == 0


def test_no_centroids(data, centroids):
    _, _, b, _ = data
    with pytest.raises(ValueError, match="number of centroids"):
        ivf.assign_cells(b, centroids[0].limit(0))


# Queries and cells as tables ------------------------------------------------------


def _lists(base, queries, k, **sizes):
    """Hits of the pairing alone, with one cell."""
    zero = F.lit(0).cast("bigint")
    lists = pairing.paired_lists(
        base.withColumns({"cell_id": zero, "shard_id": zero}), queries.withColumn("cells", F.array(zero)), k, "l2", ["f32"], **sizes
    )
    found = lists.select("query_id", F.inline(F.arrays_zip(F.col("neighbors").alias("neighbor_id"), F.col("distances").alias("distance"))))
    return lists, knn.rank_hits(found, k)


@pytest.mark.parametrize("part_rows, rounds_of", [(1 << 14, 1 << 13), (50, 7), (1, 41), (900, 1)])
def test_parts_and_rounds_do_not_matter(data, part_rows, rounds_of):
    base, queries, b, q = data
    _, hits = _lists(b, q, 12, part_rows=part_rows, rounds_of=rounds_of)
    assert_lists(hits, range(41), brute_force(range(900), base, queries, 12))


def test_groups_are_bounded(data):
    """A cell that holds everything is cut: no list comes from more rows than a part holds."""
    _, _, b, q = data
    lists, _ = _lists(b, q, 900, part_rows=90, rounds_of=10)
    sizes = [r[0] for r in lists.select(F.size("neighbors")).collect()]
    assert sum(sizes) == 41 * 900 and max(sizes) < 150


def test_a_table_of_queries_uses_one_scan(spark, data, centroids):
    _, _, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    hits = ivf.search_ivf(index, centroids[0], q, 8, 3, block_rows=5)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("vector#") and plan.count("ReadSchema: struct<row_id:bigint,vector:array<float>>") == 1
    assert "FlatMapCoGroupsInArrow" in plan


def test_shards_and_precisions_of_a_table_of_queries(spark, data, centroids):
    """Beyond one block the same lists come out per shard and per precision."""
    _, _, b, q = data
    sharded = shards.round_robin(b, 6)
    index = ivf.build_ivf(sharded, centroids[0], scratch_path(spark, "index"))

    def rows(df):
        return sorted(map(str, df.collect()))

    for block_rows in (7, None):
        options = {"shard_col": "shard_id", "num_shards": 6, "local": True, "block_rows": block_rows}
        local = rows(knn.search(sharded, q, 5, "l2", ["f32", "i8"], **options).select("query_id", "precision", "shard_id", "neighbor_id", "distance", "rank"))
        probed = rows(ivf.search_ivf(index, centroids[0], q, 5, 3, **options).select("query_id", "shard_id", "neighbor_id", "distance", "rank"))
        own = rows(knn.search(b, b.select(F.col("row_id").alias("query_id"), "vector").limit(60), 4, "ip", exclude_self=True, block_rows=block_rows))
        if block_rows:
            want = local, probed, own
    assert (local, probed, own) == want and len(local) == 41 * 6 * 5 * 2


def test_probe_counts_from_one_scan(spark, data, centroids):
    _, _, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    hits = ivf.sweep_ivf(index, centroids[0], q, 6, [1, 3, 10])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<row_id:bigint,vector:array<float>>") == 1
    for n in (1, 3, 10):
        assert lists_of(hits.filter(F.col("nprobe") == n)) == lists_of(ivf.search_ivf(index, centroids[0], q, 6, n))


@pytest.mark.parametrize("metric", ["l2", "ip", "cos"])
def test_two_levels_probed_in_full_are_exact(spark, data, metric):
    base, queries, b, q = data
    coarse, fine = twolevel.train_two_level(b, 5, 4, metric=metric)
    path = twolevel.build_two_level(b, coarse, fine, scratch_path(spark, "index"), metric)
    hits = twolevel.search_two_level(path, coarse, fine, q, 12, 5, 20, metric)
    assert_lists(hits, range(41), brute_force(range(900), base, queries, 12, metric))


def test_two_level_cells(spark, data):
    """Every row lies in the nearest fine cell of its nearest coarse cell, however the coarse cells are cut."""
    base, _, b, _ = data
    coarse, fine = twolevel.train_two_level(b, 5, 4, sample_rows=100)
    tops = {r["cell_id"]: r["centroid"] for r in coarse.collect()}
    below = {}
    for r in fine.collect():
        below.setdefault(r["coarse_id"], []).append((r["cell_id"], r["centroid"]))
    assert set(below) == set(tops) and sum(map(len, below.values())) > len(tops)
    odd = spark.createDataFrame([(5000, None)], "row_id bigint, vector array<float>")
    for part_rows in (1 << 14, 30):
        found = {r["row_id"]: (r["coarse_id"], r["cell_id"]) for r in twolevel.assign_two_level(b.unionByName(odd), coarse, fine, part_rows=part_rows).collect()}
        assert found.pop(5000) == (None, None) and len(found) == 900
        ids = sorted(tops)
        nearest = [x[0][0] for x in brute_force(ids, [tops[i] for i in ids], base, 1)]
        for row, top in enumerate(nearest):
            names = sorted(below[top])
            want = brute_force([i for i, _ in names], [c for _, c in names], base[[row]], 1)[0][0][0]
            assert found[row] == (top, want)


def test_two_level_index_opens_only_files_with_probed_cells(spark, data):
    _, _, b, _ = data
    coarse, fine = twolevel.train_two_level(b, 5, 4)
    assigned = twolevel.assign_two_level(b, coarse, fine)
    path = scratch_path(spark, "index")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        twolevel.write_two_level(assigned, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = spark.read.parquet(f"{path}/rows")
    located = spark.read.parquet(f"{path}/cells")
    assert located.agg(F.sum("n")).first()[0] == 900
    some = located.orderBy("cell_id").select("cell_id").limit(1)
    part = twolevel.rows_of_cells(spark, path, some)
    cell = some.first()[0]
    assert part.filter(F.col("cell_id") == cell).count() == whole.filter(F.col("cell_id") == cell).count() > 0
    files = {r["file"] for r in located.filter(F.col("cell_id") == cell).select("file").distinct().collect()}
    assert len(files) < len(whole.inputFiles())
    assert {f.rsplit("/", 1)[1] for f in part.inputFiles()} == {f.rsplit("/", 1)[1] for f in files}
    assert twolevel.rows_of_cells(spark, path, some.limit(0)).count() == 0


def test_hashing_index(spark, embeddings):
    base = embeddings.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    q = base.withColumnRenamed("row_id", "query_id")
    index = lsh.build_lsh(base, scratch_path(spark, "index"))
    exact, found = lists_of(knn.exact_knn(base, q, 10)), lists_of(lsh.search_lsh(index, q, 10))
    met = sum(len(set(found[i][0]) & set(ids)) for i, (ids, _) in exact.items())
    assert met >= 0.9 * 10 * len(exact)
    for i, (ids, distances) in found.items():
        assert len(ids) == len(set(ids)) and ids[0] == i and distances == sorted(distances)


def test_hashing_index_with_all_buckets_is_exact(spark, data):
    """One bit and its flip reach both buckets; with a null vector and copies."""
    base, queries, b, q = data
    extra = spark.createDataFrame([(5000, None)], "row_id bigint, vector array<float>")
    index = lsh.build_lsh(b.unionByName(extra), scratch_path(spark, "index"), tables=1, bits=1)
    hits = lsh.search_lsh(index, q, 12, tables=1, bits=1, flips=1)
    assert_lists(hits, range(41), brute_force(range(900), base, queries, 12))
    with pytest.raises(ValueError, match="flips"):
        lsh.search_lsh(index, q, 3, bits=2, flips=3)


# Large query sets -------------------------------------------------------------------


def test_blocks_of_queries_do_not_move_the_base_again(spark, data, monkeypatch):
    """Queries held against the base in small blocks still meet in a few rounds: the base moves once per round."""
    base, queries, b, q = data
    seen = []
    grid = pairing.grid
    monkeypatch.setattr(pairing, "grid", lambda *a: seen.append(grid(*a)) or seen[-1])
    assert_lists(knn.exact_knn(b, q, 12, block_rows=2), range(41), brute_force(range(900), base, queries, 12))
    assert [r["rounds"] for r in seen[0].collect()] == [1]


def test_probed_cells_share_a_list(spark, data, centroids, monkeypatch):
    """Queries that probe a good share of the cells get one list per part and shard, whatever the number of cells."""
    _, _, b, q = data
    sharded = shards.round_robin(b, 2)
    index = ivf.build_ivf(sharded, centroids[0], scratch_path(spark, "index"))
    seen = []
    lists = knn.paired_lists
    monkeypatch.setattr(knn, "paired_lists", lambda *a, **o: seen.append(lists(*a, **o)) or seen[-1])
    for nprobe in (3, 10):
        options = {"shard_col": "shard_id", "num_shards": 2, "local": True}
        together = ivf.search_ivf(index, centroids[0], q, 8, nprobe, block_rows=5, **options)
        assert seen[-1].count() <= 41 * 2
        monkeypatch.setattr(knn, "_wide", lambda *_: False)
        apart = ivf.search_ivf(index, centroids[0], q, 8, nprobe, block_rows=5, **options)
        assert seen[-1].count() > 41 * 2
        monkeypatch.undo()
        monkeypatch.setattr(knn, "paired_lists", lambda *a, **o: seen.append(lists(*a, **o)) or seen[-1])
        names = ["query_id", "shard_id", "neighbor_id", "distance", "rank"]
        assert sorted(map(str, together.select(names).collect())) == sorted(map(str, apart.select(names).collect()))


def test_many_queries_are_not_broadcast(spark, data):
    """Every task keeps the lists of all broadcast queries, so their number is bounded, however few hits are asked for."""
    assert knn._block_rows(2, 1, 1) <= 1 << 14


def test_blocks_of_an_index_search_do_not_move_the_cells_again(spark, data, centroids, monkeypatch):
    """As in an exact search: rows of a cell move once per round, and small blocks make no more rounds."""
    _, _, b, q = data
    index = ivf.build_ivf(b, centroids[0], scratch_path(spark, "index"))
    whole = lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3))
    seen = []
    grid = pairing.grid
    monkeypatch.setattr(pairing, "grid", lambda *a: seen.append(grid(*a)) or seen[-1])
    assert lists_of(ivf.search_ivf(index, centroids[0], q, 8, 3, block_rows=2)) == whole
    assert {r["rounds"] for r in seen[0].collect()} == {1}


@pytest.fixture(scope="module")
def many(spark):
    """More queries than are broadcast."""
    vectors = np.random.default_rng(3).normal(size=((1 << 14) + 600, 4)).astype(np.float32)
    return vectors, table_of(spark, range(len(vectors)), vectors, "query_id"), table_of(spark, range(60), vectors[:60])


def test_sharded_index_search_of_many_queries_keeps_no_list_per_task_of_them_all(spark, many, monkeypatch):
    vectors, q, b = many
    cells = table_of(spark, range(3), vectors[:3], "cell_id").withColumnRenamed("vector", "centroid")
    index = ivf.build_ivf(shards.round_robin(b, 4), cells, scratch_path(spark, "index"))
    monkeypatch.setattr(knn, "QueryBlock", None)
    assert_lists(ivf.sharded_ivf(index, cells, q, 5, 3, 4), range(len(vectors)), brute_force(range(60), vectors[:60], vectors, 5))


@pytest.mark.parametrize("precision", ["f32", "i8"])
def test_sharded_search_of_many_queries_keeps_no_list_per_task_of_them_all(many, monkeypatch, precision):
    vectors, q, b = many
    whole = lists_of(knn.exact_knn(b, q.filter("query_id % 97 = 0"), 5, precision=precision))
    monkeypatch.setattr(knn, "QueryBlock", None)
    found = lists_of(knn.sharded_knn(shards.round_robin(b, 4), q, 5, 4, precision=precision))
    assert len(found) == len(vectors) and {i: found[i] for i in whole} == whole


def test_lists_of_many_queries_are_merged_whole(spark, data, monkeypatch):
    """No sort of single pairs and no second ranking of what shards answer; lists of a query in several batches, ties and precisions included."""
    base, queries, b, q = data
    monkeypatch.setattr(knn, "_MERGED_PAIRS", 30)
    sharded = shards.round_robin(b, 6)
    want = brute_force(range(900), base, queries, 12)
    hits = knn.search(sharded, q, 12, shard_col="shard_id", num_shards=6, block_rows=7).drop("shard_id")
    assert_lists(hits, range(41), want)
    assert "Window" not in hits._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(knn, "_BROADCAST_ROWS", 7)
    found = knn.sharded_knn(sharded, q, 12, 6)
    assert_lists(found, range(41), want)
    assert found.columns == ["query_id", "neighbor_id", "distance", "rank"] and "Window" not in found._jdf.queryExecution().executedPlan().toString()
    kept = knn.search(b, b.select(F.col("row_id").alias("query_id"), "vector"), 5, precisions=["f32", "i8"], exclude_self=True, block_rows=50)
    monkeypatch.setattr(knn, "_SALT_ABOVE", 1)
    other = knn.search(b, b.select(F.col("row_id").alias("query_id"), "vector"), 5, precisions=["f32", "i8"], exclude_self=True, block_rows=50)
    assert kept.columns == other.columns and kept.exceptAll(other).isEmpty() and kept.count() == other.count() == 900 * 2 * 5


def test_merging_no_lists(spark):
    none = spark.createDataFrame([], pairing.LISTS).drop("probe")
    assert knn.merged_lists(none, 3, ["query_id"]).count() == 0
    one = spark.createDataFrame([(1, "f32", 0, [1], [0.5]), (2, "f32", 0, [], []), (3, "f32", 0, [3, 4], [0.0, 1.0])], none.schema)
    found = knn.merged_lists(one, 3, ["query_id"], exclude_self=True).select("query_id", "neighbor_id", "distance", "rank")
    assert [tuple(r) for r in found.collect()] == [(3, 4, 1.0, 1)]
