import numpy as np
from pyspark.sql import functions as F

from nearfield.llm import permutation, registered


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"vec_id bigint, embedding array<{kind}>").repartition(3)


def exact(rows, queries, k):
    """{query: [(score, id)]} best first by plain arithmetic."""
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, v in usable:
        if q in queries:
            found = sorted((-float((w * v).sum()), i) for i, w in usable if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in found[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def single(values):
    return [float(np.float32(x)) for x in values]


def test_everything_ranked_anew_is_exact(spark, rng):
    """With all rows of a shard as candidates the lists are those of brute force, ties included."""
    rows = [(i, single(rng.normal(size=6))) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(25)] + [(400 + i, single(10 * x for x in rows[3][1])) for i in range(3)]
    asked = {i for i, _ in rows if i % 20 == 0}
    df = frame(spark, rows)
    want = exact(rows, asked, 20)
    assert lists(permutation.search(df, df.where("vec_id % 20 = 0"), share=1.0)) == want
    assert lists(permutation.search(df, df.where("vec_id % 20 = 0"), share=1.0, shard_rows=40, block_bytes=900, pivots=9, prefix=4)) == want


def test_agreement_is_the_footrule_distance(rng):
    pivots, vectors = rng.normal(size=(30, 5)), rng.normal(size=(200, 5))
    for prefix in (1, 7, 30):
        near = permutation.nearest_pivots(vectors, pivots, prefix)
        place = np.full((200, 30), prefix)
        np.put_along_axis(place, near, np.arange(prefix)[None, :].repeat(200, 0), 1)

        def postings(pivot):
            rows = np.flatnonzero(place[:, pivot] < prefix)
            return rows, prefix - place[rows, pivot]

        for q in range(20):
            got = permutation.agreement(near[q], postings, 200, prefix)
            footrule = np.abs(place - place[q]).sum(axis=1)
            assert (prefix * (prefix + 1) - 2 * got == footrule).all()


def test_candidates_are_the_nearest_by_footrule(spark, rng):
    """One shard, few candidates: the result is brute force over the rows up to the cut-off distance."""
    rows = [(i, single(rng.normal(size=8))) for i in range(400)]
    df = frame(spark, rows)
    got = lists(permutation.search(df, df.where("vec_id % 20 = 0"), 5, pivots=16, prefix=6, share=0.1, least=1))
    base = np.array([v for _, v in rows])
    chosen = permutation.choose_pivots(permutation.vectors_of(df, "vec_id", "embedding"), 16)
    near = permutation.nearest_pivots(base, chosen, 6)
    place = np.full((400, 16), 6)
    np.put_along_axis(place, near, np.arange(6)[None, :].repeat(400, 0), 1)
    for q, found in got.items():
        distance = np.abs(place - place[q]).sum(axis=1)
        distance[q] = 10**6
        near_rows = np.flatnonzero(distance <= np.sort(distance)[39])
        scores = (base[near_rows] * base[q]).sum(axis=1)
        order = np.lexsort((near_rows, -scores))[:5]
        assert found == list(zip(near_rows[order].tolist(), scores[order].tolist()))


def test_recall_on_the_whole_table(spark, sf_dir, embeddings):
    got = lists(registered.op12_permutation_index(spark, sf_dir))
    rows = [(r["vec_id"], list(r["embedding"])) for r in embeddings.collect()]
    want = exact(rows, {i for i, _ in rows if i % 20 == 0}, 20)
    assert set(got) == set(want)
    caught = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert caught >= 0.9 * sum(map(len, want.values()))
    assert all(len(got[q]) == min(20, len(rows) - 1) for q in want)


def test_recall_where_candidates_are_few(spark, rng):
    """A tenth of the rows as candidates, no minimum: recall on clustered vectors of 32 elements."""
    centres = rng.normal(size=(40, 32))
    base = centres[rng.integers(0, 40, 6000)] + 0.7 * rng.normal(size=(6000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(i, single(v)) for i, v in enumerate(base)]
    df = frame(spark, rows)
    got = lists(permutation.search(df, df.where("vec_id % 300 = 0"), least=1, shard_rows=1500))
    want = exact(rows, set(range(0, 6000, 300)), 20)
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1, 0]), (1, [0.5, 0.5]), (2, [-1, 0]), (3, None), (4, []), (5, [0, 0]), (6, [nan, 1]), (7, [inf, 1]), (8, [None, 1]), (None, [1, 1]),
            (20, [1, 0]), (20, [1, 0]), (40, [1, 2, 3]), (41, [3, 2, 1]), (60, None), (80, [0, 0]), (100, [nan, 1]), (120, [1, 2, 3, 4])]
    asked = {0, 20, 40, 120}
    for kind in ("float", "double"):
        df = frame(spark, rows, kind)
        want = {q: x for q, x in exact(rows, asked, 20).items() if x}
        got = lists(permutation.search(df, df.where("vec_id % 20 = 0")))
        assert got == want and 120 not in got
        extra = {x: F.lit("x") for x in ("id", "vector", "shard", "rank", "score", "query_id", "ids", "rows", "starts")}
        more = df.withColumns(extra)
        assert lists(permutation.search(more, more.where("vec_id % 20 = 0"))) == want
        assert lists(permutation.search(df.where("false"), df.where("false"))) == {}
        assert lists(permutation.search(df, df.where("false"))) == {}
