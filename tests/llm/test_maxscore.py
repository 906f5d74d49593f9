import math
import random
import re

import numpy as np
import pytest

from nearfield.llm import maxscore
from tests.llm.conftest import LONG, ODD, clashing, frame

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, k=10):
    words = [(d, terms(t)) for d, t in rows]
    n_docs, n_terms = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    holders = {}
    for _, w in words:
        for t in set(w):
            holders[t] = holders.get(t, 0) + 1
    out = []
    for item, wanted in asked.items():
        found = []
        for d, w in words:
            score = 0
            for t in wanted:
                if tf := w.count(t):
                    m = 100 - 90 + (90 * len(w) * n_docs) // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, d is None, d or 0))
        for i, (score, absent, d) in enumerate(sorted(found)[:k], 1):
            out.append((item, i, None if absent else d, -score))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    text = lambda most: " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, most)))
    rows = [(d, text(40)) for d in range(n)] + [(d, text(40)) for d in range(10)] + [(None, "t1 t2 t3"), (None, "t1 t2 t3"), (n, None)]
    rows += [(n + i, rows[5][1]) for i in range(30)]
    items = [(i, text(12)) for i in range(25)] + [(3, "T59 t58, t0"), (None, "t1 t2"), (90, None), (91, "nowhere"), (92, "t4"), (92, "t4")]
    return rows, items


@pytest.mark.parametrize("shard_rows", [4096, 37])
def test_random_texts(spark, monkeypatch, shard_rows):
    rows, items = made(5)
    got = maxscore.search(frame(spark, rows), items_frame(spark, items))
    assert results(got) == brute(rows, items)
    assert results(maxscore.search(frame(spark, rows), items_frame(spark, items), k=3, block_bytes=200)) == brute(rows, items, 3)


def test_many_shards(spark, sf_dir, docs, rows):
    """Batches of few rows in many partitions: thresholds pass from shard to shard."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    assert results(maxscore.search(docs.repartition(40), benchmark)) == brute(rows, items)


def test_bounds_hold_and_units_are_skipped():
    """Whatever the threshold, all rows that reach it are found; pair bounds leave more units unopened."""
    rng = np.random.default_rng(3)
    n, skipped_pairs, skipped_singles = 500, 0, 0
    for _ in range(200):
        lists = []
        for _ in range(rng.integers(1, 9)):
            rows = np.flatnonzero(rng.random(n) < rng.choice([0.02, 0.3, 0.8]))
            lists.append((rows, rng.integers(1, 1000, len(rows))))
        lists = [x for x in lists if len(x[0])]
        total = np.zeros(n, np.int64)
        for rows, impacts in lists:
            total[rows] += impacts
        least = max(1, int(np.quantile(total, rng.choice([0.5, 0.95, 0.99]))))
        wide = np.zeros((len(lists), n), np.int64)
        for i, (rows, impacts) in enumerate(lists):
            wide[i, rows] = impacts
        pairs = [(int(wide[i : i + 2].sum(axis=0).max()), list(range(i, min(i + 2, len(lists))))) for i in range(0, len(lists), 2)]
        singles = [(int(wide[i].max()), [i]) for i in range(len(lists))]
        for units in (pairs, singles):
            found, scores, skipped = maxscore._candidates(units, lambda t: lists[t], n, least)
            want = np.flatnonzero(total >= least)
            assert set(want) <= set(found.tolist())
            assert (scores == total[found]).all()
            if units is pairs:
                skipped_pairs += sum(len(x) for _, x in sorted(units)[:skipped])
            else:
                skipped_singles += skipped
    assert skipped_pairs > 0 and skipped_singles > 0


def test_joint_maxima_are_tighter():
    """The stored joint maximum is what the rows with both terms reach, no more."""
    import pyarrow as pa

    rows = [("a " * 9).strip(), ("b " * 9).strip(), "a b", "a b c d e f", ""]
    queries = maxscore.Queries.of([(1, b"a b")])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(rows)], ["doc_id", "text"])
    (posted,) = maxscore._post(queries.vocabulary)([batch])
    n_docs, n_terms = posted.column("n_docs")[0].as_py(), posted.column("n_terms")[0].as_py()
    assert (n_docs, n_terms) == (4, 26)
    weights = np.array([100, 100])
    (index,) = maxscore._weigh(queries.coupled(np.array([3, 3]), weights), n_docs, n_terms, 2)([posted])
    shard = maxscore.Shard(index, 0, weights, n_docs, n_terms)
    (_, first), (_, second) = shard.postings(0), shard.postings(1)
    assert index.column("single")[0].as_py() == [max(first), max(second)]
    assert index.column("joint")[0].as_py() == [first[1] + second[1]]
    assert index.column("kth")[0].as_py() == [first[2] + second[2]]
    assert max(first) + max(second) > first[1] + second[1]


def test_odd_documents(spark, odd, none):
    items = [(1, "one two same"), (2, "w1x1 tail"), (3, "\U0001f600 漢字 12"), (4, ""), (None, "no id"), (5, LONG)]
    want = brute(ODD, items)
    assert want
    asked = items_frame(spark, items)
    assert results(maxscore.search(odd, asked)) == want
    from pyspark.sql import functions as F

    extra = {x: F.lit("x") for x in ("query", "rank", "ids", "terms", "n_docs")}
    assert results(maxscore.search(clashing(odd).withColumns(extra), asked.withColumns(extra | {"doc_id": F.lit("x"), "score": F.lit("x")}))) == want
    assert results(maxscore.search(none, asked)) == []
    assert results(maxscore.search(odd, asked.where("false"))) == []
