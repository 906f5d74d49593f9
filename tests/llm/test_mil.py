import zlib

import numpy as np

from nearfield.llm import mil, registered
from tests.llm.conftest import ODD, clashing, frame, same_rows


def test_gradient_free_check_of_the_network():
    """Training lowers the cross entropy, and the score is the attention-weighted sum by the formula."""
    rng = np.random.default_rng(0)
    bags = rng.integers(1, 6, 200)
    x = rng.normal(0, 1, (bags.sum(), 8)).astype(np.float32)
    owner = np.repeat(np.arange(200), bags)
    y = (np.maximum.reduceat(x[:, 0], np.cumsum(bags) - bags) > 1.0).astype(float)
    net = mil.fit(x, bags, y, rounds=150)
    f = net.forward((x - net.mean) / net.scale, bags)
    assert ((f["score"] > 0.5) == y).mean() > 0.95
    np.testing.assert_allclose(np.bincount(owner, weights=f["a"]), 1, rtol=1e-5)
    p, i = net.weights, 7
    h = np.tanh(((x - net.mean) / net.scale)[owner == i] @ p["W"] + p["Wb"])
    s = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
    a = np.exp(s) / np.exp(s).sum()
    np.testing.assert_allclose(1 / (1 + np.exp(-((a @ h) @ p["c"] + p["b"]))), f["score"][i], rtol=1e-4)


def test_passages_cover_whole_texts():
    texts = [b"", b"ab cd", b"x" * 512, b"y z " * 400, "é".encode() * 700]
    x, bags = mil.encode(texts)
    assert bags.tolist() == [1, 1, 1, 4, 3]
    alone = [mil.encode([t])[0] for t in texts]
    np.testing.assert_allclose(x, np.concatenate(alone), rtol=1e-6)
    # The share of words seen before is high only where lines repeat.
    assert x[4, -3] > 0.9 and x[1, -3] == 0


def test_held_out_accuracy(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = registered.op1_attention_quality(spark, sf_dir).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    good = np.array([r["score"] for r in held if labels[r["doc_id"]] == 1])
    bad = np.array([r["score"] for r in held if labels[r["doc_id"]] == 0])
    assert len(good) > 5 and len(bad) > 0
    assert (good[:, None] > bad[None, :]).mean() > 0.9


def test_odd_rows(spark, odd, none, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    net = mil.train(docs, labels, max_documents=50)
    got = mil.score(odd, net).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["score"])
    assert by[1] == by[2] and by[5] == by[6] and len(by[5]) == 1
    same_rows(mil.score(clashing(odd), net), mil.score(odd, net))
    assert mil.score(none, net).count() == 0
    assert mil.train(docs, labels.where("false")) is None
    assert {r["score"] for r in mil.score(odd, None).collect()} == {0.5}
    odd_labels = frame(spark, ODD).selectExpr("doc_id", "int(doc_id % 3) AS quality")
    assert mil.train(clashing(odd), odd_labels) is not None


def test_sample_bounds(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a, b = (mil.train(docs.repartition(n), labels, max_documents=30) for n in (2, 5))
    for k in a.weights:
        np.testing.assert_array_equal(a.weights[k], b.weights[k])
    assert mil.train(docs, labels, max_bytes=1) is not None
    assert mil.train(docs, labels.where("quality = 1")) is None


def test_a_long_text_does_not_end_the_sample(spark, monkeypatch):
    """Texts that do not fit are passed over, wherever the hash puts them; a missing class has its shortest text."""
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(mil, "fit", lambda x, bags, y: seen.append((len(bags), y.tolist())))
    rows = [(i, f"good words here {i}") for i in range(200)] + [(200 + i, "bad bad bad") for i in range(40)] + [(500 + i, "long text " * 3000) for i in range(20)]
    labels = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id").between(200, 239), 0).otherwise(1).alias("quality"))
    mil.train(frame(spark, rows), labels, max_bytes=20000)
    assert seen[-1][0] == 240 and sum(seen[-1][1]) == 200
    only_long = [(1, "long text " * 3000), (2, "long text " * 2000), (3, "short")]
    mil.train(frame(spark, only_long), spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "doc_id bigint, quality int"), max_bytes=100)
    assert sorted(seen[-1][1]) == [0.0, 1.0]
