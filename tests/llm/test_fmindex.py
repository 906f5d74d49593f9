import hashlib
import random
import re

import numpy as np

from nearfield.llm import fmindex
from tests.llm.conftest import ODD, clashing, frame, same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def results(found):
    return sorted((tuple(r) for r in fmindex.digests(found).collect()), key=str)


def test_whole_table(spark, sf_dir, docs, rows):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [tuple(r) for r in benchmark.select("item_id", "text").collect()]
    want = brute(rows, items)
    assert any(x[-1] for x in want)
    assert results(fmindex.contamination(docs, benchmark)) == want
    # The benchmark in many blocks gives the same.
    assert results(fmindex.contamination(docs, benchmark, block_bytes=3000)) == want


def test_random_texts(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(6)]
    make = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, make(rng.randint(1, 14)) if i % 4 else make(rng.randint(3, 5))) for i in range(1, 25)] + [(3, "W1, w2! w3"), (None, "w1 w2"), (40, None), (41, ".")]
    rows = [(d, " ".join(make(rng.randint(0, 40)) + rng.choice(["", " other", ". É x"]) for _ in range(rng.randint(0, 4)))) for d in range(60)]
    got = fmindex.contamination(frame(spark, rows), items_frame(spark, items))
    assert results(got) == brute(rows, items)


def test_odd_rows(spark, odd, none):
    items = items_frame(spark, [(1, "one two three four"), (2, "same " * 12), (3, "é ß 漢字")])
    listed = [tuple(r) for r in items.collect()]
    assert results(fmindex.contamination(odd, items)) == brute(ODD, listed)
    same_rows(fmindex.digests(fmindex.contamination(clashing(odd), items)), fmindex.digests(fmindex.contamination(odd, items)))
    assert fmindex.contamination(none, items).count() == 0
    assert not any(r["items"] for r in fmindex.contamination(odd, items.where("false")).collect())


def test_index_parts():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 9, 700)
    text[-1] = 0
    order = fmindex.suffix_order(text)
    assert sorted(order.tolist()) == list(range(700))
    tree = fmindex.Wavelet(text, 4)
    at = rng.integers(0, 700, 300)
    assert (tree.at(at) == text[at]).all()
    symbols = rng.integers(0, 9, 300)
    assert tree.rank(symbols, at).tolist() == [int((text[:i] == c).sum()) for c, i in zip(symbols, at)]
    index = fmindex.FMIndex(text)
    for n in (1, 2, 3):
        phrases = rng.integers(1, 9, (200, n))
        low, high = index.search(phrases)
        for p, a, b in zip(phrases, low, high):
            want = [i for i in range(700 - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_removed_words(spark):
    benchmark = items_frame(spark, [(1, "alpha beta gamma")])
    rows = [(1, "Say: Alpha, BETA gamma! End"), (2, "alpha beta"), (3, None), (4, "alpha beta gamma")]
    df = clashing(frame(spark, rows))
    got = fmindex.remove_spans(df, benchmark)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Say: ! End", 2: "alpha beta", 3: "", 4: ""}
