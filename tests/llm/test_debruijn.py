import hashlib
import random
import re

import numpy as np

from nearfield.llm import debruijn
from tests.llm.conftest import ODD, clashing, frame, same_rows


def brute(rows, k=20):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first, gone = {}, {d: set() for d in words}
    for d in sorted(words, key=lambda x: (x is not None, x or 0)):
        for i in range(len(words[d]) - k + 1):
            window = tuple(words[d][i : i + k])
            if window in first:
                gone[d].update(range(i, i + k))
            else:
                first[window] = (d, i)
    return sorted(
        ((d, len(w), len(gone[d]), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone[d]).encode()).hexdigest()) for d, w in words.items()),
        key=str,
    )


def results(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def test_whole_table(docs, rows):
    assert results(debruijn.cut_repeats(docs)) == brute(rows)


def test_random_passages(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(12)] + ["the"] * 4
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(18, 60))) for _ in range(8)]
    rows = []
    for d in range(150):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.2:
            parts.append("x y " * rng.randint(5, 60))
        rows.append((d * 3, rng.choice([" ", "\n"]).join(parts)))
    rng.shuffle(rows)
    df = frame(spark, rows)
    assert results(debruijn.cut_repeats(df)) == brute(rows)
    assert results(debruijn.cut_repeats(df, k=6, seed_words=2)) == brute(rows, 6)
    words = {d: t.split() for d, t in rows}
    for r in debruijn.cut_repeats(df).collect():
        kept = [w for i, w in enumerate(words[r["doc_id"]]) if not any(s["start"] <= i < s["stop"] for s in r["spans"])]
        assert hashlib.sha256(" ".join(kept).encode()).hexdigest() == r["kept_sha256"]


def test_odd_rows(odd, none):
    unique = sorted(set(ODD), key=str)
    got = results(debruijn.cut_repeats(odd))
    assert sorted(set(got), key=str) == brute(unique) and len(got) == len(ODD)
    same_rows(debruijn.cut_repeats(clashing(odd)), debruijn.cut_repeats(odd))
    assert debruijn.cut_repeats(none).count() == 0


def test_pieces_hold_every_edge_once():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 50, 500).astype(np.uint64)
    ends = np.array([0, 19, 39, 39, 300, 500])
    owner, begin, count, _, _ = debruijn.pieces(hashes, ends, 20, 5)
    covered = [(int(o), int(s) + i) for o, s, c in zip(owner, begin, count) for i in range(c)]
    starts = np.append(0, ends)
    assert sorted(covered) == [(o, s) for o in range(6) for s in range(starts[o], starts[o + 1] - 19)]

