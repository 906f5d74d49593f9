import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import nearcopies, simhash
from tests.llm.conftest import ODD, clashing, frame


def words(text):
    out = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        out = out.replace(c, " ")
    return tuple(w for w in out.split(" ") if w)


def sets(text, width=5):
    w = words(text)
    return {w[i : i + width] for i in range(len(w) - width + 1)} if len(w) >= width else {w} - {()}


def similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute(rows, least=0.8):
    """The rows that stay, by comparing all pairs of different texts that share a shingle."""
    texts = {}
    for _, t in rows:
        texts.setdefault(words(t), sets(t))
    names, parent = list(texts), {}
    holders = {}
    for i, n in enumerate(names):
        parent[i] = i
        for s in texts[n]:
            holders.setdefault(s, []).append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for pair in {(a, b) for x in holders.values() for a in x for b in x if a < b}:
        if similar(texts[names[pair[0]]], texts[names[pair[1]]]) >= least:
            parent[root(pair[0])] = root(pair[1])
    place, best = {n: i for i, n in enumerate(names)}, {}

    for d, t in rows:
        r, key = root(place[words(t)]), (d is None, d or 0, mark_of(t), t)
        best[r] = min(best.get(r, key), key, key=lambda x: x[:3])
    return sorted(((None if none else d, t) for none, d, _, t in best.values()), key=str)


def mark_of(text):
    """Spark's xxhash64 of a string is XXH64 with seed 42, signed."""
    import xxhash

    n = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return n - 2**64 if n >= 2**63 else n


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def edited(rng, text, times):
    w = text.split()
    for _ in range(times):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def made(seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    rows = []
    for _ in range(60):
        first = make(rng.randint(3, 200))
        group = [first] + [edited(rng, first, rng.randint(1, 6)) for _ in range(rng.randint(0, 5))]
        rows += [(rng.randrange(10**6), t) for t in group for _ in range(rng.choice([1, 1, 3]))]
    passage = make(60)
    rows += [(10**6 + i, make(30) + " " + passage + " " + make(20)) for i in range(40)]
    chain = make(150)
    for i in range(60):
        chain = edited(rng, chain, 1)
        rows.append((2 * 10**6 + i, chain))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"scan_limit": 3}, {"block_rows": 4}])
def test_groups_of_edited_texts(spark, options):
    rows = made(1)
    want = brute(rows)
    assert len(want) < len(rows)
    assert kept(nearcopies.keep_first(frame(spark, rows), **options)) == want


def test_whole_table(docs, rows):
    assert kept(nearcopies.keep_first(docs)) == brute(rows)


def test_one_large_group(spark):
    """Two thousand texts, each edited apart from one source: one of them stays, and so do all the others."""
    rng = random.Random(4)
    source = " ".join(f"w{rng.randrange(5000)}" for _ in range(120))
    rows = [(i, edited(rng, source, 2)) for i in range(2000)] + [(5000 + i, " ".join(f"v{rng.randrange(5000)}" for _ in range(50))) for i in range(30)]
    for options in ({}, {"scan_limit": 100}):
        got = kept(nearcopies.keep_first(frame(spark, rows), **options))
        assert got == sorted([rows[0], *rows[2000:]], key=str)


def test_tree_joins_what_all_pairs_join():
    rng = np.random.default_rng(2)
    for _ in range(30):
        centres = rng.integers(0, 256, (4, 64))
        members = centres[rng.integers(0, 4, 50)].copy()
        members[rng.random(members.shape) < rng.choice([0.1, 0.3, 0.5])] = 0
        members = members.astype(np.uint8)
        near = (members[:, None, :] == members[None, :, :]).sum(axis=2) >= 36

        def groups(pairs):
            parent = list(range(50))
            for a, b in pairs:
                ra, rb = parent[a], parent[b]
                parent = [ra if x == rb else x for x in parent]
            return [parent.index(x) for x in parent]

        found = nearcopies.tree(members, 36)
        assert all(near[a, b] for a, b in found) and len(found) < 50
        assert groups(found) == groups(np.argwhere(near).tolist())


def test_similarity_of_signatures(rng):
    """The share of equal places estimates the Jaccard similarity."""
    for share in (0.2, 0.5, 0.8):
        pool = rng.integers(0, 2**63, 40000).astype(np.uint64)
        n = int(2000 * share / (2 - share) * 2 / 2)
        a = np.unique(np.concatenate([pool[:n], pool[n:1000]]))
        b = np.unique(np.concatenate([pool[:n], pool[5000 : 5000 + 1000 - n]]))
        got = np.mean([(nearcopies.signature(a ^ np.uint64(s)) == nearcopies.signature(b ^ np.uint64(s))).mean() for s in range(20)])
        assert abs(got - nearcopies.jaccard(np.sort(a), np.sort(b))) < 0.05


def test_odd_rows(spark, odd, none):
    assert kept(nearcopies.keep_first(odd)) == brute(ODD)
    extra = {x: F.lit("x") for x in ("id", "mark", "print", "root", "first", "block", "kept_id", "times", "word", "place")}
    wide = clashing(odd).withColumns(extra)
    got = nearcopies.keep_first(wide)
    assert got.columns == wide.columns and kept(got) == brute(ODD)
    assert all(r["mark"] == r["kept_id"] == "x" for r in got.collect())
    assert nearcopies.keep_first(none).count() == 0
    ids = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "q r s"), (7, "one two"), (7, "three four"), (7, "A B C D E F"), (3, None), (9, " "), (8, "")]
    assert kept(nearcopies.keep_first(frame(spark, ids))) == sorted([(None, "q r s"), (7, "one two"), (7, "three four"), (7, "A B C D E F"), (3, None)], key=str)


def test_simhash_links_are_candidates(spark):
    """Where no pair passes the tally of least hashes, what SimHash links is still found, and still verified."""
    rng = random.Random(5)
    first = [" ".join(f"w{rng.randrange(9000)}" for _ in range(2000)) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(first)] + [(10 + i, edited(rng, t, 1)) for i, t in enumerate(first)]
    # Repeats weigh in a SimHash, not in a set of shingles.
    often = " ".join(["a b c d e"] * 300)
    rows += [(20, often), (21, often + " f g h i j k l")]
    prints = {d: simhash.fingerprint(t.encode()) for d, t in rows}
    near = {d for d in range(6) if (prints[d] ^ prints[10 + d]).bit_count() <= 3}
    assert near and (prints[20] ^ prints[21]).bit_count() <= 3 and not similar(sets(rows[-2][1]), sets(rows[-1][1])) >= 0.8
    got = {d for d, _ in kept(nearcopies.keep_first(frame(spark, rows), least=nearcopies.PLACES + 1))}
    assert got == {d for d, _ in rows} - {10 + d for d in near}
    assert kept(nearcopies.keep_first(frame(spark, rows))) == brute(rows)
