import random

import numpy as np
import xxhash

from nearfield.llm import registered, simhash
from nearfield.llm.common import components
from tests.llm.conftest import ODD, clashing, frame, same_rows


def plain_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, most=3):
    prints = [plain_print(t) for _, t in rows]
    unique = np.array(sorted(set(prints)), np.uint64)
    parent = {int(x): int(x) for x in unique}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(unique):
        for j in np.flatnonzero(np.bitwise_count(unique[i + 1 :] ^ x) <= most):
            parent[root(int(x))] = root(int(unique[i + 1 + j]))
    lowest = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            lowest[root(p)] = min(lowest.get(root(p), doc_id), doc_id)
    return sorted(((d, p, lowest.get(root(p))) for (d, _), p in zip(rows, prints)), key=str)


def results(df):
    return sorted(((r[0], r[1] % 2**64, r[2]) for r in df.collect()), key=str)


def test_whole_table(docs, rows):
    assert results(simhash.near_duplicates(docs)) == brute(rows)


def test_query_form(spark, sf_dir, rows):
    got = {r["doc_id"]: r["fingerprint"] for r in registered.op2_simhash_components(spark, sf_dir).collect()}
    assert got == {d: f"{plain_print(t):016x}" for d, t in rows}


def test_odd_rows(odd, none):
    assert results(simhash.near_duplicates(odd)) == brute(ODD)
    same_rows(simhash.near_duplicates(clashing(odd)), simhash.near_duplicates(odd))
    assert simhash.near_duplicates(none).count() == 0


def test_blocks_cover_every_three_places():
    from itertools import combinations

    assert len(simhash.BLOCKS) == 14
    for apart in combinations(range(8), 3):
        assert any(not set(apart) & set(block) for block in simhash.BLOCKS)


def test_index_joins_what_all_pairs_join(spark):
    """Also when postings are so small that both finer levels are used."""
    rng = random.Random(3)
    values = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            values.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
            x &= 2**64 - 1
    centre = rng.getrandbits(64)
    for _ in range(300):
        values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))))
    unique = np.array(sorted(values), np.uint64)
    pairs = {(int(unique[i]), int(unique[i + 1 + j])) for i, x in enumerate(unique) for j in np.flatnonzero(np.bitwise_count(unique[i + 1 :] ^ x) <= 3)}

    def groups(edges):
        parent = {int(x): int(x) for x in unique}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        found = {}
        for x in parent:
            found.setdefault(root(x), set()).add(x)
        return sorted(map(sorted, found.values()))

    prints = spark.createDataFrame([(int(x),) for x in unique.view(np.int64)], "print bigint")
    for limit in (4096, 20, 2):
        got = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.similar_pairs(prints, scan_limit=limit).collect()}
        assert {tuple(sorted(p)) for p in got} <= pairs
        assert groups(got) == groups(pairs)


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_keep_first(docs, odd, rows):
    kept = sorted(r["doc_id"] for r in simhash.keep_first(docs).collect())
    assert kept == sorted({c for _, _, c in brute(rows)})
    assert set(simhash.keep_first(docs).columns) == set(docs.columns)
    assert len(simhash.keep_first(odd).collect()) == len({c for _, _, c in brute(ODD)})


def test_keep_first_keeps_one_row_of_each_group(spark):
    """Whatever the ids: null ones, and ids that rows with different texts repeat."""
    texts = [" ".join(random.Random(i).choices([f"w{j}" for j in range(500)], k=60)) for i in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (5, texts[2]), (None, texts[4]), (9, texts[4]), (9, texts[5])]
    assert len({plain_print(t) for t in texts}) == 6
    got = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (7, texts[3]), (9, texts[4]), (9, texts[5])], key=str)
