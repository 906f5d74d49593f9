import hashlib

import numpy as np
import pytest

from nearfield.llm import digest
from tests.llm.conftest import ODD, clashing, frame, same_rows


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        marks = [digest.digest(x.encode()) for x in (t, edited, following)]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1], digest.likeness(*marks[:2]), digest.likeness(marks[0], marks[2])))
    return sorted(out, key=str)


def results(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(docs, rows):
    got = results(digest.compared(docs.repartition(7)))
    assert got == expected(rows)
    edited, other = np.array([r[5] for r in got]), np.array([r[6] for r in got])
    assert (edited[:, None] > other[None, :]).mean() > 0.95


@pytest.mark.parametrize("partitions", ["1", "8"])
def test_unique_odd_rows(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = sorted({r for r in ODD}, key=lambda r: (r[0] is not None, r[0] or 0))
    assert results(digest.compared(frame(spark, rows))) == expected(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark, odd, none):
    got = results(digest.compared(odd))
    assert len(got) == len(ODD)
    same_rows(digest.compared(clashing(odd)), digest.compared(odd))
    assert digest.compared(none).count() == 0
    only = results(digest.compared(frame(spark, [(4, "abcdefgh")])))
    assert only == expected([(4, "abcdefgh")])


def test_likeness():
    rng = np.random.default_rng(0)
    a, b = (" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"], 400)).encode() for _ in range(2))
    marks = {x: digest.digest(x) for x in (a, b, a[:1500] + b[1500:], b"", b"x")}
    assert len({len(m) for m in marks.values()}) == 1
    assert digest.likeness(marks[a], marks[a]) == 1 and digest.digest(bytes(a)) == marks[a]
    for x in marks.values():
        for y in marks.values():
            assert 0 <= digest.likeness(x, y) == digest.likeness(y, x) <= 1
    assert digest.likeness(marks[a], marks[a[:1500] + b[1500:]]) > digest.likeness(marks[a], marks[b])
