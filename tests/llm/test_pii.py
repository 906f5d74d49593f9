import hashlib
import random
import re

import pytest

from nearfield.llm import pii
from tests.llm.conftest import ODD, clashing, frame, same_rows

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in BASE[kind].finditer(text or "") if passes(kind, m.group()))


def brute(rows):
    out = []
    for d, t in rows:
        spans = base(t)
        named = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        out.append((d, *[sum(k == i for _, k, _ in spans) for i in range(4)], hashlib.sha256(named.encode()).hexdigest(), named))
    return sorted(out, key=str)


def check(df, rows):
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert [r[:6] for r in got] == [r[:6] for r in brute(rows)]
    for r, want in zip(got, brute(rows)):
        assert set(filter(None, want[6].split(","))) <= set(r[6].split(","))
        order = [(int(a), pii.KINDS.index(k)) for k, a, _ in (x.split(":") for x in filter(None, r[6].split(",")))]
        assert order == sorted(order)
    return got


def test_whole_table(docs, rows):
    got = check(pii.spans(docs), rows)
    assert all(sum(r[i] for r in got) for i in (1, 2, 3, 4))


TRICKY = [
    "a@b.c_d@e.f", "a@b.c@d.e", "x..@y.z. a@b a@.b a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111 11111111 4111  111111111111", "+1 (739) 555-5817. +4 +49-1 +123456789012345678 +1..5 ++44 20 7946 0958",
    "card 4222222222222 x0000000000000000", "\U0001f600é4111111111111111 ünï@ö.de user@host.de", "1" * 5000, "1 " * 4000, "a" * 20000, "a.b" * 5000 + "@c.de",
    "x@" + "y." * 3000 + "z", "+1" + " " * 5000 + "2", "1." * 5000, "12-34" * 900, "mail me: joe [at] example [dot] com or joe(at)example.org",
    "call 555-123-4567 or (555) 123 4567 now", "+49 30 123456 78 and 10.0.0.1:8080",
]


def test_tricky_texts(spark):
    rows = list(enumerate(TRICKY))
    check(pii.spans(frame(spark, rows)), rows)


def test_random_texts(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("0123456789.@+- ()ab_é", weights=[3] * 10 + [4, 3, 2, 3, 3, 1, 1, 3, 3, 1, 1], k=rng.randint(0, 120)))) for i in range(800)]
    check(pii.spans(frame(spark, rows)), rows)


def test_odd_rows(odd, none):
    check(pii.spans(odd), ODD)
    same_rows(pii.spans(clashing(odd)), pii.spans(odd))
    assert pii.spans(none).count() == 0


def test_adds_what_labelers_agree_on(spark):
    """Bracketed addresses after a cue word are learned from the agreement of gazetteer and context."""
    rows = [(i, f"please write mail to user{i} [at] host{i % 9} [dot] com today") for i in range(60)]
    rows += [(100 + i, f"please write mail to user{i}@host{i % 9}.com today") for i in range(60)]
    rows += [(200 + i, f"in version 1.2.{i}.999 of order 555-{100 + i}-4444 nothing [at] all") for i in range(60)]
    got = {r[0]: r for r in check(pii.spans(frame(spark, rows)), rows)}
    assert all("email:" in got[i][6] for i in range(60))
    assert all("ip:" not in got[200 + i][6] and "email:" not in got[200 + i][6] for i in range(60))


def test_em_finds_reliabilities():
    rng = random.Random(1)
    counts = {}
    for _ in range(20000):
        truth = rng.random() < 0.4
        votes = tuple((2 if truth else 0) if rng.random() < good else rng.choice([0, 1, 2]) for good in (0.9, 0.7, 0.5))
        counts[0, votes] = counts.get((0, votes), 0) + 1
    posterior, tables = pii.reliabilities(counts)
    assert tables[0][1, 0, 2] > tables[0][1, 1, 2] > tables[0][1, 2, 2]
    assert tables[0][1, 0, 2] == pytest.approx(0.9 + 0.1 / 3, abs=0.03)
    assert posterior[0, (2, 2, 2)] > 0.95 and posterior[0, (0, 0, 0)] < 0.05


def test_masked(spark, docs, odd):
    rows = [(1, "\U0001f600 mail a@b.cd, ip 1.2.3.4!"), (2, None), (3, "clean"), (4, "a@b.cd1.2.3.4"), (5, "4111111111111111")]
    df = clashing(frame(spark, rows))
    got = pii.masked(df)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {
        1: "\U0001f600 mail <email>, ip <ip>!", 2: None, 3: "clean", 4: "<email>", 5: "<card>",
    }
    assert pii.masked(odd).count() == len(ODD)


def test_very_many_matches(spark):
    """Forty thousand addresses in one text, and as many spans that overlap others: no step is quadratic."""
    import time

    many = " ".join(f"u{i}@host{i % 7}.com" for i in range(40000))
    mixed = " é".join(f"mail u{i} [at] h{i % 7} [dot] com or +1 555 {100 + i % 900} 4444 10.0.{i % 250}.1" for i in range(4000))
    rows = [(1, many), (2, mixed), (3, "")]
    df = frame(spark, rows)
    started = time.monotonic()
    got = check(pii.spans(df), rows)
    assert {r[0]: r[1] for r in got}[1] == 40000
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[1] == " ".join(["<email>"] * 40000) and "10.0." not in masked[2] and masked[3] == ""
    assert time.monotonic() - started < 60


def test_native(docs):
    for df in (pii.candidates(docs), pii.spans(docs), pii.masked(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan)
