import random
import re

import pytest
from pyspark.sql import functions as F

from nearfield.llm import divergence, registered
from tests.llm.conftest import ODD, clashing

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, least_docs=3, ranks=200):
    """rows of (text, lang, source); every value term by term."""
    langs = {}
    for text, lang, source in rows:
        langs.setdefault(lang or "", []).append((source or "", terms(text)))
    out = []
    for lang, docs in langs.items():
        holders = {}
        for _, words in docs:
            for t in set(words):
                holders[t] = holders.get(t, 0) + 1
        kept = sorted(t for t, n in holders.items() if n >= least_docs)
        sources = sorted({s for s, _ in docs})

        def shares(words):
            known = set(kept)
            words = [w for w in words if w in known]
            counts = {t: 0 for t in kept}
            for w in words:
                counts[w] += 1
            return counts, {t: 1 + (10**9 * (counts[t] + 1)) // (len(words) + len(kept)) for t in kept}

        group = {s: shares([w for x, ws in docs if x == s for w in ws]) for s in sources}
        _, whole = shares([w for _, ws in docs for w in ws])
        for s in sources:
            counts, p = group[s]
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o in sources if o != s for q in [group[o][1]]]
            words = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", words, ranks)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(found, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)


def results(df):
    return sorted(tuple(r) for r in df.collect())


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnop"] + ["É", "漢字", "Straße", "the", "THE"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + rng.choice(["", ".", " 12 x"]), rng.choice("ab"), f"s{rng.randint(0, 5)}") for _ in range(n)]
    rows += [(None, "a", "null text"), ("", "a", ""), ("the wa wb", None, None), ("the wa wb", "", None), ("the wa", None, "z"), ("alone", "lonely", "x"), ("alone", "lonely", "y")]
    return rows + rows[:9]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = made(seed)
    assert results(divergence.audit(frame(spark, rows))) == brute(rows)
    assert results(divergence.audit(frame(spark, rows), ranks=3)) == brute(rows, ranks=3)


def test_slices_do_not_matter(spark, monkeypatch):
    """Accumulators of many small slices add up to those of one."""
    rows = made(3)
    batches = divergence.materialize(
        frame(spark, rows).select(*[F.coalesce(x, F.lit("")).alias(x) for x in ("text", "lang", "source")]), "rows"
    )
    want = brute(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert results(divergence.audit(batches)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_hot_source_and_large_counts(spark):
    rows = [("the " * 20000 + "wa wb", "a", "hot")] * 30 + [("the wa wb wc", "a", f"s{i}") for i in range(12)] + [("wc " * 5, "a", "hot")] * 3
    assert results(divergence.audit(frame(spark, rows))) == brute(rows)


def test_odd_documents(spark, odd, none):
    rows = odd.withColumns({"lang": F.when(F.col("doc_id") < 9, "xx"), "source": F.when(F.col("doc_id") > 3, F.col("doc_id").cast("string"))})
    plain = [(r["text"], r["lang"], r["source"]) for r in rows.collect()]
    assert len(plain) == len(ODD)
    assert results(divergence.audit(rows)) == brute(plain)
    assert results(divergence.audit(clashing(rows).withColumns({x: F.lit("x") for x in ("term", "n", "docs", "low", "p", "q", "sid", "peer", "kept", "total", "used", "item", "value", "part")}))) == brute(plain)
    assert results(divergence.audit(none.withColumns({"lang": F.lit("x"), "source": F.lit("y")}))) == []


def test_plan_joins_no_postings(spark, sf_dir):
    """No join pairs postings: the index meets itself only inside the accumulators."""
    plan = registered.op13_source_divergence(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
