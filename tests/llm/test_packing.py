import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from nearfield.llm import packing
from nearfield.llm.registered import tokenizer_path
from tests.llm.conftest import ODD, clashing


def expected(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), 2048):
            part = np.array(ids[i : i + 2048], "<u4")
            out.append((d, i // 2048, i, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=str)


def check(rows, got):
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in got)
    return len(sequences), -(-total // 2048)


def test_whole_table(docs, rows):
    used, least = check(rows, packing.pack(docs, tokenizer_path()).collect())
    assert used <= 1.02 * least + 1


def test_odd_rows(odd, none):
    check(ODD, packing.pack(odd, tokenizer_path()).collect())
    check(ODD, packing.pack(clashing(odd), tokenizer_path()).collect())
    assert packing.pack(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"pieces": 3}, {"cost": 600}, {"pieces": 4, "cost": 900}])
def test_plan_holds_every_capacity(rule, limits):
    rng = random.Random(4)
    limits = packing.Limits(**({"tokens": 40, "pieces": 40, "cost": 1600} | limits), rule=rule)
    top = min(40, int(limits.cost**0.5))
    histogram = {n: rng.randint(1, 50) for n in range(1, top + 1) if rng.random() < 0.7}
    lines = packing.plan(histogram, limits)
    bins = {}
    for length, total in histogram.items():
        ranks = []
        for n, rank, first, used, each, offset in lines[lines[:, 0] == length].tolist():
            for i in range(used * each):
                ranks.append(rank + i)
                bins.setdefault(first + i // each, []).append((offset + (i % each) * length, length))
        assert ranks == list(range(total))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(parts) <= limits.pieces and sum(n * n for _, n in parts) <= limits.cost
    if limits.pieces == 40 and limits.cost == 1600:
        least = max(sum(n * c for n, c in histogram.items()) / 40, sum(c for n, c in histogram.items() if n > 20))
        assert len(bins) <= 11 / 9 * least + 1


def test_plan_size_does_not_follow_the_corpus():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 900) for n in range(1, 2049)}
    small, large = (packing.plan({n: c * f for n, c in histogram.items()}) for f in (1, 1000))
    assert len(large) < 3 * len(small)


def test_too_small_a_capacity():
    with pytest.raises(ValueError):
        packing.plan({30: 1}, packing.Limits(tokens=40, cost=100))


def test_tokens_are_the_tokenizers(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    rng = random.Random(8)
    letters = list("aAbBzZ''sStT. ,!?-|09\t\n\u00a0\u2028\x00\x1c\u0301\u0307\u030c") + ["ß", "É", "ñ", "ÿ", "×", "÷", "µ", "ª", "İ", "Σ", "ς", "ﬁ", "漢", "😀", "'re", "J\u030c", "K", "e\u0301"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 30))) for _ in range(3000)] + [t or "" for _, t in rows[:100]]
    tokens = packing.Tokens(tokenizer_path())
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        ids, counts = tokens.of([t.encode() for t in part])
        ends = np.cumsum(counts)
        for t, a, b in zip(part, ends - counts, ends):
            assert ids[a:b].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


SPECIAL = ["<|endoftext|> a", "<|EndOfText|> a", "x<|endoftext|>y", " <|endoftext|>  <|endoftext|>\n b C", "<|endoftext", "A <|im_start|>User<|im_end|> B", "<s> </s> <unk> [CLS] <pad>", "<|endoftext|>"]


def test_special_tokens_in_texts(spark):
    """The plain call of the tokenizer, whatever it makes of such strings."""
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = SPECIAL + [f"Words {x} more Words" for x in SPECIAL]
    texts += [f"a {t.content} {t.content.upper()}b" for t in tokenizer.get_added_tokens_decoder().values()]
    tokens = packing.Tokens(tokenizer_path())
    for t in texts:
        assert tokens.of([t.encode()])[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t
    from tests.llm.conftest import frame

    rows = list(enumerate(texts))
    check(rows, packing.pack(frame(spark, rows), tokenizer_path()).collect())


def test_another_kind_of_tokenizer_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="lower-case"):
        packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_capacities_that_bind(docs, rows, rule):
    """Few documents and little attention cost to a sequence: both hold, and so do the lengths."""
    limits = packing.Limits(pieces=3, cost=2048 * 2048 + 300 * 300, rule=rule)
    got = packing.pack(docs, tokenizer_path(), limits).collect()
    free, _ = check(rows, packing.pack(docs, tokenizer_path()).collect())
    used, _ = check(rows, got)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r["length"])
    assert max(map(len, sequences.values())) == 3 and used > free
    assert max(sum(n * n for n in x) for x in sequences.values()) <= limits.cost
    tight = packing.Limits(cost=2048 * 2048, pieces=2048, rule=rule)
    assert check(rows, packing.pack(docs, tokenizer_path(), tight).collect())[0] >= free


def test_tokens_when_the_cache_starts_afresh(monkeypatch, rows):
    texts = [(t or "").encode() for _, t in rows[:60]]
    want = packing.Tokens(tokenizer_path()).of(texts)
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    tokens = packing.Tokens(tokenizer_path())
    parts = [tokens.of([t]) for t in texts]
    assert np.concatenate([p[0] for p in parts]).tolist() == want[0].tolist()
