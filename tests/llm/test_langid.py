import math
import zlib
from collections import Counter

import numpy as np

from nearfield.llm import langid, registered
from tests.llm.conftest import ODD, clashing, frame, same_rows


def model_of(rows):
    """The model by plain counting, all words and n-grams kept."""
    words = {}
    for lang, text in rows:
        words.setdefault(lang, Counter()).update(langid.letter_words(text))
    languages = sorted(words)
    grams = {x: Counter() for x in languages}
    for lang in languages:
        for word, n in words[lang].items():
            for size in range(1, langid.LONGEST + 1):
                for gram in langid.grams(word, size):
                    grams[lang][gram] += n

    def logs(counts, keys):
        keys = sorted(keys)
        total = {x: sum(counts[x][k] for k in keys) for x in languages}
        return {k: np.array([math.log((counts[x][k] + 0.5) / (total[x] + 0.5 * len(keys))) for x in languages]) for k in keys}

    every = set().union(*words.values())
    by_size = {}
    for size in range(1, langid.LONGEST + 1):
        by_size |= logs(grams, {g for x in languages for g in grams[x] if len(g) == size})
    return languages, logs(words, every), by_size


def tables(model):
    return [{k: scores[i] for k, i in rows.items()} for rows, scores in ((model.words, model.word_scores), (model.grams, model.gram_scores))]


def predict(model, texts):
    return langid.Scorer(model).predict_all(texts)


def test_training_matches_plain_counts(spark):
    rows = [("en", "The cat sat on the mat"), ("de", "Die Katze sitzt auf der Matte"), ("en", "a dog"), ("de", "ein Hund 12"), ("fr", "élan")]
    df = spark.createDataFrame([*rows, (None, "zzz"), ("en", None)], "lang string, text string")
    model, (languages, words, grams) = langid.train(df), model_of(rows)
    assert model.languages == languages
    for got, want in zip(tables(model), (words, grams)):
        assert got.keys() == want.keys()
        for k in got:
            np.testing.assert_allclose(got[k], want[k], rtol=1e-5)
    # An unknown word goes back to the longest n-grams that are known.
    scorer = langid.Scorer(model)
    assert scorer.predict_all(["Katzen sitzen", "12"]) == [("de", scorer.predict_all(["Katzen sitzen"])[0][1]), ("und", 0.0)]
    for word in ("cats", "xcatx", "qqq", "zzé"):
        for n in range(langid.LONGEST, 0, -1):
            known = [grams[g] for g in langid.grams(word, n) if g in grams]
            if known:
                break
        scorer.learn([word])
        np.testing.assert_allclose(scorer.scores[scorer.place[word]], np.mean(known, axis=0) if known else 0, rtol=1e-5)


def test_model_size_is_bounded(docs):
    small = langid.train(docs, max_words=100, max_grams=150)
    assert 0 < len(small.words) <= 100 and 0 < len(small.grams) <= 150
    whole = langid.train(docs)
    kept = np.array([whole.words[w] for w in small.words])
    assert len(kept) == len(small.words)
    text = [r["text"] for r in docs.limit(40).collect()]
    assert np.mean([a[0] == b[0] for a, b in zip(predict(small, text), predict(whole, text))]) > 0.9


def test_held_out_accuracy(spark, sf_dir, docs):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs.collect()}
    got = registered.op6_word_backoff_language(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(truth)
    right = []
    for r in got:
        lang, text = truth[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if any(c.isalpha() for c in text or ""):
            assert r["lang_pred"] in {x for x, _ in truth.values()}
            if r["held_out"]:
                right.append(r["lang_pred"] == lang)
        else:
            assert r["lang_pred"] == "und"
    assert len(right) > 20 and np.mean(right) > 0.95


def test_held_out_languages_are_not_used(spark, docs):
    """Other labels on held-out rows change nothing."""
    from pyspark.sql import functions as F

    held = langid.held_out(F.col("doc_id"), 5, 0)
    a = langid.train(docs.where(~held))
    b = langid.train(docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).where(~held))
    assert a.languages == b.languages and a.words == b.words and (a.word_scores == b.word_scores).all()


def test_odd_rows(spark, docs, odd, none):
    model = langid.train(docs)
    got = langid.predict(odd, model).select("doc_id", "lang_pred", "score").collect()
    assert len(got) == len(ODD)
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert all(found[i] == "und" for i in (1, 2, 3, 11)) and found[5] != "und" and found[9] != "und"
    columns = ["doc_id", "lang_pred", "score"]
    same_rows(langid.predict(clashing(odd), model).select(columns), langid.predict(odd, model).select(columns))
    assert langid.predict(none, model).count() == 0
    empty = langid.train(spark.createDataFrame([], "lang string, text string"))
    assert {r["lang_pred"] for r in langid.predict(odd, empty).collect()} == {"und"}


def test_cache_starts_afresh(monkeypatch, docs):
    model = langid.train(docs)
    texts = [r["text"] for r in docs.limit(30).collect()]
    want = predict(model, texts)
    monkeypatch.setattr(langid, "CACHE_WORDS", 10)
    one = langid.Scorer(model)
    assert [one.predict_all([t])[0] for t in texts] == want


def test_small_broadcasts_cut_nothing(spark, docs, odd):
    """What is not broadcast is looked up: all predictions and scores are those of the whole tables."""
    whole = langid.train(docs.where("doc_id % 2 = 0"))
    assert whole.all_words is None
    texts = docs.select("doc_id", "text").union(odd)
    want = sorted(map(tuple, langid.predict(texts, whole).collect()), key=str)
    for words, grams in ((50, 100), (0, 0), (50, 10**9)):
        small = langid.train(docs.where("doc_id % 2 = 0"), max_words=words, max_grams=grams)
        assert len(small.words) <= words and small.all_words.count() == len(whole.words) and small.all_grams.count() == len(whole.grams)
        got = sorted(map(tuple, langid.predict(texts, small).collect()), key=str)
        assert [x[:3] for x in got] == [x[:3] for x in want]
        np.testing.assert_allclose([x[3] for x in got], [x[3] for x in want], rtol=1e-9, atol=1e-12)
