import zlib

import numpy as np

import __spark_entry__
import corpus_pipeline
from nearfield.llm import langid, registered
from nearfield.llm.registered import tokenizer_path
from nearfield.session import materialize
from tests.llm.conftest import ODD, clashing, frame
from tests.llm.test_fmindex import brute as contaminated
from tests.llm.test_pii import base
from tests.llm.test_nearcopies import brute as kept


def stages(spark, docs, sf_dir):
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(materialize(stage(spark, found[-1], sf_dir), f"test-{name}"))
    return found


def test_registered_names():
    names = [x for x in __spark_entry__.queries() if x.startswith("op")]
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()
    assert set(registered.registered()) <= set(__spark_entry__.queries())


def test_each_stage_on_the_whole_table(spark, sf_dir, docs):
    whole, spoken, single, clean, masked, packed = stages(spark, docs, sf_dir)
    for df in (spoken, single, clean, masked):
        assert df.columns == docs.columns

    def texts(df):
        return {r["doc_id"]: r["text"] for r in df.collect()}

    start = texts(whole)
    assert texts(spoken) == {d: t for d, t in start.items() if any(c.isalpha() for c in t or "")}
    assert texts(single) == dict(kept(sorted(texts(spoken).items())))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    found = {d: hit for d, _, hit, *_ in contaminated(sorted(texts(single).items()), items)}
    cut = texts(clean)
    assert set(cut) == set(found)
    for d, t in texts(single).items():
        assert (cut[d] == t) == (found[d] == 0)
    assert set(texts(masked)) == set(cut)
    for d, t in texts(masked).items():
        assert not base(t)
        if not base(cut[d]) and "@" not in cut[d] and not any(c.isdigit() for c in cut[d]):
            assert t == cut[d]
    from tests.llm.test_packing import check

    check(sorted(texts(masked).items()), packed.collect())


def test_run(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert got.count() > 0


def test_odd_documents(spark, sf_dir, docs, odd):
    from pyspark.sql import functions as F

    df = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("bigint")})
    labelled = df.withColumn("lang", F.when(F.col("doc_id") > 4, "xx"))
    for rows in (df, labelled, clashing(labelled), df.where("false")):
        found = stages(spark, rows, sf_dir)
        assert all(x.columns == rows.columns for x in found[1:5])
    assert found[-1].count() == 0
    kept = {r["doc_id"] for r in stages(spark, labelled, sf_dir)[1].collect()}
    assert kept == {d for d, t in ODD if any(c.isalpha() for c in t or "")}


def test_language_stage_without_any_language(spark, sf_dir, odd):
    """Nothing can be learned: rows with a letter stay all the same."""
    from pyspark.sql import functions as F

    df = odd.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")})
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.language(spark, df, sf_dir).collect()), key=str)
    assert got == sorted(((d, t) for d, t in ODD if any(c.isalpha() for c in t or "")), key=str)
