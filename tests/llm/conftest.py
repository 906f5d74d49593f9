from __future__ import annotations

import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())


LONG = " ".join(f"w{i % 97}x{i % 89}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four"), (6, "one two three four"), (7, LONG), (8, LONG + " tail"),
    (9, "\U0001f600 é ß 漢字 12.34.56.78 a@b.cd"), (10, "same " * 300), (11, "12 34"), (None, "no id here at all"), (12, "a\x00b c"),
    (5, "one two three four"),
]
_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def frame(spark, rows):
    """(doc_id, text) rows, dealt over a few partitions."""
    return spark.createDataFrame(rows, _SCHEMA).repartition(3)


CLASHING = [
    "size", "shard", "slot", "row_number", "print", "first", "lowest", "component_id", "words", "spans", "items", "start", "stop", "edges",
    "repeats", "branching", "length", "task", "rank", "piece", "range", "id", "hash", "ahead", "n", "lang_pred", "score", "_row", "mark", "at", "item", "n_words",
]


def clashing(df):
    """The same rows with extra columns named like those that operators make."""
    from pyspark.sql import functions as F

    return df.withColumns({x: F.lit("extra") for x in CLASHING})


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


def same_rows(a, b):
    def of(df):
        return sorted(map(str, (tuple(r) for r in df.collect())))

    assert of(a) == of(b)
