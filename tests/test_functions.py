import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import distance, quantize, text
from nearfield.operators import kernel  # noqa: F401
from nearfield.operators.knn import search
from tests.conftest import lists_of, table_of


def one(spark, vector, column):
    row = spark.createDataFrame([(0, vector)], "id int, vector array<float>").select(column.alias("x")).first()
    return row["x"]


def test_quantizer_edges(spark):
    vector = [-2.5, 0.5 / 127, -0.5 / 127, 1.01, -1.01, 0.0]
    assert one(spark, vector, quantize.quantize_i8(F.col("vector")))[:1] == [-128]
    assert one(spark, vector, quantize.quantize_i8(F.col("vector")))[3:] == [127, -128, 0]
    # -2.5 * 127 = -317.5 -> -317 -> low byte; 128 wraps to -128
    assert one(spark, vector, quantize.quantize_i8(F.col("vector"), "wrap"))[0] == -317 + 256
    assert one(spark, vector, quantize.quantize_i8(F.col("vector"), "wrap"))[3] == -128
    half_up = one(spark, [2.5 / 127, -2.5 / 127], quantize.quantize_i8(F.col("vector")))
    product = (np.array([2.5 / 127, -2.5 / 127], np.float32) * np.float32(127)).astype(float)
    assert half_up == np.floor(product + 0.5).astype(int).tolist()


@pytest.mark.parametrize("bad", [float("nan"), None])
def test_quantizer_refuses_nan_and_null(spark, bad):
    with pytest.raises(Exception, match="cannot quantize"):
        one(spark, [0.5, bad], quantize.quantize_i8(F.col("vector")))
    with pytest.raises(ValueError):
        quantize.quantize_i8(F.col("vector"), "clip")


@pytest.mark.parametrize("precision", ["f32", "f16", "bf16"])
def test_column_rounding_equals_the_kernel(spark, rng, precision):
    values = np.concatenate(
        [rng.normal(size=500), rng.normal(size=200) * 1e-6, rng.normal(size=50) * 1e4, [0.0, 1.0, -2.0, 65519.0, 65520.0, 1e-8]]
    ).astype(np.float32)
    got = one(spark, values.tolist(), quantize.round_precision(F.col("vector"), precision))
    np.testing.assert_array_equal(np.array(got, np.float32), quantize.encode(values[None, :], precision)[0])


def test_i8_rounding_restores_the_scale(spark, rng):
    values = rng.uniform(-1, 1, 100).astype(np.float32)
    got = one(spark, values.tolist(), quantize.round_precision(F.col("vector"), "i8"))
    assert np.abs(np.array(got) - values).max() <= 0.5 / 127 + 1e-6


def test_scale_u8(spark):
    row = spark.sql("select array(0Y, 127Y, -128Y, -1Y) as v").select(quantize.scale_u8(F.col("v")).alias("x")).first()
    np.testing.assert_allclose(row["x"], [0, 127 / 255, 128 / 255, 1.0], rtol=1e-6)


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    a, b = F.col("a"), F.col("b")
    rows = df.select(*[distance.distance(m, a, b).alias(m) for m in ("l2", "ip", "cos")]).collect()
    assert rows[0]["l2"] == 8.0 and rows[0]["ip"] == -2.0 and rows[0]["cos"] == pytest.approx(1 - 3 / (5**0.5 * 3))
    assert rows[1]["cos"] is None
    assert distance.check_metric("L2") == "l2"
    with pytest.raises(ValueError, match="dot is not one of the metrics"):
        distance.distance("dot", a, b)


def test_stored_codes_are_searched_as_they_are(spark, rng):
    codes = rng.integers(-128, 128, size=(300, 6))
    base, asked = table_of(spark, range(300), codes), table_of(spark, range(5), codes[:5], "query_id")
    base, asked = (df.withColumn("vector", F.col("vector").cast("array<tinyint>")) for df in (base, asked))
    hits = search(base, asked, 3, "l2", ["i8"]).filter("rank = 1").collect()
    assert {(h["query_id"], h["neighbor_id"], h["distance"]) for h in hits} == {(i, i, 0.0) for i in range(5)}
    with pytest.raises(ValueError, match="int8 codes"):
        search(base, asked, 3)


@pytest.mark.parametrize("precision", quantize.PRECISIONS)
def test_stored_precision_gives_the_same_hits(spark, rng, precision):
    vectors = rng.uniform(-1, 1, size=(300, 6))
    base, asked = table_of(spark, range(300), vectors), table_of(spark, range(9), vectors[:9] + 0.1, "query_id")
    stored = base.withColumn("vector", quantize.stored_at(F.col("vector"), precision))
    assert lists_of(search(stored, asked, 4, "l2", [precision])) == lists_of(search(base, asked, 4, "l2", [precision]))


def test_text_helpers(spark):
    df = spark.createDataFrame(
        [("a/b.fbin", 512 << 20, "One  two\tTWO\n"), ("http://x.y/z", 1 << 30, ""), ("/x.d/y", 1536 << 20, "   ")],
        "path string, size bigint, text string",
    )
    rows = df.select(
        text.path_extension(F.col("path")).alias("e"), text.format_memory(F.col("size")).alias("m"), text.words(F.col("text")).alias("w")
    ).collect()
    assert [r["e"] for r in rows] == [".fbin", "", ""]
    assert [r["m"] for r in rows] == ["512 MB", "1.0 GB", "1.5 GB"]
    assert [[w for w in r["w"] if w] for r in rows] == [["one", "two", "two"], [], []]
