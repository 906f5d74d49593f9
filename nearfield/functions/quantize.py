"""Precision handling: int8 codes and f16/bf16 rounding.

The Column builders stay in the JVM.  ``encode`` is the numpy form used inside
the search kernel, where the vectors are already in a task as Arrow batches.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("f32", "f16", "bf16", "i8")
# Bytes per vector element as stored.
BYTES = {"f32": 4, "f16": 2, "bf16": 2, "i8": 1}

# Significand bits, smallest exponent and largest finite value of each format.
_FLOAT_FORMATS = {"f16": (10, -14, 65504.0), "bf16": (7, -126, 3.3895313892515355e38)}


def check_precision(precision: str) -> str:
    name = precision.lower()
    if name not in PRECISIONS:
        raise ValueError(f"Unknown precision: {precision}. Known precisions are: {', '.join(PRECISIONS)}")
    return name


def cast_f32(vector: Column) -> Column:
    return vector.cast("array<float>")


def quantize_i8(vector: Column, overflow: str = "saturate") -> Column:
    """``floor(x * 127 + 0.5)`` per element as ``array<tinyint>``.

    ``overflow="saturate"`` clamps to [-128, 127]; ``"wrap"`` keeps the low byte.
    A NULL or NaN element raises.
    """
    if overflow not in ("saturate", "wrap"):
        raise ValueError(f"overflow must be 'saturate' or 'wrap', got {overflow!r}")

    def code(x: Column) -> Column:
        scaled = (x.cast("float") * F.lit(127).cast("float")).cast("double")
        rounded = F.floor(scaled + F.lit(0.5))
        if overflow == "saturate":
            bounded = F.least(F.lit(127), F.greatest(F.lit(-128), rounded))
        else:
            bounded = F.pmod(rounded + 128, F.lit(256)) - 128
        invalid = x.isNull() | F.isnan(x)
        return F.when(invalid, F.raise_error(F.lit("cannot quantize a NULL or NaN element")).cast("tinyint")).otherwise(
            bounded.cast("tinyint")
        )

    return F.transform(vector, code)


def dequantize_i8(codes: Column) -> Column:
    return F.transform(codes, lambda c: (c.cast("float") / F.lit(127).cast("float")).cast("float"))


def scale_u8(codes: Column) -> Column:
    """Unsigned view of byte codes scaled to [0, 1]."""
    return F.transform(codes, lambda c: (F.pmod(c.cast("int"), F.lit(256)) / F.lit(255.0)).cast("float"))


def round_precision(vector: Column, precision: str) -> Column:
    """Vector as stored at ``precision``, widened back to ``array<float>``."""
    precision = check_precision(precision)
    if precision == "f32":
        return cast_f32(vector)
    if precision == "i8":
        return dequantize_i8(quantize_i8(vector))
    bits, min_exponent, largest = _FLOAT_FORMATS[precision]

    def rounded(x: Column) -> Column:
        value = x.cast("double")
        exponent = F.greatest(F.floor(F.log2(F.abs(value))), F.lit(min_exponent))
        step = F.pow(F.lit(2.0), (exponent - bits).cast("double"))
        nearest = F.rint(value / step) * step
        bounded = F.when(F.abs(nearest) > largest, F.signum(value) * F.lit(float("inf"))).otherwise(nearest)
        return F.when((value == 0.0) | F.isnan(value) | (F.abs(value) == float("inf")), value).otherwise(bounded).cast("float")

    return F.transform(vector, rounded)


def stored_at(vector: Column, precision: str) -> Column:
    """Vector as an index of this precision keeps it: int8 codes, or rounded floats."""
    return quantize_i8(vector) if check_precision(precision) == "i8" else round_precision(vector, precision)


def encode(matrix: np.ndarray, precision: str) -> np.ndarray:
    """f32 matrix holding the values a store of this precision would hold.

    int8 codes stay in code units: distances between them are exact integers.
    """
    if precision == "f32":
        return matrix
    if precision == "f16":
        with np.errstate(over="ignore"):
            return matrix.astype(np.float16).astype(np.float32)
    if precision == "bf16":
        bits = matrix.view(np.uint32)
        rounded = (bits + 0x7FFF + ((bits >> 16) & 1)) & np.uint32(0xFFFF0000)
        return np.where(np.isnan(matrix), matrix, rounded.view(np.float32))
    if np.isnan(matrix).any():
        raise ValueError("cannot quantize a NaN element")
    codes = np.floor((matrix * np.float32(127)).astype(np.float64) + 0.5)
    return np.clip(codes, -128, 127).astype(np.float32)
