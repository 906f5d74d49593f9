"""Distances between two vector columns, in DOUBLE.

These are row-wise Column builders for already paired rows.  Searches over a
whole base table go through :mod:`nearfield.operators.knn`, which never builds
a row per (query, base) pair.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cos")


def _sum_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum_of(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum_of(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""

    def squared(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _sum_of(F.zip_with(a, b, squared))


def ip(a: Column, b: Column) -> Column:
    """Inner-product distance ``1 - a.b``."""
    return F.lit(1.0) - dot(a, b)


def cos(a: Column, b: Column) -> Column:
    """Cosine distance; NULL when either vector has zero norm."""
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def check_metric(metric: str) -> str:
    name = metric.lower()
    if name not in METRICS:
        raise ValueError(f"{metric} is not one of the metrics {', '.join(METRICS)}")
    return name


def distance(metric: str, a: Column, b: Column) -> Column:
    return {"l2": l2sq, "ip": ip, "cos": cos}[check_metric(metric)](a, b)


def rank_score(rank: Column) -> Column:
    """Reciprocal-rank score of a 1-based rank."""
    return F.lit(1.0) / rank
