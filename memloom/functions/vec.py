"""Vector arithmetic over array columns, in doubles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def vector(values: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 where a norm is 0 or the result is no number."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    c = dot(a, b) / (na * nb)
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(F.when(F.isnan(c), 0.0).otherwise(c))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def mean_vector(df, keys: list[str], column: str):
    """Element-wise mean of a vector column by keys; partial sums combine before the shuffle."""
    positions = df.select(*keys, F.posexplode(F.col(column).cast("array<double>")).alias("_pos", "_x"))
    means = positions.groupBy(*keys, "_pos").agg(F.avg("_x").alias("_x"))
    ordered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", "_x"))).alias("_v"))
    return ordered.select(*keys, F.transform("_v", lambda e: e["_x"]).alias(column))
