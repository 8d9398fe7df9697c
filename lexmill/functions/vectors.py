"""Vector expressions over ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length one; the norm is computed once per row."""
    return F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]


def centroids(df: DataFrame, by: list[str], vector: str, dim: int) -> DataFrame:
    """Direction of the mean vector per group: one partial average per component, so map sides combine."""
    means = [F.avg(F.get(F.col(vector), F.lit(i)).cast("double")).alias(f"_c{i}") for i in range(dim)]
    # Callers compare directions, so the mean is returned at unit length.
    wide = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), *means)
    return wide.select(*by, "n_items", unit(F.array(*[F.col(f"_c{i}") for i in range(dim)])).alias("centroid"))
