"""Entropy weights and concentration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import groups

EPSILON = 1e-4
SHRINKAGE = 10.0


def information(n: Column, total: Column, xlogx: Column, eps: float = EPSILON) -> Column:
    """1 - normalised entropy + eps of one criterion.

    With shares p = x/S the sum of p*ln(p) is (sum of x*ln(x))/S - ln(S), so two
    plain sums per group are enough and no second pass over the rows is needed.
    """
    entropy = -(xlogx / total - F.log(total)) / F.log(n)
    return (1.0 - entropy) + eps


def shifted(x: Column, eps: float = EPSILON) -> Column:
    return x + eps


def xlogx(x: Column, eps: float = EPSILON) -> Column:
    s = shifted(x, eps)
    return F.when(s > 0, s * F.log(s)).otherwise(0.0)


def shrunk_weight(info: Column, info_sum: Column, n: Column, m: int | Column, n0: float = SHRINKAGE) -> Column:
    """Data-derived weight blended with equal weights; equal weights below two rows."""
    m = F.lit(m) if isinstance(m, int) else m
    lam = n / (n + n0)
    return F.when(n < 2, 1.0 / m).otherwise(lam * info / info_sum + (1.0 - lam) / m)


def entropy_weights(matrix: DataFrame, group: str = "group_id", criterion: str = "criterion",
                    value: str = "value", eps: float = EPSILON, n0: float = SHRINKAGE) -> DataFrame:
    """Weights per group over a long (group, item, criterion, value) matrix."""
    x = F.col(value).cast("double")
    sums = matrix.groupBy(group, criterion).agg(
        F.count(F.lit(1)).alias("n"), F.sum(shifted(x, eps)).alias("s"), F.sum(xlogx(x, eps)).alias("t"))
    info = sums.withColumn("info", F.when(F.col("n") >= 2, information(
        F.greatest(F.col("n"), F.lit(2)), F.col("s"), F.col("t"), eps)).otherwise(1.0))
    w = Window.partitionBy(group)
    return info.select(group, criterion, "n", shrunk_weight(
        F.col("info"), F.sum("info").over(w), F.col("n"), F.count(F.lit(1)).over(w), n0).alias("weight"))


def gini_from_sums(n: Column, total: Column, rank_weighted: Column) -> Column:
    """Gini from n, the sum of values and the sum of rank*value."""
    g = (n + 1 - 2.0 * ((n + 1) * total - rank_weighted) / total) / n
    return F.when((n < 2) | (total == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g)))


def gini(df: DataFrame, by: str, value: str, hot_rows: int = groups.HOT_ROWS,
         keys: DataFrame | None = None) -> DataFrame:
    ranked = groups.group_ranks(df.select(by, F.col(value).cast("double").alias("v")), [by], ["v"], hot_rows, keys)
    sums = ranked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"),
                                  F.sum(F.col("v_rank") * F.col("v")).alias("rv"))
    return sums.select(by, "n", (F.col("s") / F.col("n")).alias("mean_value"),
                       gini_from_sums(F.col("n"), F.col("s"), F.col("rv")).alias("gini"))


def concentration_score(mean: Column, gini_value: Column, lam: float = 0.15) -> Column:
    return F.least(F.lit(100.0), mean * (1.0 + lam * gini_value))


def recent_scores(df: DataFrame, score: str, order: str, limit: int) -> DataFrame:
    """Latest non-null scores, one column (planned as a top-k, never a full sort)."""
    return df.filter(F.col(score).isNotNull()).orderBy(F.col(order).desc()).limit(limit).select(score)
