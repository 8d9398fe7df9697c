"""Class cuts taken from the scores themselves, stored in versions and applied as of the time of scoring.

Cuts are exact natural breaks: the partition of all scores into classes with the least squared deviation
inside them. Scores are counted per value on a grid of ``digits`` decimals first, so the dynamic program
sees every score through at most span * 10^digits weighted points, whatever the number of rows. The best
last split of a prefix moves up with the prefix, so each layer is filled by halving: all middle prefixes of
one depth at once, n log n work per layer and no pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules

#: Per kind of score: its fixed cuts below rules.MIN_REFERENCE scores, and its labels from low to high.
KINDS = {"clause": (rules.CLAUSE_CUTS, ["Low", "Medium", "High"]),
         "document": (rules.DOCUMENT_CUTS, ["Low", "Medium", "High", "Critical"]),
         "authenticity": (rules.TIER_CUTS, rules.TIER_LABELS)}
#: A version table of up to this many rows is sent to every task; a longer one is joined by kind.
SENT_VERSIONS = 10_000


class Splits:
    """The best splits of weighted, ascending values into 1, 2, ... classes."""

    def __init__(self, values: np.ndarray, weights: np.ndarray, classes: int):
        self.values, n = values, len(values)
        centred = values - np.average(values, weights=weights) if n else values
        self.sums = [np.concatenate([[0.0], np.cumsum(weights * centred ** power)]) for power in range(3)]
        self.starts = [np.zeros(n + 1, "int64")]
        self.best = [self.cost(np.zeros(n + 1, "int64"), np.arange(n + 1))]
        for k in range(2, min(classes, n) + 1):
            self.add_layer(k)

    def cost(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Squared deviation inside values[first:last]."""
        w, s, q = (x[last] - x[first] for x in self.sums)
        return np.maximum(q - s * s / np.where(w > 0, w, 1.0), 0.0)

    def add_layer(self, k: int) -> None:
        """For every prefix of k or more values, the start of its last of k classes (the least on ties)."""
        n = len(self.values)
        start, best = np.zeros(n + 1, "int64"), np.full(n + 1, np.inf)
        low, high = np.array([k]), np.array([n])
        from_, to = np.array([k - 1]), np.array([n - 1])
        while len(low):
            mid = (low + high) // 2
            size = np.minimum(to, mid - 1) - from_ + 1
            heads = np.cumsum(size) - size
            part = np.repeat(np.arange(len(mid)), size)
            first = np.arange(size.sum()) - heads[part] + from_[part]
            value = self.best[-1][first] + self.cost(first, mid[part])
            least = np.minimum.reduceat(value, heads)
            found = np.flatnonzero(value == least[part])
            chosen = first[found[np.unique(part[found], return_index=True)[1]]]
            start[mid], best[mid] = chosen, least
            low, high, from_, to = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (from_, chosen), (chosen, to)))
            some = low <= high
            low, high, from_, to = low[some], high[some], from_[some], to[some]
        self.starts.append(start)
        self.best.append(best)

    def cuts(self, classes: int) -> list[float]:
        """The largest value of each class but the last; with fewer values than classes the lowest repeats."""
        n = len(self.values)
        k, end, out = min(classes, n), n, []
        while k > 1:
            end = int(self.starts[k - 1][end])
            out.append(float(self.values[end - 1]))
            k -= 1
        return [float(self.values[0])] * (classes - 1 - len(out)) + out[::-1] if n else []


def value_counts(scores: DataFrame, score: str, digits: int, by: list[str]) -> DataFrame:
    """by, value on the grid, n; nulls do not count."""
    value = F.round(F.col(score).cast("double"), digits)
    return scores.filter(F.col(score).isNotNull()).groupBy(*by, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def natural_breaks(counts: DataFrame, classes: list[int], by: list[str]) -> DataFrame:
    """by, classes, sample_size and cuts for each number of classes, from by, value, n."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("value")
        splits = Splits(rows["value"].to_numpy("float64"), rows["n"].to_numpy("float64"), max(classes))
        return pd.DataFrame({**{c: [rows[c].iloc[0]] * len(classes) for c in by}, "classes": classes,
                             "sample_size": int(rows["n"].sum()), "cuts": [splits.cuts(k) for k in classes]})
    kinds = {f.name: f.dataType.simpleString() for f in counts.schema}
    return counts.groupBy(*by).applyInPandas(run, ", ".join(
        [*[f"{c} {kinds[c]}" for c in by], "classes int, sample_size long, cuts array<double>"]))


def thresholds(scores: DataFrame, score: str, fallbacks: dict[int, tuple], digits: int = 2, by: list[str] | None = None,
               minimum: int = rules.MIN_REFERENCE) -> DataFrame:
    """by, classes, sample_size, is_data_derived and cuts; fixed cuts below `minimum` scores, also with no score at all."""
    by = by or []
    made = natural_breaks(value_counts(scores, score, digits, by), sorted(fallbacks), by)
    if not by:  # a row per number of classes even where there is no score
        wanted = scores.sparkSession.createDataFrame([(k,) for k in sorted(fallbacks)], "classes int")
        made = wanted.join(F.broadcast(made), "classes", "left")
    fixed = F.create_map(*[x for k, cuts in fallbacks.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in cuts]))])
    size = F.coalesce("sample_size", F.lit(0))
    enough = size >= minimum
    return made.select(*by, "classes", size.cast("long").alias("sample_size"), enough.alias("is_data_derived"),
                       F.when(enough, F.col("cuts")).otherwise(fixed[F.col("classes")]).alias("cuts"))


def label(score: Column, cuts: Column, labels: list[str]) -> Column:
    """The class of a score: one class up for every cut it reaches."""
    reached = F.size(F.filter(cuts, lambda c: score >= c))
    return F.when(score.isNotNull(), F.element_at(F.array(*[F.lit(x) for x in labels]), reached + 1))


def versions(scores: DataFrame, score: str, period: Column, kind: str, digits: int = 2) -> DataFrame:
    """One version of the cuts of a kind per period, from the scores of all earlier periods: kind, version, cuts, sample_size, is_data_derived.

    Scores are counted per period and value first; each count then goes to the later periods.
    """
    fixed, labels = KINDS[kind]
    dated = value_counts(scores.withColumn("_period", period.cast("long")), score, digits, ["_period"])
    every = scores.select(period.cast("long").alias("p")).filter("p IS NOT NULL").agg(F.array_sort(F.collect_set("p")).alias("p"))
    spread = dated.select("_period", "value", "n", F.explode(every.scalar()).alias("version")).filter("version > _period")
    counts = spread.groupBy("version", "value").agg(F.sum("n").alias("n"))
    made = natural_breaks(counts, [len(labels)], ["version"])
    out = every.select(F.explode("p").alias("version")).join(made, "version", "left")
    size = F.coalesce("sample_size", F.lit(0)).cast("long")
    enough = size >= rules.MIN_REFERENCE
    return out.select(F.lit(kind).alias("kind"), "version", F.when(enough, F.col("cuts")).otherwise(
        F.array(*[F.lit(float(c)) for c in fixed])).alias("cuts"), size.alias("sample_size"), enough.alias("is_data_derived"))


def store(cuts: DataFrame, path: str) -> None:
    """Write versions, each in a folder of its own; a version that is written again is replaced, the others stay."""
    cuts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kind", "version").parquet(path)


def as_of(rows: DataFrame, stored: DataFrame, kind: str, score: str, period: Column, name: str = "level") -> DataFrame:
    """rows with the cuts of the latest version up to their own period, and the class by them; fixed cuts before the first version."""
    fixed, labels = KINDS[kind]
    mine = stored.filter(F.col("kind") == kind)
    until = F.lead("version").over(Window.partitionBy("kind").orderBy("version"))
    spans = mine.select(F.col("kind").alias("_kind"), F.col("version").cast("long").alias("cut_version"), until.cast("long").alias("_until"), "cuts")
    if spans.limit(SENT_VERSIONS + 1).count() <= SENT_VERSIONS:
        spans = F.broadcast(spans)
    at = period.cast("long")
    found = rows.withColumn("_at", at).join(spans, (F.col("_kind") == F.lit(kind)) & (F.col("_at") >= F.col("cut_version"))
                                            & (F.col("_until").isNull() | (F.col("_at") < F.col("_until"))), "left")
    cuts = F.coalesce("cuts", F.array(*[F.lit(float(c)) for c in fixed]))
    return found.withColumn(name, label(F.col(score), cuts, labels)).drop("_kind", "_until", "_at", "cuts")
