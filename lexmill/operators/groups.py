"""Group statistics that stay balanced when one group holds a large share of all rows.

Groups up to ``hot_rows`` rows are handled with windows after one shuffle on
the group key. Larger ones are split off and handled with map-side-combined
aggregates and value-range buckets, so no task ever sees a whole hot group.
There are at most total_rows / hot_rows hot groups, which bounds the list that
is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HOT_ROWS = 2_000_000


def hot_groups(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys holding more than hot_rows rows; reads only the key columns."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(*by)


def split_hot(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS,
              keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(ordinary rows, rows of hot groups or None).

    One cheap job counts the key column first, so the plan for hot groups is built
    only when there are any. ``keys`` names a cheaper table with the same keys to
    count. Hot rows are written to the checkpoint folder once, because the steps
    that follow read them several times.
    """
    hot = hot_groups(df if keys is None else keys, by, hot_rows)
    if hot.isEmpty():
        return df, None
    hot = F.broadcast(cut_lineage(hot))
    return df.join(hot, by, "left_anti"), cut_lineage(df.join(hot, by, "left_semi"))


def merged(normal: DataFrame, hot: DataFrame | None) -> DataFrame:
    return normal if hot is None else normal.unionByName(hot)


def window_totals(df: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    w = Window.partitionBy(*by)
    return df.select("*", *[agg.over(w).alias(name) for name, agg in totals.items()])


def joined_totals(df: DataFrame, by: list[str], totals: dict[str, Column]) -> DataFrame:
    """Totals of hot groups: combined on the map side, broadcast back (one row per hot group)."""
    df = cut_lineage(df)
    small = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in totals.items()])
    return df.join(F.broadcast(small), by)


def window_ranks(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """<c>_rank: average rank of the value in its group (ties share the mean rank)."""
    out = []
    for c in columns:
        w = Window.partitionBy(*by).orderBy(F.col(c))
        out.append(((F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0).alias(f"{c}_rank"))
    return df.select("*", *out)


def bucketed_ranks(df: DataFrame, by: list[str], columns: list[str], buckets: int = 4096) -> DataFrame:
    """The same ranks for hot groups.

    Equal values are counted first, then running counts are taken inside
    equal-width value buckets and bucket totals are chained, so the largest sort
    is one bucket of distinct values of one group and column.
    """
    keys = [*by, "_col"]
    longform = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_e"))
    counts = longform.select(*by, "_e._col", "_e._v").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    counts = cut_lineage(counts)
    span = counts.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    bucket = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / width * buckets),
                                       F.lit(buckets - 1))).otherwise(0)
    placed = counts.join(F.broadcast(span), keys).withColumn("_b", bucket)
    inside = Window.partitionBy(*keys, "_b").orderBy("_v")
    running = placed.select(*keys, "_b", "_v", "_n", F.sum("_n").over(inside).alias("_upto"))
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    chain = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.coalesce(F.sum("_bn").over(chain), F.lit(0)).alias("_before"))
    ranks = running.join(offsets, [*keys, "_b"]).select(
        *keys, "_v", (F.col("_before") + F.col("_upto") - (F.col("_n") - 1) / 2.0).alias("_rank"))
    ranks = cut_lineage(ranks)
    out = df
    for c in columns:
        one = ranks.filter(F.col("_col") == c).select(*by, F.col("_v").alias(f"_{c}_v"),
                                                      F.col("_rank").alias(f"{c}_rank"))
        matched = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
        joined = out.alias("l").join(one.alias("r"), reduce(lambda x, y: x & y, matched)
                                     & (F.col(f"l.{c}").cast("double") == F.col(f"r._{c}_v")))
        out = joined.select("l.*", f"r.{c}_rank")
    return out


def group_ranks(df: DataFrame, by: list[str], columns: list[str], hot_rows: int = HOT_ROWS,
                keys: DataFrame | None = None) -> DataFrame:
    normal, hot = split_hot(df, by, hot_rows, keys)
    return merged(window_ranks(normal, by, columns), None if hot is None else bucketed_ranks(hot, by, columns))


def percentile(rank: Column, n: Column) -> Column:
    """(rank - 1) / (n - 1), and one half for a single item (equal values land on one half by themselves)."""
    return F.when(n <= 1, 0.5).otherwise((rank - 1) / (n - 1))


def chunk_of(order: str, by: list[str], df: DataFrame, rows: int = 100_000) -> DataFrame:
    """_chunk: a coarse, order-preserving slice number inside each group.

    Slices are equal-width ranges of the order column between its group minimum
    and maximum, about one per ``rows`` rows; a small group is one slice.
    """
    span = df.groupBy(*by).agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"),
                               F.count(F.lit(1)).alias("_cnt"))
    slices = F.greatest(F.ceil(F.col("_cnt") / rows), F.lit(1))
    width = (F.col("_hi") - F.col("_lo") + 1) / slices
    return (df.join(span, by)
            .withColumn("_chunk", F.floor((F.col(order) - F.col("_lo")) / width).cast("bigint"))
            .drop("_lo", "_hi", "_cnt"))


def running_number(df: DataFrame, by: list[str], order: str, name: str = "rn", rows: int = 100_000) -> DataFrame:
    """Gap-free 1, 2, 3 ... inside each group, in two levels: inside a slice, then slice offsets."""
    cut = chunk_of(order, by, df, rows)
    keys = [*by, "_chunk"]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(order)
    return (cut.withColumn("_in", F.row_number().over(inside)).join(offsets, keys)
            .withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before", "_chunk"))


def in_order(df: DataFrame, by: list[str], order: str, value: str, rows: int = 100_000) -> DataFrame:
    """Per group: n values and whether each is at least the one before it.

    Neighbours are compared inside slices, then across slice borders.
    """
    cut = chunk_of(order, by, df.filter(F.col(value).isNotNull()), rows)
    keys = [*by, "_chunk"]
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    inner = (cut.withColumn("_drop", F.coalesce(F.col(value) < prev, F.lit(False)))
             .groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_drop").alias("_drop"),
                                 F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last")))
    before = F.lag("_last").over(Window.partitionBy(*by).orderBy("_chunk"))
    border = inner.withColumn("_drop", F.col("_drop") | F.coalesce(F.col("_first") < before, F.lit(False)))
    return border.groupBy(*by).agg(F.sum("_n").alias("n_numbered"), (~F.max("_drop")).alias("ordered"))


def numbered(df: DataFrame, by: list[str], order: str, name: str = "rn", hot_rows: int = HOT_ROWS,
             keys: DataFrame | None = None) -> DataFrame:
    """Gap-free number inside each group; hot groups are numbered in slices.

    ``keys`` may be a coarser table (fewer columns of ``by``): a group cannot be hot
    when none of the coarser groups is.
    """
    if keys is not None and hot_groups(keys, [c for c in by if c in keys.columns], hot_rows).isEmpty():
        normal, hot = df, None
    else:
        normal, hot = split_hot(df, by, hot_rows)
    w = Window.partitionBy(*by).orderBy(order)
    return merged(normal.withColumn(name, F.row_number().over(w).cast("bigint")),
                  None if hot is None else running_number(hot, by, order, name))
