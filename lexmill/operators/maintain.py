"""Table maintenance: ids, partial updates, replacement, purges, snapshots."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def content_hash(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("hash", F.md5(F.col(text)))


def intake(files: DataFrame, allowed: list[str], max_bytes: int = 200 * 1024 * 1024) -> DataFrame:
    """reason: null for accepted files, else why a file (path, length) is rejected."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.withColumn("reason", F.when(~ext.isin(allowed), "extension not allowed").when(
        F.col("length") > max_bytes, "file too large"))


def new_uploads(batch: DataFrame, existing: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of the batch whose keys are not stored yet; the first of a repeated key is kept.

    The first row per key is a combined aggregate, so copies of one upload meet
    after map-side reduction.
    """
    fresh = batch.join(existing.select(*keys).distinct(), keys, "left_anti")
    return fresh.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in batch.columns if c not in keys]), order).alias("_r")).select(
        *keys, "_r.*")


def with_ids(rows: DataFrame, order: str, last_id: int = 0, slices: int = 4096) -> DataFrame:
    """id = last_id + 1, 2, 3 ... in order of a unique numeric column, without one global sort.

    Rows are cut into equal-width slices of the order column; slice sizes are
    chained and each slice is numbered on its own.
    """
    ends = rows.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    cut = rows.withColumn("_s", F.floor((F.col(order) - lo) / ((hi - lo + 1) / slices)).cast("int"))
    sizes = cut.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_s").orderBy(order)
    return (cut.withColumn("_in", F.row_number().over(inside)).join(F.broadcast(offsets), "_s")
            .withColumn("id", F.col("_before") + F.col("_in") + last_id).drop("_s", "_in", "_before"))


def update_known(table: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Non-null delta fields overwrite, everything else stays."""
    fields = [c for c in delta.columns if c != key]
    d = delta.select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = table.join(d, key, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns],
                      *[F.col(f"_new_{c}").alias(c) for c in fields if c not in table.columns])


def replace_keys(table: DataFrame, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop every row of the given keys, then add the fresh rows (a key may end up empty)."""
    return table.join(keys.select(key).distinct(), key, "left_anti").unionByName(fresh)


def purge(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """Surviving rows of every table when the given documents go."""
    gone = doomed.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def owned_by(documents: DataFrame, users: DataFrame) -> DataFrame:
    return documents.join(users.select("user_id").distinct(), "user_id", "left_semi")


def rescore(clauses: DataFrame, results: DataFrame, key: str = "clause_id") -> DataFrame:
    """Overwrite risk fields of re-scored clauses; their old dimension breakdown is cleared unless a new one comes."""
    fields = ["risk_level", "risk_category", "risk_score", "confidence", "explanation", "dimension_breakdown"]
    r = results.select(key, *[F.col(c).alias(f"_n_{c}") for c in fields if c in results.columns], F.lit(True).alias("_hit"))
    out = clauses.join(r, key, "left")
    hit = F.coalesce("_hit", F.lit(False))

    def pick(c: str) -> Column:
        if f"_n_{c}" in r.columns:
            return F.when(hit, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
        if c == "dimension_breakdown":
            return F.when(~hit, F.col(c)).alias(c)
        return F.col(c)
    return out.select(*[pick(c) for c in clauses.columns])


def snapshot(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def snapshot_checks(live: DataFrame, copy: DataFrame, keys: list[str]) -> DataFrame:
    """One row: do counts agree and is every key of the copy filled?"""
    a = live.agg(F.count(F.lit(1)).alias("live_count"))
    filled = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])
    b = copy.agg(F.count(F.lit(1)).alias("copy_count"), F.coalesce(F.bool_and(filled), F.lit(True)).alias("keys_filled"))
    n = a.scalar()
    return b.withColumn("live_count", n).withColumn("all_passed", (F.col("copy_count") == F.col("live_count")) & F.col("keys_filled"))


def latest(logs: DataFrame, order: str, limit: int = 50) -> DataFrame:
    return logs.orderBy(F.col(order).desc()).limit(limit)


def tagged_records(parts: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per record, tagged with its kind."""
    out = None
    for kind, df in parts.items():
        one = df.select(F.to_json(F.struct(F.lit(kind).alias("record_type"), *df.columns)).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def issue_details(issues: DataFrame, clauses: DataFrame) -> DataFrame:
    """Affected clauses of each issue in listed order, with name, text and stated value; absent clauses keep their id."""
    ids = F.when(F.size(F.coalesce("clause_ids", F.array().cast("array<bigint>"))) > 0, F.col("clause_ids")).otherwise(
        F.filter(F.array("clause_id_1", "clause_id_2"), lambda x: x.isNotNull()))
    rows = issues.select("issue_id", "clause_values", F.posexplode(ids).alias("pos", "clause_id"))
    c = clauses.select("clause_id", "section_name", "text_content")
    return rows.join(c, "clause_id", "left").select(
        "issue_id", "pos", "clause_id", F.coalesce("section_name", F.lit("")).alias("section_name"),
        F.coalesce("text_content", F.lit("")).alias("text_content"), F.col("clause_values")[F.col("clause_id").cast("string")].alias("value"))
