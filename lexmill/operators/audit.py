"""Before/after checks over whole corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def last_per_text(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_id", "text").agg(F.max_by("clause_type", "ord").alias("clause_type"))


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, text, before_type, after_type, change): recovered, dropped, reclassified or same."""
    b = last_per_text(before).withColumnRenamed("clause_type", "before_type")
    a = last_per_text(after).withColumnRenamed("clause_type", "after_type")
    return b.join(a, ["doc_id", "text"], "full_outer").withColumn(
        "change", F.when(F.col("before_type").isNull(), "recovered").when(F.col("after_type").isNull(), "dropped")
        .when(F.col("before_type") != F.col("after_type"), "reclassified").otherwise("same"))


def set_changes_of(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """The same as set_changes for two choices among one table's rows: its texts are grouped once."""
    def last(side, name):
        return F.max_by(F.when(side, F.col("clause_type")), F.when(side, F.col("ord"))).alias(name)
    both = rows.filter(before | after).groupBy("doc_id", "text").agg(last(before, "before_type"), last(after, "after_type"))
    return both.withColumn("change", F.when(F.col("before_type").isNull(), "recovered").when(F.col("after_type").isNull(), "dropped")
                           .when(F.col("before_type") != F.col("after_type"), "reclassified").otherwise("same"))


def set_summary(changes: DataFrame, expected: list[str]) -> DataFrame:
    """Counts per document; a reclassification between two types outside ``expected`` is a regression."""
    surprise = (F.col("change") == "reclassified") & ~F.col("before_type").isin(expected) & ~F.col("after_type").isin(expected)
    out = changes.groupBy("doc_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("recovered", "dropped", "reclassified")],
                                        F.count_if(surprise).alias("unexpected"))
    return out.withColumn("unaffected", (F.col("recovered") + F.col("dropped") + F.col("reclassified")) == 0)


def score_changes(before: DataFrame, after: DataFrame, score: str = "lrsi") -> DataFrame:
    """Per document: largest rise and fall of a clause score and the means on both sides."""
    rows = before.select("doc_id", "clause_id", F.col(score).alias("b")).join(
        after.select("doc_id", "clause_id", F.col(score).alias("a")), ["doc_id", "clause_id"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"), F.max(F.col("a") - F.col("b")).alias("max_increase"),
                                      F.min(F.col("a") - F.col("b")).alias("max_decrease"), F.avg("b").alias("mean_before"),
                                      F.avg("a").alias("mean_after"))


def keyword_hits(rows: DataFrame, text: str, rules: list) -> DataFrame:
    """keyword, category, n_text, n_word: texts that hold a keyword anywhere, and those that hold it as whole words."""
    words = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(r.category).alias("category"), F.lit(P.jvm(P.word(k))).alias("p"))
                      for r in rules for k in r.keywords])
    low = rows.select(F.lower(text).alias("low"))
    held = low.select("low", F.explode(F.filter(words, lambda w: F.col("low").contains(w["keyword"]))).alias("w"))
    return held.groupBy("w.keyword", "w.category").agg(F.count(F.lit(1)).alias("n_text"), F.count_if(F.rlike("low", F.col("w.p"))).alias("n_word"))


def funnel(blocks: DataFrame) -> DataFrame:
    """Counts of accepted, recovered and rejected blocks by reason, and the recovery rate, per document.

    Needs doc_id, pos, block, outcome and reason; short and repeated blocks are
    rejected before classification counts.
    """
    rows = blocks.withColumn("_first", F.min("pos").over(Window.partitionBy("doc_id", "block")))
    why = (F.when(F.length("block") < 15, "too_short").when(F.col("pos") > F.col("_first"), "duplicate_raw_block")
           .when(F.col("outcome") == "rejected", F.col("reason")).otherwise(F.col("outcome")))
    kinds = ["accepted", "recovered", "too_short", "duplicate_raw_block", "classified_general", "below_min_confidence"]
    out = rows.withColumn("_w", why).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raw_blocks"), *[
        F.count_if(F.col("_w") == k).alias(k) for k in kinds])
    lost = F.col("n_raw_blocks") - F.col("accepted")
    return out.withColumn("recovery_rate", F.when(lost > 0, F.round(F.col("recovered") / lost, 4)).otherwise(0.0))
