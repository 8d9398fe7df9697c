"""Filters, display buckets and grouped metrics over persisted tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules

LEVELS = ["High", "Medium", "Low", "None"]


def plain_english(text: Column) -> Column:
    """Jargon to everyday phrases, longest phrase first."""
    for phrase in sorted(rules.PLAIN_ENGLISH, key=len, reverse=True):
        text = F.regexp_replace(text, "(?iu)" + phrase, rules.PLAIN_ENGLISH[phrase])
    return text


def highlight(text: Column) -> Column:
    """HTML-escaped text with risk words in bold."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    words = "(?iu)(" + "|".join(rules.HIGHLIGHT_WORDS) + ")"
    return F.regexp_replace(text, words, '<strong style="color:var(--lq-danger);">$1</strong>')


def mean_impact(*impacts: str) -> Column:
    """Half-even rounded mean of the known impacts; null when none is known."""
    known = F.filter(F.array(*impacts), lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.bround(F.aggregate(
        known, F.lit(0.0), lambda acc, v: acc + v) / F.size(known), 0))


def display_buckets(df: DataFrame) -> DataFrame:
    """compliance_status, impact_label and confidence_tier, each with its own null branch."""
    c = F.col("compliance_impact")
    mean = mean_impact("legal_impact", "financial_impact", "business_impact", "compliance_impact")
    conf = F.col("confidence_score")
    return (df.withColumn("compliance_status", F.when(c.isNull(), "Unknown").when(c >= 70, "Needs Review")
                          .when(c >= 40, "Monitor").otherwise("Compliant"))
            .withColumn("impact_label", F.when(mean >= 70, "High").when(mean >= 40, "Medium")
                        .when(mean.isNotNull(), "Low"))
            .withColumn("confidence_tier", F.when(conf.isNull(), "Unscored").when(conf >= 0.7, "High-Confidence Match")
                        .when(conf >= 0.4, "Moderate-Confidence Match").otherwise("Low-Confidence Match")))


def parsing_quality(documents: DataFrame, clauses: DataFrame, by: str = "doc_id", least: int = 3) -> DataFrame:
    """Clause count per document and a warning below ``least``; documents without clauses count zero."""
    n = clauses.groupBy(by).agg(F.count(F.lit(1)).alias("n_clauses"))
    out = documents.join(n, by, "left").withColumn("n_clauses", F.coalesce("n_clauses", F.lit(0)))
    return out.withColumn("warning", F.when(F.col("n_clauses") < least,
                                            "Possible parsing issue or poor clause extraction."))


def legal_only(clauses: DataFrame) -> DataFrame:
    """Structured fields stay in the table but out of legal analysis (a null class is legal)."""
    return clauses.filter(~F.col("classification").eqNullSafe("Structured Field"))


def field_defaults(clauses: DataFrame) -> DataFrame:
    """Risk columns of structured fields: level None, category Not Applicable, no score."""
    field = F.col("classification").eqNullSafe("Structured Field")
    return (clauses.withColumn("risk_level", F.when(field, "None").otherwise(F.col("risk_level")))
            .withColumn("risk_category", F.when(field, "Not Applicable").otherwise(F.col("risk_category")))
            .withColumn("risk_score", F.when(~field, F.col("risk_score"))))


def search_clauses(df: DataFrame, classification: str | None = None, level: str | None = None,
                   importance: str | None = None, text: str | None = None) -> DataFrame:
    """All given filters must hold; a missing level counts as "None"; text is looked for in title and body."""
    if classification:
        df = df.filter(F.col("classification") == classification)
    if level:
        df = df.filter(F.coalesce("risk_level", F.lit("None")) == level)
    if importance:
        df = df.filter(F.col("importance_category") == importance)
    if text:
        low = text.lower()
        df = df.filter(F.lower(F.coalesce("section_name", F.lit(""))).contains(low)
                       | F.lower(F.coalesce("text_content", F.lit(""))).contains(low))
    return df


def flagged(df: DataFrame) -> DataFrame:
    """High and Medium clauses with a category for display."""
    return df.filter(F.col("risk_level").isin("High", "Medium")).withColumn(
        "category", F.coalesce("risk_category", F.lit("Uncategorized")))


def document_metrics(documents: DataFrame, clauses: DataFrame, contradictions: DataFrame,
                     by: str = "doc_id", user: int | None = None) -> DataFrame:
    """Clause, contradiction and flagged counts and level counts; zeros for documents of other owners."""
    legal = legal_only(clauses)
    level = F.coalesce("risk_level", F.lit("None"))
    counts = legal.groupBy(by).agg(
        F.count(F.lit(1)).alias("total_clauses"),
        F.count_if(F.col("risk_level").isin("High", "Medium")).alias("risky_clauses"),
        *[F.count_if(level == x).alias(f"{x.lower()}_clauses") for x in LEVELS])
    issues = contradictions.groupBy(by).agg(F.count(F.lit(1)).alias("total_contradictions"))
    out = documents.join(counts, by, "left").join(issues, by, "left")
    own = F.lit(True) if user is None else F.col("user_id") == user
    names = ["total_clauses", "risky_clauses", "total_contradictions", *[f"{x.lower()}_clauses" for x in LEVELS]]
    return out.select(by, own.cast("int").alias("total_documents"),
                      *[F.when(own, F.coalesce(n, F.lit(0))).otherwise(0).alias(n) for n in names])


def level_percentages(clauses: DataFrame, by: str = "doc_id") -> DataFrame:
    """Share of each of four fixed levels, rounded half-even to whole percent."""
    level = F.coalesce("risk_level", F.lit("None"))
    counts = clauses.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                                     *[F.count_if(level == x).alias(x) for x in LEVELS])
    shares = F.array(*[F.struct(F.lit(x).alias("risk_level"), F.bround(100 * F.col(x) / F.col("n"), 0).alias("percent"))
                       for x in LEVELS])
    return counts.select(by, F.inline(shares))


def category_levels(clauses: DataFrame) -> DataFrame:
    """Non-zero counts per category and level, pivoted and unpivoted again."""
    wide = clauses.groupBy("classification").pivot("risk_level", LEVELS).count()
    return wide.unpivot("classification", LEVELS, "risk_level", "n").filter(F.col("n") > 0)


METRIC_FORMATS = ["clause_count", "risky_clause_count", "authenticity_score", "document_risk_score",
                  "contradiction_count", "entity_count", "relationship_count", "document_type", "processing_status"]


def metric_answers(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """One sentence per (question, document): joins questions on doc_id with one row of facts per document."""
    def plural(n, one, many):
        return F.concat(F.col(n).cast("string"), F.lit(" "), F.when(F.col(n) == 1, one).otherwise(many))

    def was(n):
        return F.when(F.col(n) == 1, " was").otherwise(" were")

    def scored(score, level, what, missing):
        return F.when(F.col(score).isNull(), missing).otherwise(F.concat(
            F.lit(f"The {what} is "), F.col(score).cast("string"), F.lit("/100 ("),
            F.coalesce(level, F.lit("Unknown")), F.lit(").")))
    text = {
        "clause_count": F.concat(F.lit("This document has "), plural("total_clauses", "clause", "clauses"), F.lit(".")),
        "risky_clause_count": F.concat(
            F.lit("This document has "), plural("risky_clauses", "risky clause", "risky clauses"), F.lit(" ("),
            F.col("high_clauses").cast("string"), F.lit(" High risk, "), F.col("medium_clauses").cast("string"),
            F.lit(" Medium risk).")),
        "authenticity_score": scored("authenticity_score", "authenticity_level", "authenticity score",
                                     "This document has not had an authenticity assessment yet."),
        "document_risk_score": scored("document_risk_score", "document_risk_level", "document risk score",
                                      "This document has not had a risk assessment yet."),
        "contradiction_count": F.concat(plural("total_contradictions", "contradiction", "contradictions"),
                                        was("total_contradictions"), F.lit(" found in this document.")),
        "entity_count": F.concat(plural("entity_count", "entity", "entities"), was("entity_count"),
                                 F.lit(" extracted from this document.")),
        "relationship_count": F.concat(plural("relationship_count", "relationship", "relationships"),
                                       was("relationship_count"), F.lit(" extracted from this document.")),
        "document_type": F.concat(F.lit("This document is classified as: "),
                                  F.coalesce("document_type", F.lit("Unknown Document")), F.lit(".")),
        "processing_status": F.concat(F.lit("This document's processing status is: "),
                                      F.coalesce("status", F.lit("unknown")), F.lit(".")),
    }
    answer = F.lit(None).cast("string")
    for metric in METRIC_FORMATS:
        answer = F.when(F.col("metric") == metric, text[metric]).otherwise(answer)
    return questions.filter(F.col("metric").isNotNull()).join(facts, "doc_id").withColumn("answer", answer)
