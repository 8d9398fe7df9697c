"""Registered classification queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import rules, rules_documents
from ..functions import patterns as P
from ..functions import text as X
from ..operators import classify as K
from .corpus import ansi_clauses, ansi_papers, clauses, papers, scratch, table
from .registry import contains_any, in_list, query, quoted, rx

CL = f"WITH c AS MATERIALIZED {ansi_clauses()} "
T = "text_content"


def kw_hits(keywords, low: str = "l") -> str:
    return " + ".join(f"CAST(contains({low}, {quoted(k)}) AND regexp_matches({low}, {rx(P.word(k))}) AS INT)"
                      for k in keywords)


def points(r: rules.ClauseRule, low: str = "l", head: str = "h") -> str:
    return (f"25 * CAST(regexp_matches({low}, {rx(r.regex)}) AS INT) + 10 * least({kw_hits(r.keywords, low)}, 5) "
            f"+ 15 * CAST(contains({head}, {quoted(r.category.lower())}) AS INT)")


def best_type_sql(source: str, text: str, keep: str, clause_rules: list | None = None) -> str:
    """keep columns plus clause_type and clause_points."""
    clause_rules = clause_rules or rules.CLAUSE_RULES
    cols = ", ".join(f"{points(r)} AS p{i}" for i, r in enumerate(clause_rules))
    names = [f"p{i}" for i in range(len(clause_rules))]
    top = f"greatest({', '.join(names)})"
    pick = " ".join(f"WHEN {n} = {top} THEN {quoted(r.category)}" for n, r in zip(names, clause_rules))
    return f"""SELECT {keep}, CASE WHEN {top} = 0 THEN 'General' {pick} END AS clause_type, {top} AS clause_points
 FROM (SELECT *, {cols} FROM (SELECT *, lower({text}) AS l,
   lower(trim(regexp_extract({text}, '^\\s*([^\\n]*)', 1))) AS h FROM {source}))"""


BOTH = f"concat(section_name, chr(10), {T})"
FIELD = f"(contains({T}, ':') AND length(trim(split_part({T}, ':', -1))) BETWEEN 1 AND 35)"
TYPED = best_type_sql("c", T, "*")
TYPED_BOTH = best_type_sql("c", BOTH, "*")
ACCEPTED_SQL = f"""SELECT *, CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN clause_type
   WHEN {FIELD} THEN 'Structured Field' END AS classification FROM ({TYPED})"""


def typed(spark, sf, both: bool = False):
    text = F.concat_ws("\n", "section_name", T) if both else F.col(T)
    return K.with_type_of_alike(clauses(spark, sf), text)


@query("label_keywords", "C1", CL + f"SELECT keyword, category, count(*) AS n_clauses FROM (" + " UNION ALL ".join(
    f"SELECT {quoted(k)} AS keyword, {quoted(r.category)} AS category FROM l WHERE contains(l, {quoted(k)}) AND regexp_matches(l, {rx(P.word(k))})"
    for r in rules.CLAUSE_RULES for k in r.keywords).replace("FROM l ", f"FROM (SELECT lower({T}) AS l FROM c) ")
    + ") GROUP BY 1, 2")
def label_keywords(spark, sf):
    rows = K.with_categories(clauses(spark, sf), F.col(T)).select(F.inline("_cats"))
    return rows.select("category", F.explode("keywords").alias("keyword")).groupBy("keyword", "category").agg(
        F.count(F.lit(1)).alias("n_clauses"))


@query("label_clause_type", "C2 C3 C4", CL + f"""
SELECT clause_id, clause_type, clause_points,
  CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN 'accepted' WHEN {FIELD} THEN 'recovered'
       ELSE 'rejected' END AS outcome,
  CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN NULL
       WHEN clause_type = 'General' THEN 'classified_general' ELSE 'below_min_confidence' END AS reason,
  CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN clause_type WHEN {FIELD} THEN 'Structured Field' END AS classification,
  CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN clause_points / 100.0 WHEN {FIELD} THEN 0.3 END AS confidence_score
FROM ({TYPED})""")
def label_clause_type(spark, sf):
    return K.accept_clauses(typed(spark, sf)).select("clause_id", "clause_type", "clause_points", "outcome", "reason",
                                                     "classification", "confidence_score")


def _kw_array(r, low="l"):
    items = ", ".join(f"CASE WHEN contains({low}, {quoted(k)}) AND regexp_matches({low}, {rx(P.word(k))}) THEN {quoted(k)} END" for k in r.keywords)
    return f"list_filter([{items}], lambda k: k IS NOT NULL)"


@query("label_multilabel", "C5 C6", CL + "SELECT clause_id, category, points, keywords, snippet, "
       "concat('Classified as ''', category, ''' because ', array_to_string(list_filter(["
       "CASE WHEN snippet <> '' THEN concat('regex matched \"', snippet, '\"') END, "
       "CASE WHEN n > 0 THEN concat(n, ' keyword(s) matched: ', keywords) END], lambda b: b IS NOT NULL), '; ')) AS reason, "
       "row_number() OVER (PARTITION BY clause_id ORDER BY points DESC, ordinal) AS place FROM (" + " UNION ALL ".join(
    f"SELECT clause_id, {quoted(r.category)} AS category, {i} AS ordinal, {points(r)} AS points, "
    f"array_to_string({_kw_array(r)}, ', ') AS keywords, len({_kw_array(r)}) AS n, regexp_extract(l, {rx(r.regex)}) AS snippet FROM d"
    for i, r in enumerate(rules.CLAUSE_RULES)).replace(
    "FROM d", f"FROM (SELECT clause_id, lower({T}) AS l, lower({T}) AS h FROM c)") + ") WHERE points >= 30")
def label_multilabel(spark, sf):
    rows = K.multilabel(clauses(spark, sf), F.col(T), ["clause_id"])
    place = F.row_number().over(Window.partitionBy("clause_id").orderBy(F.col("points").desc(), "ordinal"))
    return rows.select("clause_id", "category", "points", F.array_join("keywords", ", ").alias("keywords"), "snippet",
                       K.explain(F.col("keywords"), F.col("snippet"), F.col("category")).alias("reason"),
                       place.alias("place"))


def title_sql(kind: str, low: str, text: str) -> str:
    whens = " ".join(f"WHEN {kind} = {quoted(k)} AND {contains_any(low, list(ps))} THEN {quoted(t)}"
                     for k, topics in rules.TITLE_SUBTOPICS.items() for ps, t in topics)
    falls = " ".join(f"WHEN {kind} = {quoted(k)} THEN {quoted(t)}" for k, t in rules.FALLBACK_TITLES.items())
    words = f"regexp_extract_all(regexp_extract(trim({text}), '^((?:[^.;]|[.;]+[^.;\\s])*[.;]*)', 1), '[A-Za-z'']+')"
    strong = f"list_filter({words}, lambda w: NOT lower(w) IN {in_list(rules.TITLE_STOPWORDS)})"
    made = (f"array_to_string(list_transform((CASE WHEN len({strong}) > 0 THEN {strong} ELSE {words} END)[1:8], "
            f"lambda w: concat(upper(w[1:1]), lower(w[2:]))), ' ')")
    return f"CASE {whens} {falls} ELSE coalesce(nullif({made}, ''), 'General Provision') END"


@query("label_titles", "C8 C9", CL + f"""
SELECT clause_id, CASE WHEN n > 1 THEN concat(title, ' (', n, ')') ELSE title END AS clause_title FROM (
 SELECT clause_id, title, row_number() OVER (PARTITION BY doc_id, title ORDER BY clause_id) AS n FROM (
  SELECT doc_id, clause_id, {title_sql('clause_type', 'l', T)} AS title FROM (
   SELECT *, lower({T}) AS l FROM ({best_type_sql('c', T, 'doc_id, clause_id, ' + T)}))))""")
def label_titles(spark, sf):
    rows = K.once(typed(spark, sf), F.struct(K.clause_title(F.col("clause_type"), F.col(T)).alias("title")))
    from ..operators.segment import unique_titles
    return unique_titles(rows, "title", "clause_id", keys=clauses(spark, sf).select("doc_id")).select("clause_id", F.col("title").alias("clause_title"))


def type_counts_sql() -> str:
    cols = ", ".join("(" + " + ".join(f"len(regexp_extract_all(l, {rx(p, True)}))" for p in ps) + f") AS t{i}"
                     for i, ps in enumerate(rules_documents.TYPE_PATTERNS.values()))
    return (f"SELECT *, {cols} FROM (SELECT *, trim(regexp_replace(lower(full_text), '\\s+', ' ', 'g')) AS l FROM p)")


def doc_type_sql() -> str:
    kinds = list(rules_documents.TYPE_PATTERNS)
    items = ", ".join(f"{{'m': -t{i}, 'o': {i}, 'k': {quoted(k)}}}" for i, k in enumerate(kinds))
    return f"""SELECT *, CASE WHEN b >= 1 THEN k1 ELSE 'Unknown Document' END AS document_type,
  CASE WHEN b >= 1 AND s > 0 THEN k2 END AS runner_up, b AS type_score,
  CASE WHEN b >= 1 THEN round((b - s) / (b + s + 0.0) * (b / (b + 1.0)), 4) ELSE 0.0 END AS type_confidence
 FROM (SELECT *, -r[1].m AS b, -r[2].m AS s, r[1].k AS k1, r[2].k AS k2
       FROM (SELECT *, list_sort([{items}]) AS r FROM ({type_counts_sql()})))"""


PAPERS_TYPED = f"p AS {ansi_papers()}, pt AS ({doc_type_sql()})"


@query("label_document_type", "C11 C12", f"WITH {PAPERS_TYPED} "
       "SELECT doc_id, document_type, runner_up, type_score, type_confidence FROM pt")
def label_document_type(spark, sf):
    return K.document_type(papers(spark, sf), F.col("full_text")).select(
        "doc_id", "document_type", "runner_up", "type_score", "type_confidence")


@query("label_language", "C14", f"""
SELECT doc_id, CASE WHEN greatest(h0, h1, h2, h3) = 0 THEN 'unknown' WHEN h0 = greatest(h0, h1, h2, h3) THEN 'en'
  WHEN h1 = greatest(h0, h1, h2, h3) THEN 'fr' WHEN h2 = greatest(h0, h1, h2, h3) THEN 'de' ELSE 'es' END AS language, lang
FROM (SELECT doc_id, lang, {', '.join(f"len(list_filter(w, lambda t: t IN {in_list(ws)})) AS h{i}" for i, ws in enumerate(rules.LANGUAGE_PROFILES.values()))}
 FROM (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^a-z]+') AS w FROM documents))""")
def label_language(spark, sf):
    return K.language(table(spark, sf, "documents"), F.col("text")).select("doc_id", "language", "lang")


def _intent(text: str) -> str:
    items = ", ".join(f"CASE WHEN {kw_hits(r.keywords, text)} > 0 THEN {quoted(r.category)} END" for r in rules.CLAUSE_RULES)
    return f"array_to_string(list_filter([{items}], lambda c: c IS NOT NULL), '|')"


QUESTION = ("CASE c_custkey % 8 WHEN 0 THEN 'How many clauses are risky?' WHEN 1 THEN 'What is the notice period for termination?' "
            "WHEN 2 THEN 'Is liability capped or is there a late fee?' WHEN 3 THEN 'How authentic is it?' "
            "WHEN 4 THEN 'total clauses please' WHEN 5 THEN 'who must indemnify whom' WHEN 6 THEN 'Number of contradictions?' "
            "ELSE 'What kind of document is this?' END")
METRIC_SQL = "CASE " + " ".join(f"WHEN {contains_any('lower(trim(q))', list(ps))} THEN '{m}'"
                                for m, ps in rules.METRIC_PHRASES) + " END"


@query("label_questions", "C15 C16", f"""
SELECT c_custkey, {_intent('lower(q)')} AS intent_types, {METRIC_SQL} AS metric FROM (SELECT c_custkey, {QUESTION} AS q FROM customer)""")
def label_questions(spark, sf):
    q = table(spark, sf, "customer").withColumn("q", F.expr(QUESTION))
    return K.query_intent(q, F.col("q")).select("c_custkey", F.array_join("intent_types", "|").alias("intent_types"),
                                                K.metric_key(F.col("q")).alias("metric"))


_MONEY = f"len(regexp_extract_all({T}, {rx(P.MONEY, True)}, 0)) > 0"
IMPORTANCE_SQL = f"""SELECT *, greatest(0, least(100, CASE WHEN boiler THEN least(raw, 25) ELSE raw END)) AS importance_score FROM (
 SELECT *, CASE WHEN clause_type IN {in_list(rules.CRITICAL_TYPES)} THEN 80 WHEN clause_type IN {in_list(rules.IMPORTANT_TYPES)} THEN 55 ELSE 30 END
  + 8 * CAST(cash AS INT) + 12 * CAST(unlim AS INT) + 10 * CAST(pen AS INT) AS raw FROM (
  SELECT *, {_MONEY} AS cash, {contains_any('l2', rules.UNLIMITED_WORDS)} AS unlim, {contains_any('l2', rules.PENALTY_WORDS)} AS pen,
   clause_type = 'General' OR {contains_any('lower(section_name)', rules.BOILERPLATE_WORDS)} AS boiler
  FROM (SELECT *, lower({BOTH}) AS l2 FROM ({TYPED_BOTH}))))"""


def _impact(i: int) -> str:
    base = "CASE clause_type " + " ".join(f"WHEN {quoted(k)} THEN {v[i]}" for k, v in rules.IMPACT_BASE.items()) + \
        f" ELSE {rules.IMPACT_BASE['General'][i]} END"
    hard = contains_any(f"lower({T})", rules.IMPACT_ESCALATORS)
    nudge = [f"15 * CAST({hard} AS INT)", f"15 * CAST(cash AS INT) + 10 * CAST({hard} AS INT)",
             f"20 * CAST({contains_any(f'lower({T})', rules.BUSINESS_WORDS)} AS INT)",
             f"20 * CAST({contains_any(f'lower({T})', rules.REGULATION_WORDS)} AS INT)"][i]
    return f"greatest(0, least(100, {base} + {nudge}))"


INTEL_SQL = f"""SELECT *, CASE WHEN importance_score >= 75 THEN 'Critical' WHEN importance_score >= 40 THEN 'Important' ELSE 'Informational' END AS importance_category,
  {_impact(0)} AS legal_impact, {_impact(1)} AS financial_impact, {_impact(2)} AS business_impact, {_impact(3)} AS compliance_impact,
  clause_points / 100.0 AS confidence_score FROM ({IMPORTANCE_SQL})"""


def intelligence(spark, sf):
    """Importance, impact and identification confidence per clause."""
    rows = typed(spark, sf, both=True)
    rows = K.importance(rows, F.col("section_name"), F.col(T))
    return K.impact(rows, F.col(T)).withColumn("confidence_score", F.col("clause_points") / 100.0)


@query("label_importance", "C17", CL + f"""
SELECT clause_id, importance_score, importance_category, array_to_string(list_filter([concat('detected clause type ''', clause_type, ''''),
  CASE WHEN cash THEN 'contains monetary figures' END, CASE WHEN unlim THEN 'uses uncapped/unlimited exposure language' END,
  CASE WHEN pen THEN 'references penalties or liquidated damages' END,
  CASE WHEN boiler THEN 'heading suggests boilerplate/administrative content, capped low' END], lambda r: r IS NOT NULL), '; ') AS importance_reasons
FROM ({INTEL_SQL})""")
def label_importance(spark, sf):
    return intelligence(spark, sf).select("clause_id", "importance_score", "importance_category", "importance_reasons")


@query("label_clause_intelligence", "C18 Q12 Q13", CL + f"""
SELECT clause_id, legal_impact, financial_impact, business_impact, compliance_impact, confidence_score, importance_category,
 CASE WHEN compliance_impact >= 70 THEN 'Needs Review' WHEN compliance_impact >= 40 THEN 'Monitor' ELSE 'Compliant' END AS compliance_status,
 CASE WHEN m >= 70 THEN 'High' WHEN m >= 40 THEN 'Medium' ELSE 'Low' END AS impact_label,
 CASE WHEN confidence_score >= 0.7 THEN 'High-Confidence Match' WHEN confidence_score >= 0.4 THEN 'Moderate-Confidence Match'
      ELSE 'Low-Confidence Match' END AS confidence_tier
FROM (SELECT *, round_even((legal_impact + financial_impact + business_impact + compliance_impact) / 4.0, 0) AS m FROM ({INTEL_SQL}))""")
def label_clause_intelligence(spark, sf):
    from ..operators.report import display_buckets
    return display_buckets(intelligence(spark, sf)).select(
        "clause_id", "legal_impact", "financial_impact", "business_impact", "compliance_impact", "confidence_score",
        "importance_category", "compliance_status", "impact_label", "confidence_tier")


def _mods(ps):
    items = ", ".join(f"CASE WHEN contains(lower({T}), {quoted(p)}) THEN {quoted(p)} END" for p in ps)
    return f"array_to_string(list_filter([{items}], lambda p: p IS NOT NULL), '|')"


@query("label_modifiers", "C19", CL + f"SELECT clause_id, {_mods(rules.ESCALATORS)} AS escalators, {_mods(rules.MITIGATORS)} AS mitigators FROM c")
def label_modifiers(spark, sf):
    t = F.col(T)
    return clauses(spark, sf).select("clause_id", F.array_join(K.modifiers(t, rules.ESCALATORS), "|").alias("escalators"),
                                     F.array_join(K.modifiers(t, rules.MITIGATORS), "|").alias("mitigators"))


@query("label_parsing_quality", "C20", CL + f"""
SELECT o_orderkey AS doc_id, count(classification) AS n_clauses, CASE WHEN count(classification) < 3
  THEN 'Possible parsing issue or poor clause extraction.' END AS warning
FROM orders LEFT JOIN ({ACCEPTED_SQL}) a ON a.doc_id = o_orderkey GROUP BY 1""")
def label_parsing_quality(spark, sf):
    from ..operators.report import parsing_quality
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    found = K.accept_clauses(typed(spark, sf)).filter(F.col("classification").isNotNull())
    return parsing_quality(docs, found)


def _plain(expr: str) -> str:
    for k in sorted(rules.PLAIN_ENGLISH, key=len, reverse=True):
        expr = f"regexp_replace({expr}, {rx(k, True)}, {quoted(rules.PLAIN_ENGLISH[k])}, 'g')"
    return expr


@query("label_plain_english", "C21", CL + f"""
SELECT clause_id, {_plain(T)} AS plain, regexp_replace(replace(replace(replace(replace(replace({T}, '&', '&amp;'), '<', '&lt;'),
  '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), {rx('(' + '|'.join(rules.HIGHLIGHT_WORDS) + ')', True)},
  '<strong style="color:var(--lq-danger);">\\1</strong>', 'g') AS highlighted FROM c""")
def label_plain_english(spark, sf):
    from ..operators.report import highlight, plain_english
    return clauses(spark, sf).select("clause_id", plain_english(F.col(T)).alias("plain"),
                                     highlight(F.col(T)).alias("highlighted"))


#: A rule file of a user's own: other categories, other order.
OWN_RULES = [rules.ClauseRule("Handover", ("notice", "registered mail", "written notice"), r"within \d+ weeks|notice period"),
             rules.ClauseRule("Money", ("usd", "rs.", "late fee", "invoice"), r"shall pay|sum insured"),
             rules.ClauseRule("Law", ("governed by", "courts", "jurisdiction"), r"laws of the state"),
             rules.ClauseRule("Secrecy", ("confidential information",), r"shall not disclose")]


@query("label_by_rule_file", "S4 C2 C3", CL + f"SELECT clause_id, clause_type, clause_points FROM ({best_type_sql('c', T, '*', OWN_RULES)})")
def label_by_rule_file(spark, sf):
    """Clauses labelled by rules that were written to a file and read again."""
    path = scratch(spark, "rules")
    rules.save_clause_rules(spark, OWN_RULES, path)
    return K.with_clause_type(clauses(spark, sf), F.col(T), rules.load_clause_rules(spark, path + "/part-*")).select(
        "clause_id", "clause_type", "clause_points")
