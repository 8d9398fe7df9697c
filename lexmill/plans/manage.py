"""Registered maintenance, reporting, comparison, audit and text-preparation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import patterns as P
from ..operators import audit, compare, maintain, normalize, report, segment
from ..operators import classify as K
from ..session import cut_lineage
from .corpus import ansi_papers, clauses, papers, table
from .labels import ACCEPTED_SQL, BOTH, CL, FIELD, INTEL_SQL, TYPED, best_type_sql, intelligence, typed
from .registry import query, quoted, rx
from .scores import ROLL, stored_clauses, with_vectors

PP = f"WITH p AS {ansi_papers()} "
LEGAL = "coalesce(classification, '') <> 'Structured Field'"


@query("table_hashes", "S1 S2 Q1", "SELECT h AS hash, min(doc_id) AS doc_id, count(*) AS n_copies FROM (SELECT doc_id, md5(text) AS h FROM documents) GROUP BY 1")
def table_hashes(spark, sf):
    docs = maintain.content_hash(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.groupBy("hash").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


@query("table_new_uploads", "Q1", """WITH b AS (SELECT md5(text) AS hash, source AS owner, doc_id FROM documents), e AS (SELECT DISTINCT hash, owner FROM b WHERE doc_id % 3 = 0)
SELECT hash, owner, min(doc_id) AS doc_id FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.hash = b.hash AND e.owner = b.owner) GROUP BY 1, 2""")
def table_new_uploads(spark, sf):
    b = table(spark, sf, "documents").select(F.md5("text").alias("hash"), F.col("source").alias("owner"), "doc_id")
    return maintain.new_uploads(b, b.filter(F.col("doc_id") % 3 == 0), ["hash", "owner"], "doc_id").select("hash", "owner", "doc_id")


@query("table_pages", "S3 Q10", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, length(html) AS n_chars FROM pages WHERE contains(lower(url), 'a') ORDER BY 2, 1")
def table_pages(spark, sf):
    p = table(spark, sf, "pages").filter(F.lower("url").contains("a"))
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.length("html").alias("n_chars")).orderBy("host", "page_id")


@query("table_ids", "S5", "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders")
def table_ids(spark, sf):
    return maintain.with_ids(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("table_owner_listing", "Q2 Q3", PP + "SELECT doc_id, user_id, uploaded FROM p WHERE user_id = 3 ORDER BY uploaded DESC, doc_id")
def table_owner_listing(spark, sf):
    return papers(spark, sf).filter("user_id = 3").select("doc_id", "user_id", "uploaded").orderBy(F.col("uploaded").desc(), "doc_id")


@query("table_partial_update", "S8", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'updated' ELSE c_mktsegment END AS c_mktsegment,
  CASE WHEN c_custkey % 6 = 0 THEN 1.5 END AS score FROM customer""")
def table_partial_update(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    delta = c.filter("c_custkey % 3 = 0").select("c_custkey", F.lit("updated").alias("c_mktsegment"), F.when(F.col("c_custkey") % 6 == 0, 1.5).alias("score"))
    return maintain.update_known(c, delta, "c_custkey")


@query("table_replace", "S9", """SELECT o_custkey, o_orderkey, 'old' AS src FROM orders WHERE o_custkey % 4 <> 0 UNION ALL
 SELECT o_custkey, max(o_orderkey), 'new' FROM orders WHERE o_custkey % 8 = 0 GROUP BY 1""")
def table_replace(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    keys = o.filter("o_custkey % 4 = 0")
    fresh = o.filter("o_custkey % 8 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey")).withColumn("src", F.lit("new"))
    return maintain.replace_keys(o.withColumn("src", F.lit("old")), fresh, keys, "o_custkey")


@query("table_purge", "S10", """SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey % 7 <> 0 UNION ALL
 SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)""")
def table_purge(spark, sf):
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "doc_id").withColumn("user_id", F.col("o_custkey"))
    gone = maintain.owned_by(o, o.filter("o_custkey % 7 = 0"))
    left = maintain.purge({"orders": o, "lineitem": table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "doc_id")}, gone)
    out = None
    for name, df in left.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("table_rescore", "S11", ROLL + """SELECT clause_id, CASE WHEN part_no % 4 = 0 THEN 'High' ELSE risk_level END AS risk_level,
  CASE WHEN part_no % 4 = 0 THEN 99 ELSE risk_score END AS risk_score, CASE WHEN part_no % 4 <> 0 THEN 'kept' END AS dimension_breakdown FROM r""")
def table_rescore(spark, sf):
    rows = stored_clauses(spark, sf).select("clause_id", "part_no", "risk_level", "risk_score", F.lit("kept").alias("dimension_breakdown"))
    new = rows.filter("part_no % 4 = 0").select("clause_id", F.lit("High").alias("risk_level"), F.lit(99).cast("bigint").alias("risk_score"))
    return maintain.rescore(rows, new).drop("part_no")


@query("table_snapshot", "S13", """SELECT count(*) AS copy_count, count(*) AS live_count, true AS keys_filled, true AS all_passed FROM orders""")
def table_snapshot(spark, sf):
    live = table(spark, sf, "orders")
    return maintain.snapshot_checks(live, maintain.snapshot(live), ["o_orderkey", "o_custkey"])


@query("table_event_log", "S14", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def table_event_log(spark, sf):
    e = table(spark, sf, "events").withColumn("_k", F.struct("ts", "event_id"))
    return maintain.latest(e, "_k", 50).select("event_id", "event_type")


@query("table_intake", "S15", """SELECT page_id, CASE WHEN page_id % 4 = 3 THEN 'extension not allowed' WHEN length(html) > 2000 THEN 'file too large' END AS reason FROM pages""")
def table_intake(spark, sf):
    ext = F.element_at(F.array(F.lit(".pdf"), F.lit(".DOCX"), F.lit(".txt"), F.lit(".exe")), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, sf, "pages").select("page_id", F.concat(F.lit("/in/f"), "page_id", ext).alias("path"), F.length("html").alias("length"))
    return maintain.intake(files, [".pdf", ".docx", ".txt"], 2000).select("page_id", "reason")


@query("report_records", "S12")
def report_records(spark, sf):
    rows = stored_clauses(spark, sf)
    totals = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_clauses"))
    return maintain.tagged_records({"document_summary": totals, "clause": rows.select("clause_id", "classification", "risk_level")})


@query("report_issue_details", "Q7", ROLL + """, i AS (SELECT doc_id AS issue_id, min(clause_id) AS a, max(clause_id) AS b FROM r GROUP BY 1),
 x AS (SELECT issue_id, 0 AS pos, a AS clause_id FROM i UNION ALL SELECT issue_id, 1, b + CASE WHEN issue_id % 5 = 0 THEN 1 ELSE 0 END FROM i)
SELECT issue_id, pos, x.clause_id, coalesce(section_name, '') AS section_name, CASE WHEN pos = 0 THEN 'v' END AS "value" FROM x LEFT JOIN r ON r.clause_id = x.clause_id""")
def report_issue_details(spark, sf):
    rows = stored_clauses(spark, sf)
    i = rows.groupBy(F.col("doc_id").alias("issue_id")).agg(F.min("clause_id").alias("clause_id_1"), F.max("clause_id").alias("m"))
    i = i.withColumn("clause_id_2", F.col("m") + F.when(F.col("issue_id") % 5 == 0, 1).otherwise(0)).withColumn(
        "clause_ids", F.when(F.col("issue_id") % 2 == 0, F.array("clause_id_1", "clause_id_2"))).withColumn(
        "clause_values", F.when(F.col("clause_id_1") == F.col("clause_id_2"), F.create_map(F.lit("x"), F.lit("y"))).otherwise(
            F.create_map(F.col("clause_id_1").cast("string"), F.lit("v"))))
    i = i.withColumn("clause_values", F.create_map(F.col("clause_id_1").cast("string"), F.lit("v")))
    out = maintain.issue_details(i, rows)
    return out.select("issue_id", "pos", "clause_id", "section_name", F.when(F.col("pos") == 0, F.col("value")).alias("value"))


@query("report_clause_search", "Q4 Q8", CL + f"""SELECT clause_id FROM ({INTEL_SQL}) WHERE clause_type = 'Liability' AND importance_score >= 75
  AND (contains(lower(section_name), 'liability') OR contains(lower(text_content), 'liability')) ORDER BY clause_id""")
def report_clause_search(spark, sf):
    rows = intelligence(spark, sf).withColumnRenamed("clause_type", "classification")
    return report.search_clauses(rows, classification="Liability", importance="Critical", text="LIABILITY").select("clause_id").orderBy("clause_id")


@query("report_flagged", "Q9 Q11", ROLL + f"SELECT coalesce(classification, 'Uncategorized') AS category, risk_level, count(*) AS n FROM r WHERE risk_level IN ('High', 'Medium') AND {LEGAL} GROUP BY 1, 2")
def report_flagged(spark, sf):
    rows = report.legal_only(stored_clauses(spark, sf)).withColumn("risk_category", F.col("classification"))
    return report.flagged(report.field_defaults(rows)).groupBy("category", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query("report_document_metrics", "B1", ROLL + f""", m AS (SELECT doc_id, count(*) AS total_clauses, count(*) FILTER (WHERE risk_level IN ('High', 'Medium')) AS risky_clauses,
  {', '.join(f"count(*) FILTER (WHERE coalesce(risk_level, 'None') = '{x}') AS {x.lower()}_clauses" for x in report.LEVELS)} FROM r WHERE {LEGAL} GROUP BY 1),
 d AS (SELECT doc_id, count(*) AS n FROM r WHERE kind = 2 GROUP BY 1)
SELECT o_orderkey AS doc_id, CAST(o_custkey % 2 = 0 AS INT) AS total_documents, {', '.join(f"CASE WHEN o_custkey % 2 = 0 THEN coalesce({x}, 0) ELSE 0 END AS {y}" for x, y in
  [('total_clauses', 'total_clauses'), ('risky_clauses', 'risky_clauses'), ('n', 'total_contradictions')] + [(f'{x.lower()}_clauses',) * 2 for x in report.LEVELS])}
FROM orders LEFT JOIN m ON m.doc_id = o_orderkey LEFT JOIN d ON d.doc_id = o_orderkey""")
def report_document_metrics(spark, sf):
    rows = stored_clauses(spark, sf)
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 2).alias("user_id"))
    return report.document_metrics(docs, rows, rows.filter("kind = 2").select("doc_id"), user=0)


@query("report_level_percentages", "B3", ROLL + f"""SELECT doc_id, lv AS risk_level, round_even(100.0 * n / t, 0) AS percent FROM (
 SELECT doc_id, unnest(['High', 'Medium', 'Low', 'None']) AS lv, unnest([{', '.join(f"count(*) FILTER (WHERE coalesce(risk_level, 'None') = '{x}')" for x in report.LEVELS)}]) AS n, count(*) AS t FROM r GROUP BY doc_id)""")
def report_level_percentages(spark, sf):
    return report.level_percentages(stored_clauses(spark, sf))


@query("report_category_levels", "B4 B5", ROLL + "SELECT classification, risk_level, count(*) AS n FROM r WHERE risk_level IS NOT NULL GROUP BY 1, 2")
def report_category_levels(spark, sf):
    return report.category_levels(stored_clauses(spark, sf))


@query("report_metric_answers", "V6 B2")
def report_metric_answers(spark, sf):
    rows = stored_clauses(spark, sf)
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("user_id"))
    facts = report.document_metrics(docs, rows, rows.filter("kind = 2").select("doc_id"))
    facts = facts.select("*", (F.col("doc_id") % 3).alias("entity_count"), (F.col("doc_id") % 2).alias("relationship_count"),
                         F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 101).alias("authenticity_score"), F.lit("Suspicious").alias("authenticity_level"),
                         (F.col("doc_id") % 99).alias("document_risk_score"), F.lit(None).cast("string").alias("document_risk_level"),
                         F.lit("Loan Agreement").alias("document_type"), F.lit("processing").alias("status"))
    keys = [m for m, _ in rules.METRIC_PHRASES]
    asked = docs.select("doc_id", F.element_at(F.array(*[F.lit(k) for k in keys]), (F.col("doc_id") % len(keys) + 1).cast("int")).alias("metric"))
    return report.metric_answers(asked, facts).select("doc_id", "metric", "answer")


def doc_pairs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return o.select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderkey").alias("doc_a"), (F.col("o_orderkey") + 1).alias("doc_b"))


@query("compare_changes", "J14 J15 J16 J17")
def compare_changes(spark, sf):
    rows = with_vectors(stored_clauses(spark, sf), spark, sf).select("doc_id", "clause_id", "section_name", "text_content", "embedding")
    return compare.summary(compare.changes(doc_pairs(spark, sf), rows))


_KEYED = ROLL + """, k AS (SELECT *, coalesce(nullif(regexp_extract(section_name, '(?i)\\b(?:Section|Clause|Article|Paragraph)\\s+(\\d+(?:\\.\\d+)*)\\b', 1), ''),
   nullif(regexp_extract(substr(text_content, 1, 200), '(?i)\\b(?:Section|Clause|Article|Paragraph)\\s+(\\d+(?:\\.\\d+)*)\\b', 1), ''),
   nullif(regexp_extract(section_name, '^\\s*(\\d+(?:\\.\\d+)*)\\s*[\\.\\):]?\\s*', 1), '')) AS number FROM r),
 pr AS (SELECT o_orderkey AS pair_id FROM orders),
 a AS (SELECT pair_id, number, clause_id, row_number() OVER (PARTITION BY pair_id, number ORDER BY clause_id) AS t FROM pr JOIN k ON doc_id = pair_id WHERE number IS NOT NULL),
 b AS (SELECT pair_id, number, clause_id, row_number() OVER (PARTITION BY pair_id, number ORDER BY clause_id) AS t FROM pr JOIN k ON doc_id = pair_id + 1 WHERE number IS NOT NULL) """


@query("compare_numbered", "J14", _KEYED + "SELECT a.pair_id, a.clause_id AS a_id, b.clause_id AS b_id FROM a JOIN b ON a.pair_id = b.pair_id AND a.number = b.number AND a.t = b.t")
def compare_numbered(spark, sf):
    p, rows = doc_pairs(spark, sf), stored_clauses(spark, sf)
    return compare._in_turn(compare.sided(p, rows, "a").filter("number is not null"), compare.sided(p, rows, "b").filter("number is not null"), "number")


@query("compare_mutual_best", "J16", """WITH RECURSIVE x AS (SELECT DISTINCT l_orderkey AS pair_id, l_partkey AS a_id, l_suppkey AS b_id, ((l_partkey * 31 + l_suppkey * 17) % 1000) / 1000.0 AS score FROM lineitem),
 s AS (SELECT * FROM x WHERE score >= 0.55)
SELECT s.pair_id, a_id, b_id, score FROM s WHERE row(-score, a_id, b_id) = (SELECT min(row(-y.score, y.a_id, y.b_id)) FROM s y WHERE y.pair_id = s.pair_id AND (y.a_id = s.a_id OR y.b_id = s.b_id))""")
def compare_mutual_best(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_partkey").alias("a_id"), F.col("l_suppkey").alias("b_id"), (
        ((F.col("l_partkey") * 31 + F.col("l_suppkey") * 17) % 1000) / 1000.0).alias("score")).distinct()
    return compare.mutual_best(s)


@query("compare_lines", "J18")
def compare_lines(spark, sf):
    p, rows = doc_pairs(spark, sf), stored_clauses(spark, sf).withColumn("text_content", F.regexp_replace("text_content", r"\. ", ".\n"))
    keys = [cut_lineage(compare.sided(p, rows, side).select("pair_id", "clause_id", "number", "title")) for side in "ab"]
    texts = [p.select("pair_id", F.col(f"doc_{side}").alias("doc_id")).join(rows, "doc_id") for side in "ab"]
    return compare.line_changes(cut_lineage(compare.key_matches(*keys)), *texts)


@query("compare_side_by_side", "J19", ROLL + """, l AS (SELECT doc_id, classification, arg_max(text_content, clause_id) AS t FROM r GROUP BY 1, 2),
 pr AS (SELECT o_orderkey AS pair_id FROM orders),
 a AS (SELECT pair_id, classification, t FROM pr JOIN l ON doc_id = pair_id), b AS (SELECT pair_id, classification, t FROM pr JOIN l ON doc_id = pair_id + 1)
SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.classification, b.classification) AS classification, coalesce(a.t, '*(Clause not present in Agreement A)*') AS text_a,
  coalesce(b.t, '*(Clause not present in Agreement B)*') AS text_b FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.classification = b.classification""")
def compare_side_by_side(spark, sf):
    return compare.side_by_side(doc_pairs(spark, sf), stored_clauses(spark, sf))


FUNNEL = f"""SELECT *, CASE WHEN clause_type <> 'General' AND clause_points >= 30 THEN 'accepted' WHEN {FIELD} THEN 'recovered'
  WHEN clause_type = 'General' THEN 'classified_general' ELSE 'below_min_confidence' END AS o FROM ({TYPED})"""


@query("audit_funnel", "D1", CL + f""", f AS ({FUNNEL}), g AS (SELECT *, CASE WHEN length(text_content) < 15 THEN 'too_short'
   WHEN clause_id > min(clause_id) OVER (PARTITION BY supp_no, text_content) THEN 'duplicate_raw_block' ELSE o END AS w FROM f)
SELECT supp_no AS doc_id, count(*) AS n_raw_blocks, {', '.join(f"count(*) FILTER (WHERE w = '{k}') AS {k}" for k in ["accepted", "recovered", "too_short", "duplicate_raw_block", "classified_general", "below_min_confidence"])},
 CASE WHEN count(*) > count(*) FILTER (WHERE w = 'accepted') THEN round(count(*) FILTER (WHERE w = 'recovered') / (count(*) - count(*) FILTER (WHERE w = 'accepted') + 0.0), 4) ELSE 0.0 END AS recovery_rate
FROM g GROUP BY 1""")
def audit_funnel(spark, sf):
    rows = K.accept_clauses(typed(spark, sf)).select(F.col("supp_no").alias("doc_id"), F.col("clause_id").alias("pos"), F.col("text_content").alias("block"),
                                                     "outcome", "reason")
    return audit.funnel(rows)


@query("audit_rule_change", "D6", CL + f""", f AS ({FUNNEL}), af AS (SELECT doc_id, text_content AS text, arg_max(CASE WHEN o = 'accepted' THEN clause_type ELSE 'Structured Field' END, clause_id) AS t
   FROM f WHERE o IN ('accepted', 'recovered') GROUP BY 1, 2),
 be AS (SELECT doc_id, text_content AS text, arg_max(clause_type, clause_id) AS t FROM f WHERE o = 'accepted' AND part_no % 9 <> 0 GROUP BY 1, 2)
SELECT coalesce(af.doc_id, be.doc_id) AS doc_id, count(*) FILTER (WHERE be.t IS NULL) AS recovered, count(*) FILTER (WHERE af.t IS NULL) AS dropped,
 count(*) FILTER (WHERE af.t <> be.t) AS reclassified FROM be FULL JOIN af ON af.doc_id = be.doc_id AND af.text = be.text GROUP BY 1""")
def audit_rule_change(spark, sf):
    """Acceptance with field rescue against acceptance without it (and without every ninth part)."""
    rows = K.accept_clauses(typed(spark, sf)).filter("classification is not null").select(
        "doc_id", F.col("text_content").alias("text"), F.col("classification").alias("clause_type"), F.col("clause_id").alias("ord"),
        F.expr("outcome = 'accepted' and part_no % 9 <> 0").alias("kept"))
    changes = audit.set_changes_of(rows, F.col("kept"), F.lit(True))
    return audit.set_summary(changes, ["Structured Field"]).select("doc_id", "recovered", "dropped", "reclassified")


_HITS = " UNION ALL ".join(f"SELECT {quoted(k)} AS keyword, {quoted(r.category)} AS category, count(*) AS n_text, "
                           f"count(*) FILTER (WHERE regexp_matches(l, {rx(P.word(k))})) AS n_word FROM d WHERE contains(l, {quoted(k)})"
                           for r in rules.CLAUSE_RULES for k in r.keywords)


@query("audit_keyword_hits", "D7", CL + f", d AS MATERIALIZED (SELECT lower(text_content) AS l FROM c) SELECT * FROM ({_HITS}) WHERE n_text > 0")
def audit_keyword_hits(spark, sf):
    return audit.keyword_hits(clauses(spark, sf), "text_content", rules.CLAUSE_RULES)


@query("audit_score_change", "D8", ROLL + """SELECT doc_id, count(*) AS n_clauses, max(a - b) AS max_increase, min(a - b) AS max_decrease, round(avg(b), 6) AS mean_before, round(avg(a), 6) AS mean_after
FROM (SELECT doc_id, part_no % 101 + 0.0 AS b, supp_no % 97 + 0.0 AS a FROM r) GROUP BY 1""")
def audit_score_change(spark, sf):
    rows = stored_clauses(spark, sf)
    out = audit.score_changes(rows.select("doc_id", "clause_id", (F.col("part_no") % 101).cast("double").alias("lrsi")),
                              rows.select("doc_id", "clause_id", (F.col("supp_no") % 97).cast("double").alias("lrsi")))
    return out.select("doc_id", "n_clauses", "max_increase", "max_decrease", F.round("mean_before", 6).alias("mean_before"), F.round("mean_after", 6).alias("mean_after"))


@query("text_cache_split", "N1", """WITH t AS (SELECT doc_id, text, sha256(concat('en', 'hi', text)) AS k FROM documents), h AS (SELECT DISTINCT k FROM t WHERE doc_id % 4 = 0)
SELECT count(*) FILTER (WHERE h.k IS NOT NULL) AS hits, count(DISTINCT t.k) FILTER (WHERE h.k IS NULL AND trim(text) <> '') AS misses FROM t LEFT JOIN h ON h.k = t.k""")
def text_cache_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    cache = docs.filter("doc_id % 4 = 0").select(normalize.cache_key("en", "hi", F.col("text")).alias("key"), F.upper("text").alias("translated")).dropDuplicates(["key"])
    out, misses = normalize.cache_split(docs, cache)
    n = misses.agg(F.count(F.lit(1))).scalar()
    return out.agg(F.count("translated").alias("hits")).select("hits", n.alias("misses"))


@query("text_masking", "N2")
def text_masking(spark, sf):
    rows = normalize.mask(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.md5("masked").alias("masked_hash"), F.size("placeholders").alias("n_masked"))


def punctuation_sql(text: str) -> str:
    for old, new in normalize.PUNCTUATION:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    for pattern, new in normalize.PUNCTUATION_PATTERNS:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(new.replace('$', chr(92)))}, 'g')"
    return f"trim({text}, ' ')"


#: Texts with the marks that documents seldom hold put between their words, by document number.
MARKS = ["\u00a0?", "\u00a0«\u00a0", "\u00a0»", "nº\u00a0", "5\u00a0%", "3\u00a0ºC", "2\u00a0cm", "1\u00a01", ",\u00a0", "“(x)”", " ;", "\u00a0!", "…"]
_MARKS = "[" + ", ".join(quoted(m) for m in MARKS) + "]"


#: Ten digits from the zero of each script; of two scripts only a part is mapped, the rest stays.
_SCRIPTS = {0x0966: "0123456789", 0x09E6: "0123456789", 0x0A66: "0123456789", 0x0AE6: "0123456789", 0x0B66: "0123456789", 0x0CE6: "0123456789",
            0x06F0: "0123456789", 0x1C50: "0123456789", 0xABF0: "0123456789", 0x0660: "0", 0x0C66: "123456789"}
_ALL_DIGITS = "".join(chr(zero + d) for zero in _SCRIPTS for d in range(10))
_MAPPED = {chr(zero + int(d)): d for zero, digits in _SCRIPTS.items() for d in digits}
#: The table goes on with its first digits, so that a window at its end is as long as any other.
_DIGIT_RING = _ALL_DIGITS + _ALL_DIGITS[:8]


@query("text_punctuation", "N3 N4", f"""SELECT doc_id, {punctuation_sql('t')} AS clean, translate(digits, {quoted("".join(_MAPPED))},
  {quoted("".join(_MAPPED.values()))}) AS digits FROM (SELECT doc_id, concat(text, {_MARKS}[1 + doc_id % {len(MARKS)}], text) AS t,
  {quoted(_DIGIT_RING)}[1 + doc_id % 110 : 9 + doc_id % 110] AS digits FROM documents)""")
def text_punctuation(spark, sf):
    mark = F.element_at(F.array(*map(F.lit, MARKS)), (F.pmod("doc_id", F.lit(len(MARKS))) + 1).cast("int"))
    digits = F.substring(F.lit(_DIGIT_RING), (F.pmod("doc_id", F.lit(110)) + 1).cast("int"), F.lit(9))
    return table(spark, sf, "documents").select("doc_id", normalize.punctuation(F.concat("text", mark, "text")).alias("clean"),
                                                normalize.roman_digits(digits).alias("digits"))


@query("text_token_groups", "N5", """SELECT doc_id, CASE WHEN len(ws) > 256 THEN len(ws) // 256 + 1 ELSE 1 END AS n_groups,
 md5(array_to_string(ws, ' ')) AS rejoined FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM documents)""")
def text_token_groups(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"))
    parts = normalize.token_groups(docs, "text")
    back = normalize.regroup(parts, "doc_id").withColumnRenamed("text", "again")
    n = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_groups"))
    return n.join(back, "doc_id").select("doc_id", "n_groups", F.md5(F.trim("again")).alias("rejoined"))
