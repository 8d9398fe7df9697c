"""Registered segmentation and conflict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import patterns as P
from ..functions import text as X
from ..operators import classify as K
from ..operators import pairs, segment
from ..session import cut_lineage
from .corpus import ansi_clauses, ansi_papers, clauses, papers, table
from .facts import _ob, all_of
from .registry import bag_sql, contains_any, in_list, query, rx, shared_sql, words_sql
from .scores import ROLL, stored_clauses, with_vectors

PP = f"WITH p AS {ansi_papers()} "
T = "text_content"


def heading_sql(line: str) -> str:
    words = f"list_filter(regexp_split_to_array(trim({line}), '\\s+'), lambda w: w <> '')"
    core = "replace(regexp_replace(w, '^[:\\-]+|[:\\-]+$', '', 'g'), '''', '')"
    fits = (f"list_aggregate(list_transform({words}, lambda w: CAST(regexp_full_match({core}, '[A-Za-z]+') AND "
            f"(lower({core}) IN {in_list(rules.HEADING_CONNECTORS)} OR regexp_matches({core}, '^[A-Z]')) AS INT)), 'min') = 1")
    titled = (f"(len({words}) BETWEEN 2 AND 8 AND NOT regexp_matches({line}, '[.,;]$') AND regexp_matches({words}[1], '^[A-Z]') "
              f"AND regexp_matches({words}[-1], '^[A-Z]') AND {fits})")
    return (f"(length({line}) < 80 AND (regexp_matches({line}, {rx(P.HEADING_NUMBERED, True)}) OR regexp_matches({line}, {rx(P.HEADING_ROMAN, True)}) "
            f"OR regexp_matches({line}, {rx(P.HEADING_CAPS)}) OR regexp_matches({line}, {rx(P.HEADING_TITLE)}) OR coalesce({titled}, false)))")


@query("cut_headings", "G1", PP + f"SELECT line, {heading_sql('line')} AS heading, count(*) AS n FROM (SELECT trim(unnest(string_split(full_text, chr(10)))) AS line FROM p) GROUP BY 1, 2")
def cut_headings(spark, sf):
    lines = papers(spark, sf).select(F.explode(F.transform(F.split("full_text", "\n"), X.strip)).alias("line"))
    return K.once(lines, F.struct(X.is_heading(F.col("line")).alias("heading"))).groupBy("line", "heading").agg(F.count(F.lit(1)).alias("n"))


SECTIONS_SQL = f"""SELECT doc_id, sec, coalesce(max(line) FILTER (WHERE h = 1), 'Preamble') AS section_name,
   string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE h = 0) AS text_content
 FROM (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM (
   SELECT doc_id, pos, line, CAST({heading_sql('line')} AS INT) AS h FROM (
     SELECT doc_id, unnest(range(len(ls))) AS pos, trim(unnest(ls)) AS line FROM (SELECT doc_id, string_split(full_text, chr(10)) AS ls FROM p)) WHERE line <> ''))
 GROUP BY doc_id, sec HAVING count(*) FILTER (WHERE h = 0) > 0"""


@query("cut_sections", "G2", PP + f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS section_no, section_name, text_content FROM ({SECTIONS_SQL})")
def cut_sections(spark, sf):
    out = segment.sections(papers(spark, sf).select("doc_id", "full_text"), "full_text")
    return out.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), "section_name", "text_content")


@query("cut_page_sections", "G2 S3", PP.replace("WITH p AS", "WITH p0 AS") + f""", p AS (SELECT * FROM p0)
SELECT doc_id, section_name, text_content FROM ({SECTIONS_SQL})""")
def cut_page_sections(spark, sf):
    """Each line of a paper is a page here, so sections run across pages."""
    pages = papers(spark, sf).select("doc_id", F.posexplode(F.split("full_text", "\n")).alias("page_number", "raw_text"))
    return segment.sections_from_pages(pages).select("doc_id", "section_name", "text_content")


@query("cut_sections_or_chunks", "G3 G4")
def cut_sections_or_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("full_text"))
    return segment.sections_or_chunks(docs, "full_text").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sections"), F.max(F.length("text_content")).alias("longest"))


@query("cut_fixed_windows", "G4", """SELECT doc_id, CAST(s / 850 AS BIGINT) AS chunk_index, substr(text, CAST(s + 1 AS BIGINT), 1000) AS chunk
FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 151, 0) + 1, 850)) AS s FROM documents)""")
def cut_fixed_windows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = segment.fixed_windows(docs, "text")
    return out.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk")


@query("cut_bounded_sections", "G5 D2")
def cut_bounded_sections(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("section_name"),
                                                F.col("text").alias("text_content"))
    parts = segment.bound_sections(docs)
    return parts.filter(F.col("chunk_index").isNotNull()).groupBy("doc_id", "parent_section_name").agg(F.count(F.lit(1)).alias("n_parts"))


@query("cut_table_rows", "G6 G8", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, t AS sentence FROM (
 SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN concat_ws('; ', a, b) WHEN a = '' THEN concat('Qty: ', b, '.') ELSE concat('Part: ', a, '. Qty: ', b, '.') END AS t FROM (
  SELECT *, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END AS a0, concat(CAST(l_quantity AS BIGINT), ' boxes') AS b,
   nullif(CASE WHEN l_partkey % 5 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '-' END) AS a FROM lineitem)) WHERE length(t) >= 8""")
def cut_table_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    header = F.when(F.col("l_linenumber") % 3 == 0, F.array(F.lit(None).cast("string"), F.lit(" "))).otherwise(
        F.array(F.lit("Part(cid:12)"), F.lit("Qty")))
    cells = F.array(F.when(F.col("l_partkey") % 5 == 0, "").otherwise(F.col("l_partkey").cast("string")),
                    F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(" (cid:3)(cid:4)boxes")))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                     segment.table_sentence(header, cells).alias("sentence")).filter(F.col("sentence").isNotNull())


@query("cut_word_lines", "G7")
def cut_word_lines(spark, sf):
    li = table(spark, sf, "lineitem")
    words = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page_number"),
                      F.concat(F.lit("w"), "l_partkey").alias("text"), F.col("l_quantity").alias("x0"),
                      (F.col("l_extendedprice") % 40).alias("top"))
    return segment.lines_from_words(words, ["doc_id", "page_number"])


@query("cut_blocks", "G10 G11 G12 G13 G15", """SELECT doc_id, block_no, block, start_position, start_position + length(block) AS end_position FROM (
 SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block_no, greatest(instr(text, block) - 1, 0) AS start_position FROM (
  SELECT doc_id, text, block, min(pos) AS pos FROM (SELECT doc_id, text, unnest(range(len(bs))) AS pos, trim(unnest(bs)) AS block FROM (
    SELECT doc_id, text, string_split(text, chr(10)) AS bs FROM (SELECT doc_id, replace(full_text, chr(10), concat(chr(10), chr(10))) AS text, 1 FROM (
      """ + "SELECT * FROM " + ansi_papers() + """)))) WHERE length(block) >= 15 GROUP BY 1, 2, 3))""")
def cut_blocks(spark, sf):
    docs = papers(spark, sf).select("doc_id", F.replace("full_text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    out = segment.offsets(segment.candidate_blocks(docs, "text"), "text", "block")
    return out.select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), "block", "start_position", "end_position")


@query("cut_clauses", "C7 C9 G13 G14 J1 J22 Q11")
def cut_clauses(spark, sf):
    docs = papers(spark, sf).select("doc_id", F.replace("full_text", F.lit("\n"), F.lit("\n\n")).alias("full_text"))
    return segment.identify_clauses(docs).select("doc_id", "slot_no", "clause_title", "classification", "confidence_score",
                                                 "text_content", "start_position", "end_position")


@query("cut_document_text", "G9", f"""WITH c AS {ansi_clauses()}, o AS (SELECT doc_id, clause_id, page_num, text_content,
   coalesce(sum(length(text_content) + 2) OVER (PARTITION BY doc_id ORDER BY clause_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM c),
 m AS (SELECT doc_id, page_num, CAST(min(place) AS BIGINT) AS place FROM o GROUP BY 1, 2)
SELECT d.doc_id, full_text, pages FROM (SELECT doc_id, string_agg(text_content, chr(10) || chr(10) ORDER BY clause_id) AS full_text FROM c GROUP BY 1) d
 JOIN (SELECT doc_id, string_agg(concat(page_num, ':', place), ',' ORDER BY page_num) AS pages FROM m GROUP BY 1) p ON p.doc_id = d.doc_id""")
def cut_document_text(spark, sf):
    rows = segment.document_text(clauses(spark, sf), "clause_id", T)
    pages = F.array_join(F.transform("page_map", lambda m: F.concat_ws(":", m["page"].cast("string"), m["offset"].cast("string"))), ",")
    return rows.select("doc_id", "full_text", pages.alias("pages"))


@query("cut_page_of_clause", "G14", PP + """SELECT doc_id, needle, list_position(list_transform(ls, lambda l: contains(lower(l), lower(needle))), true) AS page_num
FROM (SELECT doc_id, string_split(full_text, chr(10)) AS ls, concat('Signed', CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS needle FROM p)""")
def cut_page_of_clause(spark, sf):
    df = papers(spark, sf).withColumn("needle", F.concat(F.lit("Signed"), F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")))
    pages = F.transform(F.split("full_text", "\n"), lambda t, i: F.struct((i + 1).alias("page_number"), t.alias("raw_text")))
    return df.select("doc_id", "needle", segment.page_of(pages, F.col("needle")).alias("page_num"))


@query("cut_sentence_chunks", "G16 G17")
def cut_sentence_chunks(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text"))
    chunks = segment.sentence_chunks(docs, "text", 1200)
    return segment.half_splits(chunks, "chunk", 600).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_parts"), F.max(F.length("chunk")).alias("longest"))


@query("cut_budget", "G18", """SELECT doc_id, CASE WHEN length(text) <= b THEN text ELSE concat(substr(text, 1, b),
  chr(10), chr(10), '[...input truncated: exceeded the model''s per-minute token budget...]') END AS fitted
FROM (SELECT doc_id, text, greatest(CAST(floor((3452 - floor(n_chars % 12000 / 3.5)) * 3.5) AS BIGINT), 500) AS b FROM documents)""")
def cut_budget(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", segment.fit_budget(F.col("text"), F.col("n_chars") % 12000).alias("fitted"))


@query("cut_bullets", "G19", f"""WITH c AS {ansi_clauses()} SELECT clause_id, array_to_string(list_filter(list_transform(
  regexp_split_to_array(replace(replace({T}, '. ', concat('.', chr(1))), '; ', concat(';', chr(1))), chr(1)), lambda s: trim(s)), lambda s: length(s) > 3)[1:6], '|') AS bullets FROM c""")
def cut_bullets(spark, sf):
    return clauses(spark, sf).select("clause_id", F.array_join(segment.bullets(F.col(T)), "|").alias("bullets"))


@query("cut_title_backfill", "C10")
def cut_title_backfill(spark, sf):
    rows = stored_clauses(spark, sf).withColumn("section_name", F.when(F.col("part_no") % 2 == 0, F.col("classification")).otherwise(
        F.col("section_name")))
    return segment.backfill_titles(rows).select("clause_id", "section_name")


LN = f"regexp_extract_all({T}, {rx(P.LABELLED_NUMBER, True)}, 0)"
LNX = rx(P.LABELLED_NUMBER, True)


@query("conflict_numeric", "J2 J4", f"""WITH c AS {ansi_clauses()}, v AS (SELECT doc_id, clause_id, label, array_to_string(list_sort(list(DISTINCT val)), ', ') AS val FROM (
  SELECT doc_id, clause_id, lower(trim(regexp_extract(m, {LNX}, 1))) AS label, trim(regexp_extract(m, {LNX}, 2)) AS val
  FROM (SELECT doc_id, clause_id, unnest({LN}) AS m FROM c)) GROUP BY 1, 2, 3)
SELECT DISTINCT a.doc_id, a.clause_id, concat('numeric:', a.label) AS topic, a.val AS "value" FROM v a JOIN v b
 ON a.doc_id = b.doc_id AND a.label = b.label AND a.val <> b.val""")
def conflict_numeric(spark, sf):
    return pairs.value_conflicts(clauses(spark, sf), ["Numeric Conflict"]).select("doc_id", "clause_id", "topic", "value")


def _values(pattern, gate):
    return f"""SELECT doc_id, clause_id, list_sort(list_distinct(xs)) AS xs FROM (SELECT doc_id, clause_id, {pattern} AS xs
  FROM c WHERE {contains_any(f'lower({T})', gate)}) WHERE len(xs) > 0"""


_DURS = (f"list_transform(regexp_extract_all({T}, {rx(P.DURATION, True)}, 0), lambda m: lower(m))")


@query("conflict_values", "J5 J6 J7", f"""WITH c AS {ansi_clauses()},
 pay AS ({_values(f"regexp_extract_all({T}, {rx(P.MONEY, True)}, 0)", rules.PAYMENT_WORDS)}),
 jur AS ({_values(f"list_transform(regexp_extract_all(lower({T}), {rx(P.STATE)}, 1), lambda s: trim(s))", rules.JURISDICTION_WORDS)}),
 dur AS ({_values(_DURS, rules.TEMPORAL_WORDS)})
SELECT DISTINCT a.doc_id, a.clause_id, 'Payment Conflict' AS contradiction_type FROM pay a JOIN pay b ON a.doc_id = b.doc_id AND a.xs <> b.xs
UNION ALL SELECT DISTINCT a.doc_id, a.clause_id, 'Conflicting Jurisdiction' FROM jur a JOIN jur b ON a.doc_id = b.doc_id AND a.xs <> b.xs
UNION ALL SELECT DISTINCT a.doc_id, a.clause_id, 'Conflicting Durations' FROM dur a JOIN dur b ON a.doc_id = b.doc_id AND a.xs <> b.xs""")
def conflict_values(spark, sf):
    kinds = ["Conflicting Durations", "Payment Conflict", "Conflicting Jurisdiction"]
    return pairs.value_conflicts(clauses(spark, sf), kinds).select("doc_id", "clause_id", "contradiction_type")


@query("conflict_dates", "J5", f"""WITH c AS {ansi_clauses()}, d AS ({_values(f"regexp_extract_all({T}, {rx(P.DATE, True)}, 0)", rules.TEMPORAL_WORDS)})
SELECT DISTINCT a.doc_id, a.clause_id FROM d a JOIN d b ON a.doc_id = b.doc_id AND NOT list_has_any(a.xs, b.xs)""")
def conflict_dates(spark, sf):
    return pairs.disjoint_dates(pairs.enriched(clauses(spark, sf), ["dates"])).select("doc_id", "clause_id")


_NORM = "lower(trim(regexp_replace(text_content, '\\s+', ' ', 'g')))"


@query("cut_near_copies", "J1 J22", f"""WITH RECURSIVE c AS {ansi_clauses("l_suppkey")}, n AS (SELECT doc_id, clause_id, part_no % 7 AS score, {_NORM} AS norm,
   array_to_string(list_sort(regexp_extract_all(text_content, {rx(P.NUMBER_TOKEN)})), '|') AS fp FROM c),
 t AS (SELECT doc_id, fp, norm, min(clause_id) AS id, arg_max(clause_id, row(score, -clause_id)) AS best, max(score) AS score FROM n GROUP BY 1, 2, 3),
 w AS (SELECT *, {words_sql("norm")} AS ws FROM t), b AS (SELECT *, {bag_sql("ws")} AS bag FROM w),
 e AS (SELECT x.doc_id, x.id AS a, y.id AS b FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.fp = y.fp AND x.id < y.id
   WHERE abs(length(x.norm) - length(y.norm)) <= 0.3 * greatest(length(x.norm), length(y.norm)) AND {shared_sql("x.bag", "y.bag")} >= 0.9 - 1e-9),
 u AS (SELECT doc_id, a, b FROM e UNION ALL SELECT doc_id, b, a FROM e),
 r(doc_id, node, reach) AS (SELECT DISTINCT doc_id, a, a FROM u UNION SELECT r.doc_id, r.node, u.b FROM r JOIN u ON u.doc_id = r.doc_id AND u.a = r.reach),
 k AS (SELECT doc_id, node, min(reach) AS class FROM r GROUP BY 1, 2)
SELECT t.doc_id, coalesce(class, id) AS slot_no, arg_max(best, row(score, -best)) AS clause_id FROM t LEFT JOIN k ON k.doc_id = t.doc_id AND node = id GROUP BY 1, 2""")
def cut_near_copies(spark, sf):
    """Clauses of each supplier without near-copies."""
    rows = clauses(spark, sf, "l_suppkey").withColumn("score", F.col("part_no") % 7)
    return segment.fold_near_copies(rows, order="clause_id", score="score").select("doc_id", "slot_no", "clause_id")


@query("conflict_duplicates", "J3 J9")
def conflict_duplicates(spark, sf):
    rows = cut_lineage(pairs.enriched(clauses(spark, sf), ["clause_number", "title_key", "dates", "durations", "money"]))
    return pairs.first_per_pair(pairs.duplicate_findings(rows), "detector")


def _edits(a: str, b: str) -> str:
    return (f"(CASE WHEN length({a}) + length({b}) = 0 THEN 1.0 ELSE 2.0 * (least(length({a}), length({b})) - (levenshtein({a}, {b}) - abs(length({a}) - length({b})))) "
            f"/ (length({a}) + length({b})) END)")


def _set(pattern: str) -> str:
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(t, {rx(pattern, True)}, 0), lambda m: lower(m))))"


_UNLIKE = "(len(x.{0}) > 0 AND len(y.{0}) > 0 AND x.{0} <> y.{0})"


@query("conflict_obligations", "J8", f"""WITH c AS {ansi_clauses()}, o AS (SELECT doc_id, clause_id, lower({_ob(1)}) AS s, lower({_ob(3)}) AS t,
   lower({_ob(2)}) LIKE '%not' AS neg FROM (SELECT doc_id, clause_id, unnest({all_of(P.OBLIGATION)}) AS m FROM c)),
 g AS (SELECT doc_id, s, t, neg, min(clause_id) AS rep FROM o GROUP BY 1, 2, 3, 4),
 w AS (SELECT *, row_number() OVER () AS k, {_set(P.MONEY)} AS ms, {_set(P.DURATION)} AS us, {words_sql("t")} AS ws FROM g), b AS (SELECT *, {bag_sql("ws")} AS bag FROM w),
 e AS (SELECT x.doc_id, x.k AS xk, y.k AS yk, x.rep AS xr, y.rep AS yr, x.neg <> y.neg AS opp, {_UNLIKE.format("ms")} AS cash, {shared_sql("x.bag", "y.bag")} AS ratio
   FROM b x JOIN b y ON x.doc_id = y.doc_id AND x.k < y.k WHERE (x.neg <> y.neg OR {_UNLIKE.format("ms")} OR {_UNLIKE.format("us")})
    AND {_edits("x.s", "y.s")} >= 0.6),
 f AS (SELECT *, CASE WHEN opp THEN 'obligation:opposite' WHEN cash THEN 'obligation:amount' ELSE 'obligation:duration' END AS topic FROM e
   WHERE CASE WHEN opp THEN ratio >= 0.55 ELSE ratio > 0.4 END),
 v AS (SELECT DISTINCT b.k, o.clause_id FROM o JOIN b ON b.doc_id = o.doc_id AND b.s = o.s AND b.t = o.t AND b.neg = o.neg),
 p AS (SELECT doc_id, opp, topic, clause_id AS x, yr AS y FROM f JOIN v ON v.k = xk UNION ALL SELECT doc_id, opp, topic, clause_id, xr FROM f JOIN v ON v.k = yk)
SELECT DISTINCT doc_id, CASE WHEN opp THEN 'Opposite Statements' ELSE 'Conflicting Obligations' END AS contradiction_type, topic,
 CASE WHEN opp THEN 'High' ELSE 'Medium' END AS severity, least(x, y) AS a_id, greatest(x, y) AS b_id FROM p WHERE x <> y""")
def conflict_obligations(spark, sf):
    return pairs.obligation_findings(pairs.enriched(clauses(spark, sf), ["obligations"])).drop("detector")


@query("conflict_issues", "J10 J11")
def conflict_issues(spark, sf):
    return pairs.issues(pairs.issue_members(clauses(spark, sf)))


@query("conflict_components", "J10", """WITH RECURSIVE e AS (SELECT DISTINCT l_linenumber AS g, l_suppkey AS a, l_partkey % 97 + 100000 AS b FROM lineitem),
 u AS (SELECT g, a, b FROM e UNION SELECT g, b, a FROM e),
 r(g, node, reach) AS (SELECT DISTINCT g, a, a FROM u UNION SELECT r.g, r.node, u.b FROM r JOIN u ON u.g = r.g AND u.a = r.reach)
SELECT g, node, min(reach) AS component FROM r GROUP BY 1, 2""")
def conflict_components(spark, sf):
    li = table(spark, sf, "lineitem")
    edges = li.select(F.col("l_linenumber").alias("g"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 97 + 100000).alias("b")).distinct()
    return pairs.components(edges, ["g"])


@query("conflict_semantic_pairs", "J12", f"""WITH c AS {ansi_clauses()}, v AS (SELECT doc_id, clause_id, CAST(embedding AS DOUBLE[]) AS e FROM c
  JOIN embeddings ON vec_id = part_no % (SELECT count(*) FROM embeddings)),
 s AS (SELECT a.doc_id, a.clause_id AS a_id, b.clause_id AS b_id, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.doc_id = b.doc_id
   AND a.clause_id < b.clause_id WHERE NOT (b.clause_id % 5 = 1))
SELECT doc_id, a_id, b_id, round(sim, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, a_id, b_id) AS p FROM s WHERE sim >= 0.35)""")
def conflict_semantic_pairs(spark, sf):
    rows = with_vectors(clauses(spark, sf), spark, sf).select("doc_id", "clause_id", "embedding")
    ids = rows.select("doc_id", "clause_id")
    flagged = ids.select("doc_id", F.col("clause_id").alias("a_id")).join(
        ids.filter(F.col("clause_id") % 5 == 1).select("doc_id", F.col("clause_id").alias("b_id")), "doc_id").filter("a_id < b_id")
    out = pairs.semantic_candidates(rows, flagged)
    return out.select("doc_id", "a_id", "b_id", F.round("similarity", 5).alias("similarity"))


@query("graph_dependencies", "J13", ROLL + f""", num AS (SELECT doc_id, nullif(regexp_extract(trim(section_name), '^(\\d+(?:\\.\\d+)*)', 1), '') AS number, clause_id FROM r),
 tgt AS (SELECT doc_id, number, max(clause_id) AS t FROM num WHERE number IS NOT NULL GROUP BY 1, 2),
 ref AS (SELECT doc_id, clause_id, regexp_extract(unnest(regexp_extract_all({T}, {rx(P.SECTION_REF, True)}, 0)), '(\\d+(?:\\.\\d+)*)', 1) AS number FROM r),
 cited AS (SELECT DISTINCT ref.doc_id, clause_id AS source_id, t AS target_id FROM ref JOIN tgt ON ref.doc_id = tgt.doc_id AND ref.number = tgt.number WHERE clause_id <> t),
 f AS (SELECT doc_id, classification AS k, min(clause_id) AS id FROM r GROUP BY 1, 2),
 rr AS (SELECT a.doc_id, a.id AS source_id, b.id AS target_id, rel AS relation FROM f a JOIN f b ON a.doc_id = b.doc_id
   JOIN (VALUES {', '.join(f"('{s}', '{t}', '{x}')" for s, t, x in rules.DEPENDENCIES)}) d(s, t, rel) ON d.s = a.k AND d.t = b.k WHERE a.id <> b.id)
SELECT doc_id, source_id, target_id, 'references' AS relation FROM cited UNION ALL
SELECT * FROM rr WHERE NOT EXISTS (SELECT 1 FROM cited WHERE cited.doc_id = rr.doc_id AND cited.source_id = rr.source_id AND cited.target_id = rr.target_id)""")
def graph_dependencies(spark, sf):
    return pairs.dependencies(stored_clauses(spark, sf)).drop("ref")
