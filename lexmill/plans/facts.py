"""Registered fact-extraction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import patterns as P
from ..functions import text as X
from ..operators import features, pairs
from .corpus import ansi_clauses, clauses, kind_clauses, kinds_sql, table
from .registry import in_list, contains_any, query, quoted, rx

CL = f"WITH c AS {ansi_clauses()} "
T = "text_content"


def all_of(pattern: str, ci: bool = False, text: str = T) -> str:
    return f"regexp_extract_all({text}, {rx(pattern, ci)}, 0)"


def joined(expr: str) -> str:
    return f"array_to_string({expr}, '|')"


def distinct_list(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def join(col):
    return F.array_join(col, "|")


DUR_TEXT = (f"list_transform({all_of(P.DURATION, True)}, lambda m: concat(CAST(regexp_extract(m, {rx(P.DURATION, True)}, 1) "
            f"AS BIGINT), ' ', lower(regexp_extract(m, {rx(P.DURATION, True)}, 2))))")


@query("fact_mentions", "X1 X2 X3 X4 X9 X10", CL + f"""
SELECT clause_id, {joined(all_of(P.MONEY, True))} AS money, {joined(all_of(P.DATE, True))} AS dates,
  {joined(DUR_TEXT)} AS durations, {joined(distinct_list(all_of(P.SECTION_REF, True)))} AS section_refs,
  {joined(f"list_sort({all_of(P.NUMBER_TOKEN)})")} AS fingerprint,
  regexp_replace(lower(trim({T})), '\\s+', ' ', 'g') AS dedup_form
FROM c""")
def fact_mentions(spark, sf):
    t = F.col(T)
    return clauses(spark, sf).select(
        "clause_id", join(X.money(t)).alias("money"), join(X.dates(t)).alias("dates"),
        join(F.transform(X.durations(t), lambda d: F.concat_ws(" ", d["n"].cast("string"), d["unit"]))).alias("durations"),
        join(X.section_refs(t)).alias("section_refs"), join(X.numeric_fingerprint(t)).alias("fingerprint"),
        X.dedup_form(t).alias("dedup_form"))


def _ob(i):
    return f"trim(regexp_extract(m, {rx(P.OBLIGATION)}, {i}))"


@query("fact_obligations", "X5 X16", CL + f"""
SELECT clause_id, ord - 1 AS pos, {_ob(1)} AS subject, {_ob(2)} AS modal, {_ob(3)} AS action,
  CASE WHEN lower({_ob(2)}) LIKE '%not' THEN 'prohibition'
       WHEN lower({_ob(2)}) IN {in_list(rules.STRONG_MODALS)} THEN 'obligation' ELSE 'right' END AS polarity
FROM (SELECT clause_id, unnest({all_of(P.OBLIGATION)}) AS m,
             unnest(range(1, len({all_of(P.OBLIGATION)}) + 1)) AS ord FROM c)""")
def fact_obligations(spark, sf):
    rows = clauses(spark, sf).select("clause_id", F.posexplode(X.obligations(F.col(T))).alias("pos", "o"))
    return rows.select("clause_id", F.col("pos").cast("bigint").alias("pos"), "o.subject", "o.modal", "o.action",
                       X.polarity(F.lower("o.modal")).alias("polarity"))


_MM = all_of(P.MODAL_MENTION)


@query("fact_modal_polarity", "X16", CL + f"""
SELECT modal, polarity, count(*) AS n FROM (
  SELECT regexp_extract(p, '^\\w+') AS modal,
    CASE WHEN p LIKE '%not' THEN 'prohibition' WHEN p IN {in_list(rules.STRONG_MODALS)} THEN 'obligation'
         ELSE 'right' END AS polarity
  FROM (SELECT lower(regexp_extract(unnest({_MM}), {rx(P.MODAL_MENTION)}, 2)) AS p FROM c)) GROUP BY 1, 2""")
def fact_modal_polarity(spark, sf):
    rows = clauses(spark, sf).select(F.explode(X.modal_mentions(F.col(T))).alias("o"))
    return rows.groupBy("o.modal", "o.polarity").agg(F.count(F.lit(1)).alias("n"))


@query("fact_clause_keys", "X6 X7 X20", CL + f"""
SELECT clause_id,
  coalesce(nullif(regexp_extract(section_name, {rx(P.CLAUSE_NUMBER, True)}, 1), ''),
           nullif(regexp_extract(substr({T}, 1, 200), {rx(P.CLAUSE_NUMBER, True)}, 1), ''),
           nullif(regexp_extract(section_name, {rx(P.LEADING_NUMBER)}, 1), '')) AS clause_number,
  lower(trim(regexp_replace(regexp_replace(trim(section_name), {rx(P.TITLE_PREFIX, True)}, ''),
                            {rx(P.LEADING_NUMBER)}, ''))) AS title_key,
  nullif(regexp_extract(trim(section_name), '^(\\d+(?:\\.\\d+)*)', 1), '') AS leading_number
FROM c""")
def fact_clause_keys(spark, sf):
    name = F.col("section_name")
    return clauses(spark, sf).select("clause_id", X.clause_number(name, F.col(T)).alias("clause_number"),
                                     X.title_key(name).alias("title_key"),
                                     X.leading_number(name).alias("leading_number"))


_LN = all_of(P.LABELLED_NUMBER, True)


@query("fact_labelled_numbers", "X8", CL + f"""
SELECT clause_id, lower(trim(regexp_extract(m, {rx(P.LABELLED_NUMBER, True)}, 1))) AS label,
       array_to_string(list_sort(list(DISTINCT trim(regexp_extract(m, {rx(P.LABELLED_NUMBER, True)}, 2)))), ', ') AS "values"
FROM (SELECT clause_id, unnest({_LN}) AS m FROM c) GROUP BY 1, 2""")
def fact_labelled_numbers(spark, sf):
    rows = clauses(spark, sf).select("clause_id", F.explode(X.labelled_numbers(F.col(T))).alias("l"))
    return rows.groupBy("clause_id", "l.label").agg(
        F.array_join(F.array_sort(F.collect_set("l.value")), ", ").alias("values"))


@query("fact_jurisdictions", "X11", CL + f"""
SELECT clause_id, nullif(trim(regexp_extract({T}, {rx(P.JURISDICTION, True)}, 1)), '') AS jurisdiction,
  array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(lower({T}), {rx(P.STATE)}, 1),
                  lambda s: trim(s)))), '|') AS states,
  array_to_string(list_sort(list_distinct(list_transform({all_of(P.PENALTY, True)}, lambda s: trim(s)))), '|') AS penalties
FROM c""")
def fact_jurisdictions(spark, sf):
    t = F.col(T)
    return clauses(spark, sf).select("clause_id", X.jurisdiction(t).alias("jurisdiction"),
                                     join(X.states(t)).alias("states"), join(X.penalties(t)).alias("penalties"))


_PARTY_TEXT = ("concat('Made between Harbour ', c_custkey, ' Ltd (\"Buyer ', c_nationkey, '\") and Quay & Sons, Inc. (\"', "
               "c_mktsegment, '\") today.')")


@query("fact_parties", "X12 X23", f"""
SELECT c_custkey, ord, full_name, short_name,
  trim(full_name) <> '' AND (contains(trim(full_name), ' ') OR (length(trim(full_name)) >= 4
     AND regexp_full_match(trim(full_name), '[A-Za-z]+'))) AS plausible_full,
  trim(short_name) <> '' AND (contains(trim(short_name), ' ') OR (length(trim(short_name)) >= 4
     AND regexp_full_match(trim(short_name), '[A-Za-z]+'))) AS plausible_short
FROM (SELECT c_custkey, unnest(range(0, len(ms))) AS ord,
             regexp_extract(unnest(ms), {rx(P.PARTY)}, 1) AS full_name,
             regexp_extract(unnest(ms), {rx(P.PARTY)}, 2) AS short_name
      FROM (SELECT c_custkey, regexp_extract_all({_PARTY_TEXT}, {rx(P.PARTY)}, 0) AS ms FROM customer))""")
def fact_parties(spark, sf):
    df = table(spark, sf, "customer").withColumn("t", F.expr(_PARTY_TEXT))
    rows = df.select("c_custkey", F.posexplode(X.parties(F.col("t"))).alias("ord", "p"))
    return rows.select("c_custkey", F.col("ord").cast("bigint").alias("ord"), "p.full_name", "p.short_name",
                       X.looks_like_party(F.col("p.full_name")).alias("plausible_full"),
                       X.looks_like_party(F.col("p.short_name")).alias("plausible_short"))


_DAYS = " ".join(f"WHEN '{u}' THEN {d}" for u, d in rules.DAYS_PER_UNIT.items())


@query("fact_deadlines", "X13", CL + f"""
SELECT clause_id, 'date' AS kind, unnest({all_of(P.DATE, True)}) AS value, CAST(NULL AS DOUBLE) AS days FROM c
UNION ALL
SELECT clause_id, 'duration', concat(n, ' ', unit), CAST(n * CASE unit {_DAYS} END AS DOUBLE) FROM (
  SELECT clause_id, CAST(regexp_extract(m, {rx(P.DURATION, True)}, 1) AS BIGINT) AS n,
         lower(regexp_extract(m, {rx(P.DURATION, True)}, 2)) AS unit
  FROM (SELECT clause_id, unnest({all_of(P.DURATION, True)}) AS m FROM c))""")
def fact_deadlines(spark, sf):
    return clauses(spark, sf).select("clause_id", F.inline(X.deadlines(X.dates(F.col(T)), X.durations(F.col(T)))))


_CUR = "CASE " + " ".join(f"WHEN starts_with(s, {quoted(p)}) THEN '{c}'" for p, c in rules.CURRENCY_PREFIXES) + " END"
_SCALE = "CASE " + " ".join(f"WHEN contains(lower(s), '{w}') THEN {f}" for w, f in rules.SCALE_WORDS) + " ELSE 1.0 END"
_MONEY_TEXT = ("CASE c_custkey % 6 WHEN 0 THEN concat('USD ', c_custkey, '.5 million is capped') "
               "WHEN 1 THEN concat('Rs. ', c_custkey, ',000 and ', c_nationkey, '.25% unlimited') "
               "WHEN 2 THEN concat('$, advisers ', c_custkey) WHEN 3 THEN concat('pay US$', c_custkey, ',500 or INR ', c_nationkey, ' lakh') "
               "WHEN 4 THEN concat('limited to $', c_custkey, ' crore') ELSE concat('nothing due ', c_custkey) END")


def _num(pattern: str) -> str:
    e = f"replace(regexp_extract(s, '{pattern}', 0), ',', '')"
    return f"CASE WHEN regexp_matches({e}, '\\d') THEN TRY_CAST({e} AS DOUBLE) END"


@query("fact_financial_terms", "X14", f"""
SELECT c_custkey, CASE WHEN suffix(s, '%') THEN {_num('[\\d,.]+')} ELSE ({_num('[\\d,]+(?:\\.\\d+)?')}) * {_SCALE} END AS amount,
  CASE WHEN NOT suffix(s, '%') THEN {_CUR} END AS currency, suffix(s, '%') AS is_percentage,
  CASE WHEN {contains_any('lower(t)', rules.UNCAP_WORDS)} THEN false
       WHEN {contains_any('lower(t)', rules.CAP_WORDS)} THEN true END AS is_capped
FROM (SELECT c_custkey, t, trim(unnest(regexp_extract_all(t, {rx(P.MONEY, True)}, 0))) AS s
      FROM (SELECT c_custkey, {_MONEY_TEXT} AS t FROM customer))""")
def fact_financial_terms(spark, sf):
    df = table(spark, sf, "customer").withColumn("t", F.expr(_MONEY_TEXT))
    return df.select("c_custkey", F.inline(X.financial_terms(F.col("t"), X.money(F.col("t")))))


#: The forms of each action word, written out.
_FORMS = {"terminate": "terminate|terminates|terminated|terminating", "termination": "termination|terminations",
          "indemnify": "indemnify|indemnifies|indemnified|indemnifying", "indemnification": "indemnification|indemnifications",
          "indemnity": "indemnity|indemnities", "waive": "waive|waives|waived|waiving", "waiver": "waiver|waivers",
          "assign": "assign|assigns|assigned|assigning", "assignment": "assignment|assignments", "comply": "comply|complies|complied|complying",
          "compliance": "compliance|compliances", "compliant": "compliant", "sanction": "sanction|sanctioned|sanctioning", "sanctions": "sanctions"}


def _action_count(kind: str) -> str:
    parts = [f"CAST(contains(l, {quoted(p)}) AS INT)" for p, k in rules.ACTION_PHRASES if k == kind]
    parts += [f"CAST(regexp_matches(l, '\\b(?:{_FORMS[w]})\\b') AS INT)" for w, k in rules.ACTION_WORDS if k == kind]
    return " + ".join(parts)


_KINDS = sorted({k for _, k in rules.ACTION_PHRASES} | {k for _, k in rules.ACTION_WORDS})


@query("fact_legal_actions", "X15 C13", CL + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT clause_id, '{k}' AS action_type, ({_action_count(k)}) / (({_action_count(k)}) + 1.0) AS confidence "
    f"FROM (SELECT clause_id, lower({T}) AS l FROM c)" for k in _KINDS) + ") WHERE confidence > 0")
def fact_legal_actions(spark, sf):
    return clauses(spark, sf).select("clause_id", F.inline(X.legal_actions(F.col(T))))


@query("fact_prose_flags", "X17 X24", CL + f"""
SELECT clause_id, regexp_matches(lower({T}), {rx(chr(92) + 'b(?:' + '|'.join(rules.PROSE_VERBS) + ')' + chr(92) + 'b')}) AS prose_verb,
  len(regexp_extract_all({T}, '[A-Za-z]{{2,}}', 0)) >= 4 AS prose,
  trim(v) <> '' AND NOT regexp_matches(trim(v), {rx(P.PLACEHOLDER_VALUE, True)}) AS populated
FROM (SELECT *, CASE part_no % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN 'TBD.' WHEN 3 THEN '' ELSE {T} END AS v FROM c)""")
def fact_prose_flags(spark, sf):
    df = clauses(spark, sf).withColumn("v", F.expr(
        "CASE part_no % 5 WHEN 0 THEN 'N/A' WHEN 1 THEN ' - ' WHEN 2 THEN 'TBD.' WHEN 3 THEN '' ELSE text_content END"))
    return df.select("clause_id", X.has_prose_verb(F.col(T)).alias("prose_verb"),
                     X.looks_like_prose(F.col(T)).alias("prose"), X.populated_value(F.col("v")).alias("populated"))


_NUM_TEXT = ("CASE o_custkey % 4 WHEN 0 THEN concat('Rs. ', o_custkey, ',00,000.50') WHEN 1 THEN concat('USD ', o_custkey) "
             "WHEN 2 THEN 'n/a' ELSE concat(o_custkey, '.5 %') END")
_DATE_CASES = {"spark": ["'MMMM d, yyyy'", "'MMM d, yyyy'", "'yyyy-MM-dd'", "'dd/MM/yyyy'", "'dd-MM-yyyy'"],
               "ansi": ["'%B %-d, %Y'", "'%b %-d, %Y'", "'%Y-%m-%d'", "'%d/%m/%Y'", "'%d-%m-%Y'"]}


def _date_text(dialect: str) -> str:
    fn = "date_format(o_orderdate, {f})" if dialect == "spark" else "strftime(o_orderdate, {f})"
    whens = " ".join(f"WHEN {i} THEN {fn.format(f=f)}" for i, f in enumerate(_DATE_CASES[dialect]))
    return f"CASE o_custkey % 6 {whens} ELSE 'soon' END"


_ANSI_FORMATS = ["'%B %d, %Y'", "'%b %d, %Y'", "'%Y-%m-%d'", "'%d/%m/%Y'", "'%d/%m/%y'", "'%d-%m-%Y'", "'%m/%d/%Y'"]


@query("fact_value_parsing", "X21 X22", f"""
SELECT o_orderkey, CASE WHEN n <> '' AND n <> '.' THEN TRY_CAST(n AS DOUBLE) END AS amount,
  strftime(coalesce({', '.join(f'try_strptime(d, {f})' for f in _ANSI_FORMATS)}), '%Y-%m-%d') AS parsed,
  strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS pdf_stamp
FROM (SELECT o_orderkey, o_orderdate, {_date_text('ansi')} AS d,
  regexp_replace(regexp_replace({_NUM_TEXT}, {rx(P.CURRENCY_TOKEN, True)}, '', 'g'), '[^\\d.]', '', 'g') AS n FROM orders)""")
def fact_value_parsing(spark, sf):
    df = table(spark, sf, "orders")
    stamp = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"))
    return df.select("o_orderkey", X.parse_numeric(F.expr(_NUM_TEXT)).alias("amount"),
                     F.date_format(X.parse_date_flexible(F.expr(_date_text("spark"))), "yyyy-MM-dd").alias("parsed"),
                     F.date_format(X.parse_pdf_date(stamp), "yyyy-MM-dd HH:mm:ss").alias("pdf_stamp"))


@query("fact_span_overlap", "X19", CL + """, a AS (
  SELECT clause_id, 1 AS mention_no, instr(text_content, 'shall') AS s, instr(text_content, 'shall') + 12 AS e FROM c
   WHERE contains(text_content, 'shall')
  UNION ALL SELECT clause_id, 2, instr(text_content, 'Section'), instr(text_content, 'Section') + 9 FROM c
   WHERE contains(text_content, 'Section')),
b AS (SELECT clause_id, part_no % 60 AS s, part_no % 60 + 10 AS e FROM c)
SELECT clause_id, mention_no, EXISTS (SELECT 1 FROM b WHERE b.clause_id = a.clause_id AND a.s < b.e AND b.s < a.e) AS corroborated
FROM a""")
def fact_span_overlap(spark, sf):
    c = clauses(spark, sf)
    marks = [(1, "shall", 12), (2, "Section", 9)]
    spans = F.array(*[F.when(F.col(T).contains(w), F.struct(F.lit(no).alias("mention_no"), F.instr(T, w).alias("start"),
                                                             (F.instr(T, w) + size).alias("end"))) for no, w, size in marks])
    left = c.select("clause_id", F.inline(F.filter(spans, lambda s: s.isNotNull())))
    right = c.select("clause_id", (F.col("part_no") % 60).alias("start"), (F.col("part_no") % 60 + 10).alias("end"))
    return features.span_corroboration(left, right).select("clause_id", "mention_no", "corroborated")


_EDITS = ("CASE WHEN length(s) + length(m) = 0 THEN 1.0 ELSE 2.0 * (least(length(s), length(m)) - (levenshtein(s, m) - abs(length(s) - length(m)))) "
          "/ (length(s) + length(m)) END")


@query("fact_subject_agreement", "X18", CL + f"""
SELECT corroborated, count(*) AS n FROM (SELECT len(list_filter(subjects, lambda s: {_EDITS} >= 0.5)) > 0 AS corroborated FROM (
  SELECT subjects, lower(unnest(raw)) AS m FROM (SELECT list_transform({_MM}, lambda m: regexp_extract(m, {rx(P.MODAL_MENTION)}, 1)) AS raw,
    list_transform({all_of(P.OBLIGATION)}, lambda m: lower(regexp_extract(m, {rx(P.OBLIGATION)}, 1))) AS subjects FROM c))) GROUP BY 1""")
def fact_subject_agreement(spark, sf):
    c = clauses(spark, sf)
    mentions = c.select("clause_id", F.posexplode(X.modal_mentions(F.col(T))).alias("mention_no", "o")).select(
        "clause_id", "mention_no", "o.subject")
    hits = c.select("clause_id", F.explode(X.obligations(F.col(T))).alias("o")).select("clause_id", "o.subject")
    return features.subject_corroboration(mentions, hits).groupBy("corroborated").agg(F.count(F.lit(1)).alias("n"))


def _conf(kinds: list[str]) -> str:
    return "(" + " + ".join(f"(({_action_count(k)}) / (({_action_count(k)}) + 1.0))" for k in kinds) + ")"


_ALL_CONF = _conf(_KINDS)
_ALL_N = "(" + " + ".join(f"CAST(({_action_count(k)}) > 0 AS INT)" for k in _KINDS) + ")"

DEPENDENCIES_SQL = f"""(WITH r AS (SELECT doc_id, clause_id, section_name, text_content, {kinds_sql()} AS classification FROM c),
 num AS (SELECT doc_id, nullif(regexp_extract(trim(section_name), '^(\\d+(?:\\.\\d+)*)', 1), '') AS number, clause_id FROM r),
 tgt AS (SELECT doc_id, number, max(clause_id) AS t FROM num WHERE number IS NOT NULL GROUP BY 1, 2),
 ref AS (SELECT doc_id, clause_id, regexp_extract(unnest(regexp_extract_all({T}, {rx(P.SECTION_REF, True)}, 0)), '(\\d+(?:\\.\\d+)*)', 1) AS number FROM r),
 cited AS (SELECT DISTINCT ref.doc_id, clause_id AS source_id, t AS target_id FROM ref JOIN tgt ON ref.doc_id = tgt.doc_id AND ref.number = tgt.number WHERE clause_id <> t),
 f AS (SELECT doc_id, classification AS k, min(clause_id) AS id FROM r GROUP BY 1, 2),
 rr AS (SELECT a.doc_id, a.id AS source_id, b.id AS target_id, rel AS relation FROM f a JOIN f b ON a.doc_id = b.doc_id
   JOIN (VALUES {', '.join(f"('{s}', '{t}', '{x}')" for s, t, x in rules.DEPENDENCIES)}) d(s, t, rel) ON d.s = a.k AND d.t = b.k WHERE a.id <> b.id)
SELECT doc_id, source_id, target_id, 'references' AS relation FROM cited UNION ALL
SELECT * FROM rr WHERE NOT EXISTS (SELECT 1 FROM cited WHERE cited.doc_id = rr.doc_id AND cited.source_id = rr.source_id AND cited.target_id = rr.target_id))"""

SIGNALS_SQL = f"""
SELECT doc_id, clause_id, vec_seed, ln(1 + coalesce(list_max(amounts), 0.0)) AS raw_financial,
  {_conf([k for k in _KINDS if k in rules.LEGAL_ACTIONS])}
   + coalesce(list_sum(list_transform(list_filter(mentions, lambda o: o.polarity <> 'right'), lambda o: o.conf)), 0.0) AS raw_legal,
  0.5 * len(states) + {_conf([k for k in _KINDS if k in rules.COMPLIANCE_ACTIONS])}
   + CASE WHEN juris IS NOT NULL THEN 1.0 ELSE 0.0 END AS raw_compliance,
  CAST(n_deadlines + coalesce(n_deps, 0) AS DOUBLE) AS raw_operational,
  CASE WHEN NOT prose THEN 0.0 WHEN len(mentions) = 0 THEN 0.5
       ELSE len(list_filter(mentions, lambda o: o.modal IN {in_list(rules.WEAK_MODALS)})) / (len(mentions) + 0.0) END AS f_ambiguity,
  CASE WHEN len(mentions) + len(states) + {_ALL_N} = 0 THEN 0.5 ELSE
   (coalesce(list_sum(list_transform(mentions, lambda o: o.conf)), 0.0) + 0.5 * len(states) + {_ALL_CONF})
   / (len(mentions) + len(states) + {_ALL_N}) END AS feature_confidence
FROM (
 SELECT doc_id, clause_id, part_no AS vec_seed, lower({T}) AS l, n_deadlines, n_deps, juris, prose, states,
  list_transform(list_filter(cash, lambda s: NOT suffix(s, '%')),
     lambda s: TRY_CAST(replace(regexp_extract(s, '[\\d,]+(?:\\.\\d+)?', 0), ',', '') AS DOUBLE)) AS amounts,
  list_transform(raw, lambda m: {{'modal': regexp_extract(lower(m[2]), '^\\w+'),
     'polarity': CASE WHEN lower(m[2]) LIKE '%not' THEN 'prohibition'
                      WHEN lower(m[2]) IN {in_list(rules.STRONG_MODALS)} THEN 'obligation' ELSE 'right' END,
     'conf': CASE WHEN list_contains(subjects, lower(m[1])) THEN 2.0 / 3 ELSE 0.5 END}}) AS mentions, {T}
 FROM (
  SELECT *, {all_of(P.MONEY, True)} AS cash,
   len({all_of(P.DATE, True)}) + len({all_of(P.DURATION, True)}) AS n_deadlines,
   nullif(trim(regexp_extract({T}, {rx(P.JURISDICTION, True)}, 1)), '') AS juris,
   list_distinct(list_transform(regexp_extract_all(lower({T}), {rx(P.STATE)}, 1), lambda s: trim(s))) AS states,
   regexp_matches(lower({T}), {rx(chr(92) + 'b(?:' + '|'.join(rules.PROSE_VERBS) + ')' + chr(92) + 'b')}) AS prose,
   list_transform({_MM}, lambda m: [regexp_extract(m, {rx(P.MODAL_MENTION)}, 1), regexp_extract(m, {rx(P.MODAL_MENTION)}, 2)]) AS raw,
   list_transform({all_of(P.OBLIGATION)}, lambda m: lower(regexp_extract(m, {rx(P.OBLIGATION)}, 1))) AS subjects
  FROM c LEFT JOIN (SELECT source_id, count(*) AS n_deps FROM {DEPENDENCIES_SQL} GROUP BY 1) dep ON source_id = clause_id))"""


@query("feature_signals", "X25 R1 R2 R3 R4 R5", CL + f"""
SELECT clause_id, round(raw_financial, 6) AS raw_financial, round(raw_legal, 6) AS raw_legal,
  round(raw_compliance, 6) AS raw_compliance, round(raw_operational, 6) AS raw_operational,
  round(f_ambiguity, 6) AS f_ambiguity, round(feature_confidence, 6) AS feature_confidence FROM ({SIGNALS_SQL})""")
def feature_signals(spark, sf):
    rows = kind_clauses(spark, sf)
    sig = features.add_dependencies(features.raw_signals(features.with_facts(rows)), features.dependency_lists(rows, pairs.dependencies(rows)))
    return sig.select("clause_id", *[F.round(c, 6).alias(c) for c in (
        "raw_financial", "raw_legal", "raw_compliance", "raw_operational", "f_ambiguity", "feature_confidence")])
