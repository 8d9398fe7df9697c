"""Registered risk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import vectors as V
from ..operators import features, groups, pairs, report, risk, stats, thresholds
from .corpus import ansi_clauses, kind_clauses, scratch, table
from .facts import SIGNALS_SQL
from .registry import query, quoted

CL = f"WITH c AS {ansi_clauses()} "
LOWER = risk.LOWER


def prototypes(spark, sf):
    """Twelve stored vectors stand in for the encoded prototype sentences."""
    rows = [(d, i * 3 + j, s) for i, d in enumerate(rules.PROTOTYPE_DIMENSIONS) for j, s in enumerate(rules.PROTOTYPES[d])]
    names = spark.createDataFrame(rows, "dimension string, proto_no long, sentence string")
    emb = table(spark, sf, "embeddings").filter(F.col("vec_id") < 12)
    return names.join(emb, F.col("proto_no") == F.col("vec_id")).select("dimension", "proto_no", "sentence", "embedding")


def with_vectors(df, spark, sf, seed="part_no"):
    """Attach the stored vector number seed mod n to each row."""
    emb = table(spark, sf, "embeddings")
    n = emb.agg(F.count(F.lit(1))).scalar()
    return df.withColumn("_vec", F.pmod(F.col(seed), n)).join(
        emb.select("vec_id", "embedding"), F.col("_vec") == F.col("vec_id")).drop("_vec", "vec_id")


def vector_signals(spark, sf):
    """Semantic signals per stored vector, computed once per vector rather than once per clause."""
    return risk.prototype_similarity(table(spark, sf, "embeddings"), prototypes(spark, sf))


def signals(spark, sf, keys, carry=()):
    """The signals of every clause and the columns to carry, which may name its evidence.

    Without very large documents the lines are dealt by document once, and all that follows stays there.
    """
    if not keys.isEmpty():
        base = kind_clauses(spark, sf)
        lists, facts = features.dependency_lists(base, pairs.dependencies(base)), features.with_facts(base)
        if "evidence" in carry:
            sig = features.raw_signals(features.evidence(features.with_dependencies(facts, lists)))
        else:
            sig = features.add_dependencies(features.raw_signals(facts), lists)
    else:
        facts = features.with_facts(features.with_own_dependencies(kind_clauses(spark, sf, by_document=True)))
        sig = features.raw_signals(features.evidence(facts) if "evidence" in carry else facts)
    sig = sig.select("doc_id", "clause_id", "part_no", *[f"raw_{d}" for d in risk.RANKED], "f_ambiguity", "feature_confidence", *carry)
    emb = vector_signals(spark, sf).drop("label", "unit").withColumnRenamed("vec_id", "_vec")
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    sig = sig.withColumn("_vec", F.pmod("part_no", n))
    return risk.outlier_signal(sig, emb, "_vec", keys=keys).drop("_vec")


def scored(spark, sf, keys=None, carry=()):
    keys = keys or counted_keys(spark, sf)
    return risk.score_clauses(signals(spark, sf, keys, carry), keys=keys)


def counted_keys(spark, sf):
    """The documents of all clauses if there is a very large one among them, else none: steps that look for large ones need not count again."""
    keys = document_keys(spark, sf)
    return keys.limit(0) if groups.hot_groups(keys, ["doc_id"]).isEmpty() else keys


def document_keys(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"))


_N_VEC = "(SELECT count(*) FROM embeddings)"


def _sims(i: int) -> str:
    return ", ".join(f"list_cosine_similarity(e.v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {i * 3 + j}))"
                     for j in range(3))


VECTORS_SQL = ("SELECT vec_id, v, " + ", ".join(f"greatest({_sims(i)}) AS e_{d}" for i, d in enumerate(risk.RANKED))
               + " FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e")

SIGNED_SQL = f"""SELECT s.*, e_financial, e_legal, e_compliance, e_operational,
  CASE WHEN m.n < 2 THEN 0.5 ELSE 1.0 - list_cosine_similarity(v.v, m.mean) END AS e_ambiguity, m.n AS n
 FROM sig s JOIN vec v ON v.vec_id = s.vec_seed % {_N_VEC}
 JOIN (SELECT doc_id, count(*) AS n, [{', '.join(f'avg(v[{i + 1}])' for i in range(64))}] AS mean
       FROM sig JOIN vec ON vec_id = vec_seed % {_N_VEC} GROUP BY doc_id) m ON m.doc_id = s.doc_id"""


def _pct(c: str) -> str:
    return (f"CASE WHEN n <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY doc_id ORDER BY {c}) "
            f"+ (count(*) OVER (PARTITION BY doc_id, {c}) - 1) / 2.0 - 1) / (n - 1) END")


def _sums(cols, clip=False):
    out = []
    for c in cols:
        x = f"(greatest(0.0, least(1.0, {c})) + 1e-4)" if clip else f"({c} + 1e-4)"
        out.append(f"sum({x}) OVER (PARTITION BY doc_id) AS {c}__s, sum({x} * ln({x})) OVER (PARTITION BY doc_id) AS {c}__t")
    return ", ".join(out)


def _inf(c):
    return f"(1.0 + ({c}__t / {c}__s - ln({c}__s)) / ln(greatest(n, 2)) + 1e-4)"


def _w(c, cols):
    total = " + ".join(_inf(x) for x in cols)
    return (f"CASE WHEN n < 2 THEN 1.0 / {len(cols)} ELSE n / (n + 10.0) * {_inf(c)} / ({total}) "
            f"+ (1.0 - n / (n + 10.0)) / {len(cols)} END")


def score_sql(alpha: float | None = None) -> str:
    """CTEs ending in sc(doc_id, clause_id, s_*, w_*, lrsi, conf, a_*)."""
    fe = [f"{k}_{d}" for d in LOWER for k in "fe"]
    a = {d: str(alpha) if alpha is not None else _w(f"f_{d}", [f"f_{d}", f"e_{d}"]) for d in LOWER}
    s = [f"s_{d}" for d in LOWER]
    parts = ["agreement", "feature_confidence", "margin"]
    es = ", ".join(f"e_{d}" for d in LOWER)
    return f"""c AS {ansi_clauses()}, sig AS ({SIGNALS_SQL}), vec AS ({VECTORS_SQL}),
 x1 AS ({SIGNED_SQL}),
 x2 AS (SELECT *, {', '.join(f'{_pct("raw_" + d)} AS f_{d}' for d in risk.RANKED)} FROM x1),
 x3 AS (SELECT *, {_sums(fe, True)} FROM x2),
 x4 AS (SELECT doc_id, clause_id, n, feature_confidence, {', '.join(fe)}, {', '.join(f'{a[d]} AS a_{d}' for d in LOWER)} FROM x3),
 x5 AS (SELECT *, {', '.join(f'greatest(0.0, least(1.0, a_{d} * f_{d} + (1.0 - a_{d}) * e_{d})) AS s_{d}' for d in LOWER)},
   1.0 - ({' + '.join(f'abs(f_{d} - e_{d})' for d in LOWER)}) / 5 AS agreement,
   list_reverse_sort([{es}])[1] - list_reverse_sort([{es}])[2] AS margin FROM x4),
 x6 AS (SELECT *, {_sums(s)}, {_sums(parts)} FROM x5),
 x7 AS (SELECT *, {', '.join(f'{_w(c, s)} AS w_{c}' for c in s)}, {', '.join(f'{_w(c, parts)} AS cw_{c}' for c in parts)} FROM x6),
 sc AS (SELECT *, 100.0 * ({' + '.join(f'w_{c} * {c}' for c in s)}) AS lrsi,
   greatest(0.0, least(100.0, 100.0 * ({' + '.join(f'cw_{c} * {c}' for c in parts)}))) AS conf FROM x7)"""


LEVEL = "CASE WHEN lrsi >= 70 THEN 'High' WHEN lrsi >= 35 THEN 'Medium' ELSE 'Low' END"
GINI = ("CASE WHEN count(*) < 2 OR sum(v) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, "
        "(count(*) + 1 - 2.0 * ((count(*) + 1) * sum(v) - sum(r * v)) / sum(v)) / count(*))) END")


@query("risk_level_distribution", "R24 B1", f"WITH {score_sql()} SELECT doc_id, "
       + ", ".join(f"count(*) FILTER (WHERE {LEVEL} = '{x}') AS {x.lower()}_count" for x in ("High", "Medium", "Low"))
       + " FROM sc GROUP BY doc_id")
def risk_level_distribution(spark, sf):
    rows = scored(spark, sf).withColumn("risk_level", risk.classify3(F.col("lrsi")))
    return risk.level_counts(rows)


@query("risk_clause_scores", "R6 R9 R10 R11 R12 R13 R14 R20 R24", f"WITH {score_sql()} SELECT clause_id, round(lrsi, 4) AS lrsi, "
       f"{LEVEL} AS risk_level, round(conf, 4) AS risk_confidence FROM sc")
def risk_clause_scores(spark, sf):
    return scored(spark, sf).select("clause_id", F.round("lrsi", 4).alias("lrsi"), risk.classify3(F.col("lrsi")).alias("risk_level"),
                                    F.round("risk_confidence", 4).alias("risk_confidence"))


@query("risk_document_scores", "R15 R16 R14 D4", f"""WITH {score_sql()}, g AS (
 SELECT doc_id, count(*) AS n_clauses, avg(v) AS m, {GINI} AS gini FROM (SELECT doc_id, lrsi AS v,
   rank() OVER (PARTITION BY doc_id ORDER BY lrsi) + (count(*) OVER (PARTITION BY doc_id, lrsi) - 1) / 2.0 AS r FROM sc) GROUP BY doc_id)
SELECT doc_id, n_clauses, round(m, 4) AS average_lrsi, round(gini, 4) AS gini, round(least(100.0, m * (1 + 0.15 * gini)), 4) AS document_risk_score FROM g""")
def risk_document_scores(spark, sf):
    keys = counted_keys(spark, sf)
    d = risk.document_scores(scored(spark, sf, keys), keys=keys)
    return d.select("doc_id", "n_clauses", *[F.round(c, 4).alias(c) for c in ("average_lrsi", "gini", "document_risk_score")])


_DIMS = ", ".join(f"{{'c': -round(w_s_{d} * s_{d} * 100 + 1e-7, 2), 'no': {i}, 'd': '{n}'}}" for i, (n, d) in enumerate(zip(rules.DIMENSIONS, LOWER)))


@query("risk_breakdown", "R21 D5", f"""WITH {score_sql()} SELECT clause_id, array_to_string(list_transform(b, lambda x: x.d), ' > ') AS dimensions,
  -b[1].c AS contribution, -b[{len(LOWER)}].c AS least FROM (SELECT clause_id, list_sort([{_DIMS}]) AS b FROM sc)""")
def risk_breakdown(spark, sf):
    rows = risk.breakdown(scored(spark, sf)).select("clause_id", F.col("dimension_breakdown").alias("b"))
    return rows.select("clause_id", F.array_join(F.transform("b", lambda p: p["dimension"]), " > ").alias("dimensions"),
                       F.get("b", F.lit(0))["contribution"].alias("contribution"), F.element_at("b", -1)["contribution"].alias("least"))


@query("risk_alpha_ablation", "D9 R12", f"""WITH a AS (WITH {score_sql(1.0)} SELECT clause_id, lrsi FROM sc),
 b AS (WITH {score_sql(0.0)} SELECT clause_id, lrsi FROM sc), d AS (WITH {score_sql()} SELECT clause_id, lrsi FROM sc)
SELECT d.clause_id, round(a.lrsi + 1e-7, 3) AS feature_only, round(b.lrsi + 1e-7, 3) AS semantic_only, round(d.lrsi + 1e-7, 3) AS current_dynamic
FROM a JOIN b ON a.clause_id = b.clause_id JOIN d ON a.clause_id = d.clause_id""")
def risk_alpha_ablation(spark, sf):
    runs = {"feature_only": 1.0, "semantic_only": 0.0, "current_dynamic": None}
    keys = counted_keys(spark, sf)
    rows = risk.score_scenarios(signals(spark, sf, keys), {n: None if a is None else {d: a for d in rules.DIMENSIONS} for n, a in runs.items()}, keys=keys)
    return rows.select("clause_id", *[F.round(F.col(n) + 1e-7, 3).alias(n) for n in runs])


@query("risk_explanations", "R22 R23 R27")
def risk_explanations(spark, sf):
    rows = risk.breakdown(scored(spark, sf, carry=("evidence",)), "evidence")
    rows = risk.explanation(rows.withColumn("risk_level", risk.classify3(F.col("lrsi"))))
    return rows.select("clause_id", "risk_level", "explanation", F.array_join(
        risk.reason_bullets(F.col("dimension_breakdown")), " | ").alias("bullets"))


@query("risk_prototype_similarity", "R7 R8", f"""SELECT vec_id, {', '.join(f'round(e_{d}, 5) AS e_{d}' for d in risk.RANKED)} FROM ({VECTORS_SQL})""")
def risk_prototype_similarity(spark, sf):
    return vector_signals(spark, sf).select("vec_id", *[F.round(f"e_{d}", 5).alias(f"e_{d}") for d in risk.RANKED])


@query("stat_entropy_weights", "R10", """WITH m AS (
  SELECT l_suppkey AS g, 'qty' AS criterion, l_quantity / 50 AS v FROM lineitem UNION ALL
  SELECT l_suppkey, 'disc', l_discount * 10 FROM lineitem UNION ALL SELECT l_suppkey, 'tax', l_tax * 10 FROM lineitem),
 s AS (SELECT g, criterion, count(*) AS n, sum(v + 1e-4) AS tot FROM m GROUP BY 1, 2),
 e AS (SELECT m.g, m.criterion, any_value(n) AS n,
   (1.0 - (-sum(((v + 1e-4) / tot) * ln((v + 1e-4) / tot)) / ln(any_value(n)))) + 1e-4 AS d
   FROM m JOIN s ON m.g = s.g AND m.criterion = s.criterion GROUP BY 1, 2)
SELECT g AS group_id, criterion, n, round(n / (n + 10.0) * d / sum(d) OVER (PARTITION BY g) + (1 - n / (n + 10.0)) / 3, 6) AS weight FROM e""")
def stat_entropy_weights(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = {"qty": F.col("l_quantity") / 50, "disc": F.col("l_discount") * 10, "tax": F.col("l_tax") * 10}
    m = li.select(F.col("l_suppkey").alias("group_id"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("criterion"), v.alias("value")) for k, v in cols.items()])))
    w = stats.entropy_weights(m)
    return w.select("group_id", "criterion", "n", F.round("weight", 6).alias("weight"))


@query("stat_group_percentiles", "R6", """SELECT event_id, round(CASE WHEN n <= 1 THEN 0.5 ELSE (r + (t - 1) / 2.0 - 1) / (n - 1) END, 6) AS pct FROM (
  SELECT event_id, count(*) OVER (PARTITION BY event_type) AS n, rank() OVER (PARTITION BY event_type ORDER BY value) AS r,
         count(*) OVER (PARTITION BY event_type, value) AS t FROM events)""")
def stat_group_percentiles(spark, sf):
    """event_type has a handful of values, so every group is hot: this runs the bucketed path."""
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    ranked = groups.joined_totals(groups.bucketed_ranks(ev, ["event_type"], ["value"]), ["event_type"], {"n": F.count(F.lit(1))})
    return ranked.select("event_id", F.round(groups.percentile(F.col("value_rank"), F.col("n")), 6).alias("pct"))


@query("stat_gini", "R15", f"""SELECT l_suppkey, count(*) AS n, round({GINI}, 6) AS gini FROM (SELECT l_suppkey, l_extendedprice AS v,
  rank() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_suppkey, l_extendedprice) - 1) / 2.0 AS r
  FROM lineitem) GROUP BY 1""")
def stat_gini(spark, sf):
    g = stats.gini(table(spark, sf, "lineitem"), "l_suppkey", "l_extendedprice")
    return g.select("l_suppkey", "n", F.round("gini", 6).alias("gini"))


def cuts_sql(points: str, classes: str, most: int) -> str:
    """CTEs ending in cut(ver, classes, cuts): natural breaks of points(ver, v, n) by the plain dynamic program over all pairs of places."""
    gap = "l.cost + (p.q - b.q) - (p.s - b.s) * (p.s - b.s) / (p.w - b.w)"
    return f"""pts AS ({points}),
 p AS (SELECT ver, v, row_number() OVER o AS i, sum(n) OVER o AS w, sum(n * v) OVER o AS s, sum(n * v * v) OVER o AS q FROM pts WINDOW o AS (PARTITION BY ver ORDER BY v)),
 lay(ver, k, i, cost, j) AS (SELECT ver, 1, i, q - s * s / w, CAST(0 AS BIGINT) FROM p UNION ALL
  SELECT l.ver, l.k + 1, p.i, min({gap}), arg_min(b.i, {gap}) FROM lay l JOIN p b ON b.ver = l.ver AND b.i = l.i JOIN p ON p.ver = l.ver AND p.i > l.i
  WHERE l.k < {most} GROUP BY l.ver, l.k, p.i),
 back(ver, classes, k, i) AS (SELECT lay.ver, k, k, i FROM lay JOIN (SELECT ver, max(i) AS top FROM p GROUP BY ver) t ON t.ver = lay.ver AND t.top = lay.i WHERE k IN ({classes})
  UNION ALL SELECT x.ver, x.classes, x.k - 1, l.j FROM back x JOIN lay l ON l.ver = x.ver AND l.k = x.k AND l.i = x.i WHERE x.k > 1),
 cut AS (SELECT back.ver, classes, list(v ORDER BY k) AS cuts FROM back JOIN p ON p.ver = back.ver AND p.i = back.i WHERE k < classes GROUP BY back.ver, classes)"""


CUT_FALLBACKS = {3: rules.CLAUSE_CUTS, 4: rules.DOCUMENT_CUTS, 6: rules.TIER_CUTS}


@query("stat_thresholds", "R17 R18 R19", f"""WITH RECURSIVE {cuts_sql("SELECT 0 AS ver, round(c_acctbal, 2) AS v, count(*) AS n FROM customer WHERE c_acctbal IS NOT NULL GROUP BY ALL", "3, 4, 6", 6)}
SELECT classes, (SELECT count(c_acctbal) FROM customer) AS sample_size, true AS is_data_derived, cuts FROM cut""")
def stat_thresholds(spark, sf):
    """Cuts of all account balances into three, four and six classes."""
    return thresholds.thresholds(table(spark, sf, "customer"), "c_acctbal", CUT_FALLBACKS)


def label_sql(score: str, cuts: str, kind: str) -> str:
    labels = ", ".join(quoted(x) for x in thresholds.KINDS[kind][1])
    return f"CASE WHEN {score} IS NOT NULL THEN [{labels}][len(list_filter({cuts}, lambda c: {score} >= c)) + 1] END"


def fixed_sql(kind: str) -> str:
    return "[" + ", ".join(str(c) for c in thresholds.KINDS[kind][0]) + "]"


#: Order values in thousands stand in for scores, the year of the order for the time of scoring.
def order_scores(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 1000).alias("score"),
                                             F.year("o_orderdate").alias("year"))


_VERSIONED = f"""o AS (SELECT o_orderkey AS doc_id, o_totalprice / 1000 AS score, CAST(year(o_orderdate) AS BIGINT) AS year FROM orders),
 y AS (SELECT DISTINCT year AS ver FROM o), {cuts_sql("SELECT y.ver, round(score, 0) AS v, count(*) AS n FROM o JOIN y ON o.year < y.ver GROUP BY y.ver, round(score, 0)", "4", 4)},
 made AS (SELECT y.ver, (SELECT count(*) FROM o WHERE year < y.ver) AS n, cuts FROM y LEFT JOIN cut ON cut.ver = y.ver),
 ver AS (SELECT ver AS version, n AS sample_size, n >= {rules.MIN_REFERENCE} AS is_data_derived, CASE WHEN n >= {rules.MIN_REFERENCE} THEN cuts ELSE {fixed_sql("document")} END AS cuts FROM made)"""


@query("stat_threshold_versions", "R17 R18 R19", f"WITH RECURSIVE {_VERSIONED} SELECT * FROM ver")
def stat_threshold_versions(spark, sf):
    """A version of the document cuts per year, from all earlier years."""
    made = thresholds.versions(order_scores(spark, sf), "score", F.col("year"), "document", digits=0)
    return made.select("version", "sample_size", "is_data_derived", "cuts")


@query("risk_levels_as_of", "R14 R19", f"""WITH RECURSIVE {_VERSIONED}
SELECT doc_id, version AS cut_version, {label_sql("score", "cuts", "document")} AS level FROM o JOIN ver ON version = year""")
def risk_levels_as_of(spark, sf):
    """Orders labelled by the cuts that were in force in their year, through stored versions."""
    scores = order_scores(spark, sf)
    path = scratch(spark, "cuts")
    thresholds.store(thresholds.versions(scores, "score", F.col("year"), "document", digits=0), path)
    rows = thresholds.as_of(scores, spark.read.parquet(path), "document", "score", F.col("year"))
    return rows.select("doc_id", "cut_version", "level")


@query("stat_recent_scores", "Q5", "SELECT c_acctbal FROM customer WHERE c_acctbal IS NOT NULL ORDER BY c_custkey DESC LIMIT 500")
def stat_recent_scores(spark, sf):
    return stats.recent_scores(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 500)


ROLL = f"""WITH c AS {ansi_clauses()}, r AS (SELECT *, CASE WHEN part_no % 7 = 0 THEN NULL ELSE part_no % 101 END AS risk_score,
   CASE WHEN part_no % 101 >= 70 THEN 'High' WHEN part_no % 101 >= 35 THEN 'Medium' WHEN part_no % 11 = 0 THEN NULL ELSE 'Low' END AS risk_level,
   CASE kind WHEN 0 THEN 'Payment' WHEN 1 THEN 'Termination' WHEN 2 THEN 'Liability' WHEN 3 THEN 'Confidentiality' WHEN 4 THEN 'Jurisdiction'
     WHEN 5 THEN 'Indemnity' WHEN 6 THEN 'Notices' ELSE 'Structured Field' END AS classification FROM c) """


def stored_clauses(spark, sf):
    """Clause rows as persisted after scoring, with gaps in score and level."""
    k = F.col("part_no") % 101
    return (kind_clauses(spark, sf)
            .withColumn("risk_score", F.when(F.col("part_no") % 7 != 0, k))
            .withColumn("risk_level", F.when(k >= 70, "High").when(k >= 35, "Medium").when(F.col("part_no") % 11 != 0, "Low")))


ADVICE = "CASE k " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in rules.RECOMMENDATIONS.items()) + " END"


@query("risk_roll_up", "R25", ROLL + f""", p AS (SELECT *, coalesce(risk_score, CASE coalesce(risk_level, 'None')
   WHEN 'High' THEN 90 WHEN 'Medium' THEN 55 WHEN 'Low' THEN 25 ELSE 5 END) + 0.0 AS v FROM r),
 g AS (SELECT doc_id, count(*) AS n_clauses, avg(v) AS m, {GINI} AS gini, count(*) FILTER (WHERE risk_level = 'High') AS high_count
  FROM (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY v) + (count(*) OVER (PARTITION BY doc_id, v) - 1) / 2.0 AS r FROM p) GROUP BY 1),
 t AS (SELECT doc_id, list(section_name ORDER BY o) FILTER (WHERE risk_level IN ('High', 'Medium')) AS secs,
   list_sort(list(DISTINCT classification) FILTER (WHERE risk_level IN ('High', 'Medium'))) AS kinds
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY v DESC, clause_id) AS o FROM p) WHERE o <= 5 GROUP BY 1),
 q AS (SELECT g.*, coalesce(secs, []) AS secs, list_filter(list_transform(coalesce(kinds, []), lambda k: {ADVICE}), lambda a: a IS NOT NULL) AS adv,
   CAST(round_even(least(100.0, m * (1 + 0.15 * gini)), 0) AS INT) AS risk_score FROM g JOIN t ON g.doc_id = t.doc_id)
SELECT doc_id, n_clauses, risk_score, high_count, round(high_count / (n_clauses + 0.0), 6) AS high_ratio,
 CASE WHEN risk_score >= 80 THEN 'Critical' WHEN risk_score >= 60 THEN 'High' WHEN risk_score >= 35 THEN 'Medium' ELSE 'Low' END AS risk_level,
 array_to_string(secs, '|') AS affected_sections, CASE WHEN len(adv) > 0 THEN array_to_string(adv, ' ') ELSE {quoted(rules.NO_RECOMMENDATION)} END AS recommendations FROM q""")
def risk_roll_up(spark, sf):
    out = risk.roll_up(stored_clauses(spark, sf))
    return out.select("doc_id", "n_clauses", "risk_score", "high_count", F.round("high_ratio", 6).alias("high_ratio"), "risk_level",
                      F.array_join("affected_sections", "|").alias("affected_sections"), "recommendations")


@query("risk_audit_context", "R26", ROLL + """, s AS (SELECT doc_id, list(line ORDER BY o) AS ls FROM (SELECT doc_id, o,
   concat(section_name, ': ', substr(text_content, 1, 200), '...') AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clause_id) AS o
   FROM r WHERE risk_level = 'High')) WHERE o <= 3 GROUP BY 1)
SELECT n.doc_id, total, high, medium, coalesce(array_to_string(ls, chr(10)), '') AS samples
FROM (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE risk_level = 'High') AS high, count(*) FILTER (WHERE risk_level = 'Medium') AS medium
      FROM r GROUP BY 1) n LEFT JOIN s ON s.doc_id = n.doc_id""")
def risk_audit_context(spark, sf):
    rows = stored_clauses(spark, sf)
    n = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("risk_level") == "High").alias("high"),
                                   F.count_if(F.col("risk_level") == "Medium").alias("medium"))
    line = F.concat("section_name", F.lit(": "), F.substring("text_content", 1, 200), F.lit("..."))
    top = risk.top_k(rows.filter(F.col("risk_level") == "High").withColumn("line", line), ["doc_id"], [F.col("clause_id").asc()], 3,
                     ["clause_id", "line"])
    return n.join(top, "doc_id", "left").select("doc_id", "total", "high", "medium", F.coalesce(F.array_join(
        F.transform("top", lambda t: t["line"]), "\n"), F.lit("")).alias("samples"))
