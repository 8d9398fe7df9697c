"""Registered retrieval and graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import rules
from ..functions import patterns as P
from ..operators import graph, pairs, retrieve, segment, vector_index
from ..session import spread
from .corpus import ansi_clauses, clauses, scratch, table
from .facts import _PARTY_TEXT
from .registry import query, quoted, rx
from .scores import ROLL, counted_keys, stored_clauses, with_vectors

VEC = f"""WITH c AS {ansi_clauses()}, v AS (SELECT doc_id, clause_id, supp_no % 10 AS user_id, text_content, CAST(embedding AS DOUBLE[]) AS e FROM c
  JOIN embeddings ON vec_id = part_no % (SELECT count(*) FROM embeddings)),
 q AS (SELECT vec_id AS query_id, vec_id % 10 AS user_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 s AS (SELECT query_id, clause_id AS vec_key, text_content, list_cosine_similarity(q.e, v.e) AS sim FROM q JOIN v ON q.user_id = v.user_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_key) AS rank FROM s) """


def questions(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("query_id"), (F.col("vec_id") % 10).alias("user_id"), "embedding")


def pool_rows(spark, sf):
    """Clauses with their owner and the number of their vector."""
    n = table(spark, sf, "embeddings").agg(F.count(F.lit(1))).scalar()
    return clauses(spark, sf).select("doc_id", F.col("clause_id").alias("vec_key"), (F.col("supp_no") % 10).alias("user_id"), "text_content", "kind",
                                     F.pmod("part_no", n).alias("vec_id"))


def top_pool(spark, sf, k):
    """Vectors repeat, so each is scored once per owner, and similarities are rounded before ranking to keep ties ties."""
    return retrieve.nearest_stored(questions(spark, sf), pool_rows(spark, sf), table(spark, sf, "embeddings"), "vec_id", k, ["user_id"])


@query("search_nearest", "V1", VEC + "SELECT query_id, rank, round(sim + 1e-8, 5) AS similarity FROM k WHERE rank <= 5")
def search_nearest(spark, sf):
    return top_pool(spark, sf, 5).select("query_id", "rank", F.round(F.col("similarity") + 1e-8, 5).alias("similarity"))


@query("search_nearest_scores", "V1", VEC + "SELECT query_id, count(*) AS n, round(sum(sim), 4) AS total FROM k WHERE rank <= 20 GROUP BY 1")
def search_nearest_scores(spark, sf):
    return top_pool(spark, sf, 20).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("similarity"), 4).alias("total"))


def clause_index(spark, sf):
    """A vector index of all clauses, written to the shared folder."""
    path = scratch(spark, "index")
    rows = with_vectors(clauses(spark, sf), spark, sf).select(F.col("clause_id").alias("vec_key"), (F.col("supp_no") % 10).alias("user_id"), "embedding")
    vector_index.build(rows, path, ["user_id"])
    return path


@query("search_index_exact", "V1", VEC + "SELECT query_id, rank, round(sim + 1e-8, 5) AS similarity FROM k WHERE rank <= 20")
def search_index_exact(spark, sf):
    """Every question against all lists of the stored index."""
    found = vector_index.search(questions(spark, sf), clause_index(spark, sf), 20, ["user_id"], exact=True)
    return found.select("query_id", "rank", F.round(F.col("similarity") + 1e-8, 5).alias("similarity"))


@query("search_index_recall", "V1")
def search_index_recall(spark, sf):
    """The share of the twenty true neighbours of each question that the lists it probes hold."""
    path, asked = clause_index(spark, sf), questions(spark, sf)
    found, true = (vector_index.search(asked, path, 20, ["user_id"], exact=e) for e in (False, True))
    return vector_index.recall_of(found, true)


@query("search_two_stage", "V2 V5")
def search_two_stage(spark, sf):
    pool = top_pool(spark, sf, 20).join(pool_rows(spark, sf).drop("vec_id", "user_id"), "vec_key")
    best = retrieve.rerank(pool, F.size(retrieve.tokens(F.col("text_content"))).cast("double"), 5)
    return retrieve.context_blocks(best.withColumn("classification", F.concat(F.lit("Kind "), "kind")), "final_rank")


ASK = "concat('late fee ', l_suppkey % 7, ' usd invoice section ', l_suppkey % 5)"
POOL = f"""c AS {ansi_clauses()}, p AS (SELECT order_key AS query_id, clause_id AS doc_key, text_content, concat('late fee usd invoice section ', order_key % 7) AS q,
   row_number() OVER (PARTITION BY order_key ORDER BY clause_id) - 1 AS vr FROM c),
 tk AS (SELECT query_id, doc_key, unnest(regexp_extract_all(lower(text_content), '[a-z0-9]+', 0)) AS term FROM p),
 dl AS (SELECT query_id, doc_key, count(*) AS dl FROM tk GROUP BY 1, 2), tf AS (SELECT query_id, doc_key, term, count(*) AS tf FROM tk GROUP BY 1, 2, 3),
 sz AS (SELECT query_id, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY 1),
 i0 AS (SELECT tf.query_id, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf JOIN sz ON sz.query_id = tf.query_id GROUP BY 1, 2),
 idf AS (SELECT query_id, term, CASE WHEN idf < 0 THEN 0.25 * avg(idf) OVER (PARTITION BY query_id) ELSE idf END AS idf FROM i0),
 qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+', 0)) AS term FROM (SELECT DISTINCT query_id, q FROM p)) GROUP BY 1, 2),
 b AS (SELECT tf.query_id, tf.doc_key, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS bm25 FROM tf JOIN qt ON qt.query_id = tf.query_id AND qt.term = tf.term
   JOIN idf ON idf.query_id = tf.query_id AND idf.term = tf.term JOIN dl ON dl.query_id = tf.query_id AND dl.doc_key = tf.doc_key JOIN sz ON sz.query_id = tf.query_id GROUP BY 1, 2)"""


def order_pool(spark, sf):
    from ..operators import groups
    keys = counted_keys(spark, sf).withColumnRenamed("doc_id", "query_id")
    # Without a very large pool the lines are dealt by pool once, and words, statistics and scores stay there.
    c = clauses(spark, sf, by_document=keys.isEmpty()).select(F.col("order_key").alias("query_id"), F.col("clause_id").alias("doc_key"), "text_content")
    c = c.withColumn("q", F.concat(F.lit("late fee usd invoice section "), (F.col("query_id") % 7).cast("string")))
    return retrieve.bm25(groups.numbered(c, ["query_id"], "doc_key", "vr", keys=keys).withColumn("vr", F.col("vr") - 1), "q", "text_content")


@query("search_bm25", "V3", f"WITH {POOL} SELECT p.query_id, p.doc_key, round(coalesce(bm25, 0.0), 5) AS bm25 FROM p LEFT JOIN b ON b.query_id = p.query_id AND b.doc_key = p.doc_key")
def search_bm25(spark, sf):
    return order_pool(spark, sf).select("query_id", "doc_key", F.round("bm25", 5).alias("bm25"))


@query("search_fusion", "V4", f"""WITH {POOL}, r AS (SELECT p.query_id, p.doc_key, vr, row_number() OVER (PARTITION BY p.query_id ORDER BY round(coalesce(bm25, 0.0), 9) DESC, vr) - 1 AS br
  FROM p LEFT JOIN b ON b.query_id = p.query_id AND b.doc_key = p.doc_key)
SELECT query_id, doc_key, row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / (60 + vr) + 1.0 / (60 + br), 12) DESC, vr) - 1 AS fused_rank FROM r""")
def search_fusion(spark, sf):
    pool = order_pool(spark, sf).withColumn("bm25", F.round("bm25", 9))
    return retrieve.reciprocal_fusion(pool, "vr", "bm25").select("query_id", "doc_key", "fused_rank")


_EVAL = ("CASE c_custkey % 6 WHEN 0 THEN concat(c_custkey % 100, '%') WHEN 1 THEN concat('0.', c_custkey % 10) WHEN 2 THEN concat(c_custkey % 130, '.4') "
         "WHEN 3 THEN 'true' WHEN 4 THEN 'high' ELSE '1' END")
_N = "CASE WHEN v = 'true' THEN 1.0 ELSE TRY_CAST(regexp_replace(v, '%+$', '') AS DOUBLE) END"


@query("search_groundedness", "V7", f"""SELECT c_custkey, score, 100 - score AS trust, CASE WHEN score <= 20 THEN 'High' WHEN score <= 50 THEN 'Medium' WHEN score IS NOT NULL THEN 'Low' END AS label,
  c_custkey % 2 = 0 AS refusal FROM (SELECT c_custkey, CASE WHEN n IS NULL THEN NULL ELSE greatest(0, least(100, CAST(round_even(CASE WHEN n BETWEEN 0 AND 1 THEN n * 100 ELSE n END, 0) AS INT))) END AS score
  FROM (SELECT c_custkey, {_N} AS n FROM (SELECT c_custkey, {_EVAL} AS v FROM customer)))""")
def search_groundedness(spark, sf):
    rows = table(spark, sf, "customer").withColumn("score", retrieve.percent_score(F.expr(_EVAL)))
    answer = F.when(F.col("c_custkey") % 2 == 0, " Not applicable.! ").otherwise("Applicable.")
    return rows.select("c_custkey", "score", (100 - F.col("score")).alias("trust"), retrieve.groundedness(F.col("score")).alias("label"),
                       retrieve.is_refusal(answer).alias("refusal"))


def entity_docs(spark, sf):
    text = F.concat(F.expr(_PARTY_TEXT), F.lit(" Payment of USD "), (F.col("c_custkey") % 900).cast("string"), F.lit(
        " due 2024-01-0"), (1 + F.col("c_custkey") % 9).cast("string"), F.lit(". Penalty of 5% applies. Governed by the laws of Texas. Buyer shall pay promptly."))
    return spread(table(spark, sf, "customer")).select(F.col("c_custkey").alias("doc_id"), text.alias("full_text"))


@query("graph_entities", "H1 B2", """SELECT c_custkey AS doc_id, unnest(['party', 'date', 'money', 'penalty', 'jurisdiction', 'obligation']) AS node_type,
  unnest([3, 1, 2, 1, 1, 1]) AS n FROM customer""")
def graph_entities(spark, sf):
    nodes, _ = graph.entity_graph(entity_docs(spark, sf), "full_text")
    return nodes.groupBy("doc_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_entity_edges", "H1", """SELECT c_custkey AS doc_id, unnest(['shall', 'governed by', 'dated', 'involves payment', 'subject to']) AS relation, unnest([1, 1, 1, 2, 1]) AS n FROM customer""")
def graph_entity_edges(spark, sf):
    _, edges = graph.entity_graph(entity_docs(spark, sf), "full_text")
    return edges.groupBy("doc_id", "relation").agg(F.count(F.lit(1)).alias("n"))


def _found(kind: str, pattern: str, part: int, form: str = "x", ci: bool = True) -> str:
    return (f"SELECT doc_id, '{kind}' AS node_type, {form} AS key FROM (SELECT doc_id, trim(regexp_extract(unnest(regexp_extract_all(t, {rx(pattern, ci)}, 0)), "
            f"{rx(pattern, ci)}, {part})) AS x FROM d)")


@query("graph_document_entities", "H1 B2", f"""WITH c AS {ansi_clauses()}, d AS (SELECT doc_id, string_agg(text_content, chr(10) || chr(10) ORDER BY clause_id) AS t FROM c GROUP BY 1)
SELECT doc_id, node_type, count(*) AS n FROM ({_found("party", P.PARTY, 2, "lower(x)", False)} UNION {_found("date", P.DATE, 0)} UNION {_found("money", P.MONEY, 0)}
 UNION {_found("penalty", P.PENALTY, 0, "lower(x)")} UNION {_found("jurisdiction", P.JURISDICTION, 1, "lower(x)")}
 UNION {_found("party", P.OBLIGATION, 1, "lower(x)", False)} UNION {_found("obligation", P.OBLIGATION, 3, "lower(x)", False)}) GROUP BY 1, 2""")
def graph_document_entities(spark, sf):
    """Entities of the whole text of each document."""
    docs = segment.document_text(clauses(spark, sf), "clause_id", "text_content").select("doc_id", "full_text")
    nodes, _ = graph.entity_graph(docs, "full_text")
    return nodes.groupBy("doc_id", "node_type").agg(F.count(F.lit(1)).alias("n"))


@query("graph_unified", "H2 B2")
def graph_unified(spark, sf):
    rows = stored_clauses(spark, sf)
    docs = segment.document_text(rows, "clause_id", "text_content").select("doc_id", "full_text")
    nodes, edges = graph.entity_graph(docs, "full_text", keep=True)
    _, kept = graph.unified(rows, nodes, edges, pairs.dependencies(rows))
    return kept.groupBy("doc_id", "relation").agg(F.count(F.lit(1)).alias("n"))


_PARTS = "(SELECT max(l_partkey) FROM lineitem)"
EDGES_SQL = f"SELECT DISTINCT l_suppkey AS doc_id, l_partkey AS source_id, 1 + (l_partkey * 7 + l_linenumber) % {_PARTS} AS target_id FROM lineitem"


def edge_rows(spark, sf):
    """Part-to-part links, a sparse graph per supplier."""
    li = table(spark, sf, "lineitem")
    last = li.agg(F.max("l_partkey")).scalar()
    return li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("source_id"),
                     (F.lit(1) + (F.col("l_partkey") * 7 + F.col("l_linenumber")) % last).alias("target_id"), F.lit("links").alias("relation")).distinct()


@query("graph_dependents", "H4", f"SELECT doc_id, target_id AS node, source_id AS dependent FROM ({EDGES_SQL})")
def graph_dependents(spark, sf):
    return graph.dependents(edge_rows(spark, sf))


@query("graph_reachable", "H5", f"""WITH RECURSIVE e AS ({EDGES_SQL}), w(doc_id, start, node, hop) AS (SELECT doc_id, source_id, target_id, 1 FROM e
  UNION SELECT w.doc_id, start, target_id, hop + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.source_id = w.node WHERE hop < 3)
SELECT doc_id, start, node, min(hop) AS hop FROM w WHERE start <> node GROUP BY 1, 2, 3""")
def graph_reachable(spark, sf):
    return graph.reachable(edge_rows(spark, sf), 3)


@query("graph_shortest_paths", "H6", f"""WITH RECURSIVE e AS ({EDGES_SQL}), w(doc_id, source, node, hop) AS (SELECT DISTINCT doc_id, source_id, source_id, 0 FROM e
  UNION SELECT w.doc_id, source, target_id, hop + 1 FROM w JOIN e ON e.doc_id = w.doc_id AND e.source_id = w.node WHERE hop < 30)
SELECT doc_id, source, node AS target, min(hop) + 1 AS n_nodes FROM w WHERE node = 1 + (source * 49 + 29) % {_PARTS} GROUP BY 1, 2, 3""")
def graph_shortest_paths(spark, sf):
    e = edge_rows(spark, sf)
    last = table(spark, sf, "lineitem").agg(F.max("l_partkey")).scalar()
    want = e.select("doc_id", F.col("source_id").alias("source")).distinct().withColumn("target", F.lit(1) + (F.col("source") * 49 + 29) % last)
    return graph.shortest_paths(e, want).select("doc_id", "source", "target", F.size("path").alias("n_nodes"))


@query("graph_ego", "H7", f"""WITH e AS ({EDGES_SQL}), u AS (SELECT doc_id, source_id AS a, target_id AS b FROM e UNION SELECT doc_id, target_id, source_id FROM e),
 ball AS (SELECT DISTINCT doc_id, a AS centre, b AS node FROM u UNION SELECT DISTINCT doc_id, a, a FROM u)
SELECT e.doc_id, x.centre, count(*) AS n_edges FROM e JOIN ball x ON x.doc_id = e.doc_id AND x.node = e.source_id
 JOIN ball y ON y.doc_id = e.doc_id AND y.centre = x.centre AND y.node = e.target_id GROUP BY 1, 2""")
def graph_ego(spark, sf):
    e = edge_rows(spark, sf)
    centres = e.select("doc_id", F.col("source_id").alias("centre")).unionByName(e.select("doc_id", F.col("target_id").alias("centre"))).distinct()
    return graph.ego_edges(e, centres, 1).groupBy("doc_id", "centre").agg(F.count(F.lit(1)).alias("n_edges"))
