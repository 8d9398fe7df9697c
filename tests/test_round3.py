"""Steps that queries share: plain pattern forms, work made once, work made where its rows already are."""

from pyspark.sql import functions as F

from lexmill.functions import patterns as P
from lexmill.functions import text as X
from lexmill.operators import authenticity as A
from lexmill.operators import compare, features, graph
from lexmill.plans import trust
from lexmill.plans.corpus import papers

SF = "/root/testdata/sf0.001"
TEXTS = ["Pay USD 1,200.50 or 7% by 3rd day of March 4, 2024; 2024-01-09, 1/2/24. Rs. 5 lakh, US$9 million, x12% and 30days.",
         "Buyer shall not pay. Seller, Inc. must   deliver\tall goods within 10 Weeks, see SECTION 4.2 and clause 7. Late fee 5%.",
         "governed by the laws of the State of New York. Courts of Ohio. PENALTY of 3% and liquidated damages. Harbour 7 Ltd (\"Buyer 1\") and",
         "", "_12 days a1 day 5 days_ 6 days\x1c7 days\x0b8 days", "Interest rate up to 9 %, notice period of USD 40, 1.2,3% 4%"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_plain_forms_find_what_unicode_forms_find(spark):
    """A text of ASCII characters takes the plain form, any other the Unicode-aware one; both find the same."""
    df = spark.createDataFrame([(t,) for t in [*TEXTS, *[t + " é" for t in TEXTS], "٣ days, ₹١ and 5 days"]], "t string")
    for pattern in P.BEGINS:
        for ci in ((True,) if pattern in (P.LABELLED_NUMBER, P.JURISDICTION, P.PENALTY) else (True, False)):
            old = F.regexp_extract_all("t", F.lit(P.jvm(pattern, ci)), F.lit(0))
            bad = df.filter(~X.matches(F.col("t"), pattern, ci).eqNullSafe(old))
            assert bad.count() == 0, (pattern, ci, bad.collect())


def test_entity_graph_needs_no_join(spark):
    """Edges are made in the row of their document."""
    docs = spark.createDataFrame([(1, "Harbour Ltd (\"Buyer One\") agrees. Buyer shall pay USD 5 on 2024-01-09. Buyer shall pay USD 5 on 2024-01-09."), (2, "Seller must go now."), (3, "x")],
                                 "doc_id long, t string")
    nodes, edges = graph.entity_graph(docs, "t")
    assert "Join" not in plan(edges) and "Join" not in plan(nodes)
    label = {(r.doc_id, r.node_id): r.label for r in nodes.collect()}
    got = sorted((r.doc_id, label[r.doc_id, r.source_id], r.relation, label[r.doc_id, r.target_id]) for r in edges.collect())
    assert got == [(1, "Buyer", "shall", "pay USD 5 on 2024-01-09")] * 2 + [
        (1, "Buyer One", "dated", "2024-01-09"), (1, "Buyer One", "involves payment", "USD 5"),
        (2, "Seller", "must", "go now")]


def test_sides_hold_no_words_and_line_changes_meet_once(spark):
    pairs = spark.createDataFrame([(1, 10, 11)], "pair_id long, doc_a long, doc_b long")
    rows = spark.createDataFrame([(10, 1, "1. A", "x\ny\ny\nz"), (11, 2, "1. A", "y\nx\nw\r\nx"), (11, 3, "2. B", "only")],
                                 "doc_id long, clause_id long, section_name string, text_content string")
    a, b = compare.sided(pairs, rows, "a"), compare.sided(pairs, rows, "b")
    assert "bag" not in a.columns
    matches = spark.createDataFrame([(1, 1, 2), (1, 9, 3)], "pair_id long, a_id long, b_id long")
    out = compare.line_changes(matches, a, b)
    assert "FullOuter" not in plan(out)
    assert sorted(map(tuple, out.collect())) == [(1, 1, 2, 1, "-", "y"), (1, 1, 2, 2, "+", "w"), (1, 1, 2, 3, "-", "z"), (1, 1, 2, 4, "+", "x"),
                                                 (1, 9, 3, 1, "+", "only")]


def test_papers_are_dealt_to_all_cores(spark):
    """A file of one row group is one read task; the work on its rows is not."""
    assert papers(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_insurance_checks_read_documents_once(spark):
    docs = trust.typed_papers(spark, SF)
    assert "Union" not in plan(A.insurance_checks(docs.filter("document_type = 'Insurance Policy'")))


def test_semantic_consistency_types_no_document(spark):
    assert "regexp_count" not in plan(trust.trust_semantic(spark, SF)).lower()


def test_mentions_meet_subjects_in_one_join(spark):
    m = spark.createDataFrame([(1, 0, "Buyer"), (1, 1, "Quay"), (2, 0, None), (3, 0, "Seller")], "clause_id long, mention_no int, subject string")
    h = spark.createDataFrame([(1, "buyers"), (1, "BUYER"), (2, "x")], "clause_id long, subject string")
    out = features.subject_corroboration(m, h)
    assert plan(out).count("Join") == 1
    assert {(r.clause_id, r.mention_no): r.corroborated for r in out.collect()} == {(1, 0): True, (1, 1): False, (2, 0): False, (3, 0): False}
