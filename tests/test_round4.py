"""Duplicates as all pairs and as links."""

import random
from difflib import SequenceMatcher

import pytest

from lexmill.operators import pairs

COLUMNS = "doc_id long, clause_id long, section_name string, text_content string"


@pytest.fixture(scope="module")
def duplicated(spark):
    """Documents whose clauses share numbers, titles, values and whole texts, and what a comparison of all pairs finds in them."""
    rng = random.Random(5)
    said = ["Fees are due at once", "Fees are due at the end of a month", "Fees are due at once.", "The buyer bears all of the cost"]
    rows = []
    for doc in range(6):
        for i in range(14):
            name = rng.choice(["Section 2. Fees", "Section 2. Fees", "Section 2. Cost", "Section 3. Fees", "Notes", "Rent"])
            rows.append((doc, 100 * doc + i, name, "It says: " + rng.choice(said) + rng.choice(["", " of USD 5", " of USD 9", " in 4 days"])))
    df = spark.createDataFrame(rows, COLUMNS)
    facts = {r.clause_id: r for r in pairs.enriched(df).collect()}
    want, keys = {}, {}
    for doc, i, _, t in rows:
        f = facts[i]
        for topic in (f"number:{f.clause_number}" if f.clause_number else None, f"title:{f.title_key}" if f.title_key else None):
            if topic:
                keys.setdefault((doc, topic), []).append(i)
    for (doc, topic), ids in keys.items():
        if topic.startswith("title:") and not 2 <= len(ids) <= 4:
            continue
        for i in ids:
            for j in ids:
                a, b = facts[i], facts[j]
                if i >= j or topic.startswith("title:") and a.clause_number and a.clause_number == b.clause_number:
                    continue
                high = any(x and y and set(x) != set(y) for x, y in ((a.money, b.money), (a.dates, b.dates), (a.durations, b.durations)))
                if high or SequenceMatcher(None, a.low, b.low).ratio() < 0.97:
                    want[doc, "duplicate:clause " + topic, i, j] = "High" if high else "Medium"
    return df, want


@pytest.mark.parametrize("block", [2, 1024])
def test_duplicates_are_all_pairs(duplicated, block):
    df, want = duplicated
    found = pairs.duplicate_findings(pairs.enriched(df), block=block).collect()
    assert len(want) > 100 and len(found) == len(want)
    assert {(r.doc_id, r.topic, r.a_id, r.b_id): r.severity for r in found} == want


def test_links_connect_what_all_pairs_connect(duplicated):
    """Issues of duplicates have the same clauses and the same severity from links as from all pairs."""
    df, want = duplicated
    links = pairs.duplicate_findings(pairs.enriched(df), links=True).distinct().collect()
    assert {(r.doc_id, r.topic, r.a_id, r.b_id) for r in links} <= set(want) and len(links) < len(want)

    def issues(found):
        out = {}
        for (doc, topic, i, j), severity in found.items():
            old = [k for k in out if k[:2] == (doc, topic) and k[2] & {i, j}]
            ranks = [severity, *(out.pop(k) for k in old)]
            out[doc, topic, frozenset({i, j}.union(*(k[2] for k in old)))] = "High" if "High" in ranks else "Medium"
        return out
    assert issues({(r.doc_id, r.topic, r.a_id, r.b_id): r.severity for r in links}) == issues(want)


def test_texts_of_one_form_are_classified_once_and_alike(spark, monkeypatch):
    """Texts that differ in digits no rule can tell apart share a form; types and points are those of each text alone."""
    from pyspark.sql import functions as F

    from lexmill import rules
    from lexmill.operators import classify
    own = [*rules.CLAUSE_RULES, rules.ClauseRule("Form 16", ("net 30",), r"\bnet\s+\d{2}\b")]
    texts = ["Pay USD 12 net 30.", "Pay USD 99 net 31.", "Pay USD 77 net 3 0", "pay usd 12 NET 30.", "Form 16\nnet 5", "Form 17\nnet 5", "Late fee of 5%", "Late fee of 7%",
             "Net ٣٠ days", "", None, None, "Governed by the laws of Ohio", "net 300", "net 00"] + [f"Fee of {i}{i} by {j}" for i in range(9) for j in range(9)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for some in (None, own, [rules.ClauseRule("A", ("x",), r"\bfee of 3"), rules.ClauseRule("B", ("33 by",), "zz")], [rules.ClauseRule("C", ("00 by",), "zz")]):
        want = {r.i: (r.clause_type, r.clause_points) for r in classify.with_clause_type(df, F.col("t"), some).collect()}
        got = classify.with_type_of_alike(df, F.col("t"), some)
        assert got.columns == ["i", "t", "clause_type", "clause_points"] and {r.i: (r.clause_type, r.clause_points) for r in got.collect()} == want
    assert df.select(classify.alike_key(F.col("t")).alias("k")).distinct().count() < 20
    monkeypatch.setattr(classify, "LOOKUP_TEXTS", 5)
    assert "Join" not in classify.with_type_of_alike(df, F.col("t"))._jdf.queryExecution().optimizedPlan().toString()


def test_rule_changes_are_found_in_one_pass(spark):
    from pyspark.sql import functions as F

    from lexmill.operators import audit
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.choice("abcdef"), rng.choice(["P", "T", "S"]), i, rng.random() < 0.5, rng.random() < 0.6) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id int, text string, clause_type string, ord int, b boolean, a boolean")
    want = audit.set_changes(df.filter("b"), df.filter("a"))
    got = audit.set_changes_of(df, F.col("b"), F.col("a"))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_dependencies_inside_a_document_are_those_of_the_joins(spark):
    """Windows over rows that lie with their document give the same lists as edges, joins and groupings, and move no row."""
    from lexmill.operators import features
    rng = random.Random(8)
    kinds = ["Termination", "Liability", "Indemnity", "Payment", "Compliance", "Jurisdiction", "Confidentiality", None]
    rows = []
    for doc in range(30):
        for i in range(rng.randrange(1, 12)):
            names = " and ".join(f"{rng.choice(['Section', 'Clause'])} {rng.randrange(1, 6)}" for _ in range(rng.randrange(4)))
            rows.append((doc, 100 * doc + i, rng.choice([f"{rng.randrange(1, 6)}. Title", "Section 2", " 3 x"]), "see " + names, rng.choice(kinds)))
    df = spark.createDataFrame(rows, COLUMNS + ", classification string").repartition("doc_id")
    joined = features.with_dependencies(df, features.dependency_lists(df, pairs.dependencies(df)))
    got = features.with_own_dependencies(df)
    want = {r.clause_id: [tuple(d) for d in r.dependencies] for r in joined.collect()}
    assert sum(map(len, want.values())) > 50
    assert {r.clause_id: [tuple(d) for d in r.dependencies] for r in got.collect()} == want
    assert got.columns == joined.columns or set(got.columns) == set(joined.columns)


def test_clauses_are_dealt_once_for_their_scores(spark):
    """Signals, means, ranks and weights of ordinary documents are made where their lines were dealt, without a join of clauses."""
    from lexmill.plans import scores
    out = scores.scored(spark, "/root/testdata/sf0.001", carry=("text_content", "evidence")).select("clause_id", "lrsi", "evidence")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert text.count("hashpartitioning(") == 1 and "SortMergeJoin" not in text


def test_pools_are_dealt_once_for_their_scores(spark):
    """Word statistics and scores of ordinary pools are made where their lines were dealt."""
    from lexmill.plans import search
    out = search.search_fusion(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning(" in line]
    assert moved and all("hashpartitioning(l_orderkey" in line for line in moved)


def test_scores_are_the_same_where_a_document_is_very_large(spark, monkeypatch):
    """With keys of very large documents at hand nothing is dealt by document; scores, evidence and word scores are the same."""
    from lexmill.plans import scores, search
    sf = "/root/testdata/sf0.001"

    def made():
        return [sorted(map(str, run(spark, sf).collect())) for run in (scores.risk_explanations, search.search_fusion)]
    want = made()
    monkeypatch.setattr(scores, "counted_keys", scores.document_keys)
    monkeypatch.setattr(search, "counted_keys", scores.document_keys)
    assert made() == want
