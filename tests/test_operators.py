"""Hand-computed and brute-force checks on small inline rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunking, similarity
from lexmill.functions import text as X
from lexmill.operators import (authenticity, classify, compare, groups, maintain, near_text, normalize, pairs, retrieve, risk, segment, stats,
                               thresholds)


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_money_terms(spark):
    got = col(spark, ["USD 5 million", "Rs. 50,000", "12.5%", "$,", "advisers 5"], lambda v: X.financial_terms(v, X.money(v)))
    assert [(t["amount"], t["currency"], t["is_percentage"]) for t in (g[0] for g in got[:4])] == [
        (5e6, "USD", False), (50000.0, "INR", False), (12.5, None, True), (None, "USD", False)]
    assert got[4] == []


def test_headings(spark):
    lines = ["GOVERNING LAW", "Conditions of Coverage", "1. Term", "Customer shall pay", "the party agrees, as follows"]
    assert col(spark, lines, X.is_heading) == [True, True, True, True, False]
    assert col(spark, lines, lambda v: X.is_heading(v, True)) == [True, True, True, False, False]


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_percentiles(spark, hot_rows):
    rows = [(1, i, v) for i, v in enumerate([1.0, 2.0, 2.0, 4.0])] + [(2, 10, 7.0)] + [(3, 20 + i, 5.0) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id int, item int, v double")
    ranked = groups.window_totals(groups.group_ranks(df, ["doc_id"], ["v"], hot_rows), ["doc_id"], {"n": F.count(F.lit(1))})
    got = {r["item"]: r["p"] for r in ranked.select("item", groups.percentile(F.col("v_rank"), F.col("n")).alias("p")).collect()}
    assert got == {0: 0.0, 1: 0.5, 2: 0.5, 3: 1.0, 10: 0.5, 20: 0.5, 21: 0.5, 22: 0.5}


def test_hot_and_ordinary_scores_agree(spark):
    rng = random.Random(7)
    cols = [f"raw_{d}" for d in risk.RANKED] + ["f_ambiguity", "feature_confidence"] + [f"e_{d}" for d in risk.LOWER]
    rows = [(d, d * 100 + i, *[round(rng.random(), 2) for _ in cols]) for d, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, clause_id long, " + ", ".join(f"{c} double" for c in cols))
    plain = {r["clause_id"]: r for r in risk.score_clauses(df).select("clause_id", "lrsi", "risk_confidence").collect()}
    split = {r["clause_id"]: r for r in risk.score_clauses(df, hot_rows=5).select("clause_id", "lrsi", "risk_confidence").collect()}
    assert plain.keys() == split.keys() and len(plain) == 44
    for k in plain:
        assert plain[k]["lrsi"] == pytest.approx(split[k]["lrsi"]) and 0 <= plain[k]["lrsi"] <= 100
        assert plain[k]["risk_confidence"] == pytest.approx(split[k]["risk_confidence"])


def test_running_number_and_order(spark):
    df = spark.createDataFrame([(g, o) for g in (1, 2) for o in range(0, 70, 3)], "g int, o long")
    got = groups.running_number(df, ["g"], "o", rows=5).collect()
    assert all(r["rn"] == r["o"] // 3 + 1 for r in got)
    rows = [(1, i, i) for i in range(20)] + [(2, i, 19 - i if i == 12 else i) for i in range(20)]
    flags = groups.in_order(spark.createDataFrame(rows, "g int, o long, v long"), ["g"], "o", "v", rows=4)
    assert {r["g"]: (r["n_numbered"], r["ordered"]) for r in flags.collect()} == {1: (20, True), 2: (20, False)}


def test_entropy_weights(spark):
    rng = random.Random(3)
    data = [[rng.random() for _ in range(5)] for _ in range(7)]
    rows = [(1, i, f"c{j}", v) for i, r in enumerate(data) for j, v in enumerate(r)] + [(2, 0, "a", 0.3), (2, 0, "b", 0.9)]
    got = {(r["group_id"], r["criterion"]): r["weight"] for r in stats.entropy_weights(
        spark.createDataFrame(rows, "group_id int, item int, criterion string, value double")).collect()}
    eps, info = 1e-4, []
    for j in range(5):
        column = [r[j] + eps for r in data]
        shares = [x / sum(column) for x in column]
        info.append(1 + sum(p * math.log(p) for p in shares) / math.log(7) + eps)
    for j in range(5):
        assert got[(1, f"c{j}")] == pytest.approx(7 / 17 * info[j] / sum(info) + 10 / 17 / 5)
    assert got[(2, "a")] == got[(2, "b")] == 0.5


def test_gini(spark):
    rows = [(1, 0.0), (1, 0.0), (2, 1.0), (2, 1.0), (2, 1.0), (3, 0.0), (3, 0.0), (3, 0.0), (3, 1.0)]
    got = {r["g"]: r["gini"] for r in stats.gini(spark.createDataFrame(rows, "g int, v double"), "g", "v").collect()}
    assert got == {1: 0.0, 2: pytest.approx(0.0), 3: pytest.approx(0.75)}


def brute_breaks(values, classes):
    data, best = sorted(values), None
    for cuts in itertools.combinations(range(1, len(data)), classes - 1):
        parts = [data[a:b] for a, b in zip((0, *cuts), (*cuts, len(data)))]
        cost = sum(sum((x - sum(p) / len(p)) ** 2 for x in p) for p in parts)
        if best is None or cost < best[0] - 1e-12:
            best = (cost, [p[-1] for p in parts[:-1]])
    return best[1]


@pytest.mark.parametrize("classes", [2, 3, 4])
def test_natural_breaks(classes):
    rng = random.Random(classes)
    for n in (4, 9, 22):
        values = [round(rng.gauss(c, 3), 1) for c in (10, 25, 90) for _ in range(n)]
        kept, counts = np.unique(values, return_counts=True)
        splits = thresholds.Splits(kept, counts.astype("float64"), classes)
        assert splits.cuts(classes) == brute_breaks(values, classes)


def test_thresholds(spark):
    rng = random.Random(5)
    values = [round(rng.gauss(c, 2), 2) for c in (10, 40, 90) for _ in range(10)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").crossJoin(spark.range(3))
    row = thresholds.thresholds(df, "v", {3: (35.0, 70.0)}).first()
    assert (list(row["cuts"]), row["sample_size"], row["is_data_derived"]) == (brute_breaks(values, 3), 90, True)
    few = thresholds.thresholds(spark.createDataFrame([(1.0,)] * 5, "s double"), "s", {3: (35.0, 70.0)}).first()
    assert (list(few["cuts"]), few["is_data_derived"]) == ([35.0, 70.0], False)
    none = thresholds.thresholds(spark.createDataFrame([], "s double"), "s", {3: (35.0, 70.0)}).first()
    assert (list(none["cuts"]), none["sample_size"]) == ([35.0, 70.0], 0)
    same = thresholds.thresholds(spark.createDataFrame([(7.0,)] * 40, "s double"), "s", {3: (35.0, 70.0)}).first()
    assert list(same["cuts"]) == [7.0, 7.0]


def test_levels_follow_the_version_of_their_time(spark, tmp_path):
    path = str(tmp_path / "cuts")
    stored = lambda rows: thresholds.store(spark.createDataFrame(rows, "kind string, version long, cuts array<double>"), path)
    stored([("clause", 2, [10.0, 20.0]), ("clause", 5, [50.0, 60.0]), ("document", 3, [1.0, 2.0, 3.0])])
    stored([("clause", 5, [30.0, 40.0])])
    rows = spark.createDataFrame([(1, 1, 36.0), (2, 2, 20.0), (3, 4, 9.0), (4, 5, 40.0), (5, 9, 30.0), (6, 9, None)], "k int, at int, s double")
    got = {r["k"]: (r["cut_version"], r["level"]) for r in thresholds.as_of(rows, spark.read.parquet(path), "clause", "s", F.col("at")).collect()}
    assert got == {1: (None, "Medium"), 2: (2, "High"), 3: (2, "Low"), 4: (5, "High"), 5: (5, "Medium"), 6: (5, None)}


def test_components(spark):
    e = spark.createDataFrame([("t", 1, 2), ("t", 2, 3), ("t", 5, 6), ("u", 3, 5)], "g string, a int, b int")
    got = {(r["g"], r["node"]): r["component"] for r in pairs.components(e, ["g"]).collect()}
    assert got == {("t", 1): 1, ("t", 2): 1, ("t", 3): 1, ("t", 5): 5, ("t", 6): 5, ("u", 3): 3, ("u", 5): 3}


def test_pivoted_conflicts_match_all_pairs(spark):
    rng = random.Random(11)
    for _ in range(3):
        members = [(1, i, sorted(rng.sample("abcdef", rng.choice([1, 2, 3])))) for i in range(14)]
        parent = {i: i for _, i, _ in members}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x
        touched = set()
        for (_, i, a), (_, j, b) in itertools.combinations(members, 2):
            if not set(a) & set(b):
                touched |= {i, j}
                x, y = sorted((root(i), root(j)))
                parent[y] = x
        want = {}
        for i in touched:
            want.setdefault(root(i), set()).add(i)
        df = spark.createDataFrame(members, "doc_id int, clause_id int, sig array<string>")
        out = {}
        for r in pairs.pivoted(df, lambda a, b: ~F.arrays_overlap(a, b), ["doc_id"], "sig").collect():
            out.setdefault(r["component"], set()).add(r["clause_id"])
        assert sorted(map(sorted, out.values())) == sorted(map(sorted, want.values()))


def test_near_copies(spark):
    rows = [(1, 0, "A penalty of 8% applies to late sums of the buyer.", 0.4), (1, 1, "A penalty of 2% applies to late sums of the buyer.", 0.9),
            (1, 2, "The cover of this policy starts on 1 May for the insured party.", 0.4),
            (1, 3, "The cover of this policy starts on 1 May for the insured person.", 0.8)]
    kept = segment.fold_near_copies(spark.createDataFrame(rows, "doc_id int, block_no int, text_content string, confidence_score double"))
    assert sorted((r["slot_no"], r["block_no"]) for r in kept.collect()) == [(0, 0), (1, 1), (2, 3)]


def test_semantic_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(d, 1000 * d + i, rng.normal(size=8).tolist()) for d, n in ((1, 5), (2, 90), (3, 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, (3, 9999, None)], "doc_id long, clause_id long, embedding array<double>")
    unit = {c: np.array(v) / np.linalg.norm(v) for _, c, v in rows}
    gone = {(2, 2001, 2002), (1, 1000, 1001)}
    want = {(d, a, b) for d, a, _ in rows for e, b, _ in rows if d == e and a < b and unit[a] @ unit[b] >= 0.35} - gone
    flagged = spark.createDataFrame(sorted(gone), "doc_id long, a_id long, b_id long")
    for few, block in ((64, 1024), (0, 20), (3, 1)):
        monkeypatch.setattr(pairs, "FEW_CLAUSES", few)
        monkeypatch.setattr(pairs, "BLOCK_CLAUSES", block)
        got = [(r["doc_id"], r["a_id"], r["b_id"]) for r in pairs.semantic_candidates(df, flagged).collect()]
        assert set(got) == want and len(got) == len(want)
    assert pairs.semantic_candidates(df, flagged, limit=2).groupBy("doc_id").count().filter("count > 2").isEmpty()


def test_near_pairs(spark):
    rng = random.Random(7)
    words = "alpha beta gamma delta eps the of and to".split()
    texts = [" ".join(rng.choices(words, [1, 1, 1, 1, 1, 5, 5, 5, 5], k=rng.randrange(0, 14))) for _ in range(160)]
    texts += ["The, of. THE;", "\u00c9t\u00e9 caf\u00e9", "\u00e9t\u00e9 (caf\u00e9)", ""]
    groups_ = [rng.randrange(3) for _ in texts]

    def bag(t):
        return collections.Counter(w for w in re.split(r"[\s.,;()]+", t.lower()) if w)

    def ratio(a, b):
        return 2 * sum((bag(a) & bag(b)).values()) / (sum(bag(a).values()) + sum(bag(b).values()))
    df = spark.createDataFrame(list(zip(range(len(texts)), groups_, texts)), "k int, g int, t string").withColumn("bag", similarity.bag(F.col("t")))
    for least in (0.5, 0.8, 0.97):
        want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if groups_[i] == groups_[j] and bag(texts[i]) and bag(texts[j])
                and ratio(texts[i], texts[j]) >= least - 1e-9}
        assert {(r["a"], r["b"]) for r in near_text.near_pairs(df, ["g"], "k", "bag", least).collect()} == want
    assert [r[0] for r in spark.createDataFrame([("abc", "abd"), ("", ""), (None, "a")], "a string, b string").select(
        F.round(similarity.edit_ratio(F.col("a"), F.col("b")), 4)).collect()] == [0.6667, 1.0, 0.0]


def test_segments(spark):
    text = "Intro line\n\nTERMS\nbody one here\n1. first point is this\n2. second point is that\n- a bullet of text\n\nOther Heading Of Things\nlast line text"
    df = spark.createDataFrame([(1, text)], "doc_id int, t string")
    blocks = [r["block"] for r in segment.candidate_blocks(df, "t", False).orderBy("block_no").collect()]
    assert blocks == ["Intro line", "TERMS\nbody one here", "1. first point is this", "2. second point is that", "- a bullet of text",
                      "Other Heading Of Things\nlast line text"]
    words = spark.createDataFrame([(1, "b", 5.0, 10.2), (1, "a", 1.0, 11.9), (1, "c", 2.0, 14.0)], "p int, text string, x0 double, top double")
    assert [r["line"] for r in segment.lines_from_words(words, ["p"]).orderBy("line_no").collect()] == ["a b", "c"]


def test_chunks():
    text = " ".join(f"word{i}" for i in range(600))
    parts = chunking.split_text(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and parts[0].startswith("word0 ") and parts[-1].endswith("word599")
    for a, b in zip(parts, parts[1:]):
        assert b.split(" ")[0] in a


def test_first_rule_wins_ties(spark):
    df = spark.createDataFrame([("terminate and be liable",), ("nothing here",)], "t string")
    assert [r["clause_type"] for r in classify.with_clause_type(df, F.col("t")).collect()] == ["Termination", "General"]


def test_field_agreement(spark):
    assert col(spark, [["500000", "500000", "900000"]], authenticity.money_agreement, "array<string>") == [pytest.approx(2 / 3)]
    assert col(spark, [["ABC-123", "ABC123", "ABC124", "XYZ999"]], authenticity.id_agreement, "array<string>") == [0.75]


def test_inapplicable_factor_changes_nothing(spark):
    rows = [(d, f, True, 0.1 * d + 0.2 * i, 50.0) for d in (1, 2, 3) for i, f in enumerate(["structure", "cross_field"])]
    schema = "doc_id int, factor string, applicable boolean, score double, confidence double"
    a = spark.createDataFrame(rows, schema)
    b = spark.createDataFrame(rows + [(d, "metadata_validation", False, None, 0.0) for d in (1, 2, 3)], schema)
    assert sorted(map(tuple, authenticity.fuse(a, a).collect())) == sorted(map(tuple, authenticity.fuse(b, b).collect()))


def test_mutual_best_is_half_of_optimum(spark):
    table = [[0.9, 0.85, 0.1], [0.88, 0.2, 0.6], [0.3, 0.7, 0.65]]
    rows = [(1, i, j, s) for i, r in enumerate(table) for j, s in enumerate(r)]
    got = compare.mutual_best(spark.createDataFrame(rows, "pair_id int, a_id int, b_id int, score double")).collect()
    best = max(sum(table[i][p[i]] for i in range(3) if table[i][p[i]] >= 0.55) for p in itertools.permutations(range(3)))
    total = sum(r["score"] for r in got)
    assert best / 2 <= total <= best + 1e-9 and {(r["a_id"], r["b_id"]) for r in got} == {(0, 0), (2, 1), (1, 2)}


def test_scores_and_masks(spark):
    assert col(spark, ["90%", "0.9", "92.4", "true", "high"], retrieve.percent_score) == [90, 90, 92, 100, None]
    df = spark.createDataFrame([(1, "Write to a.b@c.org about 12/05/2024 and 12/05/2024 or @someone now.")], "doc_id int, t string")
    row = normalize.mask(df, "t").withColumn("back", normalize.unmask(F.col("masked"), F.col("placeholders"))).first()
    assert "a.b@c.org" not in row["masked"] and "2024" not in row["masked"] and row["back"] == df.first()["t"]


def test_ids_and_rescore(spark):
    df = spark.createDataFrame([(v,) for v in (5, 90, 17, 3, 1000)], "k long")
    assert {r["k"]: r["id"] for r in maintain.with_ids(df, "k", 10, 3).collect()} == {3: 11, 5: 12, 17: 13, 90: 14, 1000: 15}


def test_subject_similarity(spark):
    from lexmill.operators import features
    m = spark.createDataFrame([(1, 0, "the Supplier"), (1, 1, "weather")], "clause_id int, mention_no int, subject string")
    h = spark.createDataFrame([(1, "Supplier")], "clause_id int, subject string")
    got = {r["mention_no"]: r["corroborated"] for r in features.subject_corroboration(m, h).collect()}
    assert got == {0: True, 1: SequenceMatcher(None, "weather", "supplier").ratio() >= 0.5}


def test_stream_intake(spark, tmp_path):
    from lexmill.streaming import intake
    text = "Termination\nThe supplier may terminate this agreement on written notice of termination.\n\nBadge Colour: Blue."
    rows = [(1, 7, text), (2, 7, text), (3, 8, text)]
    schema = "doc_id long, user_id long, full_text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = intake.start(intake.uploads(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("doc_id").distinct().count() == 2
    assert {r["classification"] for r in out.collect()} == {"Termination", "Structured Field"}


def test_number_groups_pair_every_differing_clause(spark):
    """The first clause of the group holds no amount; the second and third differ."""
    rows = [(1, 10, "Section 2. Fees", "Section 2. Fees are due."), (1, 11, "Section 2. Fees", "Section 2. Fees of USD 5 are due."),
            (1, 12, "Section 2. Fees", "Section 2. Fees of USD 10 are due."), (1, 13, "Section 3. Term", "Section 3. Term of USD 7.")]
    df = spark.createDataFrame(rows, "doc_id long, clause_id long, section_name string, text_content string")
    found = pairs.first_per_pair(pairs.duplicate_findings(pairs.enriched(df)), "detector").collect()
    assert {(r.a_id, r.b_id) for r in found if r.severity == "High"} == {(11, 12)}


def test_value_stars_touch_what_all_pairs_touch(spark):
    rng = random.Random(2)
    rows = [(g, i, [str(v) for v in sorted(rng.sample(range(3), rng.randint(0, 2)))]) for g in range(40) for i in range(rng.randint(1, 6))]
    df = spark.createDataFrame(rows, "g int, clause_id int, m array<string>")
    got = {(r.g, c) for r in pairs.value_stars(df, ["g"], ["m"]).collect() for c in (r.a_id, r.b_id)}
    assert got == {(g, i) for g, i, m in rows for h, j, n in rows if g == h and m and n and m != n}


def test_all_clauses_of_an_opposed_statement_are_found(spark):
    said = ["Supplier shall deliver the goods to the buyer.", "Supplier shall deliver the goods to the buyer.",
            "Supplier shall not deliver the goods to the buyer."]
    df = spark.createDataFrame([(1, i, f"{i}. Delivery", t) for i, t in enumerate(said)], "doc_id long, clause_id long, section_name string, text_content string")
    found = pairs.obligation_findings(pairs.enriched(df)).filter("contradiction_type = 'Opposite Statements'").collect()
    assert {c for r in found for c in (r.a_id, r.b_id)} == {0, 1, 2}


def test_patterns_are_spared_only_where_they_cannot_match():
    import re

    from lexmill import rules
    from lexmill.operators import classify

    for rule in rules.CLAUSE_RULES:
        stems = classify.leading_words(rule.regex)
        for keyword in rule.keywords:
            if re.search(rule.regex, keyword) and stems is not None:
                assert any(s in keyword for s in stems), (rule.category, keyword)


def test_document_text_and_page_map(spark):
    from lexmill.operators import segment

    rows = [(1, 2, "bb", 1), (1, 1, "a", 1), (1, 3, "ccc", 2), (2, 1, None, 5)]
    got = {r.doc_id: (r.full_text, [tuple(m) for m in r.page_map]) for r in segment.document_text(
        spark.createDataFrame(rows, "doc_id int, n int, t string, page_num int"), "n", "t").collect()}
    assert got == {1: ("a\n\nbb\n\nccc", [(1, 0), (2, 7)]), 2: ("", [(5, 0)])}


def test_wording_of_number_groups_is_compared_between_all_texts(spark):
    """B and C differ from A in money but only in wording from each other; random groups against brute force."""
    rng = random.Random(5)
    base = "the supplier shall deliver all goods to the warehouse of the buyer without undue delay and at its own cost"
    said = {(0, 0): "Fees of USD 5 are due.", (0, 1): "Fees of USD 9 are payable on the first day of a month.", (0, 2): "A sum of USD 9 falls due."}
    for g in range(1, 40):
        for i in range(rng.randint(2, 6)):
            words = base.split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 8])):
                words[rng.randrange(len(words))] = rng.choice(["a", "their", "promptly", "goods"])
            said[g, i] = " ".join(words) + rng.choice(["", "", " for USD 5", " for USD 9"])
    rows = [(g, 10 * g + i, "Section 2. Fees", t) for (g, i), t in said.items()]
    df = spark.createDataFrame(rows, "doc_id long, clause_id long, section_name string, text_content string")
    found = {(r.doc_id, r.a_id, r.b_id) for r in pairs.duplicate_findings(pairs.enriched(df)).collect() if r.severity == "Medium"}
    money = {i: t.split("USD ")[1].split()[0] if "USD" in t else "" for _, i, _, t in rows}
    text = {i: t.lower() for _, i, _, t in rows}
    want = {(g, i, j) for g, i, _, _ in rows for h, j, _, _ in rows if g == h and i < j
            and not (money[i] and money[j] and money[i] != money[j]) and SequenceMatcher(None, text[i], text[j]).ratio() < 0.97}
    assert (0, 1, 2) in want and found <= want
    first = {i: min(j for h, j, _, _ in rows if h == g and text[j] == text[i]) for g, i, _, _ in rows}
    assert {p for p in want if first[p[1]] == p[1] and first[p[2]] == p[2]} <= found
    assert {(g, c) for g, *p in want for c in p} == {(g, c) for g, *p in found for c in p}


def test_appended_batches_replace_themselves(spark, tmp_path):
    from lexmill.sources import files
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1, 7), (2, 8)], "k int, user_id int")
    files.append(rows, path, "a", "user_id")
    files.append(rows.limit(1), path, "b", "user_id")
    files.append(rows, path, "a", "user_id")
    assert sorted(r["batch_id"] for r in files.stored(spark, path).collect()) == ["a", "a", "b"]
    with pytest.raises(Exception, match="needs its user_id"):
        files.append(spark.createDataFrame([(3, None)], "k int, user_id int"), path, "c", "user_id")
    assert files.stored(spark, path).count() == 3


def test_rule_files(spark, tmp_path):
    from lexmill import rules
    path = str(tmp_path / "rules")
    rules.save_clause_rules(spark, rules.CLAUSE_RULES, path)
    assert rules.load_clause_rules(spark, path + "/part-*") == rules.CLAUSE_RULES
    for name, text in (("none", "{}"), ("broken", "{"), ("lacking", '{"A": {"keywords": [], "regex": "x"}}')):
        (tmp_path / name).write_text(text)
        with pytest.raises(rules.RuleError):
            rules.load_clause_rules(spark, str(tmp_path / name))


def test_migration_touches_only_changed_buckets(spark, tmp_path):
    from lexmill.operators import migrate
    path = str(tmp_path / "clauses")
    old = spark.createDataFrame([(d, 10 * d + i, f"S{i}", 20, "Low") for d in range(40) for i in range(3)],
                                "doc_id long, clause_id long, section_name string, risk_score long, risk_level string")
    migrate.store(old, path, 8)

    def files_of():
        return {p.parent.name: (p.name, p.stat().st_mtime_ns) for p in (tmp_path / "clauses").glob("*/*.parquet")}
    before = files_of()
    fresh = spark.createDataFrame([(30, 90, "High"), (31, 20, "Low"), (9999, 1, "Low")], "clause_id long, risk_score long, risk_level string")
    report = {r["doc_id"]: r for r in migrate.dry_run(spark.createDataFrame([(d,) for d in (3, 4, 77)], "doc_id long"), migrate.stored(spark, path), fresh).collect()}
    assert (report[3]["n_clauses"], report[3]["n_changed"], report[4]["n_changed"], report[77]["error"]) == (3, 1, 0, "no persisted clauses")
    assert report[3]["score_after"] > report[3]["score_before"] == 20
    staged = migrate.stage(migrate.stored(spark, path), fresh, path, "r1")
    assert migrate.checks(migrate.stored(spark, path), staged).first()["all_passed"] and files_of() == before
    for _ in range(2):  # publishing again changes nothing
        migrate.publish(spark, path, "r1")
        got = {r["clause_id"]: (r["risk_score"], r["risk_level"]) for r in migrate.stored(spark, path).collect()}
        assert len(got) == 120 and got[30] == (90, "High") and got[31] == (20, "Low")
    after = files_of()
    assert sum(after[k] != before[k] for k in before) == 1
    migrate.migrate(path, fresh, "r2")  # a whole run repeated finds nothing to change
    assert files_of() == after
    bad = migrate.stored(spark, path).filter("clause_id <> 32").withColumn("risk_score", F.lit(1).cast("long"))
    assert not migrate.checks(migrate.stored(spark, path), bad).first()["all_passed"]


def test_vector_index(spark, tmp_path):
    from lexmill.operators import vector_index
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    rows = [(i, i % 3, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(900)] + [(1000 + i, 1, centres[0].tolist()) for i in range(150)]
    vectors = spark.createDataFrame(rows, "vec_key long, user_id long, embedding array<double>")
    asked = spark.createDataFrame([(i, i % 3, (centres[i % 12] + 0.3 * rng.normal(size=16)).tolist()) for i in range(60)],
                                  "query_id long, user_id long, embedding array<double>")
    path = str(tmp_path / "index")
    vector_index.build(vectors, path, ["user_id"], lists=24, slice_rows=40)
    exact = vector_index.search(asked, path, 20, ["user_id"], exact=True)
    unit = {k: (u, np.array(v) / np.linalg.norm(v)) for k, u, v in rows}
    want = {}
    for q, u, v in asked.collect():
        v = np.array(v) / np.linalg.norm(v)
        want[q] = [k for _, k in sorted((-round(float(x @ v), 9), k) for k, (o, x) in unit.items() if o == u)[:20]]
    got = {}
    for r in exact.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_key"])
    assert got == want
    probes = spark.read.parquet(path + "/lists").first()["probes"]
    assert probes < 24
    found = vector_index.search(asked, path, 20, ["user_id"])
    assert vector_index.recall_of(found, exact).agg(F.avg("recall")).first()[0] >= 0.95


def test_inflected_actions(spark):
    texts = ["He terminated it.", "She assigns it", "Vendor indemnifies and was complying", "waived", "sanctions", "sanctioned sanctions", "reassigned", "A termination; they terminate."]
    got = [{a["action_type"]: round(a["confidence"], 4) for a in r} for r in col(spark, texts, X.legal_actions)]
    assert got == [{"termination": 0.5}, {"assignment": 0.5}, {"indemnification": 0.5, "compliance": 0.5}, {"waiver": 0.5}, {"sanctions": 0.5},
                   {"sanctions": 0.6667}, {}, {"termination": 0.6667}]
