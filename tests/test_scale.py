"""Joins on keys as many as documents are dealt out, never broadcast, also where the optimizer takes their input for small."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from lexmill import rules
from lexmill.functions import patterns, similarity
from lexmill.operators import classify, compare, migrate, near_text, pairs, retrieve, risk, segment
from lexmill.plans import manage, migration


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_broadcasts_nothing_and_keeps_its_scores(spark, tmp_path):
    texts = {(1, 1): "late fee late usd", (1, 2): "usd invoice", (1, 3): "usd usd other words", (1, 4): None, (2, 1): "fee", (2, 2): ""}
    asked = {1: "late fee usd usd", 2: "fee fee"}
    spark.createDataFrame([(q, d, t, asked[q]) for (q, d), t in texts.items()], "query_id long, doc_key long, t string, q string").write.parquet(f"{tmp_path}/pool")
    pool = spark.read.parquet(f"{tmp_path}/pool")
    out = retrieve.bm25(pool, "q", "t")
    assert "Broadcast" not in plan(out)
    got = {(r.query_id, r.doc_key): r.bm25 for r in out.collect()}
    for q in asked:
        docs = {d: re.findall("[a-z0-9]+", t) if t is not None else None for (p, d), t in texts.items() if p == q}
        known = [t for t in docs.values() if t is not None]
        mean_length = sum(map(len, known)) / len(known)
        df = Counter(w for t in known for w in set(t))
        idf = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        mean = sum(idf.values()) / len(idf)
        for d, t in docs.items():
            want = sum((0.25 * mean if idf[w] < 0 else idf[w]) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean_length))
                       for w in asked[q].split() if t and w in t)
            assert abs(got[q, d] - want) < 1e-9


def test_near_pairs_broadcast_nothing(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("doc_id"), "id", F.array(F.lit(1), F.lit(2), F.lit(3), F.col("id") % 4 + 10).cast("array<bigint>").alias("bag"))
    alone = spark.range(40, 50).select(F.col("id").alias("doc_id"), "id", F.array(F.lit(1)).cast("array<bigint>").alias("bag"))
    out = near_text.near_pairs(rows.unionByName(alone), ["doc_id"], "id", "bag", 0.9)
    assert "Broadcast" not in plan(out)
    assert {(r.a, r.b) for r in out.collect()} == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 4 == b % 4}


def test_near_copies_keep_no_words_of_texts_alone_with_their_numbers(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(segment, "cut_lineage", lambda df: kept.append(df) or df)
    rows = spark.range(30).select((F.col("id") % 3).alias("doc_id"), F.col("id").alias("block_no"), F.lit(1.0).alias("confidence_score"), F.concat(
        F.lit("The buyer shall pay the price for all goods, whatever else is agreed, on day "), F.when(F.col("id") < 6, F.lit(7)).otherwise(F.col("id") + 100).cast("string"),
        F.when(F.col("id") < 3, " without delay").otherwise("")).alias("text_content"))
    out = segment.fold_near_copies(rows)
    assert "Broadcast" not in plan(out)
    assert sorted((r.doc_id, r.slot_no, r.block_no) for r in out.collect()) == sorted((i % 3, i, i) for i in range(30) if not 3 <= i < 6)
    assert [df.count() for df in kept] == [6]


def test_differs_settles_by_edits_what_matching_blocks_would_say(spark):
    import difflib
    base = "client must notify supplier by registered mail within 3 weeks, see section 3 and clause 5."
    texts = [base, base.replace("3 weeks", "4 weeks"), base.replace("mail", "post"), "x" + base, base[::-1], base.upper(), "", base * 3]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    out = rows.select("a", "b", similarity.differs(F.col("a"), F.col("b"), 0.97).alias("d"))
    got = {(r.a, r.b): r.d for r in out.collect()}
    assert all(d == (difflib.SequenceMatcher(None, a, b).ratio() < 0.97) for (a, b), d in got.items())
    assert "levenshtein" in plan(out)


def test_issues_broadcast_nothing_that_grows_with_the_documents(spark):
    rows = spark.range(8).select((F.col("id") % 2).alias("doc_id"), F.col("id").alias("clause_id"), F.array(F.col("id") % 2).alias("m"))
    assert "Broadcast" not in plan(pairs.value_stars(rows, ["doc_id"], ["m"]))


def test_text_windows_of_digits_are_whole(spark, tmp_path):
    spark.range(111).select(F.col("id").alias("doc_id"), F.lit("a").alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    assert {len(r.digits) for r in manage.text_punctuation(spark, str(tmp_path)).collect()} == {9}


def test_categories_are_found_by_prefix_trees_and_are_those_of_each_pattern_alone(spark):
    own = [rules.ClauseRule("Money", ("usd", "rs.", "late", "late fee", "late fee due"), r"\bpa(y|id)\b|sum insured"),
           rules.ClauseRule("Law", ("governed by", "late", "courts"), r"\blaws? of\b|\bcourts\b|\bgovern"),
           rules.ClauseRule("Notice", ("by mail", "by"), r"(?:registered )?mail\b")]
    texts = ["late fee due", "a late fee is late", "xlate feed by-mail", "Rs.5 rs. x", "misgoverned by courts_", "Law of USD\npaid", "sum insured, resum insured", "Money: by mail", "\u00e9late fee\u00e9", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = classify.with_categories(df, F.col("t"), own)
    assert "contains(lambda" not in out.drop("t")._jdf.queryExecution().optimizedPlan().toString().lower().replace("contains(_head", "")
    got = {(r.i, c["category"]): (c["points"], c["keywords"], c["snippet"]) for r in out.collect() for c in r["_cats"]}
    want = {}
    for i, t in enumerate(texts):
        for rule in own:
            kept = [k for k in rule.keywords if re.search(patterns.word(k), t.lower())]
            hit = re.search(rule.regex, t.lower())
            points = 25 * bool(hit and hit.group()) + 10 * min(len(kept), 5) + 15 * (rule.category.lower() in t.lower().split("\n")[0])
            if points:
                want[i, rule.category] = (points, kept, hit.group() if hit else "")
    assert got == want


def test_one_pattern_finds_all_keywords():
    words = [k for r in rules.CLAUSE_RULES for k in r.keywords]
    tree = re.compile(rf"\b({classify.prefix_tree(sorted(set(words)))})\b")
    assert all(tree.fullmatch(w) for w in words) and len(tree.pattern) < sum(map(len, words))


def test_clause_means_move_no_vectors_when_they_are_few_and_agree_for_hot_documents(spark, tmp_path, monkeypatch):
    vecs = {k: [math.sin(k * 7 + i) for i in range(4)] for k in range(5)}
    spark.createDataFrame(list(vecs.items()), "_vec long, embedding array<float>").write.parquet(f"{tmp_path}/v")
    rows = spark.createDataFrame([(d, c, (d * 3 + c) % 5) for d in range(4) for c in range(d + 1)], "doc_id long, clause_id long, _vec long")
    out = risk.outlier_signal(rows, spark.read.parquet(f"{tmp_path}/v"), "_vec", dim=4)
    moved = [line for line in plan(out).split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "Aggregate" not in plan(out)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = {}
    for d in range(4):
        own = [vecs[(d * 3 + c) % 5] for c in range(d + 1)]
        mean = [sum(x) / len(own) for x in zip(*own)]
        want |= {(d, c): 1 - cosine(v, mean) if d else 0.5 for c, v in enumerate(own)}
    monkeypatch.setattr(risk, "LOOKUP_ROWS", 0)
    for some in (out, risk.outlier_signal(rows, spark.read.parquet(f"{tmp_path}/v"), "_vec", dim=4),
                 risk.outlier_signal(rows, spark.read.parquet(f"{tmp_path}/v"), "_vec", dim=4, hot_rows=2)):
        got = {(r.doc_id, r.clause_id): r.e_ambiguity for r in some.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_scenarios_are_scored_on_one_pass_over_the_signals(spark):
    one = spark.range(60).select((F.col("id") % 7).alias("doc_id"), F.col("id").alias("clause_id"), *[
        ((F.col("id") * (i + 3)) % 11 / 11.0).alias(c) for i, c in enumerate([*[f"raw_{d}" for d in risk.RANKED], "f_ambiguity", "feature_confidence", *[f"e_{d}" for d in risk.LOWER]])])
    runs = {"fixed": {"Legal": 1.0}, "own": None}
    for hot in (1_000, 8):
        out = risk.score_scenarios(one, runs, hot_rows=hot)
        if hot == 1_000:
            assert plan(out).count("Exchange hashpartitioning") == 1
        got = {r.clause_id: (r.fixed, r.own) for r in out.collect()}
        for i, alpha in enumerate(runs.values()):
            want = {r.clause_id: r.lrsi for r in risk.score_clauses(one, alpha=alpha, hot_rows=hot).collect()}
            assert got.keys() == want.keys() and all(abs(got[k][i] - want[k]) < 1e-9 for k in want)


def test_a_stage_recomputes_once(spark, tmp_path):
    rows = spark.range(20).select((F.col("id") % 4).alias("doc_id"), F.col("id").alias("clause_id"), F.lit(1).alias("risk_score"))
    migrate.store(rows, f"{tmp_path}/t", 4)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    fresh = rows.withColumn("risk_score", F.lit(2)).coalesce(1).mapInPandas(count, rows.schema).select("clause_id", "risk_score")
    out = migrate.migrate(f"{tmp_path}/t", fresh, "r")
    assert {r.risk_score for r in out.collect()} == {2} and seen.value == 20


def test_vectors_that_rows_share_are_scored_once(spark, monkeypatch):
    vecs = {v: [float(v % 3), float(v % 5), 1.0] for v in range(12)}
    vecs[7] = vecs[2]
    stored = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<float>")
    rows = spark.range(300).select(F.col("id").alias("vec_key"), (F.col("id") % 2).alias("user_id"), (F.col("id") * 7 % 12).alias("vec_id"))
    asked = spark.range(6).select(F.col("id").alias("query_id"), (F.col("id") % 2).alias("user_id"), F.array(F.col("id") % 4, F.lit(1), F.lit(1)).cast("array<float>").alias("embedding"))
    scored = []
    plain = retrieve.nearest
    monkeypatch.setattr(retrieve, "nearest", lambda q, v, *a, **b: scored.append(v.count()) or plain(q, v, *a, **b))
    got = sorted(map(tuple, retrieve.nearest_stored(asked, rows, stored, "vec_id", 30, ["user_id"], slice_rows=4).select("query_id", "rank", "vec_key", "similarity").collect()))
    assert scored == [12]
    want = plain(asked, rows.join(stored, "vec_id"), 30, ["user_id"]).select("query_id", "rank", "vec_key", "similarity")
    assert got == sorted(map(tuple, want.collect())) and len(got) == 180


def test_changes_keep_no_texts_or_vectors(spark, monkeypatch):
    kept, words = [], ["pay", "notify", "deliver", "usd", "within", "days", "supplier", "client"]
    plain = compare.cut_lineage
    monkeypatch.setattr(compare, "cut_lineage", lambda df: kept.append(set(df.columns)) or plain(df))
    texts = {(d, c): " ".join(words[(d + c + i) % 8] for i in range(5 + c % 2)) for d in range(3) for c in range(5)}
    name = {c: f"Section {c}. Payment" if c < 2 else "Notices" if c == 2 else "Other things" if c == 3 else "" for c in range(5)}
    vecs = {(d, c): [1.0, (d + c) % 3 - 1.0, c / 5] for d, c in texts}
    rows = spark.createDataFrame([(d, 10 * d + c, name[(c + d) % 5], texts[d, c], vecs[d, c]) for d, c in texts],
                                 "doc_id long, clause_id long, section_name string, text_content string, embedding array<float>")
    pairs_of = spark.createDataFrame([(0, 0, 1), (1, 1, 2)], "pair_id long, doc_a long, doc_b long")
    got = compare.changes(pairs_of, rows).collect()
    assert kept and not any(c.startswith(("text_content", "embedding", "bag", "unit")) for columns in kept for c in columns)
    pairs_seen = [(r.pair_id, r.a_id, r.b_id) for r in got if r.a_id is not None and r.b_id is not None]
    assert len(pairs_seen) >= 4
    for r in got:
        if r.a_id is None or r.b_id is None:
            continue
        a, b = (divmod(x, 10) for x in (r.a_id, r.b_id))
        left, right = Counter(texts[a].split()), Counter(texts[b].split())
        ratio = 2 * sum((left & right).values()) / sum((left + right).values())
        va, vb = vecs[a], vecs[b]
        cos = sum(x * y for x, y in zip(va, vb)) / math.sqrt(sum(x * x for x in va) * sum(y * y for y in vb))
        assert abs(r.score - (ratio + cos) / 2) < 1e-6 and r.status == ("unchanged" if ratio >= 0.97 else "modified")
    assert sum(r.status != "added" for r in got) == 10 and sum(r.status != "removed" for r in got) == 10


def test_relationships_are_made_once_for_all_batches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(migration.files, "append", lambda df, *a: seen.append(plan(df)))
    monkeypatch.setattr(migration.files, "stored", lambda *a: None)
    migration.store_relationships(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("FileScan" in p for p in seen)
