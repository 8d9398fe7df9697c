"""Quality rules and source mixing: SQL side by side, odd rows, and properties of the mix."""

from __future__ import annotations

import collections
import re

import pytest

from lexmill.llm import mixing, queries, rule_cascade
from tests.oracle import connect, rows_of

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None, None), (2, "", "a"), (3, "one two\nthree\nthree\n\n \t\n", "a"), (3, "one two\nthree\nthree\n\n \t\n", "a"),
       (4, "le " * 30_000, "b"), (5, "## $$ word | < >", "b"), (None, "no id here", None), (6, "a b c a b c a", "c"), (7, "x" * 5000, "é"),
       (8, " ".join(f"word{i}" for i in range(60)), "d"), (9, "SO!! LOUD!! " * 40, "d")]
SCHEMA = "doc_id long, text string, source string"


def compare(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rel = connect(SF).execute(queries.ORACLES[name])
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rel.fetchall())


@pytest.mark.parametrize("name", ["op1_source_mix", "op5_quality_rules"])
def test_same_rows_as_sql(spark, name):
    compare(spark, name)


def figures(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside))


def test_figures_of_odd_texts(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS _t", "3 AS n_lines")
    got = rule_cascade.rule_report(docs).collect()
    want = sorted((str(i), *figures(t)) for i, t, _ in ODD)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in got}
    assert verdict[8] == (False, True) and verdict[4] == (True, False) and verdict[9][1] is False


def test_the_order_of_rules_changes_no_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    figure = rule_cascade.over_text(docs.text)
    orders = [rule_cascade.RULES, rule_cascade.RULES[::-1], rule_cascade.ordered(docs, rule_cascade.RULES)]
    kept = [sorted(r.doc_id for r in docs.filter(rule_cascade.first_rejection(o, figure).isNull()).collect()) for o in orders]
    assert kept[0] == kept[1] == kept[2] == sorted(r.doc_id for r in rule_cascade.cascade(docs).collect())
    report = rule_cascade.rule_report(docs)
    assert kept[0] == sorted(r.doc_id for r in report.filter("kept").collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert rule_cascade.rule_report(docs).count() == 0 and rule_cascade.cascade(docs).columns == docs.columns
    assert mixing.mix(docs).count() == 0 and mixing.repeated(docs).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, again = ([tuple(r) for r in mixing.mix(docs).orderBy("doc_id").collect()] for _ in range(2))
    assert first == again
    by_target, target_of = collections.Counter(), {}
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for doc, size, source_size, target, taken in first:
        assert 0 <= taken <= 3 * size and target <= 3 * source_size + 1e-6
        by_target[source[doc]] += taken
        target_of[source[doc]] = target
    assert abs(sum(target_of.values()) - sum(r[1] for r in first)) < 1
    for name, target in target_of.items():
        assert abs(by_target[name] - target) <= 0.02 * target + 2 * mixing.BLOCK_WORDS


@pytest.mark.parametrize("counts", [(8000, 4000, 150), (500, 3000, 20)])
def test_sources_of_short_texts_come_to_their_targets(spark, counts):
    rows = [(k * 100_000 + i, f"w{i} " * n, "abc"[k]) for k, (n, many) in enumerate(zip((250, 60, 10), counts)) for i in range(many)]
    rows += [(900_000 + i, f"u{i} " * 4000, "d") for i in range(5)]
    got = collections.Counter()
    source = {r[0]: r[2] for r in rows}
    for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect():
        got[source[r.doc_id]] += r.taken
        assert r.taken <= 3 * r.size
    for name, target in goal(words_of_sources((t, s) for _, t, s in rows)).items():
        assert abs(got[name] - target) <= max(0.02 * target, mixing.BLOCK_WORDS)


def test_mix_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS size", "2 AS rank", "3 AS row", "4 AS _times")
    got = mixing.mix(docs).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r.size for r in got) and all(r.taken == 0 for r in got if r.size == 0)
    again = mixing.repeated(docs)
    assert again.columns == docs.columns and again.count() <= 3 * len(ODD)


@pytest.mark.parametrize("weights,seats,cap", [([5.0, 2.0, 1.0], 17, 100), ([1.0] * 9, 4, 3), ([100.0, 31.0, 30.0], 30, 19), ([0.0, 3.0], 5, 9)])
def test_apportionment_is_sainte_lague(spark, weights, seats, cap):
    parties = spark.createDataFrame([(0, i, w, cap, seats) for i, w in enumerate(weights)], "g int, p int, w double, cap long, seats long")
    got = {r.p: r.quota for r in mixing.apportion(parties, ["g"], ["p"], "w", "cap", "seats").collect()}
    want = collections.Counter()
    for _ in range(seats):
        best = max((i for i in range(len(weights)) if want[i] < cap and weights[i] > 0), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
        want[best] += 1
    assert got == {i: want[i] for i in range(len(weights))}


def words_of_sources(rows):
    found = collections.Counter()
    for text, source in rows:
        found[source] += len(WORD.findall(text or ""))
    return found


def goal(sizes):
    """Targets by lowering what is left, source by source, until no limit is passed."""
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(sorted(sizes))}
    left, open_, out = sum(sizes.values()), set(sizes), {}
    while True:
        stops = {s for s in open_ if 3 * sizes[s] * sum(weight[t] for t in open_) <= left * weight[s]}
        if not stops:
            return out | {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        out |= {s: 3 * sizes[s] for s in stops}
        open_, left = open_ - stops, left - sum(3 * sizes[s] for s in stops)


@pytest.mark.parametrize("longer", [1, 5])
def test_repeated_words_come_to_the_target_of_each_source(spark, longer):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").dropDuplicates(["doc_id"]).selectExpr(
        "doc_id", f"repeat(concat(text, ' '), {longer}) AS text", "source")
    rows = [(r.text, r.source) for r in docs.collect()]
    got, want = words_of_sources((r.text, r.source) for r in mixing.repeated(docs).collect()), goal(words_of_sources(rows))
    longest = {s: max(len(WORD.findall(t or "")) for t, x in rows if x == s) for s in want}
    assert all(abs(got[s] - want[s]) <= longest[s] for s in want)


def test_short_texts_of_a_small_source_in_a_large_table(spark):
    rows = [(i, f"w{i} " * 250, "a") for i in range(4000)] + [(10_000 + i, f"v{i} " * 10, "b") for i in range(60)] + [
        (20_000 + i, f"u{i} " * 4000, "c") for i in range(400)]
    got = words_of_sources((r.text, r.source) for r in mixing.repeated(spark.createDataFrame(rows, SCHEMA)).collect())
    want = goal(words_of_sources((t, s) for _, t, s in rows))
    assert want["b"] == 3 * 600 == got["b"] and abs(got["a"] - want["a"]) <= 250 and abs(got["c"] - want["c"]) <= 4000


def test_copies_against_a_running_sum(spark):
    rows = [(i % 700, f"x{i % 700} " * (1 + i * i % 97), "ab"[i % 3 % 2]) for i in range(1000)] + [(None, "n o", None)] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.copies(docs).collect()
    again = collections.Counter(tuple(r) for r in mixing.repeated(docs).collect())
    number = collections.Counter(rows)
    assert sorted(r.rows for r in found) == sorted(number.values())
    assert sum(again.values()) == sum(r.rows * r.whole + r.more for r in found) and all(0 <= r.more <= r.rows for r in found)
    sizes = words_of_sources((t, s or "~") for _, t, s in rows)
    for source, target in goal(sizes).items():
        share = target / sizes[source]
        n = sum(k for (_, _, s), k in number.items() if (s or "~") == source)
        assert abs(sum(k for (_, _, s), k in again.items() if (s or "~") == source) - share * n) < 1 + 1e-6
        assert all(int(share) * k <= again[row] <= int(share + 1) * k for row, k in number.items() if (row[2] or "~") == source)
