"""Line dedup and the shingle join against brute force, and the pipeline."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from lexmill.llm import line_dedup, shingle_forest
from lexmill.llm.star import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def within_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = j = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def kept_by_brute_force(docs):
    seen, want = [], {}
    for key, text in docs:
        if text is None:
            want[key] = (0, 0, None)
            continue
        out, n, kept = [], 0, 0
        for line in text.split("\n"):
            if WORD.search(line):
                n += 1
                copy = any(s == line or min(len(s), len(line)) >= line_dedup.MIN_CHARS and within_one(s, line) for s in seen)
                seen.append(line)
                if copy:
                    continue
                kept += 1
            out.append(line)
        want[key] = (n, kept, "\n".join(out))
    return want


def test_lines(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(8, 16))) for _ in range(40)]

    def changed(x):
        i, how = rng.randrange(len(x)), rng.random()
        return x[:i] + rng.choice("abé🙂") + x[i + (how < 0.5):] if how < 0.8 else x[:i] + x[i + 1:]

    docs = [(i, "\n".join(rng.choice([changed, str])(rng.choice(base)) if rng.random() < 0.9 else "" for _ in range(rng.randint(0, 12))))
            for i in range(120)]
    docs += [(200, None), (201, ""), (202, "short\nshort\nshorx"), (203, " \n\t\n"), (204, "long " * 20_000), (205, "long " * 19_999 + "lonk ")]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS line_no", "2 AS kept", "3 AS h1", "4 AS n_lines")
    want = kept_by_brute_force(docs)
    got = {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.deduplicated(table).collect()}
    assert got == want
    cleaned = line_dedup.cleaned(table)
    assert cleaned.columns == table.columns
    assert {r.doc_id: r.text for r in cleaned.collect()} == {i: w[2] for i, w in want.items() if w[0] == 0 or w[1] > 0}
    shuffled = line_dedup.BROADCAST_ROWS
    line_dedup.BROADCAST_ROWS = -1
    try:
        assert {r.doc_id: (r.n_lines, r.n_kept, r.text) for r in line_dedup.deduplicated(table).collect()} == want
    finally:
        line_dedup.BROADCAST_ROWS = shuffled
    assert line_dedup.deduplicated(table.filter("false")).count() == 0


def test_lines_of_repeated_rows_and_null_ids(spark):
    docs = [(1, "the same line\nother words"), (1, "the same line\nother words"), (None, "a line without an id"), (2, "the same line")]
    got = sorted(((r.doc_id or 0), r.n_kept, r.text) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(0, 1, "a line without an id"), (1, 2, docs[0][1]), (1, 2, docs[0][1]), (2, 0, "")]


def classes_by_brute_force(docs):
    sets = {}
    for _, text in docs:
        words = WORD.findall(text or "")
        sets.setdefault(text, set(zip(*[words[k:] for k in range(5)])))
    texts, parent, links = list(sets), {t: t for t in sets}, collections.Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            common = len(sets[a] & sets[b])
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common) - 1e-9:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    least = {}
    for key, text in docs:
        least[root(text)] = min(least.get(root(text), key), key)
    return {key: (least[root(text)], links[text]) for key, text in docs}


def near_copies(rng, n_base, n_copies, words):
    docs = []
    for b in range(n_base):
        text = [rng.choice("abcdefghijkl") * rng.randint(1, 4) for _ in range(words)]
        for _ in range(n_copies):
            copy = list(text)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice("xyz") * 3
            docs.append((len(docs), " ".join(copy)))
    return docs


def test_shingle_join(spark, monkeypatch):
    rng = random.Random(9)
    docs = near_copies(rng, 30, 8, 120)
    docs += [(1000, None), (1001, None), (1002, ""), (1003, "a b c"), (1004, "a b c"), (1005, "p q r s t"), (1006, docs[0][1]), (1006, docs[0][1])]
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS root", "2 AS text_key", "3 AS size", "4 AS block")
    want = classes_by_brute_force(docs)
    got = shingle_forest.classes(table).collect()
    assert len(got) == len(docs) and {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    kept = shingle_forest.first_of_classes(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in want.values()})
    assert shingle_forest.classes(table.filter("false")).count() == 0


def test_large_groups_in_blocks(spark, monkeypatch):
    rng = random.Random(10)
    docs = near_copies(rng, 2, 90, 150)
    monkeypatch.setattr(shingle_forest, "NODE_BLOCK", 16)
    monkeypatch.setattr(shingle_forest, "GROUP_BLOCK", 8)
    got = shingle_forest.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == classes_by_brute_force(docs)


def test_depth_meets_the_recall():
    for similarity in (0.5, 0.8, 0.95):
        d = shingle_forest.depth_for(similarity)
        assert 1 - (1 - similarity ** d) ** shingle_forest.TREES >= shingle_forest.RECALL
        assert d == shingle_forest.MAX_DEPTH or 1 - (1 - similarity ** (d + 1)) ** shingle_forest.TREES < shingle_forest.RECALL


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (103, 101), (200, 200)] + [(300, 300 + k) for k in range(1, 40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in (100, 101, 103)}, **{300 + k: 300 for k in range(40)}}


def test_variant_keys_meet():
    keys = lambda x: set(line_dedup.variant_keys(x, 1, 1)[0].tolist())
    assert keys("abcdefghijkl") & keys("abcdeghijkl") and keys("abcdefghijkl") & keys("abcdefghijkm") and not keys("abcdefghijkl") & keys("xbcdefghijkm")
    assert isinstance(line_dedup.variant_keys("ab" * 40_000, 1, 0)[0], np.ndarray)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("row", F.lit(1)).withColumn("kept", F.lit("x"))
    columns, rows = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows.append(docs.count())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert rows[0] >= rows[1] >= rows[2] >= rows[3] > 0 and rows[5] == rows[4]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert result.count() == rows[5]
