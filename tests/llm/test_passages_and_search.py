"""Repeated passages and the ranked search against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import shared_terms, super_kmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOC = "doc_id long, text string"


def without_repeats(docs):
    seen, out = {}, []
    words = {k: WORD.findall(t or "") for k, t in docs}
    for k in sorted(words, key=lambda k: (k is not None, k or 0)):
        for i in range(len(words[k]) - 19):
            seen.setdefault(tuple(words[k][i:i + 20]), (k, i))
    for k, text in docs:
        gone = set()
        for i in range(len(words[k]) - 19):
            if seen[tuple(words[k][i:i + 20])] != (k, i):
                gone.update(range(i, i + 20))
        out.append((k, len(words[k]), len(gone), None if text is None else " ".join(w for i, w in enumerate(words[k]) if i not in gone)))
    return out


def passages(rng):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "\U0001f642", "\x00", "a\x1fb", " "]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    common, note = prose(45), prose(20)
    docs = []
    for i in range(150):
        words = prose(rng.randrange(0, 80))
        if i % 3 == 0:
            at = rng.randrange(len(words) + 1)
            words[at:at] = common[rng.randrange(0, 10):]
        if i % 7 == 0:
            words += note + prose(3) + note
        docs.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    docs += [(i, docs[9][1]) for i in range(200, 230)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "same " * 300), (304, "same " * 25 + "end"), (305, " ".join(prose(3000) * 2)), (None, docs[3][1]),
             (306, "x" * 2_500_000 + " " + docs[9][1])]
    return docs


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.mark.parametrize("bucket_bytes", [4_000_000, 2_000, 300])
def test_repeated_passages(spark, bucket_bytes):
    docs = passages(random.Random(5))
    table = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS bucket", "2 AS ranges", "3 AS key", "4 AS start").repartition(5)
    got = super_kmers.deduplicated(table, bucket_bytes=bucket_bytes)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(without_repeats(docs), key=key)


def test_word_hashes(monkeypatch):
    words = [b"w%d" % i for i in range(5000)] + [b"x" * 70, b"\xc3\xa9"]
    for piece in (1 << 20, 50):
        monkeypatch.setattr(super_kmers, "PIECE", piece)
        starts, ends, hashes = super_kmers.word_table(b" ".join(words + words[::-1]))
        assert (hashes[:len(words)] == hashes[len(words):][::-1]).all() and len(set(hashes.tolist())) == len(words)


def test_hot_buckets_and_equal_hashes(spark, monkeypatch):
    docs = passages(random.Random(6))
    want = sorted((r for r in without_repeats(docs)), key=key)
    rows = [(k if k is not None else -1, 0, t.encode()) for k, t in docs if t is not None]
    hot = super_kmers.Cut([r[2] for r in rows], 3, {0: 4, 2: 7})
    assert len(set(hot.bucket.tolist())) > 6 and (hot.windows[hot.bucket >= 3] == 1).all()
    whole = super_kmers.Cut([r[2] for r in rows], 3, {})
    assert hot.windows.sum() == whole.windows.sum() and whole.windows.max() > 1
    # different windows under one hash are told apart by their bytes
    starts, ends, hashes = super_kmers.word_table(whole.buffer)
    word = np.concatenate([np.arange(a, a + n) for a, n in zip(whole.at, whole.windows)])
    right = super_kmers.first_places(whole.buffer, word, starts, ends, hashes)
    assert (super_kmers.first_places(whole.buffer, word, starts, ends, hashes & np.uint64(1)) == right).all()
    monkeypatch.setattr(super_kmers, "HOT_LOADS", 0.5)
    got = super_kmers.deduplicated(spark.createDataFrame(docs, DOC).repartition(3), bucket_bytes=3_000)
    assert sorted(map(tuple, got.collect()), key=key) == want


def test_repeated_rows_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text)] * 3 + [(2, text + " x"), (2, "y " + text), (5, text), (5, text)]
    got = super_kmers.deduplicated(spark.createDataFrame(rows, DOC)).collect()
    removed = sorted((r["doc_id"], r["n_removed"]) for r in got)
    assert removed == [(1, 0)] * 3 + [(2, 30)] * 2 + [(5, 30)] * 2
    assert super_kmers.digests(spark.createDataFrame([], DOC)).collect() == []


def best_by_brute_force(items, docs):
    found = [(k, Counter(terms(t))) for k, t in docs]
    total, n_docs = sum(sum(c.values()) for _, c in found), sum(1 for _, c in found if c)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for k, c in found:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, k is not None, k))
        out += [(item, rank, k, -s) for rank, (s, _, k) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:20], 1)]
    return out


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_ranked_search(spark):
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "Été", "ÉTÉ", "a1", "x-y", "_", "naïve", "☃"] + [f"t{i}" for i in range(60)]
    prose = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, [9] * 10 + [1] * 60, k=n))
    items = [(i, prose(rng.randrange(1, 25))) for i in range(60)] + [(70, None), (71, ""), (72, "?!"), (73, "nowhere found"), (74, "t1 " * 50), (3, "t5 t6")]
    items += [items[0], (None, "t7 t8 the")]
    docs = [(i, prose(rng.randrange(0, 60))) for i in range(300)] + [(400 + i, "t1 t2 the") for i in range(40)]
    docs += [(500, None), (501, ""), (502, "... "), (503, "t3 " * 50_000), (None, "t1 t2 the"), (7, "t1 t9"), (7, "t1 t9")]
    item_table = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS block", "2 AS terms")
    doc_table = spark.createDataFrame(docs, DOC).selectExpr("*", "1 AS n", "2 AS ids", "3 AS item_id").repartition(6)
    want = sorted(best_by_brute_force(items, docs), key=key)
    for block_terms, at_once in ((20_000, 8), (150, 2)):
        got = shared_terms.search(item_table, doc_table, block_terms=block_terms, at_once=at_once)
        assert sorted(map(tuple, got.collect()), key=key) == want


def test_empty_searches(spark):
    none, one = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs, empty = spark.createDataFrame([(1, "a")], DOC), spark.createDataFrame([], DOC)
    for items, rows in ((none, docs), (one, empty), (none, empty), (one, spark.createDataFrame([(1, None)], DOC))):
        assert shared_terms.search(items, rows).collect() == []


def test_shared_sums():
    rng = random.Random(3)
    items = [[b"t%d" % rng.randrange(30) for _ in range(rng.randrange(0, 80))] for _ in range(40)]
    plan = shared_terms.Plan(items)
    held = [Counter([t]) for t in plan.terms]
    for a, b in plan.additions:
        held.append(held[a] + held[b])
    assert [held[k] if k >= 0 else Counter() for k in plan.items] == [Counter(i) for i in items]
    assert len(plan.additions) < 0.8 * sum(len(i) - 1 for i in items if i)
