"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

from lexmill.llm import merkle

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    out = []
    for name, v in zip(merkle.FIELDS, row):
        if name == "text" and lower and v is not None:
            v = "".join(c.lower() if "A" <= c <= "Z" else c for c in v)
        out.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h(*out)


def grown(nodes):
    """The root of nodes and, for each, the steps to it."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            run = nodes[at // 16 * 16: at // 16 * 16 + 16]
            paths[i].append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
            where[i] = at // 16
        nodes = [h(*nodes[k:k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0], paths


def by_brute_force(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    trees = {s: grown([leaf_of(r) for r in groups[s]]) for s in order}
    root, above = grown([trees[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for row, path in zip(groups[s], trees[s][1]):
            path = path + up
            touched = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            now = leaf_of(row, touched)
            for left, right in path:
                now = h(left, now, right)
            out.append((row[0], leaf_of(row), trees[s][0], root, h(*[x for at in path for x in at]), now, now == root))
    return out


def same(spark, rows):
    docs = spark.createDataFrame(rows, FIELDS).selectExpr("*", "1 AS at", "2 AS hash", "'x' AS grp", "3 AS kid", "4 AS block")
    got = merkle.tamper_report(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(by_brute_force(rows), key=key)


def test_small_groups_nulls_and_ties(spark):
    rows = [(i, f"s{i % 3}", "en", 5, f"Text {i}") for i in range(70)]
    rows += [(3, "s0", "en", 5, "Text 3"), (3, "s0", None, 5, "another"), (None, "s0", "en", None, "No id"), (None, None, None, None, None),
             (900, "alone", "en", 0, ""), (901, "", "de", 1, "Ü" * 3000), (902, "\U0001f642", "de", 1, "AB\ncd"), (903, "�", "de", 1, "x")]
    same(spark, rows)


def test_levels_end_with_their_group(spark):
    same(spark, [(i, f"n{n}", None, n, f"Row {i}") for n in (1, 2, 15, 16, 17, 255, 256, 257, 4096) for i in range(n)])


def test_blocks_of_blocks(spark):
    same(spark, [(i, "hot", None, None, "A") for i in range(4096 * 3 + 5)] + [(i, "small", None, None, "B") for i in range(20)])


def test_more_groups_than_a_block(spark):
    same(spark, [(i, f"host{i:05d}", None, None, "A") for i in range(4100)])


def test_empty_table(spark):
    assert merkle.tamper_report(spark.createDataFrame([], FIELDS)).collect() == []
