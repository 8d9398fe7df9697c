"""Ranked lexical search of many items at once, with the sums that items share worked out once.

A term is a maximal run of letters, digits and characters beyond ASCII, A-Z lower-cased. A document's score
for an item is the sum over the item's terms, repeats included, of the term's weight times a saturating
function of how often the document holds it; all in whole numbers. Each item gets its best documents.

How: items are dealt into blocks. In a block the sets of terms that several items share are mined: terms of
exactly the same items form one set, then the pair of sets that most items hold together becomes a set of
its own, again and again. So every item is a node of a graph whose inner nodes are sums that items share.
One pass over the documents counts the terms that any item holds and stores them; document and term counts
come from there. A second pass fills, for some documents at a time, the values of the single terms, then
every shared sum once, then the items, each by one addition per edge, and keeps the best documents of its
task; the best of all tasks are ranked. Work and memory follow the terms of a bounded number of blocks;
further blocks take further passes.

Defined results: null and empty items have no rows; items equal in id and text are one item, items that
share only the id are ranked each for itself; null and empty documents count no terms and are never found;
repeated documents are ranked each, a null id before others; documents without a score above zero are left
out; empty tables give an empty result; only ids and texts are read.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut_lineage

BEST = 20
#: Terms, repeats included, of the items of one block (one item at least), and blocks of one pass over the documents.
BLOCK_TERMS, BLOCKS_AT_ONCE = 20_000, 8
#: Sets of one item among which pairs are mined.
NEAR = 32
#: Values held at once in a task.
CELLS = 4_000_000
NULL_ID = -(1 << 63)
#: Letters and digits as they are read, A-Z as a-z, other ASCII as a space.
READ = bytes(c | 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(READ).split()


def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [terms_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("text"), pa.array([len(t) for t in terms], pa.int64())],
                                         ["item_id", "text", "n_terms"])


class Plan:
    """Terms of a block, the additions that give its items, and the node of each item. The first nodes are the terms, repeated ones by as many."""

    def __init__(self, items: list[list[bytes]]):
        holders = defaultdict(list)  # a term that an item repeats has several leaves of one value
        for i, item in enumerate(items):
            for term, times in Counter(item).items():
                for copy in range(times):
                    holders[term, copy].append(i)
        leaves = sorted(holders)
        self.terms = [term for term, _ in leaves]
        self.additions: list[tuple[int, int]] = []
        alike = defaultdict(list)
        for k, leaf in enumerate(leaves):
            alike[tuple(holders[leaf])].append(k)
        rests: list[list[list[int]]] = [[] for _ in items]
        for of, own in sorted(alike.items(), key=lambda x: (-len(x[0]), x)):
            node = self.sum_of(own)
            for i in of:
                if not rests[i] or len(rests[i][-1]) == NEAR:
                    rests[i].append([])
                rests[i][-1].append(node)
        self.share([part for item in rests for part in item])
        self.items = [self.sum_of([node for part in item for node in sorted(part)]) for item in rests]

    def sum_of(self, nodes: list[int]) -> int:
        if not nodes:
            return -1
        node = nodes[0]
        for other in nodes[1:]:
            node = self.add(node, other)
        return node

    def add(self, a: int, b: int) -> int:
        self.additions.append((a, b))
        return len(self.terms) + len(self.additions) - 1

    def share(self, parts: list[list[int]]) -> None:
        """Replace, in place, pairs of nodes that several parts hold by their sum, the most frequent pair first."""
        count: Counter = Counter()
        where = defaultdict(set)
        for k, part in enumerate(parts):
            for i, a in enumerate(part):
                where[a].add(k)
                count.update((min(a, b), max(a, b)) for b in part[i + 1:])
        heap = [(-n, pair) for pair, n in count.items() if n > 1]
        heapq.heapify(heap)
        while heap:
            n, (a, b) = heapq.heappop(heap)
            now = count[a, b]
            if now != -n:
                if now > 1:
                    heapq.heappush(heap, (-now, (a, b)))
                continue
            new = self.add(a, b)
            met: Counter = Counter()
            for k in sorted(where[a] & where[b]):
                part = parts[k]
                part.remove(a)
                part.remove(b)
                for x in part:
                    count[min(a, x), max(a, x)] -= 1
                    count[min(b, x), max(b, x)] -= 1
                    met[x] += 1
                part.append(new)
                where[a].discard(k)
                where[b].discard(k)
                where[new].add(k)
            del count[a, b]
            for x, n in met.items():
                count[x, new] = n
                if n > 1:
                    heapq.heappush(heap, (-n, (x, new)))


def planned(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per block: item ids, terms, additions and the node of each item."""
    rows = rows.sort_values(["item_id", "text"])
    plan = Plan([terms_of(t) for t in rows["text"]])
    left, right = zip(*plan.additions) if plan.additions else ((), ())
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "ids": [rows["item_id"].tolist()], "terms": [plan.terms], "lefts": [list(left)],
                         "rights": [list(right)], "nodes": [plan.items]})


PLAN = "block long, ids array<long>, terms array<binary>, lefts array<int>, rights array<int>, nodes array<int>"


def plans(items: DataFrame, block_terms: int) -> tuple[DataFrame, int]:
    """The plan of every block and the number of blocks."""
    read = cut_lineage(items.filter("text IS NOT NULL").select(F.coalesce("item_id", F.lit(NULL_ID)).alias("item_id"), F.col("text").cast("binary").alias(
        "text")).distinct().mapInArrow(with_terms, "item_id long, text binary, n_terms long").filter("n_terms > 0"))
    blocks = int(-(-(read.agg(F.sum("n_terms")).first()[0] or 0) // block_terms))
    dealt = read.select(F.expr(f"pmod(xxhash64(item_id, text), {max(blocks, 1)})").alias("block"), "item_id", "text")
    return cut_lineage(dealt.groupBy("block").applyInPandas(planned, PLAN)), blocks


def counted(numbers):
    """For mapInArrow: doc_id, n (terms), and of the terms in numbers (a broadcast) their number and how often they occur."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = numbers.value
        for batch in batches:
            n, sizes, ids, times = [], [0], [], []
            for text in batch.column("text").to_pylist():
                terms = terms_of(text)
                n.append(len(terms))
                found = [(wanted[t], k) for t, k in Counter(terms).items() if t in wanted]
                ids += [f[0] for f in found]
                times += [f[1] for f in found]
                sizes.append(len(ids))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (ids, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "times"])
    return run


def best_of(score: np.ndarray, doc: np.ndarray, best: int) -> np.ndarray:
    return np.lexsort((doc, -score))[:best]


def ranked_in_task(shared, n_docs: int, n_terms: int, best: int):
    """For mapInArrow: the best documents of the task's rows for every item of the plans in shared (a broadcast)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, blocks = shared.value
        tops = [[(np.empty(0, "int64"), np.empty(0, "int64")) for _ in b["nodes"]] for b in blocks]
        widest = max(len(b["own"]) + len(b["lefts"]) for b in blocks)
        step = max(64, CELLS // (len(weights) + widest))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, times = (part.column(c) for c in ("ids", "times"))
                sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
                ids, times = (x.flatten().to_numpy().astype("int64") for x in (ids, times))
                doc_id = part.column("doc_id").to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                m = 100 - 25 + (25 * part.column("n").to_numpy().astype("int64") * n_docs) // n_terms
                values = np.zeros((len(weights), len(sizes)), "int64")
                values[ids, doc] = weights[ids] * ((1_000_000_000 * times) // (1000 * times + 12 * m[doc]))
                for block, top in zip(blocks, tops):
                    n = len(block["own"])
                    sums = np.empty((n + len(block["lefts"]), len(sizes)), "int64")
                    sums[:n] = values[block["own"]]
                    for k, (a, b) in enumerate(zip(block["lefts"], block["rights"]), n):
                        np.add(sums[a], sums[b], out=sums[k])
                    for i, node in enumerate(block["nodes"]):
                        score, who = top[i]
                        found = np.flatnonzero(sums[node] >= (score[-1] if len(score) == best else 1))
                        if len(found):
                            score, who = np.concatenate([score, sums[node][found]]), np.concatenate([who, doc_id[found]])
                            order = best_of(score, who, best)
                            top[i] = score[order], who[order]
        for block, top in zip(blocks, tops):
            counts = [len(score) for score, _ in top]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(sum(counts), block["block"])), pa.array(np.repeat(np.arange(len(top)), counts)), pa.array(np.repeat(block["ids"], counts)),
                pa.array(np.concatenate([who for _, who in top])), pa.array(np.concatenate([score for score, _ in top]))],
                ["block", "item", "item_id", "doc_id", "score"])
    return run


def weight(n_docs: int, holding):
    """A term's weight from the documents that hold it."""
    return F.floor(1000 * F.log((F.lit(float(2 * n_docs + 2))) / (2 * holding + 1))).cast("long")


def one_pass(rows: DataFrame, some: list, best: int) -> DataFrame:
    """block, item, item_id, doc_id and score of each task's best documents for the items of some plans."""
    spark = rows.sparkSession
    terms = sorted({t for p in some for t in p["terms"]})
    numbers = {bytes(t): k for k, t in enumerate(terms)}
    found = cut_lineage(rows.mapInArrow(counted(spark.sparkContext.broadcast(numbers)), "doc_id long, n long, ids array<int>, times array<int>"))
    n_docs, n_terms = found.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(terms), "int64")
    for r in found.select(F.explode("ids").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("holding")).select("term", weight(
            n_docs, F.col("holding")).alias("w")).collect():  # a row per term of the pass at most
        weights[r["term"]] = r["w"]
    blocks = [{"block": p["block"], "own": np.array([numbers[bytes(t)] for t in p["terms"]]), "ids": np.array(p["ids"], "int64"),
               **{k: list(p[k]) for k in ("lefts", "rights", "nodes")}} for p in some]
    shared = spark.sparkContext.broadcast((weights, blocks))
    return found.filter(F.size("ids") > 0).select("doc_id", "n", "ids", "times").mapInArrow(
        ranked_in_task(shared, n_docs, max(n_terms, 1), best), "block long, item long, item_id long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", id_column: str = "doc_id", text: str = "text",
           best: int = BEST, block_terms: int = BLOCK_TERMS, at_once: int = BLOCKS_AT_ONCE) -> DataFrame:
    """item_id, rank, doc_id and score of the best documents of each item."""
    made, blocks = plans(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")), block_terms)
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    tops = docs.sparkSession.createDataFrame([], "block long, item long, item_id long, doc_id long, score long")
    for first in range(0, blocks, at_once):
        some = made.filter(F.col("block").between(first, first + at_once - 1)).orderBy("block").collect()
        if some:
            tops = tops.unionByName(one_pass(rows, some, best))
    order = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc("doc_id"))
    known = lambda c: F.nullif(F.col(c), F.lit(NULL_ID)).alias(c)
    return tops.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select(known("item_id"), "rank", known("doc_id"), "score")


_TERMS = ("regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")

SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ts FROM documents),
c AS (SELECT count(*) FILTER (len(ts) > 0) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d),
f AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, n_docs),
i AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS.format("text")}) AS term FROM
      (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, term),
m AS (SELECT r, doc_id, 100 - 25 + (25 * len(ts) * n_docs) // n_terms AS m FROM d, c),
s AS (SELECT item_id, i.text, r, m.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, i.text, r, m.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) <= {BEST}"""
