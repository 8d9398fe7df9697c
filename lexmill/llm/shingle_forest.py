"""N-gram Jaccard join by banded MinHash.

Texts are sets of 5-word shingles. A signature of each text holds TREES bands of hashes; in a band, texts
that share all its hashes meet in a node. The width of a band is the same for all texts and set before any
row is read: the largest up to MAX_DEPTH at which a pair at the similarity bound meets in some band with the
target recall (4 hashes in 16 bands give 0.9997 at 0.8). There are no tries and no prefixes that the data
shorten: the bound and the recall are fixed, so fixed bands find what they ask for in one grouped pass, and
longer signatures would only be made and moved as well. What meets is not yet a link:

1. Equal texts are one text of the bands (known by md5), so copies are never compared.
2. Within a node, signatures estimate similarities; pairs far below the bound (FAR standard errors)
   are dropped and a spanning forest of the rest is kept. Large nodes are dealt into blocks, and each pair
   of blocks is a task of its own, so a node of any size is spread.
3. Components of these edges are groups of possible links. Each group is verified exactly: texts travel
   once to their group (to each pair of blocks of it, if it is large), shingle sets are intersected as
   matrices, links are counted per text and a spanning forest of the links is kept. No pair is emitted.
4. Components of the verified links are the classes.

Defined results: null texts and texts below 5 words have no shingles, so they are linked to nothing; equal
texts (nulls too) always share a class; classes take the least id in them; rows equal in id and text count once
and get equal rows; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.star import components
from lexmill.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
TREES = 16
MAX_DEPTH = 8
RECALL = 0.999
FAR = 5.0
#: Most texts of one block of a trie node, and of one block of a group to verify.
NODE_BLOCK = 256
GROUP_BLOCK = 128
CHUNK = 1 << 15
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def depth_for(similarity: float, recall: float = RECALL, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """Hashes in a band: the most that find pairs at this similarity with this probability, by formula."""
    depth = max_depth
    while depth > 1 and 1 - (1 - similarity ** depth) ** trees < recall:
        depth -= 1
    return depth


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, in order, and how many each text has."""
    cut = [WORD.findall(t) if t else [] for t in texts]
    flat = np.array([w for c in cut for w in c], dtype=object)
    sizes = np.array([len(c) for c in cut], "int64")
    hashes = mixed(pd.util.hash_array(flat, categorize=True)) if len(flat) else np.zeros(0, "uint64")
    if len(flat) < words:
        return np.zeros(0, "uint64"), np.zeros(len(texts), "int64")
    rolled = np.zeros(len(flat) - words + 1, "uint64")
    for k in range(words):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(flat) - words + 1 + k]
    counts = np.maximum(sizes - words + 1, 0)
    starts = np.cumsum(sizes) - sizes
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    return mixed(rolled[at]), counts


def hash_rows(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(8)
    return draw.integers(0, 1 << 63, n).astype("uint64") * np.uint64(2) + np.uint64(1), draw.integers(0, 1 << 63, n).astype("uint64")


def signatures(texts: list[str | None], n: int, words: int = WORDS) -> np.ndarray:
    """n least hashes of each text; texts without shingles get rows of the largest number."""
    found = np.full((len(texts), n), 0xFFFFFFFF, "uint32")
    factor, offset = hash_rows(n)
    begin = 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end] or "") < 8 * CHUNK):
            total += len(texts[end] or "")
            end += 1
        values, counts = shingles(texts[begin:end], words)
        full = np.flatnonzero(counts)
        if len(full):
            starts = (np.cumsum(counts) - counts)[full]
            for k in range(n):
                found[begin + full, k] = np.minimum.reduceat((values * factor[k] + offset[k]) >> np.uint64(32), starts)
        begin = end
    return found


def signature_rows(n: int, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            rows = signatures(texts, n, words)
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(), "text_key": batch["text_key"].to_numpy(),
                                "signature": [r.tobytes() if r[0] != 0xFFFFFFFF or (r != r[0]).any() else None for r in rows]})
    return run


def spanning(links: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of a symmetric matrix of links, and the tree of each row."""
    left, tree, edges = np.ones(len(links), bool), np.zeros(len(links), "int64"), []
    for root in range(len(links)):
        if not left[root]:
            continue
        left[root], tree[root], todo = False, root, [root]
        while todo:
            at = todo.pop()
            fresh = np.flatnonzero(links[at] & left)
            left[fresh], tree[fresh] = False, root
            edges += [(at, int(f)) for f in fresh]
            todo += fresh.tolist()
    return edges, tree


def bridges(links: np.ndarray, between: np.ndarray | None) -> list[tuple[int, int]]:
    """A spanning forest of the links of one block; of two blocks, only the links that tie trees of the one to trees of the other."""
    if between is None:
        return spanning(links)[0]
    _, tree = spanning(links & ~between)
    x, y = np.nonzero(np.triu(links & between))
    ends = np.sort(np.stack([tree[x], tree[y]], axis=1), axis=1)
    _, first = np.unique(ends, axis=0, return_index=True) if len(ends) else (None, np.zeros(0, int))
    names, edges = list(range(len(links))), []
    for i in first.tolist():
        a, b = (find(names, int(e)) for e in ends[i])
        if a != b:
            names[a] = b
            edges.append((int(x[i]), int(y[i])))
    return edges


def find(names: list[int], at: int) -> int:
    while names[at] != at:
        names[at] = names[names[at]]
        at = names[at]
    return at


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows that arrive sorted by keys -> one frame per group, over the ends of batches."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        changed = np.zeros(len(batch), bool)
        for k in keys:
            column = batch[k].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.iloc[a:b]
        rest = batch.iloc[cuts[-1]:]
    if rest is not None and len(rest):
        yield rest


def crossing(blocks: np.ndarray, first: int, second: int) -> np.ndarray | None:
    """Which pairs of rows belong to this pair of blocks: all of one block, or those between two."""
    return None if first == second else blocks[:, None] != blocks[None, :]


def node_edges(bound: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[bytes] = []
        b: list[bytes] = []
        for cell in in_groups(batches, ["tree", "prefix", "first", "second"]):
            if len(cell) > 1:
                keys = cell["text_key"].to_numpy()
                rows = np.frombuffer(b"".join(cell["signature"]), "uint32").reshape(len(cell), -1)
                alike = np.zeros((len(cell), len(cell)), "uint16")
                for column in rows.T:
                    alike += column[:, None] == column[None, :]
                links = alike >= bound * rows.shape[1]
                between = crossing(cell["block"].to_numpy(), cell["first"].iloc[0], cell["second"].iloc[0])
                for x, y in bridges(links, between):
                    a.append(keys[x])
                    b.append(keys[y])
            if len(a) >= 20_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})
    return run


def overlaps(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of each pair of texts, and the number of different shingles of each."""
    values, counts = shingles(texts, words)
    owner = np.repeat(np.arange(len(texts)), counts)
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    sizes = np.bincount(owner, minlength=len(texts))
    group = np.cumsum(np.concatenate([[0], values[1:] != values[:-1]])) if len(values) else np.zeros(0, int)
    often = np.bincount(group, minlength=1)[group] > 1 if len(values) else np.zeros(0, bool)
    owner, group = owner[often], group[often]
    common = np.zeros((len(texts), len(texts)), "float64")
    if len(group):
        column = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
        for begin in range(0, int(column[-1]) + 1, 4096):
            a, b = np.searchsorted(column, (begin, begin + 4096))
            part = np.zeros((len(texts), int(column[b - 1]) - begin + 1), "float32")
            part[owner[a:b], column[a:b] - begin] = 1
            common += part @ part.T
    return common, sizes


def verified_links(similarity: float, words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for cell in in_groups(batches, ["root", "first", "second"]):
            cell = cell.drop_duplicates("text_key")
            if len(cell) < 2:
                continue
            keys = cell["text_key"].to_numpy()
            common, sizes = overlaps(cell["text"].tolist(), words)
            links = (common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-9) & (common > 0)
            np.fill_diagonal(links, False)
            between = crossing(cell["block"].to_numpy(), cell["first"].iloc[0], cell["second"].iloc[0])
            counts = (links if between is None else links & between).sum(axis=1)
            edges = bridges(links, between)
            linked = np.flatnonzero(counts)
            yield pd.DataFrame({"a": [*keys[linked], *[keys[x] for x, _ in edges]], "b": [*[None] * len(linked), *[keys[y] for _, y in edges]],
                                "n": np.concatenate([counts[linked], np.zeros(len(edges), "int64")]).astype("int64")})
    return run


def dealt(members: DataFrame, group: list[str], size: str, most: int, sort_key: str) -> DataFrame:
    """Members of groups of known size, in blocks; each row goes to every pair of blocks that holds its own."""
    blocks = F.ceil(F.col(size) / most).cast("int")
    placed = members.withColumn("block", F.pmod(F.xxhash64(sort_key), blocks).cast("int")).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = placed.select("*", F.least("block", "_other").alias("first"), F.greatest("block", "_other").alias("second")).drop("_other", size)
    cell = [*group, "first", "second"]
    return cells.repartition(*[F.col(c) for c in cell]).sortWithinPartitions(*cell)


def text_key(text: Column) -> Column:
    return F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit("00")))


def keyed_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).withColumn("text_key", text_key(F.col("text")))


def linked_texts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                 words: int = WORDS, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, text_key) of all rows; (text_key, n_links) of linked texts; (node, root) of their components."""
    depth = depth_for(similarity, recall)
    rows = keyed_rows(docs, id_column, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(rows.mapInPandas(signature_rows(TREES * depth, words), f"doc_id {kind}, text_key binary, signature binary"))
    texts = signed.filter("signature IS NOT NULL").groupBy("text_key").agg(F.min("signature").alias("signature"))
    forest = texts.select("text_key", F.posexplode(F.array(*[F.xxhash64(F.substring("signature", 1 + 4 * depth * t, 4 * depth))
                                                             for t in range(TREES)])).alias("tree", "prefix"))
    forest = cut_lineage(forest)
    nodes = forest.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    error = (similarity * (1 - similarity) / (TREES * depth)) ** 0.5
    met = forest.join(nodes, ["tree", "prefix"]).join(texts, "text_key")
    edges = dealt(met, ["tree", "prefix"], "size", NODE_BLOCK, "text_key").mapInPandas(
        node_edges(similarity - FAR * error), "a binary, b binary")
    groups = components(edges)
    sized = groups.join(groups.groupBy("root").agg(F.count(F.lit(1)).alias("size")), "root").withColumnRenamed("node", "text_key")
    first_row = signed.groupBy("text_key").agg(F.min("doc_id").alias("first_id"))
    with_text = sized.join(first_row, "text_key").join(rows.withColumnRenamed("text_key", "_key"), (
        F.col("text_key") == F.col("_key")) & F.col("first_id").eqNullSafe(F.col("doc_id"))).drop("_key", "first_id", "doc_id")
    found = cut_lineage(dealt(with_text, ["root"], "size", GROUP_BLOCK, "text_key").mapInPandas(
        verified_links(similarity, words), "a binary, b binary, n long"))
    counted = found.filter("b IS NULL").groupBy(F.col("a").alias("text_key")).agg(F.sum("n").alias("n_links"))
    return signed.select("doc_id", "text_key"), counted, components(found.filter("b IS NOT NULL").select("a", "b"))


def members(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
            words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """doc_id, text_key, root (key of the class), class_id and n_links of each row."""
    rows, counted, parts = linked_texts(docs, id_column, text, similarity, words, recall)
    least = rows.groupBy("text_key").agg(F.min("doc_id").alias("least"))
    placed = least.join(parts.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("class_id")), "root").join(counted, "text_key", "left")
    by_text = named.select("text_key", "root", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return rows.join(by_text, "text_key").select("doc_id", "text_key", "root", "class_id", "n_links")


def classes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class) and n_links, the other texts at or above the bound."""
    return members(docs, **options).select("doc_id", "class_id", "n_links")


def first_of_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without near copies: the row with the least id of each class stays, once."""
    first = members(docs, id_column, text, **options).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*")
    packed = docs.select(F.struct("*").alias("row")).withColumn("_key", text_key(F.col("row")[text])).withColumn("_id", F.col("row")[id_column])
    stay = packed.join(first, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_semi")
    return stay.dropDuplicates(["_id", "_key"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
