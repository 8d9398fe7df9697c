"""Quality of a text by a byte network over overlapping chunks.

Learned filters of widths 2, 3 and 4 run over the whole text. Their largest answers in each chunk
(two neighbouring halves; chunks overlap by a half) feed a hidden layer; the largest hidden values over
all chunks are combined into one probability of label 1. So one bad stretch anywhere can lower the score.

The network is fitted in numpy on a bounded sample of labelled texts: SAMPLE_ROWS rows, the first by a
hash of the id, of each of them HALVES half chunks spread over the text (all of them in most texts).

Defined results: null and empty texts are scored as one empty chunk; without labelled rows, or with one
label only, every score is the share of label 1 among them (0.5 without any); equal texts get equal
scores; of documents only id and text are read, of labels only id and label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_filters import Adam, Filters, glued, slices

HALF = 128
WIDTHS = (2, 3, 4)
AHEAD = max(WIDTHS) - 1
FILTERS = 8
HIDDEN = 24
SAMPLE_ROWS = 4000
HALVES = 40
EPOCHS = 10
#: Small samples are gone through more often, up to about this many steps of 32 texts.
STEPS = 1000
BATCH_BYTES = 1 << 16


@dataclass
class Net:
    filters: Filters
    weights: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    share: float | None = None


def halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Half chunks with the next bytes of the text behind each, and the number of half chunks of each text."""
    rows, counts = glued(texts, HALF)
    ahead = np.zeros((len(rows), AHEAD), "uint8")
    ahead[:-1] = rows[1:, :AHEAD]
    ahead[np.cumsum(counts) - 1] = 0
    return np.concatenate([rows, ahead], axis=1), counts


def chunks(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of each chunk (the same where a text has one half only), and the chunks of each text."""
    n = np.maximum(counts - 1, 1)
    owner = np.repeat(np.arange(len(counts)), n)
    left = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (np.cumsum(counts) - counts)[owner]
    return left, left + (counts[owner] > 1), n


def spread(texts: list[bytes]) -> list[tuple[np.ndarray, ...]]:
    """Half chunks of each text, at most HALVES runs of them, evenly spread in neighbouring pairs."""
    found = []
    for text in texts:
        rows, _ = halves([text])
        if len(rows) > HALVES:
            starts = np.linspace(0, len(rows) - 2, HALVES // 2).astype(int)
            rows = rows[np.unique(np.concatenate([starts, starts + 1]))]
        found.append(rows)
    return found


def fit(texts: list[bytes], labels: list[int], seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    size = len(WIDTHS) * FILTERS
    net = Net(Filters(WIDTHS, FILTERS, seed), rng.normal(0, size ** -0.5, (size, HIDDEN)).astype("float32"), np.full(HIDDEN, 0.1, "float32"),
              rng.normal(0, 0.3, HIDDEN).astype("float32"), np.zeros(1, "float32"))
    want = np.array(labels, "float32")
    if len(set(labels)) < 2:
        net.share = float(want.mean()) if len(want) else 0.5
        return net
    grids, order = spread(texts), np.arange(len(texts))
    adam = Adam([*net.filters.parameters(), net.weights, net.bias, net.out, net.out_bias], 0.006)
    epochs = max(EPOCHS, -(-STEPS * 32 // len(texts)))
    for epoch in range(epochs):
        adam.rate = 0.006 * (1 - epoch / epochs)
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            pick = order[at:at + 32]
            counts = np.array([len(grids[i]) for i in pick])
            grid = np.ascontiguousarray(np.concatenate([grids[i] for i in pick]).T)
            pooled, places = net.filters.forward(grid, HALF)
            left, right, n = chunks(counts)
            chunk = np.maximum(pooled[left], pooled[right])
            hidden = np.maximum(chunk @ net.weights + net.bias, 0)
            first, owner = np.cumsum(n) - n, np.repeat(np.arange(len(pick)), n)
            top = np.maximum.reduceat(hidden, first, axis=0)
            slope = (1 / (1 + np.exp(-(top @ net.out + net.out_bias))) - want[pick]) / len(pick)
            to_hidden = (hidden == top[owner]) * (hidden > 0) * (slope[:, None] * net.out)[owner]
            to_chunk = to_hidden @ net.weights.T
            down = np.zeros_like(pooled)
            np.add.at(down, left, to_chunk * (pooled[left] == chunk))
            np.add.at(down, right, to_chunk * (pooled[right] == chunk) * (left != right)[:, None])
            down *= pooled > 0
            adam.update([*net.filters.backward(grid, places, down), chunk.T @ to_hidden, to_hidden.sum(axis=0), top.T @ slope,
                         slope.sum(keepdims=True)])
    return net


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """Probability of label 1 for each text."""
    if net.share is not None:
        return np.full(len(texts), net.share)
    found = [np.zeros(0)]
    for begin, end in slices(texts, 1 << 20):
        rows, counts = halves(texts[begin:end])
        step = BATCH_BYTES // HALF
        pooled = np.concatenate([net.filters.pooled(np.ascontiguousarray(rows[i:i + step].T), HALF) for i in range(0, len(rows), step)])
        left, right, n = chunks(counts)
        hidden = np.maximum(np.maximum(pooled[left], pooled[right]) @ net.weights + net.bias, 0)
        top = np.maximum.reduceat(hidden, np.cumsum(n) - n, axis=0)
        found.append(1 / (1 + np.exp(-(top @ net.out + net.out_bias).astype("float64"))))
    return np.concatenate(found)


def answers(net: Net, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net.filters.fold()
        for batch in batches:
            scores = score(net, [(t or "").encode("utf-8", "replace") for t in batch["text"]])
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": scores,
                                "predicted": (scores >= threshold).astype("int32")})
    return run


def rate(docs: DataFrame, labels: DataFrame, held_out, id_column: str = "doc_id", text: str = "text", label: str = "quality",
         threshold: float = 0.3, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. held_out: id column -> boolean column; such rows teach nothing."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    few = known.filter(~held_out(F.col("doc_id"))).select("doc_id", "label", F.xxhash64(F.col("doc_id").cast("string")).alias("t")).orderBy(
        "t", "label").limit(sample_rows).groupBy("doc_id").agg(F.min("label").alias("label"))
    sample = rows.join(F.broadcast(few), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "label").limit(2 * sample_rows).collect()
    sample.sort()
    net = fit([r["text"].encode("utf-8", "replace") for r in sample], [r["label"] for r in sample])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(
        answers(net, threshold), f"doc_id {kind}, held_out boolean, score double, predicted int")
