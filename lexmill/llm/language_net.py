"""Language of a text by a byte network: filters of widths 2, 3 and 4, max pooling and softmax over fixed-length windows.

The network is fitted in numpy on a bounded sample of labelled texts (SAMPLE_ROWS rows, the first by a
hash of the id; WINDOWS windows spread over each text) and then scores every window of every text. The
language of a text is the one with the largest mean log probability over its windows.

Defined results: null texts and texts without a letter are `und` with score 0; rows without a language
teach nothing; with no labelled row, or one language only, every other text gets that language (or
`und`); equal texts get equal answers; only id, text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_filters import Adam, Filters, glued, slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
SAMPLE_ROWS = 3000
WINDOWS = 4
EPOCHS = 8
#: Small samples are gone through more often, up to about this many steps of 128 windows.
STEPS = 700
BATCH_BYTES = 1 << 16
UNKNOWN = "und"


@dataclass
class Net:
    languages: list[str]
    filters: Filters
    weights: np.ndarray
    bias: np.ndarray


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def fit(texts: list[bytes], languages: list[str], seed: int = 5) -> Net:
    names = sorted(set(languages))
    net = Net(names, Filters(WIDTHS, FILTERS, seed), np.random.default_rng(seed).normal(
        0, 0.1, (len(WIDTHS) * FILTERS, max(1, len(names)))).astype("float32"), np.zeros(max(1, len(names)), "float32"))
    rows, counts = glued(texts, WINDOW)
    first = np.cumsum(counts) - counts
    chosen = np.concatenate([f + np.unique(np.linspace(0, c - 1, min(c, WINDOWS)).astype(int)) for f, c in zip(first, counts)] or [np.zeros(0, int)])
    labels = np.searchsorted(names, np.repeat(np.array(languages, dtype=object), counts).astype(str)) if names else np.zeros(0, int)
    rng, adam = np.random.default_rng(seed), Adam([*net.filters.parameters(), net.weights, net.bias], 0.01)
    for _ in range(max(EPOCHS, -(-STEPS * 128 // len(chosen))) if len(names) > 1 else 0):
        rng.shuffle(chosen)
        for at in range(0, len(chosen), 128):
            pick = chosen[at:at + 128]
            grid = np.ascontiguousarray(rows[pick].T)
            pooled, places = net.filters.forward(grid, WINDOW)
            slope = np.exp(log_softmax(pooled @ net.weights + net.bias))
            slope[np.arange(len(pick)), labels[pick]] -= 1
            slope /= len(pick)
            down = (slope @ net.weights.T) * (pooled > 0)
            adam.update([*net.filters.backward(grid, places, down), pooled.T @ slope, slope.sum(axis=0)])
    return net


def predict(net: Net, texts: list[bytes]) -> list[tuple[str, float]]:
    """Language and its probability for texts that hold a letter."""
    found: list[tuple[str, float]] = []
    for begin, end in slices(texts, 1 << 20):
        rows, counts = glued(texts[begin:end], WINDOW)
        step = BATCH_BYTES // WINDOW
        logs = np.concatenate([log_softmax(net.filters.pooled(np.ascontiguousarray(rows[i:i + step].T), WINDOW) @ net.weights + net.bias)
                               for i in range(0, len(rows), step)])
        mean = log_softmax(np.add.reduceat(logs, np.cumsum(counts) - counts, axis=0) / counts[:, None])
        best = mean.argmax(axis=1)
        found += [(net.languages[b], float(np.exp(m[b]))) for b, m in zip(best, mean)]
    return found


def answers(net: Net):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net.filters.fold()
        for batch in batches:
            texts = batch["text"].tolist()
            lettered = [i for i, t in enumerate(texts) if net.languages and t is not None and any(map(str.isalpha, t))]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, (name, score) in zip(lettered, predict(net, [texts[i].encode("utf-8", "replace") for i in lettered])):
                names[i], scores[i] = name, score
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"],
                                "lang_pred": pd.Series(names, dtype=object), "score": scores})
    return run


def detect(docs: DataFrame, held_out, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. held_out: id column -> boolean column; such rows teach nothing."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    ticket = F.xxhash64(F.col("doc_id").cast("string"))
    labelled = rows.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    few = labelled.select("doc_id", ticket.alias("t")).orderBy("t").limit(sample_rows).select("doc_id").distinct()
    sample = labelled.join(F.broadcast(few), "doc_id").filter(F.length("text") > 0).select("text", "lang").limit(2 * sample_rows).collect()
    sample.sort()
    net = fit([r["text"].encode("utf-8", "replace") for r in sample], [r["lang"] for r in sample])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInPandas(
        answers(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
