"""Byte filters of several widths with max pooling, in numpy: the shared part of the two convolutional networks.

A filter of width w adds one learned number per (place, byte) over w neighbouring bytes. Filters run
position-major, so one lookup serves a whole batch of windows. For scoring, neighbouring places are
folded into one table per pair of bytes, which halves the lookups.
"""

from __future__ import annotations

import numpy as np


class Filters:
    def __init__(self, widths: tuple[int, ...], count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.widths, self.count = widths, count
        self.tables = [rng.normal(0, 0.3, (w, 256, count)).astype("float32") for w in widths]
        self.bias = [np.zeros(count, "float32") for _ in widths]

    def parameters(self) -> list[np.ndarray]:
        return self.tables + self.bias

    def fold(self) -> None:
        """Pair tables for scoring; call once after training."""
        self.pairs = [[(table[t][:, None, :] + table[t + 1][None, :, :]).reshape(65536, -1) if t + 1 < len(table) else table[t]
                       for t in range(0, len(table), 2)] for table in self.tables]

    def pooled(self, grid: np.ndarray, positions: int) -> np.ndarray:
        """grid: bytes, place by window -> the largest answer of each filter in each window, from 0."""
        two = grid[:-1].astype("uint16") << 8 | grid[1:]
        found = []
        for width, parts, bias in zip(self.widths, self.pairs, self.bias):
            n = min(positions, len(grid) - width + 1)
            answers = None
            for k, table in enumerate(parts):
                index = two if len(table) > 256 else grid
                part = table.take(index[2 * k:2 * k + n], axis=0)
                answers = part if answers is None else np.add(answers, part, out=answers)
            found.append(np.maximum(answers.max(axis=0) + bias, 0))
        return np.concatenate(found, axis=1)

    def forward(self, grid: np.ndarray, positions: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """As pooled, with the place of each largest answer."""
        found, places = [], []
        for width, table, bias in zip(self.widths, self.tables, self.bias):
            n = min(positions, len(grid) - width + 1)
            answers = table[0].take(grid[:n], axis=0)
            for t in range(1, width):
                answers += table[t].take(grid[t:t + n], axis=0)
            best = answers.argmax(axis=0)
            places.append(best)
            found.append(np.maximum(np.take_along_axis(answers, best[None], axis=0)[0] + bias, 0))
        return np.concatenate(found, axis=1), places

    def backward(self, grid: np.ndarray, places: list[np.ndarray], slope: np.ndarray) -> list[np.ndarray]:
        """Slopes of the parameters from the slopes of the pooled answers (those cut off at 0 already zeroed)."""
        tables, biases = [], []
        columns, windows = np.arange(self.count), np.arange(grid.shape[1])[:, None]
        for k, (width, best) in enumerate(zip(self.widths, places)):
            part = slope[:, k * self.count:(k + 1) * self.count]
            grads = [np.bincount((grid[best + t, windows].astype("int64") * self.count + columns).ravel(), part.ravel().astype("float64"),
                                 256 * self.count).reshape(256, -1) for t in range(width)]
            tables.append(np.stack(grads).astype("float32"))
            biases.append(part.sum(axis=0))
        return tables + biases


class Adam:
    def __init__(self, parameters: list[np.ndarray], rate: float):
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def update(self, slopes: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, v in zip(self.parameters, slopes, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9 ** self.step)) / (np.sqrt(v / (1 - 0.99 ** self.step)) + 1e-7)


def glued(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in rows of `width`, each text padded with byte 0 to whole rows (one at least); and the rows of each text."""
    counts = np.array([max(1, -(-len(t) // width)) for t in texts], "int64")
    buffer = b"".join([t.ljust(int(n) * width, b"\0") for t, n in zip(texts, counts)])
    return np.frombuffer(buffer, "uint8").reshape(-1, width), counts


def slices(texts: list[bytes], most_bytes: int) -> list[tuple[int, int]]:
    """Runs of texts of about most_bytes in total; a longer text is a run of its own."""
    found, begin, total = [], 0, 0
    for i, text in enumerate(texts):
        if i > begin and total + len(text) > most_bytes:
            found.append((begin, i))
            begin, total = i, 0
        total += len(text)
    return [*found, (begin, len(texts))] if texts else []
