"""Recursive text chunking: split at the coarsest separator present, merge up to a size with overlap."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, so a piece keeps the separator it starts with."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    window: list[str] = []
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            out.append("".join(window).strip())
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    out.append("".join(window).strip())
    return [chunk for chunk in out if chunk]


def split_text(text: str, size: int = 1000, overlap: int = 150, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    level = next(i for i, s in enumerate(separators) if s == "" or s in text)
    chunks: list[str] = []
    small: list[str] = []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            small.append(piece)
            continue
        if small:
            chunks += _packed(small, size, overlap)
            small = []
        chunks += split_text(piece, size, overlap, separators[level + 1:]) if level + 1 < len(separators) else [piece]
    return chunks + (_packed(small, size, overlap) if small else [])


def chunk_array(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Arrow-batched chunk lists; only texts longer than ``size`` should be sent here."""
    def chunks(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: split_text(t, size, overlap) if t else [])
    return F.pandas_udf(chunks, ArrayType(StringType()))(text)
