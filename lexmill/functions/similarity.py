"""How alike two texts are: by the words they share, by the edits between them, or by their matching blocks.

All but the last are columns of built-in functions; matching blocks are sought only where the edits leave it open.
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the small helpers by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What stands between words.
BETWEEN = r"[\s\p{P}]+"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bag(text: Column) -> Column:
    """The words of a text, each with its number among equal ones, as hashes: equal words of two texts meet as often as both hold them.

    Words are sorted, so the k-th of a run of equal words is numbered by its distance to the run's start.
    """
    words = F.array_sort(F.array_remove(F.split(F.lower(text), BETWEEN), ""))

    def numbered(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(starts, lambda at: F.flatten(F.transform(at, lambda first, j: F.transform(F.sequence(
            F.lit(0), F.coalesce(F.get(at, j + 1), F.size(s)) - first - 1), lambda k: F.xxhash64(F.get(s, first), k)))))
    return let(words, lambda s: F.when(F.size(s) > 0, numbered(s)).otherwise(F.array().cast("array<bigint>")))


def shared(left: Column, right: Column) -> Column:
    """Twice the words two bags share over all their words; 1 for two empty bags, 0 where one is null."""
    n = F.size(left) + F.size(right)
    ratio = F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(left, right)) / n)
    return F.when(left.isNull() | right.isNull(), 0.0).otherwise(ratio)


def word_ratio(left: Column, right: Column) -> Column:
    """Share of words of two texts."""
    return F.when(left == right, 1.0).otherwise(shared(bag(left), bag(right)))


def edit_ratio(left: Column, right: Column) -> Column:
    """Twice the characters that stay in the least edits from one text to the other, over all their characters; 0 where one is null.

    The difference of the lengths must be inserted; every further edit changes a character.
    """
    la, lb = F.length(left), F.length(right)
    stay = F.least(la, lb) - (F.levenshtein(left, right) - F.abs(la - lb))
    return F.coalesce(F.when(la + lb == 0, 1.0).otherwise(2.0 * stay / (la + lb)), F.lit(0.0))


def differs(left: Column, right: Column, least: float) -> Column:
    """Is the share of matching blocks of two texts below `least`?

    2 min / (sum of lengths) is the most it can be; a text equal to the other needs no look. Matching blocks are a common
    subsequence, so n edits leave at most 1 - n / (sum of lengths); edits are counted up to that bound only. What is left goes
    in Arrow batches.
    """
    def below(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x is not None and SequenceMatcher(None, x, y).ratio() < least for x, y in zip(a, b)], dtype=bool)
    la, lb = F.length(left), F.length(right)
    settled = F.when(left == right, False).when(2.0 * F.least(la, lb) < least * (la + lb), True).when(
        F.call_function("levenshtein", left, right, F.floor((1.0 - least) * (la + lb) + 1e-9).cast("int")) < 0, True)
    open_left = F.when(settled.isNull(), left)
    return F.coalesce(settled, F.pandas_udf(below, "boolean")(open_left, right))
