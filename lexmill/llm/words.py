"""Word expressions shared by the native operators.

A word is a maximal run of characters other than space, tab, line feed, vertical tab,
form feed and carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


#: The same word list in SQL of the checking engine.
ANSI_WORDS = r"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
