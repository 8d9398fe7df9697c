"""Named queries with the ANSI SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern as an ANSI string literal."""
    return "'" + ("(?i)" if ignore_case else "") + pattern.replace("'", "''") + "'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def contains_any(expr: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quoted(p)})" for p in phrases) + ")"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def words_sql(text: str) -> str:
    """The words of a text, sorted."""
    return f"list_sort(list_filter(regexp_split_to_array(lower({text}), '[\\s\\p{{P}}]+'), lambda x: x <> ''))"


def bag_sql(words: str) -> str:
    """Sorted words, each with its number among equal ones."""
    return f"list_transform(range(1, len({words}) + 1), lambda i: {words}[i] || '#' || (i - list_position({words}, {words}[i])))"


def shared_sql(left: str, right: str) -> str:
    """Share of words of two bags."""
    return f"(2.0 * len(list_intersect({left}, {right})) / (len({left}) + len({right})))"
