"""Near-duplicate lines by a deletion-neighbourhood join.

Two lines are near when one character inserted, deleted or replaced makes them equal; of near lines the
earliest stays (by document id, then place in the text). A line goes when an earlier line of any document
equals it or is near to it.

How: equal lines are one class, known by a 128-bit hash and its first place. Lines within one edit agree
in their first or in their last half, so only classes that share a half with another class are looked at
further. Those emit hashed keys: themselves, and every variant with one character of the other half left
out, with the place it was left out. Classes that share a key and the place differ in one replaced
character; a class that is a variant of others differs from them by one inserted character. So the
earliest neighbour of each class is a minimum per key, found without pairs of lines, and is verified by
the edit distance of both texts.

Defined results: null texts have no lines and stay null; lines without a word always stay; lines shorter
than MIN_CHARS must be equal to count as copies; rows equal in id and text are one document and get equal
results; documents that share an id are ordered by a hash of their text; an empty table gives an empty
result; only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.words import WORD_CLASS, let
from lexmill.session import cut_lineage

MIN_CHARS = 10
#: Up to this many candidate classes are sent to every executor; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
KEYS_AT_ONCE = 100_000
PLACE = ["doc_id", "row_hash", "line_no"]
LINE = ["h1", "h2"]


def half_key(line: Column, side: int, length: Column) -> Column:
    """Hash of the first (side 0) or last (side 1) `length` characters."""
    part = F.substring(line, F.lit(1), length) if side == 0 else F.substring(line, F.char_length(line) - length + 1, length)
    return F.xxhash64(F.lit(side), length, part)


def line_classes(rows: DataFrame, min_chars: int) -> DataFrame:
    """One row per different line: its hash, its first place, its length and the keys of its halves."""
    lines = rows.select("doc_id", "row_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(
        F.col("line").rlike(WORD_CLASS))
    n = F.char_length("line")
    long, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    fuzzy = n >= min_chars
    keyed = lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), n.alias("n"),
                         *[F.when(fuzzy & test, half_key(F.col("line"), side, size)).alias(f"k{side}{name}")
                           for side in (0, 1) for name, size, test in (("a", long, F.lit(True)), ("b", short, short < long))])
    return keyed.groupBy(*LINE).agg(F.min(F.struct(*PLACE)).alias("first"), F.min("n").alias("n"),
                                    *[F.min(f"k{side}{name}").alias(f"k{side}{name}") for side in (0, 1) for name in "ab"])


def sized(table: DataFrame) -> DataFrame:
    """A written table, sent to every executor where it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def shared_keys(rows: DataFrame) -> DataFrame:
    """Keys that more than one row holds."""
    return cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))


def sharing_classes(classes: DataFrame) -> DataFrame:
    """Classes that share a half with another class, with their first place and which half it is."""
    halves = classes.select(*LINE, F.inline(F.array(*[
        F.struct(F.col(f"k{side}{name}").alias("key"), F.lit(side).alias("side")) for side in (0, 1) for name in "ab"]))).filter("key IS NOT NULL")
    found = halves.join(sized(shared_keys(halves)), "key", "left_semi").groupBy(*LINE).agg(
        F.max((F.col("side") == 0).cast("int")).alias("front"), F.max((F.col("side") == 1).cast("int")).alias("back"))
    return classes.select(*LINE, "first").join(sized(cut_lineage(found)), LINE)


MIX, UNMIX = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def variant_keys(line: str, front: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the line itself (place -1) and of it without the character at each place of the halves still open."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64") + np.uint64(1)
    n = len(codes)
    powers = np.cumprod(np.concatenate([np.ones(1, "uint64"), np.full(n, MIX, "uint64")]))[:n]
    sums = np.concatenate([np.zeros(1, "uint64"), np.cumsum(codes * powers)])
    half = (n - 1) // 2
    places = np.arange(0 if back else half, n if front else n - half)
    without = sums[places] + (sums[n] - sums[places + 1]) * np.uint64(UNMIX)
    keys = np.concatenate([sums[n:], without]) ^ np.concatenate([[n], np.full(len(places), n - 1)]).astype("uint64")
    return keys.view("int64"), np.concatenate([[-1], places])


def variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        found, total = [], 0
        for row in zip(batch["h1"], batch["h2"], batch["line"], batch["front"], batch["back"]):
            found.append((*row[:2], *variant_keys(*row[2:])))
            total += len(found[-1][2])
            if total >= KEYS_AT_ONCE:
                yield listed(found)
                found, total = [], 0
        if found:
            yield listed(found)


def listed(found: list[tuple]) -> pd.DataFrame:
    counts = [len(keys) for _, _, keys, _ in found]
    return pd.DataFrame({"h1": np.repeat([f[0] for f in found], counts), "h2": np.repeat([f[1] for f in found], counts),
                         "key": np.concatenate([f[2] for f in found]), "place": np.concatenate([f[3] for f in found]).astype("int32")})


def earliest_neighbours(near: DataFrame) -> DataFrame:
    """h1, h2 and the first place of the earliest other class within one edit, verified on the texts."""
    emitted = near.select(*LINE, "line", "front", "back").mapInPandas(variants, "h1 long, h2 long, key long, place int")
    keys = cut_lineage(emitted.join(sized(shared_keys(emitted)), "key", "left_semi").join(near.select(*LINE, "first"), LINE))
    who = F.struct("first", *LINE)
    left_out = F.when(F.col("place") >= 0, who)
    replaced = keys.filter("place >= 0").groupBy("key", "place").agg(F.min(who).alias("other"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    inserted = keys.groupBy("key").agg(F.min(F.when(F.col("place") < 0, who)).alias("whole"), F.min(left_out).alias("shorter_of")).filter(
        "whole IS NOT NULL AND shorter_of IS NOT NULL")
    links = keys.join(replaced, ["key", "place"]).select(*LINE, "other").unionByName(
        keys.join(inserted, "key").select(*LINE, F.when(F.col("place") < 0, F.col("shorter_of")).otherwise(F.col("whole")).alias("other")))
    best = links.filter((F.col("other.h1") != F.col("h1")) | (F.col("other.h2") != F.col("h2"))).groupBy(*LINE).agg(F.min("other").alias("other"))
    texts = near.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("line").alias("other_line"))
    return best.join(near.select(*LINE, "line"), LINE).join(texts, (F.col("other.h1") == F.col("o1")) & (F.col("other.h2") == F.col("o2"))).filter(
        F.levenshtein("line", "other_line", 1) >= 0).select(*LINE, F.col("other.first").alias("other_first"))


def kept_lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, row_hash and the sorted numbers of the lines that stay, from rows of doc_id and text."""
    rows = rows.withColumn("row_hash", F.xxhash64("text"))
    classes = cut_lineage(line_classes(rows.filter("text IS NOT NULL"), min_chars))
    sharing = cut_lineage(sharing_classes(classes))
    wanted = sharing.select(*LINE, "first", "front", "back", F.col("first.doc_id").alias("_id"), F.col("first.row_hash").alias("_hash"),
                            F.col("first.line_no").alias("_line"))
    if sharing.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    near = cut_lineage(rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))).select(
        *LINE, "first", "front", "back", F.get(F.split("text", "\n"), F.col("_line")).alias("line")).dropDuplicates(LINE))
    gone = cut_lineage(earliest_neighbours(near).select(*LINE, "other_first"))
    kept = classes.join(sized(gone), LINE, "left").filter("other_first IS NULL OR other_first > first").select("first.*")
    return kept.groupBy("doc_id", "row_hash").agg(F.sort_array(F.collect_list("line_no")).alias("kept"))


def rebuilt(lines: Column, kept: Column) -> Column:
    """n_lines (with a word) and text of the kept and the blank lines."""
    worded = lambda line: line.rlike(WORD_CLASS)
    blank = F.filter(F.transform(lines, lambda line, i: F.when(~worded(line), i)), lambda i: i.isNotNull())
    return F.struct(F.size(F.filter(lines, worded)).cast("long").alias("n_lines"), F.array_join(F.transform(
        F.sort_array(F.array_union(kept, blank)), lambda i: F.get(lines, i)), "\n").alias("text"))


def with_kept_lines(docs: DataFrame, id_column: str, text: str, min_chars: int) -> DataFrame:
    """row (all columns of docs), n_lines, n_kept and text. The row travels as one value, so its names clash with none here."""
    per_row = kept_lines(docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")), min_chars)
    packed = docs.select(F.struct("*").alias("row"))
    on = F.col("row")[id_column].eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.col("row")[text]) == F.col("row_hash"))
    joined = packed.join(per_row, on, "left").select("row", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    made = joined.select("row", F.size("kept").cast("long").alias("n_kept"), F.inline_outer(F.array(
        let(F.split(F.col("row")[text], "\n"), lambda lines: rebuilt(lines, F.col("kept"))))))
    return made.select("row", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), "n_kept", "text")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines (with a word), n_kept and text, the lines that stay."""
    return with_kept_lines(docs, id_column, text, min_chars).select(F.col("row")[id_column].alias("doc_id"), "n_lines", "n_kept", "text")


def cleaned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with their texts reduced to the lines that stay; documents that lose every line with a word go."""
    left = with_kept_lines(docs, id_column, text, min_chars).filter("n_lines = 0 OR n_kept > 0")
    return left.select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
