"""Text preparation around a translation cache."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as X

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The native digits that are written as each digit.
NATIVE = {
    "0": "\u09e6\u0ae6\u0ce6\u0966\u0660\uabf0\u0b66\u0a66\u1c50\u06f0",
    "1": "\u09e7\u0ae7\u0967\u0ce7\u06f1\uabf1\u0b67\u0a67\u1c51\u0c67",
    "2": "\u09e8\u0ae8\u0968\u0ce8\u06f2\uabf2\u0b68\u0a68\u1c52\u0c68",
    "3": "\u09e9\u0ae9\u0969\u0ce9\u06f3\uabf3\u0b69\u0a69\u1c53\u0c69",
    "4": "\u09ea\u0aea\u096a\u0cea\u06f4\uabf4\u0b6a\u0a6a\u1c54\u0c6a",
    "5": "\u09eb\u0aeb\u096b\u0ceb\u06f5\uabf5\u0b6b\u0a6b\u1c55\u0c6b",
    "6": "\u09ec\u0aec\u096c\u0cec\u06f6\uabf6\u0b6c\u0a6c\u1c56\u0c6c",
    "7": "\u09ed\u0aed\u096d\u0ced\u06f7\uabf7\u0b6d\u0a6d\u1c57\u0c6d",
    "8": "\u09ee\u0aee\u096e\u0cee\u06f8\uabf8\u0b6e\u0a6e\u1c58\u0c6e",
    "9": "\u09ef\u0aef\u096f\u0cef\u06f9\uabf9\u0b6f\u0a6f\u1c59\u0c6f",
}

# Punctuation replacements, in order.
PUNCTUATION = [("\r", ""), ("(", " ("), (")", ") "), ("( ", "("), (" )", ")"), (" :", ":"), (" ;", ";"), ("`", "'"), ("„", '"'), ("“", '"'),
               ("”", '"'), ("–", "-"), ("—", " - "), ("´", "'"), ("‘", "'"), ("‚", "'"), ("’", "'"), ("''", '"'), ("´´", '"'), ("…", "..."),
               ("\u00a0«\u00a0", ' "'), ("«\u00a0", '"'), ("«", '"'), ("\u00a0»\u00a0", '" '), ("\u00a0»", '"'), ("»", '"'),
               ("\u00a0%", "%"), ("nº\u00a0", "nº "), ("\u00a0:", ":"), ("\u00a0ºC", " ºC"), ("\u00a0cm", " cm"), ("\u00a0?", "?"),
               ("\u00a0!", "!"), ("\u00a0;", ";"), (",\u00a0", ", ")]
PUNCTUATION_PATTERNS = [(r"[ ]{2,}", " "), (r"\.{2,}", "."), (r"\) ([\.!:?;,])", ")$1"), (r"(\d) %", "$1%"), (r"\"([,\.]+)", '$1"'),
                        ("(\\d)\u00a0(\\d)", "$1.$2")]


def cache_key(source: str, target: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(source), F.lit(target), text), 256)


def cache_split(texts: DataFrame, cache: DataFrame, source: str = "en", target: str = "hi") -> tuple[DataFrame, DataFrame]:
    """(texts with their cached translation or null, distinct misses); blank texts pass through."""
    blank = X.strip(F.coalesce("text", F.lit(""))) == ""
    keyed = texts.withColumn("key", F.when(~blank, cache_key(source, target, F.col("text"))))
    out = keyed.join(cache.select("key", "translated"), "key", "left").withColumn(
        "translated", F.when(blank, F.col("text")).otherwise(F.col("translated")))
    misses = keyed.filter(~blank).join(cache, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    return out, misses


NATIVE_DIGITS = "".join(NATIVE.values())
ROMAN_DIGITS = "".join(roman * len(native) for roman, native in NATIVE.items())


def roman_digits(text: Column) -> Column:
    return F.translate(text, NATIVE_DIGITS, ROMAN_DIGITS)


def punctuation(text: Column) -> Column:
    for old, new in PUNCTUATION:
        text = F.replace(text, F.lit(old), F.lit(new))
    for pattern, new in PUNCTUATION_PATTERNS:
        text = F.regexp_replace(text, pattern, new)
    return F.trim(text)


def mask(df: DataFrame, text: str) -> DataFrame:
    """masked text and a map placeholder -> original for e-mails, URLs, long numerals and handles.

    Matches are replaced kind after kind; equal matches share a placeholder.
    """
    from .classify import once
    df = once(df, F.struct(roman_digits(F.regexp_replace(F.col(text), r"^\n+|\n+$", "")).alias("_t"),
                           F.array().cast("array<string>").alias("_all")))
    kinds = [(P.EMAIL, None), (P.URL, r"[.]"), (P.NUMERAL, r"[ .:]"), (P.HANDLE, None)]
    for pattern, squeeze in kinds:
        found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col("_t"), F.lit(P.jvm(pattern)), F.lit(0))))
        if squeeze:
            found = F.filter(found, lambda m: F.length(F.regexp_replace(m, squeeze, "")) >= 4)
        df = once(df, F.struct(found.alias("_f"))).withColumnRenamed("_t", "_t0").withColumnRenamed("_all", "_all0")
        start = F.struct(F.col("_t0").alias("t"), F.size("_all0").alias("n"))
        done = F.aggregate("_f", start, lambda acc, m: F.struct(
            F.replace(acc["t"], m, F.concat(F.lit("<ID"), (acc["n"] + 1).cast("string"), F.lit(">"))).alias("t"), (acc["n"] + 1).alias("n")))
        df = once(df, F.struct(done["t"].alias("_t"), F.concat("_all0", "_f").alias("_all"))).drop("_f", "_t0", "_all0")
    names = F.transform("_all", lambda m, i: F.concat(F.lit("<ID"), (i + 1).cast("string"), F.lit(">")))
    masked = F.replace(F.regexp_replace("_t", r"(?U)\s+", " "), F.lit(">/"), F.lit(">"))
    return df.withColumn("masked", masked).withColumn("placeholders", F.map_from_arrays(names, F.col("_all"))).drop("_t", "_all")


def unmask(masked: Column, placeholders: Column) -> Column:
    """Originals put back, highest placeholder number first."""
    entries = F.reverse(F.map_entries(placeholders))
    return F.aggregate(entries, masked, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def token_groups(df: DataFrame, text: str, size: int = 256) -> DataFrame:
    """Groups of at most ``size`` words, numbered; a text that is an exact multiple ends in an empty group."""
    words = F.filter(F.split(F.col(text), r"(?U)\s+"), lambda w: w != "")
    n = F.size("_w")
    starts = F.when(n > size, F.sequence(F.lit(0), n, F.lit(size))).otherwise(F.array(F.lit(0)))
    df = df.withColumn("_w", words)
    parts = F.transform(starts, lambda s: F.array_join(F.slice("_w", s + 1, size), " "))
    return df.select(*[c for c in df.columns if c not in (text, "_w")], F.posexplode(parts).alias("group_no", "part"))


def regroup(parts: DataFrame, key: str) -> DataFrame:
    """Parts of one text joined again in order (a text's own parts only)."""
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_no", "part"))),
                                                           lambda p: p["part"]), " ").alias("text"))
