"""Quality rules as a short-circuit cascade.

A rule is a reject condition over figures of a text. The cascade measures on a small sample what a
rule costs (seconds per text) and how many texts it rejects, orders the rules by
rejections per cost and evaluates them as one CASE expression, which stops at the first
rule that rejects. The order changes the time only: a text is kept when no rule rejects it.

Defined results: a null text counts as the empty text (no words); blank lines are never
copies; an empty table gives an empty result; repeated rows are judged row by row; columns
of the input never clash with names used here, since every expression reads the text only.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.words import WORD_CLASS, let, words_of

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """reject: function from a figure's name to its column -> boolean column, never null."""

    name: str
    reject: object


def symbols(text: Column) -> Column:
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{SYMBOLS}]+", "")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(WORD_CLASS))


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside windows of `width` words that occur twice or more in the text.

    A window becomes one long: the upper bits of its hash, then its position in as many
    bits as the word count needs. One primitive sort puts equal windows side by side.
    """
    def over(w: Column) -> Column:
        last = F.size(w) - width

        def shifted(bits: Column) -> Column:
            packed = F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.call_function(
                "shiftleft", F.xxhash64(*[w[i + k] for k in range(width)]), bits).bitwiseOR(i)))
            return let(packed, lambda s: covered(s, bits))

        def covered(s: Column, bits: Column) -> Column:
            twins = F.filter(F.sequence(F.lit(0), F.size(s) - 2), lambda j: F.call_function(
                "shiftrightunsigned", s[j].bitwiseXOR(s[j + 1]), bits) == 0)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            starts = F.sort_array(F.array_distinct(F.flatten(F.transform(
                twins, lambda j: F.array(s[j].bitwiseAND(mask), s[j + 1].bitwiseAND(mask))))))
            return F.aggregate(
                starts, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
                lambda acc, p: F.struct((p + width).alias("end"), (acc["n"] + p + width - F.greatest(acc["end"], p)).alias("n")),
                lambda acc: acc["n"])

        return F.when(last < 1, F.lit(0).cast("long")).otherwise(let(F.char_length(F.bin(F.size(w))), shifted))

    return let(words, over)


def dup_lines(lines: Column) -> Column:
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def joined_chars(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


#: Each figure of a text as an expression over the text alone.
FIGURES = {
    "n_words": lambda t: F.size(words_of(t)).cast("long"),
    "word_chars": lambda t: joined_chars(words_of(t)),
    "n_repeat_words": lambda t: repeated_words(words_of(t)),
    "n_symbols": symbols,
    "n_lines": lambda t: F.size(worded_lines(t)).cast("long"),
    "n_dup_lines": lambda t: let(worded_lines(t), dup_lines),
    "n_shouts": lambda t: F.char_length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^!]+|(?<!!)!(?!!)", "")).cast("long"),
}


def measures(text: Column) -> Column:
    """Base figures of a text in one struct; words and lines are cut once."""
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), joined_chars(w).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    by_lines = let(worded_lines(text), lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                                          dup_lines(x).alias("n_dup_lines")))
    return F.struct(by_words.alias("of_words"), by_lines.alias("of_lines"), symbols(text).alias("n_symbols"))


def base_failed(n: Column, repeated: Column) -> Column:
    return (n < 50) | (repeated * 100 > n * 50)


#: The base rules.
BASE = [
    Rule("few_words", lambda m: m("n_words") < 50),
    Rule("repeats", lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
]
#: The rules the method adds: marks on the words, copied lines, shouting, words without spaces.
ADDED = [
    Rule("symbols", lambda m: m("n_symbols") * 20 > m("word_chars")),
    Rule("copied_lines", lambda m: m("n_dup_lines") * 100 > m("n_lines") * 50),
    Rule("shouting", lambda m: m("n_shouts") * 5 > m("n_words")),
    Rule("long_words", lambda m: m("word_chars") > m("n_words") * 40),
]
RULES = BASE + ADDED


def over_text(text: Column):
    """Figures computed from the text where a rule asks for them."""
    return lambda name: FIGURES[name](text)


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400) -> list[dict]:
    """Seconds and rejections of each rule over at most sample_rows texts (a bounded sample, used for the order only).

    One job counts the rejections of all rules and warms the code up; then each rule is timed alone.
    """
    spark = docs.sparkSession
    sample = spark.createDataFrame([(r[0],) for r in docs.select(text).take(sample_rows)], "t string").coalesce(1)
    counted = sample.agg(F.count(F.lit(1)).alias("of"),
                         *[F.count_if(rule.reject(over_text(F.col("t")))).alias(f"r{i}") for i, rule in enumerate(rules)]).first()
    found = []
    for i, rule in enumerate(rules):
        began = time.perf_counter()
        sample.agg(F.count_if(rule.reject(over_text(F.col("t"))))).first()
        found.append({"name": rule.name, "seconds": time.perf_counter() - began,
                      "rejected": (counted[f"r{i}"] + 0.5) / (counted["of"] + 1)})
    return found


def ordered(docs: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = 400) -> list[Rule]:
    by_name = {e["name"]: e["rejected"] / e["seconds"] for e in estimate(docs, rules, text, sample_rows)}
    return sorted(rules, key=lambda r: (-by_name[r.name], r.name))


def first_rejection(rules: list[Rule], figure) -> Column:
    """The name of the first rule that rejects; null when none does. Later rules are then not evaluated."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.reject(figure), F.lit(rule.name))
    return F.lit(None).cast("string") if chain is F else chain


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 400) -> DataFrame:
    """docs that no rule rejects, with docs' own columns."""
    best = ordered(docs, RULES if rules is None else rules, text, sample_rows)
    return docs.filter(first_rejection(best, over_text(F.col(text))).isNull())


def rule_report(docs: DataFrame, id_column: str = "doc_id", text: str = "text", added: list[Rule] | None = None,
                sample_rows: int = 400) -> DataFrame:
    """One row per document: its base figures, base_failed and the verdict of the cascade.

    The cascade of added rules is asked only about texts that pass the base rules; figures that
    the report holds already are taken from it, others are computed where the cascade gets that far.
    """
    best = ordered(docs, ADDED if added is None else added, text, sample_rows)
    figures = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("_t"),
                          F.inline(F.array(measures(F.col(text)))))  # the generator keeps the figures from being computed again
    held = {"n_words": "of_words.n_words", "word_chars": "of_words.word_chars", "n_symbols": "n_symbols",
            "n_dup_lines": "of_lines.n_dup_lines", "n_repeat_words": "of_words.n_repeat_words", "n_lines": "of_lines.n_lines"}
    flat = figures.select("doc_id", "_t", *[F.col(path).alias(name) for name, path in held.items()])
    figure = lambda name: F.col(name) if name in held else FIGURES[name](F.col("_t"))
    failed = first_rejection(BASE, figure).isNotNull()
    return flat.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
                       F.when(failed, F.lit(False)).otherwise(first_rejection(best, figure).isNull()).alias("kept"))
