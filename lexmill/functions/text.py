"""Fact extraction: string columns in, array and struct columns out.

Everything here is a column expression, so a scan, its filters and these
extractions stay in one stage. A pattern with several groups is matched once
over the text; groups are read from the short matches.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from . import patterns as P
from .similarity import let


def by_form(text: Column, pattern: str, ignore_case: bool, find: Callable[[str], Column]) -> Column:
    """What find makes of a pattern: of its plain form where the text is all ASCII, else of its slower Unicode-aware form."""
    return F.when(F.octet_length(text) == F.length(text), find(P.plain(pattern, ignore_case))).otherwise(find(P.jvm(pattern, ignore_case)))


def matches(text: Column, pattern: str, ignore_case: bool = False, index: int = 0) -> Column:
    return by_form(text, pattern, ignore_case, lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(index)))


def group_of(match: Column, pattern: str, index: int, ignore_case: bool = False) -> Column:
    return by_form(match, pattern, ignore_case, lambda p: F.regexp_extract(match, p, index))


def found_in(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return by_form(text, pattern, ignore_case, lambda p: text.rlike(p))


def any_contains(text_lower: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for phrase in phrases:
        hit = hit | text_lower.contains(phrase)
    return hit


# Every character Python's str.strip() removes.
WHITESPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
              + "\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def evidence_confidence(count: Column) -> Column:
    return count / (count + F.lit(1.0))


def money(text: Column) -> Column:
    return matches(text, P.MONEY, True)


def dates(text: Column) -> Column:
    return matches(text, P.DATE, True)


def durations(text: Column) -> Column:
    return F.transform(matches(text, P.DURATION, True), lambda m: F.struct(
        group_of(m, P.DURATION, 1, True).cast("bigint").alias("n"),
        F.lower(group_of(m, P.DURATION, 2, True)).alias("unit")))


def section_refs(text: Column) -> Column:
    return F.array_distinct(matches(text, P.SECTION_REF, True))


def obligations(text: Column) -> Column:
    return F.transform(matches(text, P.OBLIGATION), lambda m: F.struct(
        strip(group_of(m, P.OBLIGATION, 1)).alias("subject"),
        strip(group_of(m, P.OBLIGATION, 2)).alias("modal"),
        strip(group_of(m, P.OBLIGATION, 3)).alias("action")))


def polarity(modal_lower: Column) -> Column:
    strong = modal_lower.isin(rules.STRONG_MODALS)
    return F.when(modal_lower.endswith("not"), "prohibition").when(strong, "obligation").otherwise("right")


def obligation_subjects(text: Column) -> Column:
    return F.transform(obligations(text), lambda o: F.lower(o["subject"]))


def modal_mentions(text: Column, subjects: Column | None = None) -> Column:
    """Subject, modal, polarity and action of each modal phrase, weak modals included.

    Confidence is 2/3 when the strong-modal extractor saw the same subject, else 1/2.
    """
    if subjects is None:
        return let(obligation_subjects(text), lambda found: modal_mentions(text, found))

    def mention(m):
        subject = strip(group_of(m, P.MODAL_MENTION, 1))
        phrase = F.lower(group_of(m, P.MODAL_MENTION, 2))
        seen = F.array_contains(subjects, F.lower(subject))
        return F.struct(subject.alias("subject"), F.regexp_extract(phrase, r"^\w+", 0).alias("modal"),
                        polarity(phrase).alias("polarity"),
                        strip(group_of(m, P.MODAL_MENTION, 3)).alias("action"),
                        F.when(seen, F.lit(2.0) / 3).otherwise(0.5).alias("confidence"))
    return F.transform(matches(text, P.MODAL_MENTION), mention)


def clause_number(section_name: Column, text: Column) -> Column:
    def first(value, pattern, ignore_case):
        return F.nullif(group_of(value, pattern, 1, ignore_case), F.lit(""))
    name = F.coalesce(section_name, F.lit(""))
    return F.coalesce(first(name, P.CLAUSE_NUMBER, True),
                      first(F.substring(F.coalesce(text, F.lit("")), 1, 200), P.CLAUSE_NUMBER, True),
                      first(name, P.LEADING_NUMBER, False))


def title_key(section_name: Column) -> Column:
    name = strip(F.coalesce(section_name, F.lit("")))
    def without(form):
        cut = F.regexp_replace(name, form(P.TITLE_PREFIX, True), "")
        return F.lower(strip(F.regexp_replace(cut, form(P.LEADING_NUMBER), "")))
    return F.when(F.octet_length(name) == F.length(name), without(P.plain)).otherwise(without(P.jvm))


def leading_number(section_name: Column) -> Column:
    return F.nullif(F.regexp_extract(strip(section_name), r"^(\d+(?:\.\d+)*)", 1), F.lit(""))


def labelled_numbers(text: Column) -> Column:
    return F.transform(matches(text, P.LABELLED_NUMBER, True), lambda m: F.struct(
        F.lower(strip(group_of(m, P.LABELLED_NUMBER, 1, True))).alias("label"),
        strip(group_of(m, P.LABELLED_NUMBER, 2, True)).alias("value")))


def numeric_fingerprint(text: Column) -> Column:
    return F.array_sort(matches(text, P.NUMBER_TOKEN))


def dedup_form(text: Column) -> Column:
    return by_form(text, r"\s+", False, lambda p: F.regexp_replace(F.lower(strip(text)), p, " "))


def jurisdiction(text: Column) -> Column:
    return F.nullif(strip(group_of(text, P.JURISDICTION, 1, True)), F.lit(""))


def jurisdictions(text: Column) -> Column:
    return F.array_distinct(F.transform(matches(text, P.JURISDICTION, True),
                                        lambda m: strip(group_of(m, P.JURISDICTION, 1, True))))


def states(text: Column) -> Column:
    found = by_form(text, P.STATE, False, lambda p: F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)))
    return F.array_sort(F.array_distinct(F.transform(found, strip)))


def parties(text: Column) -> Column:
    found = F.when(~text.contains("("), F.array().cast("array<string>")).otherwise(matches(text, P.PARTY))
    return F.transform(found, lambda m: F.struct(
        group_of(m, P.PARTY, 1).alias("full_name"), group_of(m, P.PARTY, 2).alias("short_name")))


def penalties(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(matches(text, P.PENALTY, True), strip)))


def deadlines(found_dates: Column, found_durations: Column) -> Column:
    by_date = F.transform(found_dates, lambda d: F.struct(
        F.lit("date").alias("kind"), d.alias("value"), F.lit(None).cast("double").alias("days")))
    unit_days = F.create_map(*[F.lit(x) for kv in rules.DAYS_PER_UNIT.items() for x in kv])
    by_span = F.transform(found_durations, lambda d: F.struct(
        F.lit("duration").alias("kind"), F.concat_ws(" ", d["n"].cast("string"), d["unit"]).alias("value"),
        (d["n"].cast("double") * unit_days[d["unit"]]).alias("days")))
    return F.concat(by_date, by_span)


def safe_number(value: Column) -> Column:
    cleaned = F.replace(value, F.lit(","), F.lit(""))
    return F.when(cleaned.rlike(r"\d"), cleaned.try_cast("double"))


def capped(text: Column) -> Column:
    low = F.lower(text)
    return F.when(any_contains(low, rules.UNCAP_WORDS), False).when(any_contains(low, rules.CAP_WORDS), True)


def financial_terms(text: Column, mentions: Column) -> Column:
    """amount stays null when a mention carries no digit; is_capped is null when nothing is said."""
    def term(raw, cap):
        s = strip(raw)
        percent = s.endswith("%")
        currency = F.lit(None).cast("string")
        for prefix, code in reversed(rules.CURRENCY_PREFIXES):
            currency = F.when(s.startswith(prefix), code).otherwise(currency)
        scale = F.lit(1.0)
        for word, factor in reversed(rules.SCALE_WORDS):
            scale = F.when(F.lower(s).contains(word), factor).otherwise(scale)
        amount = F.when(percent, safe_number(F.regexp_extract(s, r"[\d,.]+", 0))).otherwise(
            safe_number(F.regexp_extract(s, r"[\d,]+(?:\.\d+)?", 0)) * scale)
        return F.struct(amount.alias("amount"), F.when(~percent, currency).alias("currency"),
                        percent.alias("is_percentage"), cap.alias("is_capped"))
    return let(capped(text), lambda cap: F.transform(mentions, lambda raw: term(raw, cap)))


def inflected(word: str) -> list[str]:
    """The regular forms of a verb or noun, itself first."""
    if word.endswith("y"):
        return [word, word[:-1] + "ies", word[:-1] + "ied", word + "ing"]
    if word.endswith("e"):
        return [word, word + "s", word + "d", word[:-1] + "ing"]
    return [word, word + "s", word + "ed", word + "ing"]


def action_forms(word: str) -> list[str]:
    """Forms of a lexicon word that are not lexicon words themselves, so that no text counts twice for one word."""
    others = {w for w, _ in rules.ACTION_WORDS} - {word}
    return [f for f in inflected(word) if f not in others]


def legal_actions(text: Column) -> Column:
    """Action types named by a phrase or by any form of a lexicon word, with evidence-count confidence."""
    low = F.lower(text)
    forms = [(action_forms(w), k) for w, k in rules.ACTION_WORDS]
    worded = [F.when(low.contains(os.path.commonprefix(fs)) & found_in(low, r"\b(?:" + "|".join(fs) + r")\b"), k) for fs, k in forms]
    named = [F.when(low.contains(w), k) for w, k in rules.ACTION_PHRASES]

    def counted(hits):
        return F.transform(F.array_sort(F.array_distinct(hits)), lambda k: F.struct(
            k.alias("action_type"), evidence_confidence(F.size(F.filter(hits, lambda h: h == k))).alias("confidence")))
    return let(F.array_compact(F.array(*named, *worded)), counted)


def has_prose_verb(text: Column) -> Column:
    return by_form(text, r"\b(?:" + "|".join(rules.PROSE_VERBS) + r")\b", False, lambda p: F.lower(text).rlike(p))


def parse_numeric(value: Column) -> Column:
    cleaned = by_form(value, P.CURRENCY_TOKEN, True, lambda p: F.regexp_replace(value, p, ""))
    cleaned = F.regexp_replace(cleaned, r"[^\d.]", "")
    return F.when((cleaned != "") & (cleaned != "."), cleaned.try_cast("double"))


def parse_date_flexible(value: Column) -> Column:
    """First of seven formats that fits."""
    v = strip(value)
    formats = ["MMMM d, yyyy", "MMM d, yyyy", "yyyy-M-d", "d/M/yyyy", "d/M/yy", "d-M-yyyy", "M/d/yyyy"]
    return F.coalesce(*[F.to_date(F.try_to_timestamp(v, F.lit(f))) for f in formats])


def parse_pdf_date(value: Column) -> Column:
    """D:YYYYMMDDhhmmss with every part after the year optional."""
    pattern = r"^D:(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?"
    year = F.regexp_extract(value, pattern, 1)

    def part(index, default):
        return F.coalesce(F.nullif(F.regexp_extract(value, pattern, index), F.lit("")), F.lit(default))
    stamp = F.concat(year, F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "),
                     part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    return F.when(year != "", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")))


def parse_iso_date(value: Column) -> Column:
    return value.try_cast("timestamp")


def looks_like_party(name: Column) -> Column:
    s = strip(name)
    return (s != "") & (s.contains(" ") | ((F.length(s) >= 4) & s.rlike(r"^\p{L}+$")))


def looks_like_prose(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z]{2,}")) >= 4


def populated_value(text: Column) -> Column:
    s = strip(F.coalesce(text, F.lit("")))
    return (s != "") & ~found_in(s, P.PLACEHOLDER_VALUE, True)


def is_heading(line: Column, strict_roman: bool = False) -> Column:
    """Short line that matches a heading pattern or reads as a title with connectors.

    strict_roman=False keeps the case-insensitive Roman-numeral pattern, under which
    "Customer shall pay" is a heading; True asks for upper-case numerals.
    """
    words = F.filter(F.split(strip(line), r"(?U)\s+"), lambda w: w != "")

    def fits(w):
        core = F.replace(F.regexp_replace(w, r"^[:\-]+|[:\-]+$", ""), F.lit("'"), F.lit(""))
        return core.rlike(r"^\p{L}+$") & (F.lower(core).isin(rules.HEADING_CONNECTORS) | core.rlike(r"^\p{Lu}"))
    titled = (F.size(words).between(2, 8) & ~line.rlike(r"[.,;]$")
              & F.element_at(words, 1).rlike(r"^\p{Lu}") & F.element_at(words, -1).rlike(r"^\p{Lu}")
              & F.forall(words, fits))
    shaped = (found_in(line, P.HEADING_NUMBERED, True) | found_in(line, P.HEADING_ROMAN, not strict_roman)
              | line.rlike(P.HEADING_CAPS) | found_in(line, P.HEADING_TITLE))
    return (F.length(line) < 80) & (shaped | F.coalesce(titled, F.lit(False)))
