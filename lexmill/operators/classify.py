"""Clause and document classification by generated rule expressions.

Rule sets are small and known when the plan is built, so they enter the plan as
literals: nothing is joined or shuffled. All keywords are found by one prefix tree,
and so are the words that begin a category's pattern, which spares most texts the pattern.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules, rules_documents
from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage

MIN_CONFIDENCE = 0.3
STRUCTURED = "Structured Field"


def prefix_tree(words: list[str]) -> str:
    """One pattern for all words that reads each character of a text once, not once per word."""
    root: dict = {}
    for word in words:
        node = root
        for ch in word:
            node = node.setdefault(ch, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [P.literal(ch) + pattern(node[ch]) for ch in sorted(node) if ch]
        body = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return "" if not ways else f"(?:{body})?" if "" in node else body
    return pattern(root)


def words_found(low: Column, words: list[str], whole: bool = True) -> Column:
    """Which of the words the text holds where a word begins; whole: that also end with a word.

    Words are dealt into sets of which none begins another, so each set has at most one word at a place, and no
    place is passed over by a lookahead.
    """
    rest, found, end = set(words), [], r"\b" if whole else ""
    while rest:
        top = {w for w in rest if not any(o != w and o.startswith(w) for o in rest)}
        rest -= top
        found.append(X.matches(low, rf"\b(?=({prefix_tree(sorted(top))}){end})", index=1))
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *found))


def rules_of(words: Column, owners: dict[str, list[int]]) -> Column:
    """Numbers of the rules that own the words."""
    if not owners:
        return F.array().cast("array<int>")
    table = F.create_map(*[c for w, nos in owners.items() for c in (F.lit(w), F.array(*map(F.lit, nos)))])
    return F.array_distinct(F.flatten(F.transform(words, lambda w: table[w])))


def owners_of(lists: list[tuple[str, ...] | list[str]]) -> dict[str, list[int]]:
    """Each word with the places of the lists that hold it."""
    found: dict[str, list[int]] = {}
    for i, words in enumerate(lists):
        for w in dict.fromkeys(words):
            found.setdefault(w, []).append(i)
    return found


def alternatives(regex: str) -> list[str]:
    """The alternatives of a pattern; a pattern with escaped brackets or bars is left whole."""
    if re.search(r"\\[\[\](){}|]", regex):
        return [regex]
    found, depth, start = [], 0, 0
    for i, ch in enumerate(regex + "|"):
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            found.append(regex[start:i])
            start = i + 1
    return found


def begins_words(regex: str) -> bool:
    """Do all alternatives of a pattern begin with a word boundary?"""
    return all(w.startswith(r"\b") for w in alternatives(regex))


def one_boundary(regex: str) -> str:
    """The same pattern; where all its alternatives begin with a word boundary, that is looked for once at each place."""
    return r"\b(?:" + "|".join(w[2:] for w in alternatives(regex)) + ")" if begins_words(regex) else regex


def leading_words(regex: str) -> list[str] | None:
    """Plain text of the alternatives of a pattern, one of which any match must contain; None if an alternative has none.

    It is what an alternative begins with, or its longest word after a blank if that beginning is short.
    """
    stems = []
    for way in alternatives(regex):
        part = way.removeprefix(r"\b")
        stem = re.match(r"[a-z0-9 -]*", part).group()
        if part[len(stem):len(stem) + 1] in ("?", "*", "{"):
            stem = stem[:-1]
        if len(stem) >= 3:
            stems.append(stem)
            continue
        later = re.findall(r"\\s\+([a-z]{3,})(?![a-z?*{])", re.sub(r"\(.*\)", "()", part))
        if later:
            stems.append(max(later, key=len))
        elif part != way and len(stem) == 2:
            stems.append(stem)
        else:
            return None
    return stems


def first_line(text: Column) -> Column:
    """First non-blank line, trimmed."""
    return F.regexp_extract(text, r"(?U)^\s*(\S(?:[^\n\r]*\S)?)", 1)


def once(df: DataFrame, *structs: Column) -> DataFrame:
    """Add the fields of costly struct expressions so that each is evaluated exactly once per row.

    A generator's output cannot be folded back into later filters and
    projections, which would otherwise repeat the whole rule set.
    """
    for struct in structs:
        df = df.select("*", F.inline(F.array(struct)))
    return df


def with_categories(df: DataFrame, text: Column, clause_rules: list[rules.ClauseRule] | None = None) -> DataFrame:
    """_cats: array<struct<points, ordinal, category, keywords, snippet>> of the categories with points, in rule order; none for a null text.

    Points are whole hundredths: 25 for the regex, 10 per keyword up to 5, 15 for a heading mention.
    """
    clause_rules = clause_rules or rules.CLAUSE_RULES
    df = once(df, F.struct(F.lower(text).alias("_low"), F.lower(first_line(text)).alias("_head")))
    stems = [leading_words(r.regex) for r in clause_rules]
    bounded = owners_of([ss if ss and begins_words(r.regex) else [] for ss, r in zip(stems, clause_rules)])
    keywords = owners_of([r.keywords for r in clause_rules])
    df = once(df, F.struct(words_found(F.col("_low"), list(keywords)).alias("_kw"), words_found(F.col("_low"), list(bounded), False).alias("_stems")))
    df = once(df, F.struct(rules_of(F.col("_kw"), keywords).alias("_named"), rules_of(F.col("_stems"), bounded).alias("_may"))).drop("_stems")

    def snippet(i: int) -> Column:
        found = X.group_of(F.col("_low"), one_boundary(clause_rules[i].regex), 0)
        if stems[i] is None:
            return found
        may = F.array_contains("_may", F.lit(i)) if begins_words(clause_rules[i].regex) else reduce(
            lambda a, b: a | b, [F.col("_low").contains(s) for s in dict.fromkeys(stems[i])])
        return F.when(may, found).otherwise("")
    step = 25
    parts = []
    for start in range(0, len(clause_rules), step):
        df = once(df, F.struct(F.array(*[snippet(i) for i in range(start, min(start + step, len(clause_rules)))]).alias(f"_rx{start}")))
        parts.append(f"_rx{start}")
    table = F.array(*[F.struct(F.lit(r.category).alias("name"), F.array(*map(F.lit, r.keywords)).cast("array<string>").alias("ks")) for r in clause_rules])
    heads = F.array(*[F.lit(r.category.lower()) for r in clause_rules])
    df = once(df, F.struct(F.concat(*parts).alias("_rx"))).drop(*parts)
    hits = F.filter(F.array(*map(F.lit, range(len(clause_rules)))), lambda i: (F.get("_rx", i) != "") | F.array_contains("_named", i)
                    | F.col("_head").contains(F.get(heads, i)))
    df = once(df, F.struct(hits.alias("_nos")))
    found = F.transform("_nos", lambda i: F.struct(
        F.get(table, i)["name"].alias("category"), (-i - 1).alias("ordinal"), F.get("_rx", i).alias("snippet"),
        F.filter(F.get(table, i)["ks"], lambda k: F.array_contains("_kw", k)).alias("keywords"),
        F.col("_head").contains(F.get(heads, i)).alias("headed")))
    df = once(df, F.struct(found.alias("_found"))).drop("_low", "_head", "_kw", "_named", "_may", "_rx", "_nos")
    points = F.transform("_found", lambda r: F.struct(
        (25 * (r["snippet"] != "").cast("int") + 10 * F.least(F.size(r["keywords"]), F.lit(5))
         + 15 * r["headed"].cast("int")).alias("points"), r["ordinal"].alias("ordinal"),
        r["category"].alias("category"), r["keywords"].alias("keywords"), r["snippet"].alias("snippet")))
    return once(df, F.struct(points.alias("_cats"))).drop("_found")


def with_clause_type(df: DataFrame, text: Column, clause_rules: list[rules.ClauseRule] | None = None,
                     prefix: str = "clause") -> DataFrame:
    """<prefix>_type and <prefix>_points; the earliest rule wins a tie, General when nothing scores."""
    df = once(df, F.struct(text.isNull().alias("_null")))
    df = with_categories(df, text, clause_rules)
    best = F.array_max(F.transform("_cats", lambda c: F.struct(c["points"], c["ordinal"], c["category"])))
    df = once(df, F.struct(best.alias("_best"))).drop("_cats")
    points = F.when(~F.col("_null"), F.coalesce("_best.points", F.lit(0)))
    return once(df, F.struct(F.coalesce("_best.category", F.lit("General")).alias(f"{prefix}_type"), points.alias(f"{prefix}_points"))).drop("_best", "_null")


#: A table of texts that are classified once is broadcast up to so many rows and bytes, by an estimate that one pass makes.
LOOKUP_TEXTS, LOOKUP_BYTES = 100_000, 64 << 20


def alike_key(text: Column, clause_rules: list[rules.ClauseRule] | None = None) -> Column:
    """A form of a text such that texts of one form get the same type and points: the text with all its digits as zeros.

    Rules tell one digit from another only in plain words that hold digits (a keyword "net 30"). A text that contains one of
    these keeps its digits; in any other form such a word cannot be found, since it holds a digit that is not zero. Where a
    pattern itself names a digit, or a word's digits are all zeros, every text keeps its digits.
    """
    clause_rules = clause_rules or rules.CLAUSE_RULES
    named = sorted({w for r in clause_rules for w in (*r.keywords, r.category.lower()) if re.search(r"[0-9]", w)})
    spelt = [re.sub(r"\{\d*,?\d*\}", "", r.regex) for r in clause_rules]
    if any(re.search(r"[0-9]|\\[xu]", x) for x in spelt) or not all(re.search("[1-9]", w) for w in named):
        return text
    masked = F.translate(text, "123456789", "0" * 9)
    return F.when(X.any_contains(F.lower(text), named), text).otherwise(masked) if named else masked


def with_type_of_alike(df: DataFrame, text: Column, clause_rules: list[rules.ClauseRule] | None = None, prefix: str = "clause") -> DataFrame:
    """The same as with_clause_type; texts of one form (see alike_key) are classified once, if an estimate finds few enough forms."""
    keyed = df.withColumn("_key", alike_key(text, clause_rules))
    n, size = keyed.agg(F.approx_count_distinct("_key"), F.coalesce(F.avg(F.octet_length("_key")), F.lit(0.0))).first()
    if n > LOOKUP_TEXTS or n * size > LOOKUP_BYTES:
        return with_clause_type(df, text, clause_rules, prefix)
    forms = keyed.select("_key").distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    known = cut_lineage(with_clause_type(forms, F.col("_key"), clause_rules, prefix).withColumnRenamed("_key", "_form"))
    return keyed.join(F.broadcast(known), F.col("_key").eqNullSafe(F.col("_form")), "left").drop("_key", "_form")


def looks_structured(text: Column) -> Column:
    """The text after the last colon is 1 to 35 characters long."""
    tail = X.strip(F.substring_index(text, ":", -1))
    return text.contains(":") & F.length(tail).between(1, 35)


def accept_clauses(df: DataFrame, text: str = "text_content", rescue_fields: bool = True) -> DataFrame:
    """classification, confidence and reason for each block; rejected blocks keep a reason."""
    general = F.col("clause_type") == "General"
    failed = general | (F.col("clause_points") < 30)
    df = once(df, F.struct((looks_structured(F.col(text)) if rescue_fields else F.lit(False)).alias("_field")))
    field = F.col("_field")
    return (df.withColumn("outcome", F.when(~failed, "accepted").when(field, "recovered").otherwise("rejected"))
            .withColumn("reason", F.when(failed & general, "classified_general")
                        .when(failed, "below_min_confidence"))
            .withColumn("classification", F.when(~failed, F.col("clause_type")).when(field, STRUCTURED))
            .withColumn("confidence_score", F.when(~failed, F.col("clause_points") / 100.0)
                        .when(field, MIN_CONFIDENCE)).drop("_field"))


def multilabel(df: DataFrame, text: Column, keep: list[str], min_points: int = 30,
               clause_rules: list[rules.ClauseRule] | None = None) -> DataFrame:
    """Every category at or above the bar, best first, with its evidence."""
    df = with_categories(df, text, clause_rules)
    hits = F.filter("_cats", lambda c: c["points"] >= min_points)
    return df.select(*keep, F.inline(hits)).withColumn("ordinal", -F.col("ordinal") - 1)


def explain(keywords: Column, snippet: Column, category: Column) -> Column:
    """Reason line naming the regex snippet and the matched keywords."""
    bits = F.filter(F.array(
        F.when(snippet != "", F.concat(F.lit('regex matched "'), snippet, F.lit('"'))),
        F.when(F.size(keywords) > 0, F.concat(F.size(keywords).cast("string"), F.lit(" keyword(s) matched: "),
                                              F.array_join(keywords, ", ")))), lambda b: b.isNotNull())
    return F.when(F.size(bits) > 0, F.concat(F.lit("Classified as '"), category, F.lit("' because "),
                                             F.array_join(bits, "; "))).otherwise(
        F.concat(F.lit("Classified as '"), category, F.lit("' by best-available score.")))


def clause_title(category: Column, text: Column) -> Column:
    """Subtopic title, else the type's own title, else the first significant words."""
    low = F.lower(text)
    named = F
    for kind in {**rules.TITLE_SUBTOPICS, **rules.FALLBACK_TITLES}:
        title = F.lit(rules.FALLBACK_TITLES.get(kind)).cast("string")
        for phrases, name in reversed(rules.TITLE_SUBTOPICS.get(kind, [])):
            title = F.when(X.any_contains(low, list(phrases)), name).otherwise(title)
        named = named.when(category == kind, title)  # only the phrases of the clause's own type are looked for
    sentence = F.get(F.split(X.strip(text), r"(?U)(?<=[.;])\s+", 2), F.lit(0))
    words = F.regexp_extract_all(sentence, F.lit(r"[A-Za-z']+"), F.lit(0))
    strong = F.filter(words, lambda w: ~F.lower(w).isin(rules.TITLE_STOPWORDS))
    picked = F.slice(F.when(F.size(strong) > 0, strong).otherwise(words), 1, 8)
    made = F.array_join(F.transform(picked, lambda w: F.concat(
        F.upper(F.substring(w, 1, 1)), F.lower(w.substr(F.lit(2), F.length(w))))), " ")
    return F.coalesce(named, F.nullif(made, F.lit("")), F.lit("General Provision"))


def own_heading(block: Column) -> Column:
    """The block's first line when it is a heading and text follows it."""
    head = X.strip(F.substring_index(block, "\n", 1))
    rest = F.when(block.contains("\n"), F.regexp_replace(block, r"^[^\n]*\n", "")).otherwise("")
    return F.when((head != "") & (X.strip(rest) != "") & X.is_heading(head), head)


def document_type(df: DataFrame, text: Column, type_patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """(Patterns are lower-case and so is the text they see.) document_type, runner_up and type_confidence = margin x evidence of the pattern counts."""
    type_patterns = type_patterns or rules_documents.TYPE_PATTERNS
    low = X.strip(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))
    df = once(df, F.struct(low.alias("_low")))
    kinds = list(type_patterns.items())
    parts = []
    for start in range(0, len(kinds), 5):
        counts = []
        for i, (kind, pats) in list(enumerate(kinds))[start:start + 5]:
            total = F.lit(0)
            for p in pats:
                total = total + X.by_form(F.col("_low"), p, False, lambda form: F.regexp_count("_low", F.lit(form)))
            counts.append(F.struct((-total).alias("minus"), F.lit(i).alias("ordinal"), F.lit(kind).alias("kind")))
        df = once(df, F.struct(F.array(*counts).alias(f"_t{start}")))
        parts.append(f"_t{start}")
    df = once(df, F.struct(F.slice(F.array_sort(F.concat(*parts)), 1, 2).alias("_top"))).drop("_low", *parts)
    best, second = -F.col("_top")[0]["minus"], -F.col("_top")[1]["minus"]
    known = best >= 1
    margin = (best - second) / (best + second)
    return (df.withColumn("document_type", F.when(known, F.col("_top")[0]["kind"]).otherwise(rules_documents.UNKNOWN))
            .withColumn("runner_up", F.when(known & (second > 0), F.col("_top")[1]["kind"]))
            .withColumn("type_score", best)
            .withColumn("type_confidence", F.when(known, F.round(margin * X.evidence_confidence(best), 4))
                        .otherwise(0.0)).drop("_top"))


def language(df: DataFrame, text: Column, profiles: dict[str, list[str]] | None = None) -> DataFrame:
    """Language whose function words are most frequent in the text."""
    profiles = profiles or rules.LANGUAGE_PROFILES
    head = F.lower(F.coalesce(text, F.lit("")))
    tokens = F.filter(F.split(head, "[^a-z]+"), lambda t: t != "")
    def hits(words):
        return F.size(F.filter("_tokens", lambda t: t.isin(words)))
    scored = [F.struct(hits(words).alias("hits"), F.lit(-i).alias("ordinal"), F.lit(code).alias("code"))
              for i, (code, words) in enumerate(profiles.items())]
    df = once(df, F.struct(tokens.alias("_tokens")))
    df = once(df, F.struct(F.array_max(F.array(*scored)).alias("_lang")))
    return (df.withColumn("language", F.when(F.col("_lang.hits") > 0, F.col("_lang.code")).otherwise("unknown"))
            .drop("_tokens", "_lang"))


def importance(df: DataFrame, name: Column, text: Column) -> DataFrame:
    """importance_score, importance_category and reasons, from clause_type of name+text."""
    both = F.lower(F.concat_ws("\n", name, text))
    has_money = F.size(X.money(text)) > 0
    unlimited = X.any_contains(both, rules.UNLIMITED_WORDS)
    penalty = X.any_contains(both, rules.PENALTY_WORDS)
    kind = F.col("clause_type")
    base = (F.when(kind.isin(rules.CRITICAL_TYPES), rules.TIER_SCORES["critical"])
            .when(kind.isin(rules.IMPORTANT_TYPES), rules.TIER_SCORES["important"])
            .otherwise(rules.TIER_SCORES["informational"]))
    raw = base + 8 * has_money.cast("int") + 12 * unlimited.cast("int") + 10 * penalty.cast("int")
    boiler = (kind == "General") | X.any_contains(F.lower(name), rules.BOILERPLATE_WORDS)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.when(boiler, F.least(raw, F.lit(25))).otherwise(raw)))
    reasons = F.filter(F.array(
        F.concat(F.lit("detected clause type '"), kind, F.lit("'")),
        F.when(has_money, "contains monetary figures"),
        F.when(unlimited, "uses uncapped/unlimited exposure language"),
        F.when(penalty, "references penalties or liquidated damages"),
        F.when(boiler, "heading suggests boilerplate/administrative content, capped low")),
        lambda r: r.isNotNull())
    return (df.withColumn("importance_score", score)
            .withColumn("importance_category", F.when(score >= 75, "Critical").when(score >= 40, "Important")
                        .otherwise("Informational"))
            .withColumn("importance_reasons", F.array_join(reasons, "; ")))


def impact(df: DataFrame, text: Column) -> DataFrame:
    """legal, financial, business and compliance impact, 0 to 100."""
    low = F.lower(text)
    has_money = (F.size(X.money(text)) > 0).cast("int")
    hard = X.any_contains(low, rules.IMPACT_ESCALATORS).cast("int")
    nudges = [15 * hard, 15 * has_money + 10 * hard,
              20 * X.any_contains(low, rules.BUSINESS_WORDS).cast("int"),
              20 * X.any_contains(low, rules.REGULATION_WORDS).cast("int")]
    for i, name in enumerate(["legal", "financial", "business", "compliance"]):
        base = F.lit(rules.IMPACT_BASE["General"][i])
        for kind, values in rules.IMPACT_BASE.items():
            base = F.when(F.col("clause_type") == kind, values[i]).otherwise(base)
        df = df.withColumn(f"{name}_impact", F.greatest(F.lit(0), F.least(F.lit(100), base + nudges[i])))
    return df


def modifiers(text: Column, phrases: list[str]) -> Column:
    """Escalating or mitigating phrases present, in list order."""
    low = F.lower(text)
    return F.filter(F.array(*[F.when(low.contains(p), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())


def query_intent(df: DataFrame, text: Column, clause_rules: list[rules.ClauseRule] | None = None) -> DataFrame:
    """Categories whose keywords occur in a question; an empty list means no filter."""
    clause_rules = clause_rules or rules.CLAUSE_RULES
    owners = owners_of([r.keywords for r in clause_rules])
    df = once(df, F.struct(words_found(F.lower(F.coalesce(text, F.lit(""))), list(owners)).alias("_kw")))
    names = F.array(*[F.lit(r.category) for r in clause_rules])
    return df.withColumn("intent_types", F.transform(F.array_sort(rules_of(F.col("_kw"), owners)), lambda i: F.get(names, i))).drop("_kw")


def metric_key(text: Column) -> Column:
    """First metric with a phrase in the question, else null."""
    low = F.lower(X.strip(text))
    key = F.lit(None).cast("string")
    for metric, phrases in rules.METRIC_PHRASES:
        key = F.coalesce(key, F.when(X.any_contains(low, list(phrases)), metric))
    return key
