"""Conflicts between clauses of one document, without listing all pairs.

An issue is a connected set of conflicting clauses. Where conflict means "the
values differ", every clause of a topic belongs to one issue as soon as two
values exist, so issues come from one grouped aggregate. For other relations
each clause is compared with one or two pivots of its topic, which settles all
but a residue; only residue members are paired with the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import similarity
from ..functions import text as X
from ..functions import vectors as V
from ..session import cut_lineage, dealt
from .classify import once
from .near_text import near_pairs

Conflict = Callable[[str, str], Column]


FACTS = {"clause_number": lambda t, name: X.clause_number(name, t), "title_key": lambda t, name: X.title_key(name), "dates": lambda t, name: X.dates(t),
         "durations": lambda t, name: X.durations(t), "money": lambda t, name: X.money(t), "obligations": lambda t, name: X.obligations(t),
         "labelled": lambda t, name: X.labelled_numbers(t), "states": lambda t, name: X.states(t)}


def enriched(clauses: DataFrame, facts: list[str] | None = None) -> DataFrame:
    """Keys and facts of each clause, computed once: all of FACTS, or only those that are asked for."""
    t, name = F.col("text_content"), F.coalesce("section_name", F.lit("Clause"))
    return once(clauses, F.struct(F.lower(t).alias("low"), *[FACTS[f](t, name).alias(f) for f in facts or FACTS]))


def value_set(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array))


def duration_text(durations: Column) -> Column:
    return F.transform(value_set(durations), lambda d: F.concat_ws(" ", d["n"].cast("string"), d["unit"]))


#: Kinds of value conflicts and the fact each is made of.
VALUE_KINDS = {"Numeric Conflict": "labelled", "Conflicting Durations": "durations", "Payment Conflict": "money", "Conflicting Jurisdiction": "states"}


def value_members(rows: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(doc_id, clause_id, contradiction_type, topic, severity, value): every clause that states a value of these kinds, all by default."""
    low = F.col("low")

    def entry(kind, topic, severity, values, words):
        return F.when(X.any_contains(low, words) & (F.size(values) > 0), F.struct(
            F.lit(kind).alias("contradiction_type"), F.lit(topic).alias("topic"), F.lit(severity).alias("severity"),
            F.array_join(values, ", ").alias("value")))
    single = {"Conflicting Durations": lambda: entry("Conflicting Durations", "temporal:durations", "Medium", duration_text(F.col("durations")), rules.TEMPORAL_WORDS),
              "Payment Conflict": lambda: entry("Payment Conflict", "payment", "High", value_set(F.col("money")), rules.PAYMENT_WORDS),
              "Conflicting Jurisdiction": lambda: entry("Conflicting Jurisdiction", "jurisdiction", "High", F.col("states"), rules.JURISDICTION_WORDS)}
    asked = kinds or list(VALUE_KINDS)
    parts = []
    if "Numeric Conflict" in asked:
        parts.append(F.transform(F.array_distinct(F.transform("labelled", lambda x: x["label"])), lambda k: F.struct(
            F.lit("Numeric Conflict").alias("contradiction_type"), F.concat(F.lit("numeric:"), k).alias("topic"),
            F.lit("High").alias("severity"), F.array_join(value_set(F.transform(F.filter(
                "labelled", lambda x: x["label"] == k), lambda x: x["value"])), ", ").alias("value"))))
    if some := [make() for kind, make in single.items() if kind in asked]:
        parts.append(F.filter(F.array(*some), lambda e: e.isNotNull()))
    return rows.select("doc_id", "clause_id", F.inline(F.concat(*parts)))


def value_conflicts(clauses: DataFrame, kinds: list[str]) -> DataFrame:
    """Members of the conflicts of these kinds, from clauses; no other fact is extracted, and each clause is read once."""
    return differing(value_members(enriched(clauses, [VALUE_KINDS[k] for k in kinds]), kinds))


def differing(members: DataFrame) -> DataFrame:
    """Members of topics that hold at least two different values."""
    keys = ["doc_id", "contradiction_type", "topic"]
    members = cut_lineage(members)
    live = members.groupBy(*keys).agg((F.min("value") != F.max("value")).alias("live"),
                                      F.min("clause_id").alias("component")).filter("live").drop("live")
    return members.join(dealt(live), keys)


def pivoted(members: DataFrame, conflict: Conflict, by: list[str], sig: str) -> DataFrame:
    """component per member of each group under a symmetric conflict relation.

    ``sig`` is what conflict() looks at; members with equal sig never conflict with
    each other. The first sig is compared with all others, then its first opponent
    with those that did not conflict. What is left meets the other sigs of its
    group directly, and small components are labelled by propagation.
    """
    sigs = members.groupBy(*by, sig).agg(F.min("clause_id").alias("rep"))
    p1 = sigs.groupBy(*by).agg(F.min(F.struct("rep", F.col(sig).alias("s"))).alias("p1"))
    one = sigs.join(dealt(p1), by).withColumn("ps", F.col("p1.s"))
    one = one.withColumn("c1", (F.col("rep") != F.col("p1.rep")) & conflict(sig, "ps")).drop("ps")
    p2 = one.filter("c1").groupBy(*by).agg(F.min(F.struct("rep", F.col(sig).alias("s"))).alias("p2"))
    two = one.join(dealt(p2), by, "left").withColumn("ps", F.col("p2.s"))
    two = two.withColumn("c2", F.coalesce(~F.col("c1") & conflict(sig, "ps"), F.lit(False))).drop("ps")
    # rep 0..: members of the main component carry the first pivot's id.
    settled = F.col("p2").isNotNull() & (F.col("c1") | F.col("c2") | (F.col("rep") == F.col("p1.rep")))
    two = cut_lineage(two.select(*by, sig, "rep", F.when(settled, F.col("p1.rep")).alias("main")))
    rest = two.filter(F.col("main").isNull())
    other = two.select(*by, F.col(sig).alias("osig"), F.col("rep").alias("orep"), F.col("main").alias("omain"))
    met = rest.join(dealt(other), by).filter(F.col("rep") != F.col("orep")).filter(conflict(sig, "osig"))
    edges = met.select(*by, F.col("rep").alias("a"), F.coalesce("omain", "orep").alias("b"))
    found = components(edges, by).withColumnRenamed("node", "rep")
    main_label = found.select(*by, F.col("rep").alias("main"), F.col("component").alias("merged"))
    labelled = (two.join(dealt(found), [*by, "rep"], "left").join(dealt(main_label), [*by, "main"], "left")
                .withColumn("component", F.coalesce("merged", "main", "component")).filter(F.col("component").isNotNull()))
    return members.join(dealt(labelled.select(*by, sig, "component")), [*by, sig])


def components(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component): smallest node id reachable, by label propagation with pointer jumping.

    Each round is one join and one combined minimum; rounds are written to the
    checkpoint folder so that lost executors cost one round, not the whole chain.
    """
    both = edges.select(*by, "a", "b").unionByName(edges.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*by, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(dealt(labels.select(*by, F.col("node").alias("b"), "component")), [*by, "b"]).groupBy(
            *by, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(dealt(near), [*by, "node"]).withColumn("best", F.least("component", "near"))
        hop = labels.select(*by, F.col("node").alias("best"), F.col("component").alias("hop"))
        new = step.join(dealt(hop), [*by, "best"]).select(*by, "node", F.least("best", "hop").alias("component"),
                                                   (F.least("best", "hop") < F.col("component")).alias("moved"))
        new = cut_lineage(new)
        labels = new.drop("moved")
        if new.filter("moved").isEmpty():
            return labels


def disjoint_dates(rows: DataFrame) -> DataFrame:
    """Clauses with temporal wording whose date sets share no date, as connected issues."""
    gated = rows.filter(X.any_contains(F.col("low"), rules.TEMPORAL_WORDS) & (F.size("dates") > 0))
    members = cut_lineage(gated.select("doc_id", "clause_id", value_set(F.col("dates")).alias("sig")))
    out = pivoted(members, lambda a, b: ~F.arrays_overlap(a, b), ["doc_id"], "sig")
    return out.select("doc_id", "clause_id", F.lit("Contradictory Dates").alias("contradiction_type"),
                      F.lit("temporal:dates").alias("topic"), F.lit("Medium").alias("severity"),
                      F.array_join("sig", ", ").alias("value"), "component")


#: A rule, no limit of size: a title that more clauses share is a heading of a kind, and its clauses are no copies.
MAX_TITLE_GROUP = 4


def meeting(rows: DataFrame, by: list[str], key: str, block: int) -> DataFrame:
    """Every pair of rows of a group once: the columns of the one with the lesser key as a_<column>, beside those of the other.

    Groups above ``block`` rows are dealt into blocks and every two blocks meet in a cell of their own, so no task holds a
    whole group, however large it is.
    """
    sizes = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    own = rows.join(dealt(sizes), by).withColumn("_own", F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int"))
    cells = own.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).withColumn(
        "_i", F.least("_own", "_with")).withColumn("_j", F.greatest("_own", "_with")).drop("_blocks", "_with")
    at = [*by, "_i", "_j"]
    left = cells.select(*at, *[F.col(c).alias(f"a_{c}") for c in cells.columns if c not in at])
    return cells.join(dealt(left), at).filter((F.col(f"a_{key}") < F.col(key)) & ((F.col("a__own") != F.col("_own")) | (F.col("_i") == F.col("_j")))).drop(
        "_i", "_j", "_own", "a__own")


def duplicate_findings(rows: DataFrame, links: bool = False, block: int | None = None) -> DataFrame:
    """Pairs of clauses with one number or title (titles used 2 to 4 times) whose values or wording differ.

    High when money, dates or durations differ, Medium when the wording ratio is below 0.97. Different texts of a number are
    compared once, in blocks; every clause of one is then paired with every clause of the other, in blocks again. ``links``
    asks for no more pairs than leave the same clauses connected (see `_number_links`).
    """
    block = block or BLOCK_CLAUSES
    facts = rows.select("doc_id", "clause_id", "section_name", "low", "clause_number", "title_key",
                        value_set(F.col("money")).alias("m"), value_set(F.col("dates")).alias("d"),
                        value_set(F.col("durations")).alias("u"))
    number = facts.filter(F.col("clause_number").isNotNull()).withColumn("topic", F.concat(F.lit("duplicate:clause number:"), "clause_number"))
    number = number.join(dealt(number.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")), ["doc_id", "topic"], "left_semi")
    alike = Window.partitionBy("doc_id", "topic", "low", "m", "d", "u")
    number = number.withColumn("text_id", F.min("clause_id").over(alike)).withColumn("n_alike", F.count(F.lit(1)).over(alike))
    cols = ["doc_id", "topic", "a_id", "clause_id", "low", "a_low", "m", "a_m", "d", "a_d", "u", "a_u"]
    texts = number.filter(F.col("clause_id") == F.col("text_id")).select("doc_id", "topic", "clause_id", "low", "m", "d", "u", "n_alike")
    wordings = meeting(texts, ["doc_id", "topic"], "clause_id", block).withColumnRenamed("a_clause_id", "a_id")
    titled = facts.filter(F.col("title_key") != "")
    size = titled.groupBy("doc_id", "title_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, MAX_TITLE_GROUP))
    few = titled.join(dealt(size), ["doc_id", "title_key"])
    other = few.select("doc_id", "title_key", F.col("clause_id").alias("a_id"), F.col("clause_number").alias("a_number"),
                       *[F.col(c).alias(f"a_{c}") for c in ("low", "m", "d", "u")])
    same = few.join(dealt(other), ["doc_id", "title_key"]).filter(F.col("a_id") < F.col("clause_id")).filter(
        ~F.coalesce(F.col("a_number") == F.col("clause_number"), F.lit(False))).withColumn(
        "topic", F.concat(F.lit("duplicate:clause title:"), "title_key"))

    def differ(c):
        return (F.size(c) > 0) & (F.size(f"a_{c}") > 0) & (F.col(c) != F.col(f"a_{c}"))
    one = F.lit(1).cast("bigint")
    pairs = wordings.select(*cols, "a_n_alike", "n_alike").unionByName(same.select(*cols, one.alias("a_n_alike"), one.alias("n_alike")))
    pairs = pairs.withColumn("high", differ("m") | differ("d") | differ("u"))
    numbered = F.col("topic").startswith("duplicate:clause number:")
    kept = ["doc_id", "topic", "severity", "a_id", F.col("clause_id").alias("b_id"), F.col("a_n_alike").alias("a_n"), F.col("n_alike").alias("b_n")]
    hard = pairs.filter(F.col("high") & ~numbered if links else F.col("high")).withColumn("severity", F.lit("High")).select(*kept)
    soft = pairs.filter(~F.col("high") & (F.col("low") != F.col("a_low")))
    medium = soft.filter(similarity.differs(F.col("a_low"), F.col("low"), 0.97)).withColumn("severity", F.lit("Medium")).select(*kept)
    found = cut_lineage(hard.unionByName(medium))
    again = number.filter("n_alike > 1").select("doc_id", "topic", "text_id", "clause_id", "n_alike")
    ids = ["doc_id", "topic", "severity", "a_id", "b_id"]
    if links:
        out = _number_links(found, again).unionByName(value_stars(number, ["doc_id", "topic"], ["m", "d", "u"]).withColumn("severity", F.lit("High")).select(*ids))
    else:
        out = found.filter("a_n = 1 and b_n = 1").select(*ids).unionByName(_all_alike(found.filter("a_n > 1 or b_n > 1"), again, block).select(*ids))
    return out.select("doc_id", F.lit("Duplicate Clause").alias("contradiction_type"), "topic", "severity", "a_id", "b_id", F.when(numbered, 0).otherwise(1).alias("detector"))


def _all_alike(found: DataFrame, again: DataFrame, block: int) -> DataFrame:
    """Pairs of texts (by their first clauses) as pairs of all clauses of both; clauses of one text are dealt into blocks."""
    def blocks(n):
        return F.ceil(F.col(n) / block).cast("int")
    out = found
    for side in "ab":
        out = out.withColumn(f"{side}_at", F.explode(F.sequence(F.lit(0), blocks(f"{side}_n") - 1)))
    members = again.select("doc_id", "topic", "text_id", F.col("clause_id").alias("_member"), F.pmod(F.xxhash64("clause_id"), blocks("n_alike")).cast("int").alias("_at"))
    for side in "ab":
        own = members.withColumnRenamed("text_id", f"{side}_id").withColumnRenamed("_at", f"{side}_at")
        out = out.join(dealt(own), ["doc_id", "topic", f"{side}_id", f"{side}_at"], "left").withColumn(
            f"_{side}", F.when(F.col(f"{side}_n") > 1, F.col("_member")).otherwise(F.col(f"{side}_id"))).drop("_member").filter(F.col(f"_{side}").isNotNull())
    return out.withColumn("a_id", F.least("_a", "_b")).withColumn("b_id", F.greatest("_a", "_b"))


def _number_links(found: DataFrame, again: DataFrame) -> DataFrame:
    """Pairs of texts by their first clauses, and each further clause of a text with the first clause of the opposed one.

    The clauses that all pairs connect are connected by these as well: an issue needs no more than that.
    """
    ids = ["doc_id", "topic", "severity", "a_id", "b_id"]
    more = again.filter("clause_id <> text_id").drop("n_alike")
    sides = [found.join(dealt(more.withColumnRenamed("text_id", mine)), ["doc_id", "topic", mine]).select(
        "doc_id", "topic", "severity", F.least("clause_id", other).alias("a_id"), F.greatest("clause_id", other).alias("b_id"))
        for mine, other in (("a_id", "b_id"), ("b_id", "a_id"))]
    return found.select(*ids).unionByName(sides[0]).unionByName(sides[1])


def value_stars(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, a_id, b_id): every clause whose value set differs from another's in its group, paired with the first clause of
    the least set, or of the greatest where its own is the least. One pair per clause and value kind."""
    found = None
    for c in values:
        some = rows.filter(F.size(c) > 0)
        ends = some.groupBy(*by).agg(F.min(F.struct(F.col(c).alias("v"), F.col("clause_id").alias("id"))).alias("_lo"), F.max(c).alias("_hi")).filter(
            F.col("_lo.v") != F.col("_hi"))
        tops = some.join(dealt(ends), by).filter(F.col(c) == F.col("_hi")).groupBy(*by).agg(F.min("clause_id").alias("_top"))
        other = F.when(F.col(c) == F.col("_lo.v"), F.col("_top")).otherwise(F.col("_lo.id"))
        one = some.join(dealt(ends), by).join(dealt(tops), by).select(*by, F.least("clause_id", other).alias("a_id"), F.greatest("clause_id", other).alias("b_id"))
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def obligation_findings(rows: DataFrame) -> DataFrame:
    """Opposite or diverging obligations of similar subjects.

    Equal statements of a document are compared once, by their first clause; each clause that
    makes one is then paired with the first clause of the opposed statement. Actions meet at their
    rarest common words; subjects are compared by their edits.
    """
    o = rows.select("doc_id", "clause_id", F.explode("obligations").alias("o"))
    s = o.select("doc_id", "clause_id", F.lower("o.subject").alias("s"), F.lower("o.action").alias("t"),
                 F.lower("o.modal").rlike(r"\bnot\b").alias("neg"))
    members = s.select("doc_id", F.xxhash64("s", "t", "neg").alias("statement"), "clause_id").distinct()
    s = s.groupBy("doc_id", "s", "t", "neg").agg(F.min("clause_id").alias("clause_id")).withColumn("statement", F.xxhash64("s", "t", "neg"))
    s = s.withColumn("m", value_set(X.money(F.col("t")))).withColumn("u", value_set(X.durations(F.col("t")))).withColumn(
        "bag", similarity.bag(F.col("t")))

    def differ(l, r, c):
        return (F.size(f"{l}{c}") > 0) & (F.size(f"{r}{c}") > 0) & (F.col(f"{l}{c}") != F.col(f"{r}{c}"))

    def fits(l, r):
        opposed = F.col(f"{l}neg") != F.col(f"{r}neg")
        return (opposed | differ(l, r, "m") | differ(l, r, "u")) & (similarity.edit_ratio(F.col(f"{l}s"), F.col(f"{r}s")) >= 0.6)
    met = near_pairs(s.select("doc_id", "statement", "clause_id", "s", "neg", "m", "u", "bag"), ["doc_id"], "statement", "bag", 0.4, fits)
    opp = F.col("a_neg") != F.col("b_neg")
    kept = met.filter(F.when(opp, F.col("ratio") >= 0.55).otherwise(F.col("ratio") > 0.4)).select(
        "doc_id", F.when(opp, "Opposite Statements").otherwise("Conflicting Obligations").alias("contradiction_type"),
        F.when(opp, "obligation:opposite").when(differ("a_", "b_", "m"), "obligation:amount").otherwise("obligation:duration").alias("topic"),
        F.when(opp, "High").otherwise("Medium").alias("severity"), F.col("a_clause_id").alias("l_id"), F.col("b_clause_id").alias("r_id"),
        F.col("a").alias("l_st"), F.col("b").alias("r_st"))
    kept = cut_lineage(kept.select("doc_id", "contradiction_type", "topic", "severity", "l_id", "r_id", "l_st", "r_st"))
    sides = [kept.join(dealt(members.withColumnRenamed("statement", f"{mine}_st")), ["doc_id", f"{mine}_st"]).select(
        "doc_id", "contradiction_type", "topic", "severity", F.col("clause_id").alias("x"), F.col(f"{other}_id").alias("y"))
        for mine, other in (("l", "r"), ("r", "l"))]
    every = sides[0].unionByName(sides[1]).filter("x <> y")
    return every.select("doc_id", "contradiction_type", "topic", "severity", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"),
                        F.lit(2).alias("detector")).distinct()


def first_per_pair(findings: DataFrame, order: str) -> DataFrame:
    """One finding per (document, type, unordered pair): the one of the earliest detector."""
    w = Window.partitionBy("doc_id", "contradiction_type", F.least("a_id", "b_id"), F.greatest("a_id", "b_id")).orderBy(order, "severity", "topic")
    return findings.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r", "detector")


def issue_members(clauses: DataFrame) -> DataFrame:
    """All conflicts of all documents in long form: one row per issue and clause.

    Issues are connected sets, so the duplicates are asked for as links: all pairs would connect the same clauses.
    """
    rows = cut_lineage(enriched(clauses))
    keys = ["doc_id", "contradiction_type", "topic"]
    cols = [*keys, "severity", "component", "clause_id", "value"]
    valued = differing(value_members(rows)).select(*cols).unionByName(disjoint_dates(rows).select(*cols))
    found = cut_lineage(first_per_pair(duplicate_findings(rows, links=True).unionByName(obligation_findings(rows)), "detector"))
    comp = components(found.select(*keys, F.col("a_id").alias("a"), F.col("b_id").alias("b")), keys)
    worst = found.join(dealt(comp.withColumnRenamed("node", "a_id")), [*keys, "a_id"]).groupBy(*keys, "component").agg(
        F.max(F.when(F.col("severity") == "High", 3).otherwise(2)).alias("rank"))
    paired = comp.join(dealt(worst), [*keys, "component"]).select(
        *keys, F.when(F.col("rank") == 3, "High").otherwise("Medium").alias("severity"), "component",
        F.col("node").alias("clause_id"), F.lit(None).cast("string").alias("value"))
    return valued.unionByName(paired)


def issues(members: DataFrame, limit: int | None = None) -> DataFrame:
    """The issues of each document, most severe first, with clause counts and first clause; the first ``limit`` if given."""
    keys = ["doc_id", "contradiction_type", "topic", "component"]
    rows = members.groupBy(*keys).agg(F.max("severity").alias("_s"), F.count(F.lit(1)).alias("n_clauses"),
                                      F.min("severity").alias("severity"), F.min("clause_id").alias("first_clause"))
    rank = F.create_map(*[F.lit(x) for kv in rules.SEVERITY_RANK.items() for x in kv])[F.col("severity")]
    w = Window.partitionBy("doc_id").orderBy(rank.desc(), "contradiction_type", "topic", "component")
    placed = rows.drop("_s").withColumn("place", F.row_number().over(w))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


#: Documents of up to so many clauses are compared row by row; clauses of one block of a larger one.
FEW_CLAUSES, BLOCK_CLAUSES = 64, 1024


def _close_in_block(floor: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, side = rows["clause_id"].to_numpy(), rows["side"].to_numpy()
        units = np.array(rows["u"].tolist())
        left, right = (np.flatnonzero((side == s) | (side == 2)) for s in (0, 1))
        scores = units[left] @ units[right].T
        i, j = np.nonzero(scores >= floor)
        a, b = ids[left[i]], ids[right[j]]
        some = a < b if (side == 2).all() else np.full(len(a), True)
        return pd.DataFrame({"doc_id": rows["doc_id"].iloc[0], "a_id": np.minimum(a, b)[some], "b_id": np.maximum(a, b)[some], "similarity": scores[i, j][some]})
    return run


def semantic_candidates(clauses: DataFrame, flagged: DataFrame, vector: str = "embedding", floor: float = 0.35,
                        limit: int | None = None) -> DataFrame:
    """Unflagged clause pairs of each document with cosine at least ``floor``, best first; the first ``limit`` if given.

    Clauses of a large document are dealt into blocks, every two blocks meet once as a product of matrices, and only pairs
    that reach the floor become rows. Flagged pairs are then left out by their ids alone.
    """
    unit = cut_lineage(clauses.filter(F.col(vector).isNotNull()).select("doc_id", "clause_id", V.unit(F.col(vector)).alias("u")))
    sizes = unit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > FEW_CLAUSES).withColumn("_blocks", F.ceil(F.col("_n") / BLOCK_CLAUSES).cast("int")).select("doc_id", "_blocks")
    small = unit.join(large, "doc_id", "left_anti")
    other = small.select("doc_id", F.col("clause_id").alias("b_id"), F.col("u").alias("ub"))
    near = small.withColumnRenamed("clause_id", "a_id").join(other, "doc_id").filter("a_id < b_id").select(
        "doc_id", "a_id", "b_id", V.dot(F.col("u"), F.col("ub")).alias("similarity")).filter(F.col("similarity") >= floor)
    dealt = unit.join(large, "doc_id").withColumn("_own", F.pmod(F.xxhash64("clause_id"), F.col("_blocks")).cast("int"))
    cells = dealt.select("doc_id", "clause_id", "u", "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_with")).select(
        "doc_id", "clause_id", "u", F.least("_own", "_with").alias("_i"), F.greatest("_own", "_with").alias("_j"),
        F.when(F.col("_own") == F.col("_with"), 2).when(F.col("_own") < F.col("_with"), 0).otherwise(1).alias("side"))
    kinds = {f.name: f.dataType.simpleString() for f in unit.schema}
    far = cells.groupBy("doc_id", "_i", "_j").applyInPandas(_close_in_block(floor), f"doc_id {kinds['doc_id']}, a_id {kinds['clause_id']}, "
                                                            f"b_id {kinds['clause_id']}, similarity double")
    open_pairs = near.unionByName(far).join(flagged.select("doc_id", "a_id", "b_id"), ["doc_id", "a_id", "b_id"], "left_anti")
    w = Window.partitionBy("doc_id").orderBy(F.col("similarity").desc(), "a_id", "b_id")
    placed = open_pairs.withColumn("place", F.row_number().over(w))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def dependencies(clauses: DataFrame, type_rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Edges source -> target: numbered references (last clause of a number) and type rules (first of a type)."""
    num = X.leading_number(F.col("section_name"))
    numbered = clauses.select("doc_id", num.alias("number"), "clause_id", "section_name").filter(F.col("number").isNotNull())
    target = numbered.groupBy("doc_id", "number").agg(F.max(F.struct("clause_id", "section_name")).alias("t"))
    refs = clauses.select("doc_id", "clause_id", "section_name", F.posexplode(X.section_refs(F.col("text_content"))).alias("ord", "ref"))
    refs = refs.withColumn("number", F.regexp_extract("ref", r"(\d+(?:\.\d+)*)", 1))
    hit = refs.join(target, ["doc_id", "number"]).filter(F.col("clause_id") != F.col("t.clause_id"))
    cited = hit.groupBy("doc_id", F.col("clause_id").alias("source_id"), F.col("t.clause_id").alias("target_id")).agg(
        F.min_by("ref", "ord").alias("ref")).select("doc_id", "source_id", "target_id", F.lit("references").alias("relation"), "ref")
    first = clauses.groupBy("doc_id", F.coalesce("classification", F.lit("General")).alias("kind")).agg(F.min("clause_id").alias("id"))
    table = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t"), F.lit(r).alias("r")) for s, t, r in (type_rules or rules.DEPENDENCIES)])
    src = first.select("doc_id", "kind", F.col("id").alias("source_id"), F.explode(table).alias("e")).filter(F.col("kind") == F.col("e.s"))
    ruled = src.join(first.select("doc_id", F.col("kind").alias("tk"), F.col("id").alias("target_id")), "doc_id").filter(
        (F.col("tk") == F.col("e.t")) & (F.col("source_id") != F.col("target_id"))).select(
        "doc_id", "source_id", "target_id", F.col("e.r").alias("relation"), F.lit(None).cast("string").alias("ref"))
    fresh = ruled.join(cited.select("doc_id", "source_id", "target_id"), ["doc_id", "source_id", "target_id"], "left_anti")
    return cited.unionByName(fresh)
