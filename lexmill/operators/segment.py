"""Text to sections, blocks, chunks and clauses.

A document is one row, so cutting it up is array work inside that row: no
shuffle until clauses of one document have to be compared with each other.
Page tables, where a document is many rows, use running sums per page.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunking, similarity
from ..functions import patterns as P
from ..functions import text as X
from ..session import cut_lineage, dealt
from . import classify, groups, near_text
from .pairs import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_BLOCK = 15
MARKERS = r"\n(?=" + "|".join(p[5:-1] for p in (P.NUMBERED_MARKER, P.LETTERED_MARKER, P.BULLET_MARKER)) + ")"


def strip_glyphs(text: Column) -> Column:
    return F.regexp_replace(text, P.CID, "")


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), X.strip), lambda line: line != "")


def cut_at(lines: Column, starts: Column) -> Column:
    """Slices of an array from each start (0-based, ascending) to the next."""
    def piece(start, k):
        stop = F.coalesce(F.get(starts, k + 1), F.size(lines))
        return F.slice(lines, start + 1, stop - start)
    return F.transform(starts, piece)


def sections(df: DataFrame, text: str, strict_roman: bool = False) -> DataFrame:
    """section_no, section_name and text_content; text before the first heading is the Preamble.

    A heading with no text under it gives no section.
    """
    df = df.withColumn("_lines", content_lines(F.col(text)))
    heads = F.filter(F.transform("_lines", lambda line, i: F.when(X.is_heading(line, strict_roman), i)),
                     lambda i: i.isNotNull())
    df = df.withColumn("_heads", F.concat(F.array(F.lit(-1)), heads))

    def section(h, k):
        stop = F.coalesce(F.get(F.col("_heads"), k + 1), F.size("_lines"))
        name = F.when(h < 0, "Preamble").otherwise(F.get(F.col("_lines"), F.greatest(h, F.lit(0))))
        return F.struct(name.alias("section_name"), F.slice("_lines", h + 2, stop - h - 1).alias("body"))
    made = F.filter(F.transform("_heads", section), lambda s: F.size(s["body"]) > 0)
    out = df.select(*[c for c in df.columns if not c.startswith("_")], F.posexplode(made).alias("section_no", "_s"))
    return (out.withColumn("section_name", F.col("_s.section_name"))
            .withColumn("text_content", F.array_join("_s.body", "\n")).drop("_s"))


def sections_from_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_number",
                        text: str = "raw_text", strict_roman: bool = False) -> DataFrame:
    """Sections of a page table; a section keeps the page its heading stands on.

    The section number is a running count of headings: inside each page, plus the
    headings of earlier pages, so the largest window holds one page or one
    document's page totals.
    """
    lines = pages.select(doc, page, F.posexplode(content_lines(F.col(text))).alias("_pos", "_line"))
    lines = lines.withColumn("_head", X.is_heading(F.col("_line"), strict_roman).cast("int"))
    per_page = lines.groupBy(doc, page).agg(F.sum("_head").alias("_n"))
    before = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_page.select(doc, page, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(doc, page).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("_in", F.sum("_head").over(inside)).join(offsets, [doc, page]).withColumn(
        "section_no", F.col("_before") + F.col("_in"))
    body = F.array_sort(F.collect_list(F.when(F.col("_head") == 0, F.struct(page, "_pos", "_line"))))
    made = placed.groupBy(doc, "section_no").agg(
        F.coalesce(F.max(F.when(F.col("_head") == 1, F.col("_line"))), F.lit("Preamble")).alias("section_name"),
        F.coalesce(F.max(F.when(F.col("_head") == 1, F.col(page))), F.lit(1)).alias("page_num"),
        F.array_join(F.transform(body, lambda b: b["_line"]), "\n").alias("text_content"))
    return made.filter(F.col("text_content") != "")


def fixed_windows(df: DataFrame, text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """chunk_index and chunk: windows of ``size`` characters, each starting size-overlap further on."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(step))
    chunks = F.transform(starts, lambda s: F.substring(F.col(text), s + 1, F.lit(size)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(chunks).alias("chunk_index", "chunk"))


def recursive_chunks(df: DataFrame, text: str, size: int = 1000, overlap: int = 150) -> DataFrame:
    """chunk_index, chunk and length; texts that already fit never leave the JVM."""
    keep = [c for c in df.columns if c != text]
    short = df.filter(F.length(text) < size).select(*keep, F.array(X.strip(F.col(text))).alias("_c"))
    short = short.withColumn("_c", F.filter("_c", lambda c: c != ""))
    long = df.filter(F.length(text) >= size).select(*keep, chunking.chunk_array(F.col(text), size, overlap).alias("_c"))
    return short.unionByName(long).select(*keep, F.posexplode("_c").alias("chunk_index", "chunk"),).withColumn(
        "length", F.length("chunk"))


def bound_sections(df: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Oversize sections become "(part i/n)" rows that keep their parent; the others pass through."""
    fits = df.filter(F.length("text_content") <= size).select(
        "*", F.lit(None).cast("string").alias("parent_section_name"), F.lit(None).cast("int").alias("chunk_index"))
    long = df.filter(F.length("text_content") > size).withColumn(
        "_c", chunking.chunk_array(F.col("text_content"), size, overlap))
    parts = long.select(*[c for c in df.columns if c not in ("section_name", "text_content")],
                        F.col("section_name").alias("parent_section_name"), F.size("_c").alias("_n"),
                        F.posexplode("_c").alias("chunk_index", "text_content"))
    parts = parts.withColumn("section_name", F.concat(
        F.col("parent_section_name"), F.lit(" (part "), (F.col("chunk_index") + 1).cast("string"), F.lit("/"),
        F.col("_n").cast("string"), F.lit(")"))).drop("_n")
    return fits.unionByName(parts)


def sections_or_chunks(df: DataFrame, text: str) -> DataFrame:
    """Heading sections, or chunks named "Section n" for documents with at most two sections."""
    keep = [c for c in df.columns if c != text]
    df = df.withColumn("_lines", content_lines(F.col(text)))
    heads = F.transform("_lines", lambda line: X.is_heading(line))
    df = df.withColumn("_heads", heads)
    # A section exists where a body line follows the start of the text or a heading.
    n = F.size(F.filter(F.transform("_heads", lambda h, i: (~h) & F.coalesce(F.get(F.col("_heads"), i - 1), F.lit(True))),
                        lambda x: x))
    df = df.withColumn("_n", n).drop("_lines", "_heads")
    by_heading = sections(df.filter(F.col("_n") > 2).drop("_n"), text).select(
        *keep, "section_no", "section_name", "text_content")
    by_chunk = recursive_chunks(df.filter(F.col("_n") <= 2).drop("_n"), text).select(
        *keep, F.col("chunk_index").alias("section_no"),
        F.concat(F.lit("Section "), (F.col("chunk_index") + 1).cast("string")).alias("section_name"),
        F.col("chunk").alias("text_content"))
    return by_heading.unionByName(by_chunk)


def table_sentence(header: Column, cells: Column) -> Column:
    """ "H: v. H: v." for filled header/cell pairs, else the cells joined by "; "; null below 8 characters."""
    def full(v):
        return X.strip(F.coalesce(v, F.lit(""))) != ""
    pairs = F.filter(F.zip_with(header, cells, lambda h, c: F.when(full(h) & full(c), F.concat(
        X.strip(strip_glyphs(h)), F.lit(": "), X.strip(strip_glyphs(c))))),
        lambda p: p.isNotNull() & (F.regexp_replace(p, "[: .]", "") != ""))
    named = F.exists(header, full) & (F.size(pairs) > 0)
    bare = F.array_join(F.filter(F.transform(F.filter(cells, full), lambda c: X.strip(strip_glyphs(c))),
                                 lambda c: c != ""), "; ")
    text = F.when(F.coalesce(named, F.lit(False)), F.concat(F.array_join(pairs, ". "), F.lit("."))).otherwise(bare)
    return F.when(F.length(text) >= 8, text)


def lines_from_words(words: DataFrame, by: list[str]) -> DataFrame:
    """Lines of a page from word boxes (text, x0, top).

    Words are taken by rounded top, then x0; a new line starts when a word lies
    more than 3 units from the first word of the current line. One page is one
    ordered fold over its own words.
    """
    page = words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(
        F.bround("top", 0).alias("r"), F.col("x0"), F.col("top"), F.col("text")))).alias("_w"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("no"),
                     F.array().cast("array<struct<no:int,x0:double,text:string>>").alias("out"))

    def step(acc, w):
        new = acc["anchor"].isNull() | (F.abs(w["top"] - acc["anchor"]) > 3)
        no = F.when(new, acc["no"] + 1).otherwise(acc["no"])
        return F.struct(F.when(new, w["top"]).otherwise(acc["anchor"]).alias("anchor"), no.alias("no"),
                        F.array_append(acc["out"], F.struct(no.alias("no"), w["x0"].alias("x0"),
                                                            w["text"].alias("text"))).alias("out"))
    rows = page.select(*by, F.explode(F.aggregate("_w", start, step, lambda acc: acc["out"])).alias("_o"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o.x0", "_o.text"))), lambda s: s["text"]), " ")
    out = rows.groupBy(*by, F.col("_o.no").alias("line_no")).agg(X.strip(strip_glyphs(line)).alias("line"))
    return out.filter(F.col("line") != "")


def blocks_of(text: Column) -> Column:
    """Candidate blocks in text order: blank lines, then inner headings, then list markers."""
    paragraphs = F.filter(F.transform(F.split(text, P.jvm(P.BLANK_LINES)), X.strip), lambda p: p != "")

    def by_heading(p):
        lines = F.split(p, "\n")
        inner = F.filter(F.transform(lines, lambda line, i: F.when((i > 0) & X.is_heading(X.strip(line)), i)),
                         lambda i: i.isNotNull())
        cut = F.transform(cut_at(lines, F.concat(F.array(F.lit(0)), inner)), lambda ls: F.array_join(ls, "\n"))
        return F.when(F.size(lines) < 3, F.array(p)).otherwise(cut)
    pieces = F.flatten(F.transform(paragraphs, by_heading))
    marked = F.flatten(F.transform(pieces, lambda piece: F.split(piece, P.jvm(MARKERS))))
    return F.filter(F.transform(marked, X.strip), lambda b: b != "")


def candidate_blocks(df: DataFrame, text: str, drop_short_and_repeated: bool = True) -> DataFrame:
    """block_no and block; exact repeats inside a document and blocks under 15 characters are dropped."""
    blocks = blocks_of(F.col(text))
    if drop_short_and_repeated:
        blocks = F.array_distinct(F.filter(blocks, lambda b: F.length(b) >= MIN_BLOCK))
    return df.select("*", F.posexplode(blocks).alias("block_no", "block"))


def offsets(df: DataFrame, full_text: str, block: str) -> DataFrame:
    """0-based start (first occurrence, 0 if absent) and end of a block."""
    start = F.greatest(F.position(F.col(block), F.col(full_text)) - 1, F.lit(0))
    return df.withColumn("start_position", start).withColumn("end_position", start + F.length(block))


def page_of(pages: Column, block: Column) -> Column:
    """First page (array of page_number, raw_text) whose text contains the block, ignoring case."""
    hit = F.filter(pages, lambda p: F.lower(p["raw_text"]).contains(F.lower(block)))
    return F.get(F.transform(hit, lambda p: p["page_number"]), F.lit(0))


def document_text(sections: DataFrame, order: str, text: str, doc: str = "doc_id", page: str = "page_num", gap: str = "\n\n") -> DataFrame:
    """Text of each document from its sections in order, and where the first section of each page begins in it.

    A document's own sections meet in one row, as its text does. page_map: array of (page, offset), by page.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(page).alias("page"), F.coalesce(text, F.lit("")).alias("t"))))
    df = sections.groupBy(doc).agg(parts.alias("_parts"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<page: {sections.schema[page].dataType.simpleString()}, offset: int>>").alias("map"))
    placed = F.aggregate("_parts", begin, lambda acc, p: F.struct(
        (acc["at"] + F.length(p["t"]) + len(gap)).alias("at"),
        F.when(F.exists(acc["map"], lambda m: m["page"].eqNullSafe(p["page"])), acc["map"]).otherwise(
            F.array_append(acc["map"], F.struct(p["page"].alias("page"), acc["at"].alias("offset")))).alias("map")))
    return df.select(doc, F.array_join(F.transform("_parts", lambda p: p["t"]), gap).alias("full_text"),
                     F.array_sort(placed["map"]).alias("page_map"))


def fold_near_copies(clauses: DataFrame, doc: str = "doc_id", order: str = "block_no", text: str = "text_content",
                     score: str = "confidence_score", at_least: float = 0.9, longer: float = 0.3) -> DataFrame:
    """Collapse near-copies inside a document; slot_no is the place a kept clause takes.

    Two clauses can only be copies when all their numbers agree, they share at_least of their words and
    their lengths differ by ``longer`` of the longer one at most. Clauses linked by copies are one class: it
    takes the place of its first clause and keeps the one with the highest score, the first of equals.
    """
    best = F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))
    keyed = clauses.select(doc, F.xxhash64(X.numeric_fingerprint(F.col(text))).alias("_fp"), X.dedup_form(F.col(text)).alias("_norm"), order, score)
    texts = keyed.groupBy(doc, "_fp", "_norm").agg(F.min(order).alias("_id"), F.max(best).alias("_best"))
    # Most texts are the only one with their numbers: their words are never taken, and only the others are kept on disk.
    several = keyed.groupBy(doc, "_fp").agg(F.count(F.lit(1)).alias("_f")).filter("_f > 1").select(doc, "_fp")
    near = texts.select(doc, "_fp", "_id", "_norm").join(dealt(several), [doc, "_fp"], "left_semi")
    near = cut_lineage(near.select(doc, "_fp", "_id", F.length("_norm").alias("_len"), similarity.bag(F.col("_norm")).alias("_bag")))
    pairs = near_text.near_pairs(near, [doc, "_fp"], "_id", "_bag", at_least,
                                 lambda l, r: F.abs(F.col(f"{l}_len") - F.col(f"{r}_len")) <= longer * F.greatest(f"{l}_len", f"{r}_len"))
    classes = components(pairs.select(doc, "a", "b"), [doc]).withColumnRenamed("node", "_id")
    kept = texts.select(doc, "_id", "_best").join(dealt(classes), [doc, "_id"], "left").groupBy(doc, F.coalesce("component", "_id").alias("slot_no")).agg(
        F.max("_best").alias("_best")).select(doc, "slot_no", (-F.col("_best.o")).cast(clauses.schema[order].dataType).alias(order))
    return clauses.join(dealt(kept), [doc, order])


def unique_titles(df: DataFrame, title: str, order: str, doc: str = "doc_id",
                  hot_rows: int = groups.HOT_ROWS, keys: DataFrame | None = None) -> DataFrame:
    """Second and later uses of a title in a document get " (n)"."""
    out = groups.numbered(df, [doc, title], order, "_n", hot_rows, keys)
    return out.withColumn(title, F.when(F.col("_n") > 1, F.concat(F.col(title), F.lit(" ("), F.col("_n").cast("string"),
                                                                  F.lit(")"))).otherwise(F.col(title))).drop("_n")


def backfill_titles(clauses: DataFrame, doc: str = "doc_id", order: str = "clause_id") -> DataFrame:
    """Replace titles that only repeat the category by a generated one with the next free suffix."""
    bare = F.lower(F.trim("section_name")) == F.lower(F.trim("classification"))
    stale = clauses.filter(F.coalesce(bare, F.lit(False)) & (F.trim("classification") != ""))
    base = F.coalesce(classify.own_heading(F.col("text_content")),
                      classify.clause_title(F.col("classification"), F.col("text_content")))
    wanted = groups.numbered(classify.once(stale, F.struct(base.alias("base"))).select(doc, order, "base").withColumn("_key", F.lower("base")),
                             [doc, "_key"], order, "_k")
    split = F.regexp_extract(F.lower(F.trim("section_name")), r"^(.*?)(?: \((\d+)\))?$", 1)
    slot = F.regexp_extract(F.lower(F.trim("section_name")), r"^(.*?)(?: \((\d+)\))?$", 2)
    taken = clauses.select(doc, split.alias("_key"), F.coalesce(F.nullif(slot, F.lit("")).cast("bigint"), F.lit(1)).alias(
        "_slot")).distinct()
    need = wanted.groupBy(doc, "_key").agg(F.max("_k").alias("_need"))
    used = taken.join(need, [doc, "_key"]).groupBy(doc, "_key").agg(F.count(F.lit(1)).alias("_used"))
    room = need.join(used, [doc, "_key"], "left").withColumn("_top", F.col("_need") + F.coalesce("_used", F.lit(0)))
    free = room.select(doc, "_key", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_top").cast("bigint"))).alias("_slot")).join(
        taken, [doc, "_key", "_slot"], "left_anti")
    placed = groups.numbered(free, [doc, "_key"], "_slot", "_k")
    made = wanted.join(placed, [doc, "_key", "_k"]).select(doc, order, F.when(F.col("_slot") == 1, F.col("base")).otherwise(
        F.concat("base", F.lit(" ("), F.col("_slot").cast("string"), F.lit(")"))).alias("new_title"))
    return clauses.join(made, [doc, order], "left").withColumn(
        "section_name", F.coalesce("new_title", "section_name")).drop("new_title")


def sentence_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """Whole sentences packed up to ``size`` characters; a longer sentence is cut hard."""
    sentences = F.split(X.strip(F.col(text)), r"(?U)(?<=[.!?])\s+")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc, s):
        fits = F.length(acc["cur"]) + 1 + F.length(s) <= size
        empty = acc["cur"] == ""
        return F.struct(F.when(empty | fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"])).alias("done"),
                        F.when(empty | ~fits, s).otherwise(F.concat(acc["cur"], F.lit(" "), s)).alias("cur"))
    packed = F.aggregate(sentences, start, step, lambda acc: F.when(acc["cur"] == "", acc["done"]).otherwise(
        F.array_append(acc["done"], acc["cur"])))
    cut = F.flatten(F.transform(packed, lambda c: F.transform(
        F.sequence(F.lit(0), F.length(c) - 1, F.lit(size)), lambda s: F.substring(c, s + 1, F.lit(size)))))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(cut).alias("chunk_index", "chunk"))


def half_split(text: Column) -> tuple[Column, Column]:
    """Cut near the middle, after a sentence end that lies in the second fifth or later."""
    mid = F.floor(F.length(text) / 2).cast("int")
    window = F.substring(text, F.lit(1), mid + 1)
    gap = F.length(window) - F.instr(F.reverse(window), " .") - 1
    found = (F.instr(F.reverse(window), " .") > 0) & (gap >= F.length(text) * 0.2)
    at = F.when(found, gap + 1).otherwise(mid)

    def cut(position):
        return (X.strip(F.substring(text, F.lit(1), position)),
                X.strip(text.substr(position + 1, F.length(text))))
    left, right = cut(at)
    left_mid, right_mid = cut(mid)
    bad = (left == "") | (right == "")
    return F.when(bad, left_mid).otherwise(left), F.when(bad, right_mid).otherwise(right)


def half_splits(df: DataFrame, text: str, limit: int, depth: int = 4) -> DataFrame:
    """Halve texts above ``limit`` characters again and again, at most ``depth`` times; part_no keeps the order."""
    out = df.withColumn("part_no", F.lit(0))
    for _ in range(depth):
        left, right = half_split(F.col(text))
        parts = F.when(F.length(text) > limit, F.array(left, right)).otherwise(F.array(F.col(text)))
        out = out.select(*[c for c in out.columns if c not in (text, "part_no")], "part_no",
                         F.posexplode(parts).alias("_i", text)).withColumn(
            "part_no", F.col("part_no") * 2 + F.col("_i")).drop("_i")
    return out


def fit_budget(text: Column, system_chars: Column | int, token_limit: int = 6000, completion: int = 2048,
               margin: int = 500, chars_per_token: float = 3.5) -> Column:
    """Text cut to the character budget left beside a system prompt, with a marker when cut."""
    system = F.lit(system_chars) if isinstance(system_chars, int) else system_chars
    tokens = F.lit(token_limit - completion - margin) - F.floor(system / chars_per_token)
    budget = F.greatest(F.floor(tokens * chars_per_token), F.lit(500)).cast("int")
    marker = "\n\n[...input truncated: exceeded the model's per-minute token budget...]"
    return F.when(F.length(text) <= budget, text).otherwise(F.concat(F.substring(text, F.lit(1), budget), F.lit(marker)))


def bullets(text: Column) -> Column:
    """Bullet lines of an explanation: by dash lines, else by sentence; longer than 3 characters, at most six."""
    t = X.strip(F.coalesce(text, F.lit("")))
    dashed = t.startswith("-") | t.contains("\n-")
    by_line = F.transform(F.split(t, "\n"), lambda p: X.strip(F.regexp_replace(p, r"^[- ]+|[- ]+$", "")))
    by_sentence = F.transform(F.split(t, r"(?U)(?<=[.;])\s+"), X.strip)
    parts = F.when(dashed, by_line).otherwise(by_sentence)
    return F.slice(F.filter(parts, lambda p: F.length(p) > 3), 1, 6)


def identify_clauses(documents: DataFrame, text: str = "full_text", doc: str = "doc_id",
                     clause_rules=None, rescue_fields: bool = True, hot_rows: int = groups.HOT_ROWS) -> DataFrame:
    """Documents to clauses: blocks, classification, acceptance, near-copy folding, titles, positions."""
    rows = candidate_blocks(documents, text)
    rows = classify.with_type_of_alike(rows, F.col("block"), clause_rules)
    rows = classify.accept_clauses(rows, "block", rescue_fields).filter(F.col("classification").isNotNull())
    rows = classify.once(rows, F.struct(F.coalesce(
        classify.own_heading(F.col("block")),
        classify.clause_title(F.col("classification"), F.col("block"))).alias("clause_title")))
    rows = offsets(rows, text, "block").drop(text)
    kept = fold_near_copies(rows.withColumnRenamed("block", "text_content"), doc)
    # A document is one row here, so its clauses are bounded by the size of that row.
    return unique_titles(kept, "clause_title", "slot_no", doc, hot_rows, documents.select(doc))
