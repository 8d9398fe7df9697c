"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import (avi, bpe, html_text, language_net, line_dedup, merkle, mixing, quality_net, rule_cascade, secret_scan, shared_terms,
                         shingle_forest, super_kmers)
from lexmill.llm.words import ANSI_WORDS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUALITY_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, {ANSI_WORDS.format(text="text")} AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
t AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM t) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (SELECT w.*, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(list_sum(list_transform(list_filter(regexp_extract_all(text, '!+'), lambda x: length(x) > 1),
                                                   lambda x: length(x))), 0) AS BIGINT) AS n_shouts
      FROM w LEFT JOIN covered USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (20 * n_symbols > word_chars OR 100 * n_dup_lines > 50 * n_lines
                                OR 5 * n_shouts > n_words OR word_chars > 40 * n_words) AS kept
FROM f"""


@register("op1_source_mix", mixing.MIX_SQL)
def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


def vocabulary(name: str) -> str:
    """The place of an installed public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op2_bpe_round_trip")
def bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))


def remainder_is(divisor: int, value: int):
    """Rows whose crc32 of the id as text leaves this remainder."""
    def test(key: Column) -> Column:
        return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % divisor == value
    return test


@register("op3_quality_net")
def quality_scores(spark: SparkSession, sf: str) -> DataFrame:
    return quality_net.rate(table(spark, sf, "documents"), table(spark, sf, "labels"), remainder_is(5, 0))


@register("op4_language_net")
def language_guesses(spark: SparkSession, sf: str) -> DataFrame:
    return language_net.detect(table(spark, sf, "documents"), remainder_is(4, 2))


@register("op5_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return rule_cascade.rule_report(table(spark, sf, "documents"))


@register("op6_avi_frames")
def avi_frames(spark: SparkSession, sf: str) -> DataFrame:
    return avi.figures(avi.store(table(spark, sf, "documents")))


@register("op7_secret_spans")
def secret_spans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf, "documents"))


@register("op8_html_layout")
def html_layout(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


SHINGLE_SQL = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents GROUP BY text),
w AS (SELECT id, {ANSI_WORDS.format(text="text")} AS ws FROM t),
s AS (SELECT DISTINCT id, array_to_string(ws[i:i + 4], chr(10)) AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
k AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.8 * (x.n + y.n - common) - 1e-9),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
r(node, reach) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach),
c AS (SELECT node, min(reach) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links FROM u GROUP BY a)
SELECT doc_id, coalesce(class_id, id) AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM documents d JOIN t ON d.text IS NOT DISTINCT FROM t.text LEFT JOIN c ON node = id LEFT JOIN l ON l.a = id"""


@register("op9_shingle_join", SHINGLE_SQL)
def shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return shingle_forest.classes(table(spark, sf, "documents"))


#: Lines within one edit share a half; of the pairs that do, the edit is sought place by place.
LINES_SQL = f"""
WITH s AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM s)),
w AS (SELECT *, regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS worded FROM l),
c AS (SELECT line, length(line) AS n, min(row(doc_id, line_no)) AS place FROM w WHERE worded GROUP BY line),
h AS (SELECT line, n, place, side, size, CASE WHEN side = 0 THEN substr(line, 1, size) ELSE substr(line, n - size + 1) END AS part
      FROM (SELECT *, unnest([0, 1]) AS side FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS size FROM c WHERE n >= {line_dedup.MIN_CHARS}))),
p AS (SELECT DISTINCT a.line AS x, b.line AS y, b.place AS later FROM h a JOIN h b ON a.side = b.side AND a.size = b.size AND a.part = b.part
      WHERE a.place < b.place AND abs(a.n - b.n) <= 1),
o AS (SELECT later, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS x, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS y FROM p),
g AS (SELECT DISTINCT later FROM o WHERE len(list_filter(range(0, length(y)), lambda i: substr(x, 1, i) = substr(y, 1, i)
      AND substr(x, CAST(i + 1 + length(x) - length(y) + 1 AS BIGINT)) = substr(y, i + 2))) > 0),
k AS (SELECT place FROM c WHERE place NOT IN (SELECT later FROM g)),
m AS (SELECT w.*, worded AND k.place IS NOT NULL AS kept FROM w LEFT JOIN k ON k.place = row(w.doc_id, w.line_no))
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
       CASE WHEN d.text IS NOT NULL THEN coalesce(m2.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) FILTER (worded) AS n_lines, count(*) FILTER (kept) AS n_kept,
       string_agg(line, chr(10) ORDER BY line_no) FILTER (kept OR NOT worded) AS text FROM m GROUP BY doc_id) m2 ON m2.doc_id = d.doc_id"""


@register("op10_line_dedup", LINES_SQL)
def line_copies(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf, "documents"))


@register("op11_merkle_manifest", merkle.MANIFEST_SQL)
def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.tamper_report(table(spark, sf, "documents"))


@register("op12_repeated_passages", super_kmers.REPEATS_SQL)
def repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return super_kmers.digests(table(spark, sf, "documents"))


@register("op13_ranked_search", shared_terms.SEARCH_SQL)
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return shared_terms.search(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
