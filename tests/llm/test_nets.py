"""Held-out accuracy of the two byte networks, and their odd rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import language_net, quality_net, queries

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "123 456 !!"), (4, "é"), (5, "the of and " * 30_000), (5, "the of and " * 30_000)]


def test_quality_of_held_out_texts(spark):
    got = queries.QUERIES["op3_quality_net"](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("held_out").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    assert all(r.predicted for r in rows if r.quality == 1)


def test_language_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.QUERIES["op4_language_net"](spark, SF).join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("label", F.lit(1)).withColumn("t", F.lit(1))
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (2, None)], "doc_id long, quality int")
    never = queries.remainder_is(7, 9)
    languages = {r.doc_id: (r.lang_pred, r.score) for r in language_net.detect(docs, never).collect()}
    assert languages[1] == languages[2] == languages[3] == ("und", 0.0) and languages[4][0] == languages[5][0] == "en"
    scores = quality_net.rate(docs, labels, never).collect()
    assert len(scores) == len(ODD) and len({r.score for r in scores if r.doc_id == 5}) == 1
    nothing = labels.filter("false")
    assert {r.score for r in quality_net.rate(docs, nothing, never).collect()} == {0.5}
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_net.detect(unknown, never).collect()} == {"und"}
    assert language_net.detect(docs.filter("false"), never).count() == quality_net.rate(docs.filter("false"), labels, never).count() == 0
