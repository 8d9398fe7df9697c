"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept and returns a DataFrame that
is written as Parquet and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import bpe, line_dedup, mixing, rule_cascade, shingle_forest
from lexmill.llm.queries import vocabulary
from lexmill.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rule_cascade.cascade(docs)


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that copy an earlier one; documents of which nothing is left go."""
    cleaned = line_dedup.cleaned(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near copies; documents equal in id and text stay once."""
    return shingle_forest.first_of_classes(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source asks for, in whole copies whose words come to the target."""
    return mixing.repeated(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count and digests of the ids and of the decoded text of each row."""
    return bpe.encode(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_copies), ("near copies", near_copies),
          ("source mix", source_mix), ("bpe", encoded)]

#: SQL has no byte-pair merges, so the whole run has none; tests compare it with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
