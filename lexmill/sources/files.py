"""Text files and stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, length, full_text (bad bytes become replacement characters) and content hash."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", "length", F.decode("content", "UTF-8").alias("full_text"), F.md5("content").alias("hash"))


def pages_of(documents: DataFrame, text: str = "full_text") -> DataFrame:
    """doc_id, page_number (from 1) and raw_text, cut at form feeds."""
    return documents.select("doc_id", F.posexplode(F.split(text, "\f")).alias("_i", "raw_text")).select(
        "doc_id", (F.col("_i") + 1).alias("page_number"), "raw_text")


def append(df: DataFrame, path: str, batch: str, owner: str | None = None) -> None:
    """Add the rows of a batch to a stored table; a batch that is written again replaces itself. A row without its owner fails the job.

    Every batch has a folder of its own, so a lost run is repeated without doubling rows.
    """
    if owner is not None:
        df = df.withColumn(owner, F.when(F.col(owner).isNull(), F.raise_error(F.lit(f"a stored row needs its {owner}"))).otherwise(F.col(owner)))
    df.withColumn("batch_id", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows of an appended table with their batch_id."""
    return spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("string"))
