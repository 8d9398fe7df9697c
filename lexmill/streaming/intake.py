"""Incremental intake: new files are hashed, de-duplicated per owner and cut into clauses batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segment


def uploads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of upload rows (doc_id, user_id, full_text) from a folder of parquet files."""
    return spark.readStream.schema(schema).parquet(path)


def first_uploads(stream: DataFrame) -> DataFrame:
    """The first upload of each content hash and owner; later copies are dropped by stream state."""
    return stream.withColumn("hash", F.md5("full_text")).dropDuplicates(["hash", "user_id"])


def clause_writer(target: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink; a batch owns one folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        clauses = segment.identify_clauses(batch.select("doc_id", "full_text"))
        clauses.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")
    return write


def start(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    return (first_uploads(stream).writeStream.foreachBatch(clause_writer(target))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
