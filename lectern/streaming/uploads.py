"""Chunked uploads as a stream: each micro-batch is merged into the staged rows.

An analogue of the bank's import job, which takes batches that may be sent
twice: the last write of a (job, position) wins, whatever the batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.merge import last_write

ITEM = "job string, position int, sent_at timestamp, stem string, answer string"


def stage_uploads(spark: SparkSession, source: str, staged: str, checkpoint: str):
    """Append the JSON files under ``source`` that are new to ``staged``, and return the finished query.

    Each micro-batch is written under its own number, so a batch that is run
    again after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staged}/batch={number}")

    stream = spark.readStream.schema(ITEM).json(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def staged_rows(spark: SparkSession, staged: str) -> DataFrame:
    """One row per job and position: the last sent."""
    rows = spark.read.parquet(staged)
    return last_write(rows, ["job", "position"], F.desc("sent_at"), F.desc("batch")).drop("batch")
