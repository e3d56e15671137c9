"""Measurements as a stream: the stateless operators work unchanged; per-document rules run on each micro-batch.

A document's rows must arrive in one micro-batch (a file for each document or more), as reports do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from biolab.operators import validate
from biolab.operators.resolve import parsed, resolve

SCHEMA = "doc_id long, ord int, patient_id long, date date, raw_name string, raw_value string, raw_unit string"


def read(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def numbers(stream: DataFrame) -> DataFrame:
    return parsed(stream)


def daily(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """(day, raw_name, n, mean): counts by day of the report; late rows are waited for as long as ``late`` says."""
    p = parsed(stream).withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    return p.groupBy(F.window("at", "1 day").alias("w"), "raw_name").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").cast("date").alias("day"), "raw_name", "n", "mean")


def write_status(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes every document's status under a folder for its micro-batch, so a repeated batch replaces itself."""

    def batch(df: DataFrame, epoch: int) -> None:
        validate.document_status(resolve(parsed(df))).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
