"""Incremental, exactly-once conversion of arriving files into a Parquet table.

This is the chunked JSON -> table conversion of the source notebook done as
a streaming query: each micro-batch reads the new files (at most ``max_files``,
if given), appends them to the target table, and the checkpoint records progress, so a
restarted or failed job resumes without duplicates or gaps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from starlens.session import scratch_path


def ingest_stream(spark: SparkSession, source_path: str, target_path: str, schema: T.StructType | str,
                  fmt: str = "json", checkpoint: str | None = None, max_files: int | None = None,
                  partition_by=None, available_now: bool = True):
    """Start the ingest; returns the StreamingQuery (``availableNow`` drains
    everything present and stops)."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if fmt == "json":
        reader = reader.option("mode", "PERMISSIVE")
    src = reader.format(fmt).load(source_path)
    w = (src.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint or scratch_path(spark, f"ingest-ckpt-{uuid.uuid4().hex}")))
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start(target_path)


def ingest_and_read(spark: SparkSession, source_path: str, schema, fmt: str = "parquet",
                    max_files: int | None = None) -> DataFrame:
    """Run an ingest to completion into a fresh table under the shared
    checkpoint folder and return the table."""
    run = uuid.uuid4().hex
    target = scratch_path(spark, f"ingest-{run}")
    q = ingest_stream(spark, source_path, target, schema, fmt=fmt,
                      checkpoint=scratch_path(spark, f"ingest-ckpt-{run}"), max_files=max_files)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.schema(schema).parquet(target)
