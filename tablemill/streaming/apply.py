"""Fitted operators on a stream: the same projections as on a batch, no state and no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemill.session import work_path


def read_stream(spark: SparkSession, folder: str, name_filter: str | None = None, schema=None) -> DataFrame:
    """Parquet files of a folder as a stream, in bounded micro-batches."""
    if schema is None:
        schema = spark.read.parquet(f"{folder}/{name_filter or ''}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.parquet(folder)


def apply_to_stream(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], target: str | None = None,
                    checkpoint: str | None = None) -> DataFrame:
    """Run ``transform`` over everything available and return what was written.

    Progress lives in the checkpoint folder, so a restarted run goes on where the last one stopped and
    the file sink writes each batch once.
    """
    spark = stream.sparkSession
    target = target or work_path(spark, "stream")
    checkpoint = checkpoint or work_path(spark, "progress")
    out = transform(stream)
    run = (out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
           .outputMode("append").trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(target)
