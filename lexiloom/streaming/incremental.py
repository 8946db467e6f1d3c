"""Incremental runs: files that came since the last run are processed once, with a checkpoint in place of lists of outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_new_files(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Appends transform(new Parquet files below source) to sink; a run that is stopped goes on where it was, and each file counts once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").parquet(source)
    query = transform(rows).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_batches(spark: SparkSession, source: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 1000) -> None:
    """handle(batch, number) for new files; a batch may come again after a failure, so handle must replace by number."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its number, replacing what a failed attempt left."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def new_keys(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def source_file(rows: DataFrame) -> DataFrame:
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), "([^/]+)$", 1))
