"""Incremental feature ingestion with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import naming
from cuesheet.operators import merging
from cuesheet.sources import tables


def stream_files(spark: SparkSession, base: str, glob: str = "*.{srt,ass}", encoding: str = "UTF-8") -> DataFrame:
    """New subtitle files as they appear: ``(path, content)``."""
    return (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(base)
        .select(naming.decoded_path(F.col("path")).alias("path"), F.decode("content", encoding).alias("content"))
    )


def ingest(source: DataFrame, features: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
           key: str = "doc_id") -> None:
    """Process everything that is available, then stop. Running it again adds only what is new.

    Every batch goes to its own folder below ``out`` and replaces it when the batch is repeated after a failure, and
    ids in earlier batches are left out, so each id is written exactly once.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = features(batch)
        earlier = tables.read_if_exists(spark, out, f"{key} {dict(rows.dtypes)[key]}, batch bigint").where(F.col("batch") < batch_id)
        merging.not_yet_done(rows, earlier, key).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
