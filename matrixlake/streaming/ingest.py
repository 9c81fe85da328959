"""Incremental ingest: coordinates that land in a folder are checked and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from matrixlake.operators.counts import sum_duplicates, to_rows, validate_counts
from matrixlake.schema import COO


def append_batch(path: str):
    """A batch's cells must be complete; a batch that fails its check stops the stream and leaves nothing of itself."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = to_rows(validate_counts(sum_duplicates(batch))).withColumnRenamed("row", "global_row_index")
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")  # a batch that is run again replaces itself

    return run


def ingest(spark: SparkSession, landing: str, path: str, checkpoint: str, files_per_batch: int = 64, once: bool = True) -> StreamingQuery:
    stream = spark.readStream.schema(COO).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    writer = stream.writeStream.foreachBatch(append_batch(path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
