"""Score newly arriving texts and append the results.

The reference grows a results file run after run.  Here documents arrive
as files in a folder (Structured Streaming file source); every micro-batch
is scored with the *static* trained token model by the same batch
operators (``foreachBatch``: inside it the batch is an ordinary
DataFrame, so per-document aggregation needs no streaming state), and the
scores are written to ``<sink>/batch_id=<n>``.  Re-running a batch after a
failure overwrites that batch's folder, so the sink is exactly-once with
the checkpointed offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def score_stream(spark: SparkSession, source_path: str, schema, sink: str, checkpoint: str,
                 score_batch: Callable[[DataFrame], DataFrame], files_per_trigger: int = 1,
                 available_now: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
              .parquet(source_path))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        (score_batch(batch).write.mode("overwrite")
         .parquet(f"{sink.rstrip('/')}/batch_id={batch_id}"))

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
