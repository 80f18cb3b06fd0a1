"""Structured Streaming scorer (T1 as a stream, T2).

Requests arrive as files; each micro-batch is scored by the same batch
plan against the static estimate / forecast / metadata tables, restricted
to the 30 hours the batch can see, and written to a parquet sink.  The
query keeps no state of its own (the bounded as-of join is recomputed
per batch), so it needs no watermark; progress is kept in a checkpoint
folder under the shared location so a restarted query resumes where it
stopped.  Each micro-batch overwrites its own ``batch_id=N`` folder, so a
batch replayed after a failure replaces its earlier output instead of
duplicating it (exactly-once output).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from gatecast.plans.predict import score_requests
from gatecast.schemas import LABELS_SCHEMA
from gatecast.session import fresh_dir, remove_dir


FILE_ROWS = 1_000_000


def start_scoring_stream(spark: SparkSession, requests_dir: str, inputs: dict[str, DataFrame],
                         models: dict[tuple[str, str], PipelineModel], out_dir: str,
                         checkpoint_dir: str | None = None, files_per_trigger: int = 1,
                         available_now: bool = True):
    """Start the streaming query; returns the ``StreamingQuery``."""
    stream = (spark.readStream.schema(LABELS_SCHEMA)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(requests_dir))

    def score_batch(batch: DataFrame, batch_id: int) -> None:
        workdir = fresh_dir(spark, "stream-features")
        scored = score_requests(batch, inputs, models, workdir=workdir)
        scored.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")
        remove_dir(spark, workdir)

    w = (stream.writeStream.foreachBatch(score_batch)
         .option("checkpointLocation", checkpoint_dir or fresh_dir(spark, "stream-ckpt")))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def stream_score(spark: SparkSession, requests: DataFrame, inputs: dict[str, DataFrame],
                 models: dict[tuple[str, str], PipelineModel]) -> DataFrame:
    """Write ``requests`` as files of up to FILE_ROWS rows, two at least, stream them
    through the scorer until all are processed, and return the sink's contents."""
    req_dir = fresh_dir(spark, "stream-requests")
    files = max(2, -(-requests.count() // FILE_ROWS))
    requests.repartition(files).write.mode("overwrite").parquet(req_dir)
    out_dir = fresh_dir(spark, "stream-out")
    q = start_scoring_stream(spark, req_dir, inputs, models, out_dir)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(out_dir).drop("batch_id")
