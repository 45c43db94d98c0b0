"""The polling jobs as streams over append-only folders.

Each returns a started query that handles what is available and stops. State
lives in the target folders and the query's checkpoint, so a lost executor or
a restart repeats a batch without harm: every batch is written under its own
id, and a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papertally.operators.merge import sync_delivery
from papertally.operators.review import last_feedback


def _each_batch(
    source: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        handle(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_delivery(spark: SparkSession, queue_folder: str, log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """New mail-queue rows (name, status) applied to the share log; each batch
    writes the log rows it settles."""
    schema = "name string, status string"
    source = spark.readStream.schema(schema).parquet(queue_folder)

    def settle(batch: DataFrame) -> DataFrame:
        synced = sync_delivery(log, batch)
        return synced.where("log_status IN ('Success', 'Failed')").join(
            batch.select(batch["name"].alias("email_queue")), "email_queue", "left_semi"
        )

    return _each_batch(source, settle, out, checkpoint)


def stream_run_totals(spark: SparkSession, call_folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Partial totals per run and batch; summing them gives the run totals."""
    schema = "run string, total_tokens bigint, cost_usd double, cost_estimated int"
    source = spark.readStream.schema(schema).parquet(call_folder)

    return _each_batch(source, _totals, out, checkpoint)


def _totals(batch: DataFrame) -> DataFrame:
    return batch.groupBy("run").agg(
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
        F.max("cost_estimated").alias("cost_estimated"),
    )


def stream_feedback(spark: SparkSession, event_folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """The last verdict per field and batch, ``clear`` too. Events of one field may
    come in several batches: ``feedback_fold`` over all results gives what stands.
    Added values are not part of it."""
    schema = "doc string, field string, idx int, verdict string, value string, by string, at timestamp, seq bigint"
    source = spark.readStream.schema(schema).parquet(event_folder)
    return _each_batch(source, last_feedback, out, checkpoint)
