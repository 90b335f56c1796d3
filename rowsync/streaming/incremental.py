"""Continuous incremental replication as a Structured Streaming query.

The change log is a streaming source (files here; any source with the change
log schema works); the source offsets are the cursor. Each micro-batch is
collapsed to one row per id (last op by seq), joined to the *current* source
rows, and written to both sinks by ``write_batch``; Spark commits the offsets
only after ``foreachBatch`` returns, so a failed batch is re-run with the same
batch id and the same rows, and absorbed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.collapse import collapse_changes, join_changes_current
from ..plans.batch_writer import write_batch
from ..schemas import CHANGE_LOG
from ..session import fits_broadcast
from ..sinks.tables import Tables


def stream_change_log(spark: SparkSession, change_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The change log as a streaming DataFrame (schema fixed, no inference)."""
    r = spark.readStream.schema(CHANGE_LOG)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(change_dir)


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The streaming query's id: Spark makes it with the checkpoint and keeps it
    there over restarts, before the first batch runs."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def incremental_batch(tables: Tables, products_loader: Callable[[SparkSession], DataFrame],
                      checkpoint: str, op_from: str = "page", crash: dict | None = None):
    """The ``foreachBatch`` function: collapse -> current rows -> both sinks ->
    progress row (cursor = max seq of the page). Batch ids hold the query's
    durable id, so a query on a new checkpoint replaces no other one's batches."""
    def apply(df: DataFrame, epoch_id: int) -> None:
        spark = df.sparkSession
        page = df.persist()
        try:
            collapsed = collapse_changes(page)
            products = products_loader(spark)  # re-read: the source keeps changing
            # one pass over the page for four scalars; as_of becomes a literal, so
            # the writes below do not each run a scalar subquery over the page
            n, lo, hi, last_at = page.agg(F.count(F.lit(1)), F.min("product_id"), F.max("product_id"),
                                          F.max("changed_at").cast("string")).first()
            small = fits_broadcast(n)
            if lo is not None:
                # literal bounds reach the Parquet scan (row-group skipping on an
                # id-clustered source); a scalar subquery would not be pushed
                products = products.where(F.col("id").between(lo, hi))
            rows = join_changes_current(collapsed, products, broadcast_page=small, op_from=op_from, changes=page)
            as_of = F.lit(last_at).cast("timestamp_ntz")
            batch_id = f"inc-{query_id(spark, checkpoint)}-{epoch_id}"
            crash_at = None
            if crash and crash.get("epoch") == epoch_id and crash.get("left", 0) > 0:
                crash["left"] -= 1
                crash_at = crash["at"]
            write_batch(tables, rows, "incremental", batch_id, as_of, small=small, crash_at=crash_at)
            prog = page.agg(
                F.lit("incremental").alias("mode"), F.lit("incremental").alias("run_id"),
                F.lit(batch_id).alias("batch_id"), F.lit(None).cast("long").alias("range_id"),
                F.lit(None).cast("long").alias("last_id"), F.lit(None).cast("long").alias("target_max_id"),
                F.max("seq").alias("cursor_seq"), F.max("changed_at").alias("committed_at"))
            tables.commit_progress(prog.where(F.col("cursor_seq").isNotNull()), "incremental")
        finally:
            page.unpersist()
    return apply


def run_incremental(spark: SparkSession, tables: Tables, change_dir: str, checkpoint: str,
                    products_loader: Callable[[SparkSession], DataFrame],
                    max_files_per_trigger: int | None = None, op_from: str = "page",
                    crash: dict | None = None, available_now: bool = True, processing_time: str | None = None,
                    wait: bool = True):
    """Start (or resume from ``checkpoint``) the incremental query. With
    ``available_now`` it drains what is there and stops (tests, catch-up); without
    ``wait`` it runs beside what the caller does next."""
    stream = stream_change_log(spark, change_dir, max_files_per_trigger)
    w = (stream.writeStream.foreachBatch(incremental_batch(tables, products_loader, checkpoint, op_from, crash))
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "5 seconds")
    q = w.start()
    if available_now and wait:
        q.awaitTermination()
    return q
