"""The event consumer as a Structured Streaming query over the published
stream: parse -> first delivery per event id -> insert if absent into the
event store -> malformed deliveries to the consumer DLQ (keyed by batch).
A failed store write fails the micro-batch; nothing is committed and the
engine re-runs it; the anti join absorbs what the failed attempt stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.events import parse_event
from ..operators.events import dedupe_first
from ..session import fits_broadcast
from ..sinks.tables import Tables
from .incremental import query_id

DELIVERY_SCHEMA = "delivery_id long, message_id string, body string"


def stream_deliveries(spark: SparkSession, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(DELIVERY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.parquet(folder)


def consume_batch(tables: Tables, deliveries: DataFrame, batch_id: str, consumed_at) -> None:
    """One consumer flush: store what is new, quarantine what is malformed. The
    flush's event ids are measured (text of any length) before a broadcast."""
    parsed = parse_event(deliveries).persist()
    try:
        good = parsed.where(F.col("error").isNull())
        first = dedupe_first(good.select("event_id", "delivery_id", "message_id", "product_id", "op", "version",
                                         F.col("body").alias("payload")),
                             order=["delivery_id", "message_id"])
        rows = first.select("event_id", "product_id", "op", "version", "payload",
                            consumed_at.alias("consumed_at"))
        size = good.agg(F.count(F.lit(1)), F.sum(F.octet_length("event_id"))).first()
        stored = tables.append_events(rows, small=fits_broadcast(*size), n_rows=size[0])
        bad = parsed.where(F.col("error").isNotNull()).select(
            F.coalesce(F.col("message_id"), F.lit("?")).alias("event_id"),
            F.to_json(F.struct(F.col("body").alias("raw"))).alias("payload"), "error",
            consumed_at.alias("created_at"))
        tables.clear("consumer_dlq", batch_id=batch_id)  # a re-run replaces its rows, also by none
        malformed = tables.write_consumer_dlq(bad, batch_id)
        # a re-run of the batch replaces its counters: it stores what the failed one left
        tables.write_counters("consumer", "consumer", batch_id, 1, {
            "received": size[0] + malformed, "malformed": malformed, "stored": stored, "duplicates": size[0] - stored})
    finally:
        parsed.unpersist()


def run_consumer(spark: SparkSession, tables: Tables, folder: str | None, checkpoint: str, consumed_at,
                 max_files_per_trigger: int | None = None, fail_epoch: dict | None = None):
    """Consume what is there and stop: the deliveries under ``folder``, or without one
    the stream that the jobs published into ``tables``."""
    def apply(df: DataFrame, epoch_id: int) -> None:
        # read once, into the parsed rows that the batch keeps
        consume_batch(tables, df, f"c-{query_id(df.sparkSession, checkpoint)}-{epoch_id}", consumed_at)
        if fail_epoch and fail_epoch.get("epoch") == epoch_id and fail_epoch.get("left", 0) > 0:
            fail_epoch["left"] -= 1
            raise RuntimeError("injected failure before ack")
    stream = (tables.stream_messages(max_files_per_trigger) if folder is None
              else stream_deliveries(spark, folder, max_files_per_trigger))
    q = (stream.select("delivery_id", "message_id", "body").writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q
