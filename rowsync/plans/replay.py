"""DLQ replay and item retry as batch jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.validate import validate_strict
from ..operators.dlq import replay_missing
from ..operators.gate import gate_outcomes
from ..operators.outcomes import classify_outcomes
from ..session import fits_broadcast
from ..sinks.tables import Tables
from ..sources.changes import lookup_by_ids
from .batch_writer import _touched_log


def dlq_replay(tables: Tables, products: DataFrame, as_of: Column, batch_id: str | None = None,
               ids: DataFrame | None = None) -> DataFrame:
    """Replay DLQ entries of the document sink in one pass (no 500-row chunks):
    requested ids (empty/None = all open) -> **current** source rows ->
    validate -> version gate -> documents. ok or duplicate -> resolved;
    rejected again -> attempts+1 with the new error (entry stays open); id gone
    from the source -> resolved. Writes only the document sink. Returns one
    row ``replayed, resolved, failed``.

    Each call is a batch of its own, so a replay never replaces another one's
    rows; ``batch_id`` names it to repeat a replay that was stopped."""
    spark = products.sparkSession
    batch_id = batch_id or f"replay-{uuid.uuid4().hex}"
    log_batch = f"replay-{batch_id}"
    attempt = tables.begin_attempt("replay", batch_id, as_of)
    if attempt.number > 1:
        tables.clear("docs", mode="replay", batch_id=batch_id)
        tables.clear("outcomes", mode="replay", batch_id=batch_id)
        tables.clear("dlq", log_batch=log_batch)
    # its own rows are excluded: a write refreshes cached frames over its path
    dlq = tables.dlq(exclude_log_batch=log_batch)
    req = (ids.select(F.col(ids.columns[0]).alias("record_id")) if ids is not None
           else dlq.where((F.col("sink") == "es") & (F.col("status") == "open")).select("record_id")).distinct()
    req = req.persist()
    out = None
    try:
        n = req.count()  # fills the cache; a bounded request probes the stored documents in place
        current = lookup_by_ids(products, req, id_col="record_id").withColumn("op", F.lit("update"))
        batch = validate_strict(current).withColumn("batch_id", F.lit(batch_id))
        exclude = (F.col("mode") == "replay") & (F.col("batch_id") == batch_id)
        stored = _touched_log(tables, batch, exclude, small=fits_broadcast(n)).groupBy("id").agg(F.max("version").alias("version"))
        out = gate_outcomes(batch, stored).persist()
        gone = replay_missing(req, products)
        tables.write_docs(out.where(F.col("outcome") == "ok"), "replay", batch_id)
        none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
        resolved = out.where(F.col("outcome").isin("ok", "duplicate")).select(
            F.col("id").alias("record_id"), "version", none_s.alias("error"), F.lit("resolve").alias("kind"))
        gone_rows = gone.select(F.col("id").alias("record_id"), F.lit(None).cast("long").alias("version"),
                                none_s.alias("error"), F.lit("resolve").alias("kind"))
        bumped = out.where(F.col("outcome") == "dlq").select(
            F.col("id").alias("record_id"), "version", "error", F.lit("bump").alias("kind"))
        rows = resolved.unionByName(gone_rows).unionByName(bumped).select(
            F.lit("es").alias("sink"), "record_id", "version", none_s.alias("payload"), "error",
            F.lit(batch_id).alias("batch_id"), F.lit("replay").alias("mode"), "kind", none_i.alias("attempts"),
            F.when(F.col("kind") == "resolve", "resolved").otherwise("open").alias("status"),
            as_of.alias("updated_at"))
        tables.write_dlq_rows(rows, log_batch, attempt.commit_seq)
        counts = tables.write_outcomes(out.select(
            F.lit("replay").alias("mode"), F.lit(batch_id).alias("batch_id"), F.lit("es").alias("sink"), "id",
            "version", "outcome", "reason", "error", F.lit(attempt.number).alias("attempt")))
        tables.write_counters("writer", "replay", batch_id, attempt.number, counts)
        ok, failed = counts["ok"] + counts["duplicate"], counts["dlq"]
        n_gone = gone.count()
        return spark.range(0, 1, 1, 1).select(F.lit(n).cast("long").alias("replayed"),
                                              F.lit(ok + n_gone).cast("long").alias("resolved"),
                                              F.lit(failed).cast("long").alias("failed"))
    finally:
        req.unpersist()
        if out is not None:
            out.unpersist()


def item_retry(first: DataFrame, respond: Callable[[DataFrame, int], DataFrame], max_attempts: int = 5) -> DataFrame:
    """Per-item retry for a fallible sink: items answered 429/5xx are sent again
    alone until none is left (or ``max_attempts``); the rest of the batch
    stands. ``first`` holds (id, status, error) of attempt 1; ``respond(pending,
    k)`` returns the sink's (id, status, error) for attempt k. Each attempt is
    one Spark job over the pending items only; the loop is bounded by
    ``max_attempts``. Items still failing at the end stay ``retry``."""
    out = None
    pending = classify_outcomes(first).withColumn("attempt", F.lit(1))
    for k in range(1, max_attempts + 1):
        if k > 1:
            pending = classify_outcomes(respond(pending.select("id"), k)).withColumn("attempt", F.lit(k))
        pending = pending.persist()
        final = pending.where(F.col("outcome") != "retry") if k < max_attempts else pending
        out = final if out is None else out.unionByName(final)
        pending = pending.where(F.col("outcome") == "retry")
        if k < max_attempts and pending.isEmpty():
            break
    return out
