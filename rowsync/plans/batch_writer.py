"""One batch to both sinks (the unit every job repeats).

``write_batch`` takes the current rows of a batch (with their op), persists
them once, and then: validates, gates against the stored documents, writes
the accepted documents, publishes one event per row (rejected rows too),
quarantines rejects and resolves open DLQ entries that were written, records
the per-record outcomes. Every write is idempotent per batch id, so a batch
repeated after a crash converges to the same state and its replay is counted.
The caller commits its progress only after this returns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.events import to_event
from ..functions.validate import validate_strict
from ..operators.gate import gate_outcomes
from ..schemas import PRODUCT_COLUMNS
from ..sinks.tables import Tables, bucket_of


class InjectedCrash(RuntimeError):
    """Raised by tests at a chosen point of a batch (after a sink wrote)."""


def _touched_log(tables: Tables, batch: DataFrame, exclude: Column, small: bool,
                 key_range: tuple[int, int] | None = None) -> DataFrame:
    """Stored documents of the batch's ids only. A key-range batch (a backfill
    wave) pushes ``lo < id <= hi`` into the log scan. A bounded page broadcasts
    its (bucket, id) pairs into a semi join: the bucket-partitioned base is
    pruned by bucket and the log is probed in place. Otherwise the log is
    aggregated per id and AQE picks the join. The batch's own rows are excluded:
    a write refreshes cached frames over the same path, and the gate output
    must stay what it was before the batch wrote its documents."""
    log = tables.doc_log().where(~exclude)
    if key_range is not None:
        lo, hi = key_range
        log = log.where((F.col("id") > lo) & (F.col("id") <= hi))
    if small:
        ids = F.broadcast(batch.select("id", bucket_of(F.col("id"), tables.buckets).alias("bucket")).distinct())
        log = log.join(ids, ["bucket", "id"], "left_semi")
    return log.select("id", "version")


def write_batch(tables: Tables, rows: DataFrame, mode: str, batch_id: str, as_of: Column,
                batch_col: str | None = None, small: bool = False, crash_at: str | None = None,
                key_range: tuple[int, int] | None = None) -> DataFrame:
    """Write one batch to both sinks; returns its outcome rows.

    ``rows`` are current source rows with an ``op`` column. ``as_of`` is the
    batch time (event ``emitted_at``, DLQ ``updated_at``): an argument, so a
    replay produces the same rows. ``small``: the caller measured the batch's ids
    (``session.fits_broadcast``), they may be broadcast. For a backfill wave, ``batch_id`` names the
    wave and ``batch_col`` the per-row key-range batch id: the wave is the partition that a
    repeat replaces and is judged without, the range is kept with each outcome and entry."""
    bid = F.lit(batch_id) if batch_col is None else F.col(batch_col)
    log_batch = f"{mode}-{batch_id}"
    attempt = tables.begin_attempt(mode, batch_id, as_of)
    if attempt.number > 1:
        # an overwrite by nothing leaves a partition as it is: clear what the
        # earlier attempt wrote, so that this one replaces it also where it has no rows
        tables.clear("docs", mode=mode, batch_id=batch_id)
        tables.clear("outcomes", mode=mode, batch_id=batch_id)
        tables.clear("dlq", log_batch=log_batch)
    batch = validate_strict(rows).withColumn("batch_id", bid)
    out = None
    try:
        exclude = (F.col("mode") == mode) & (F.col("batch_id") == batch_id)
        stored = (_touched_log(tables, batch, exclude, small, key_range)
                  .groupBy("id").agg(F.max("version").alias("version")))
        # the gate output carries every batch column (left join): it is the
        # one persisted copy of the batch that all sinks read
        out = gate_outcomes(batch, stored).persist()

        # 1. documents: accepted rows into the batch's own partition
        tables.write_docs(out.where(F.col("outcome") == "ok"), mode, batch_id)
        if crash_at == "after_docs":
            raise InjectedCrash("after_docs")

        # 2. stream: one event per row, rejected rows included
        ev = to_event(out, emitted_at=as_of).select("event_id", "product_id", "op", "version", "product",
                                                      "emitted_at")
        published = tables.publish(ev, batch_id, as_of, mode, attempt.number)
        if crash_at == "after_events":
            raise InjectedCrash("after_events")

        # 3. DLQ: rejects upserted, written ids resolve their open entries
        payload = F.to_json(F.struct(*[F.col(c) for c in PRODUCT_COLUMNS if c in rows.columns]))
        rej = out.where(F.col("outcome") == "dlq").select(
            F.lit("es").alias("sink"), F.col("id").alias("record_id"), "version", payload.alias("payload"),
            "error", "batch_id", F.lit(mode).alias("mode"), F.lit("reject").alias("kind"),
            F.lit(None).cast("int").alias("attempts"), F.lit("open").alias("status"), as_of.alias("updated_at"))
        written = out.where(F.col("outcome").isin("ok", "duplicate")).select(F.col("id").alias("record_id"))
        if small:
            dlq_now = tables.dlq(log_batch, record_ids=F.broadcast(written.distinct()))
        else:
            dlq_now = tables.dlq(log_batch, id_range=key_range)
        open_ids = dlq_now.where((F.col("status") == "open") & (F.col("sink") == "es")).select("record_id")
        res = (out.where(F.col("outcome").isin("ok", "duplicate"))
               .select(F.col("id").alias("record_id"), "version", "batch_id")
               .join(open_ids, "record_id", "left_semi")
               .select(F.lit("es").alias("sink"), "record_id", "version", F.lit(None).cast("string").alias("payload"),
                       F.lit(None).cast("string").alias("error"), "batch_id", F.lit(mode).alias("mode"),
                       F.lit("resolve").alias("kind"), F.lit(None).cast("int").alias("attempts"),
                       F.lit("resolved").alias("status"), as_of.alias("updated_at")))
        tables.write_dlq_rows(rej.unionByName(res), log_batch, attempt.commit_seq)
        if crash_at == "after_dlq":
            raise InjectedCrash("after_dlq")

        # 4. outcomes (source of every counter), replaced per batch
        counts = tables.write_outcomes(out.select(
            F.lit(mode).alias("mode"), "batch_id", F.lit("es").alias("sink"), "id", "version", "outcome",
            "reason", "error", F.lit(attempt.number).alias("attempt")), wave=batch_id if batch_col is not None else None)
        tables.write_counters("writer", mode, batch_id, attempt.number, counts | {"published": published})
        if crash_at == "before_commit":
            raise InjectedCrash("before_commit")
        return tables.outcomes_of(mode, batch_id)
    finally:
        if out is not None:
            out.unpersist()
