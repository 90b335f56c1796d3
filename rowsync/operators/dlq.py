"""Dead-letter queue life cycle as keyed DataFrame updates.

The DLQ is keyed by ``(sink, record_id)``. Every operation here is a join of
the current DLQ with a keyed change set and returns the new DLQ state; the
table layer appends that state as a new generation, so no file is edited in
place and a repeated batch produces the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["sink", "record_id"]
DLQ_COLUMNS = ["sink", "record_id", "version", "error", "batch_id", "mode", "attempts", "status", "updated_at"]


def dlq_upsert(dlq: DataFrame, rejects: DataFrame, sink: str, batch_id: str, mode: str, now: Column) -> DataFrame:
    """Upsert the rejects of one batch: a new key opens with attempts 1; a known
    key takes the new version/payload/error/batch/mode, attempts+1 and is
    reopened. Rejects are first reduced to one row per key (highest version).
    Full outer join on the key; the batch side is bounded by the batch."""
    r = (rejects.groupBy(F.col("id").alias("record_id"))
         .agg(F.max_by(F.struct("version", "error", *(["payload"] if "payload" in rejects.columns else [])),
                       F.col("version")).alias("_r"))
         .select(F.lit(sink).alias("sink"), "record_id", F.col("_r.version").alias("r_version"),
                 F.col("_r.error").alias("r_error"),
                 *( [F.col("_r.payload").alias("r_payload")] if "payload" in rejects.columns else [])))
    j = dlq.join(r, KEY, "full_outer")
    hit = F.col("r_version").isNotNull()
    known = F.col("status").isNotNull()
    out = j.select(
        "sink", "record_id",
        F.when(hit, F.col("r_version")).otherwise(F.col("version")).alias("version"),
        F.when(hit, F.col("r_error")).otherwise(F.col("error")).alias("error"),
        F.when(hit, F.lit(batch_id)).otherwise(F.col("batch_id")).alias("batch_id"),
        F.when(hit, F.lit(mode)).otherwise(F.col("mode")).alias("mode"),
        F.when(hit & known, F.col("attempts") + 1).when(hit, F.lit(1)).otherwise(F.col("attempts"))
         .cast("int").alias("attempts"),
        F.when(hit, F.lit("open")).otherwise(F.col("status")).alias("status"),
        F.when(hit, now).otherwise(F.col("updated_at")).alias("updated_at"),
        *([F.when(hit, F.col("r_payload")).otherwise(F.col("payload")).alias("payload")]
          if "payload" in dlq.columns and "payload" in rejects.columns else []),
    )
    return out


def _mark(dlq: DataFrame, ids: DataFrame, sink: str, only_open: bool, now: Column,
          id_col: str = "id") -> DataFrame:
    hits = (ids.select(F.col(id_col).alias("record_id")).distinct()
            .withColumn("sink", F.lit(sink)).withColumn("_hit", F.lit(True)))
    j = dlq.join(hits, KEY, "left")
    cond = F.col("_hit").isNotNull() & ((F.col("status") == "open") if only_open else F.lit(True))
    j = j.withColumn("_hit", cond)
    return (j.withColumn("status", F.when(F.col("_hit"), F.lit("resolved")).otherwise(F.col("status")))
             .withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
             .drop("_hit"))


def auto_resolve(dlq: DataFrame, written: DataFrame, sink: str, now: Column, id_col: str = "id") -> DataFrame:
    """Open entries whose id was just written (ok or duplicate) become resolved.
    Always a join (no cached 'DLQ is empty' shortcut that a restart resets)."""
    return _mark(dlq, written, sink, True, now, id_col)


def dlq_resolve(dlq: DataFrame, ids: DataFrame, sink: str, now: Column, id_col: str = "id") -> DataFrame:
    """Set resolved for the given ids, whatever their status (touches updated_at)."""
    return _mark(dlq, ids, sink, False, now, id_col)


def dlq_bump(dlq: DataFrame, failures: DataFrame, sink: str, now: Column) -> DataFrame:
    """attempts+1 and the new error for ids rejected again (status unchanged)."""
    f = (failures.groupBy(F.col("id").alias("record_id")).agg(F.max("error").alias("_err"))
         .withColumn("sink", F.lit(sink)))
    j = dlq.join(f, KEY, "left")
    hit = F.col("_err").isNotNull()
    return (j.withColumn("attempts", F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int"))
             .withColumn("error", F.when(hit, F.col("_err")).otherwise(F.col("error")))
             .withColumn("updated_at", F.when(hit, now).otherwise(F.col("updated_at")))
             .drop("_err"))


def filter_open(dlq: DataFrame, sink: str = "es") -> DataFrame:
    return dlq.where((F.col("sink") == sink) & (F.col("status") == "open"))


def dlq_counts(dlq: DataFrame, sinks=("es", "rabbitmq")) -> DataFrame:
    """Open entries per sink, zero-filled for the known sinks (one row, one
    column per sink): a pivot over the fixed sink list, no literal table."""
    p = dlq.where(F.col("status") == "open").groupBy().pivot("sink", list(sinks)).count()
    return p.select(*[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(s) for s in sinks])


def dlq_list(dlq: DataFrame, status: str = "open", limit: int = 100) -> DataFrame:
    """Entries with a status, newest first (record id breaks ties), top ``limit``."""
    return (dlq.where(F.col("status") == status)
            .orderBy(F.col("updated_at").desc(), F.col("record_id").asc()).limit(limit))


def dlq_open_ids(dlq: DataFrame, sink: str = "es") -> DataFrame:
    return filter_open(dlq, sink).select("record_id").orderBy("record_id")


def replay_missing(requested: DataFrame, products: DataFrame, id_col: str = "record_id") -> DataFrame:
    """Requested ids with no source row (requested minus found)."""
    return requested.select(F.col(id_col).alias("id")).distinct().join(products.select("id"), "id", "left_anti")
