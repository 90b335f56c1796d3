"""Per-item sink outcomes: flattening, classification, routing and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACTION = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("error", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("caused_by", T.StructType([
            T.StructField("type", T.StringType()),
            T.StructField("reason", T.StringType())])),
    ])),
])
BULK_RESPONSE = T.ArrayType(T.StructType([
    T.StructField(a, _ACTION) for a in ("index", "create", "update", "delete")]))


def flatten_bulk(raw: DataFrame, col: str = "items") -> DataFrame:
    """Nested bulk response (JSON array text) -> ``(id, status, error)`` rows.
    Action = first of index/create/update/delete; error text
    ``type: reason (cause type: cause reason)``."""
    items = raw.select(F.explode(F.from_json(F.col(col), BULK_RESPONSE)).alias("w"))
    a = F.coalesce(F.col("w.index"), F.col("w.create"), F.col("w.update"), F.col("w.delete"))
    items = items.select(a.alias("a"))
    e = F.col("a.error")
    cause = F.when(F.col("a.error.caused_by").isNotNull(),
                   F.concat(F.lit(" ("), F.col("a.error.caused_by.type"), F.lit(": "),
                            F.col("a.error.caused_by.reason"), F.lit(")"))).otherwise(F.lit(""))
    err = F.when(e.isNotNull(), F.concat(F.col("a.error.type"), F.lit(": "), F.col("a.error.reason"), cause))
    return items.select(F.col("a._id").try_cast("long").alias("id"), F.col("a.status").alias("status"),
                        err.alias("error"))


def classify_outcomes(items: DataFrame, status: str = "status", error: str = "error") -> DataFrame:
    """2xx ok · 409 duplicate · 429 or >=500 retry · anything else dlq (also
    1xx/3xx and a missing status). A dlq item without error text gets
    ``http <status>`` (``http null`` when the status is missing)."""
    s = F.col(status)
    outcome = (F.when((s >= 200) & (s < 300), "ok")
               .when(s == 409, "duplicate")
               .when((s == 429) | (s >= 500), "retry")
               .otherwise("dlq"))
    default = F.concat(F.lit("http "), F.coalesce(s.cast("string"), F.lit("null")))
    err = F.when(outcome == "dlq", F.coalesce(F.col(error), default)).otherwise(F.col(error))
    return items.withColumn("outcome", outcome).withColumn(error, err)


def route_outcomes(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Split one (persisted) outcome DataFrame into the four routes. The caller
    persists once; the four filters reuse it instead of recomputing the batch."""
    return {o: outcomes.where(F.col("outcome") == o) for o in ("ok", "duplicate", "retry", "dlq")}


def batch_summary(outcomes: DataFrame, keys=("mode", "batch_id")) -> DataFrame:
    """written / duplicates / dlq / retry / attempts per batch."""
    o = F.col("outcome")
    attempt = F.col("attempt") if "attempt" in outcomes.columns else F.lit(1)
    return outcomes.groupBy(*keys).agg(
        F.count_if(o == "ok").alias("written"),
        F.count_if(o == "duplicate").alias("duplicates"),
        F.count_if(o == "dlq").alias("dlq"),
        F.count_if(o == "retry").alias("retry"),
        F.max(attempt).cast("long").alias("attempts"),
    )


def sink_totals(outcomes: DataFrame) -> DataFrame:
    """Counters by sink and mode from the durable outcome table (they survive
    restarts): records written (ok for documents; every event for the stream),
    duplicates absorbed, dlq items, batches committed."""
    o = F.col("outcome")
    return outcomes.groupBy("sink", "mode").agg(
        F.count_if(o == "ok").alias("written"),
        F.count_if(o == "duplicate").alias("duplicates"),
        F.count_if(o == "dlq").alias("dlq"),
        F.count_distinct("batch_id").alias("batches"),
    )


def written_ids(outcomes: DataFrame, key: str = "id") -> DataFrame:
    """ok ∪ duplicate: ids the sink holds at this version or newer (both resolve DLQ entries)."""
    return outcomes.where(F.col("outcome").isin("ok", "duplicate")).select(key).distinct()
