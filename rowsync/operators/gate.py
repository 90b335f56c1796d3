"""The version gate: accept a document iff its version is strictly higher than
the stored one (equal = replay, older = stale; both count as duplicates)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gate_join(batch: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Batch left join current documents on the key; adds ``doc_version``."""
    d = docs.select(key, F.col("version").alias("doc_version"))
    return batch.join(d, key, "left")


def gate_outcomes(batch: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """Per-record outcome of writing ``batch`` (rows with ``version`` and a
    validation ``error``) over ``docs``: dlq (parse failure, reported before a
    version conflict), ok (new or higher version), duplicate (replay / stale)."""
    j = gate_join(batch, docs, key)
    v, dv = F.col("version"), F.col("doc_version")
    outcome = (F.when(F.col("error").isNotNull(), "dlq")
               .when(dv.isNull() | (v > dv), "ok")
               .otherwise("duplicate"))
    reason = (F.when(F.col("error").isNotNull(), "rejected")
              .when(dv.isNull(), "new")
              .when(v > dv, "newer")
              .when(v == dv, "replay")
              .otherwise("stale"))
    return j.withColumn("outcome", outcome).withColumn("reason", reason)


def current_state(docs_log: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Highest version wins: one row per key from an append-only document log.
    Commutative and idempotent, so write order and replays do not matter.
    ``max_by`` is combined map-side before the shuffle."""
    cols = [c for c in docs_log.columns if c != key]
    best = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(version))
    return docs_log.groupBy(key).agg(best.alias("_d")).select(key, *[F.col(f"_d.{c}").alias(c) for c in cols])
