"""Deriving the change log and current rows from source writes (the trigger rules).

Rules of the source: an INSERT logs ``insert`` with version 1; every UPDATE
bumps the version by one and logs ``delete`` when ``deleted_at`` goes from
null to set, otherwise ``update`` (a restore or touching a deleted row is an
``update``). Deletes are soft: the row stays with ``deleted_at`` set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import DEFAULT_RANGE_WIDTH, running_sums


def mutations_from_events(events: DataFrame, width: int = DEFAULT_RANGE_WIDTH) -> DataFrame:
    """One source write per ``events`` row: first write of a user's row is the
    insert, ``error`` soft-deletes, ``signup`` restores, anything else touches.
    Keys and sequence numbers start at 1 (cursors are exclusive and start at 0)."""
    m = events.select(
        (F.col("event_id") + 1).alias("seq"),
        (F.col("user_id") + 1).alias("product_id"),
        F.col("ts").alias("changed_at"),
        "event_type",
    )
    m = running_sums(m, ["product_id"], "seq", {"version": F.lit(1)}, width)
    kind = (F.when(F.col("version") == 1, "insert")
            .when(F.col("event_type") == "error", "soft_delete")
            .when(F.col("event_type") == "signup", "restore")
            .otherwise("touch"))
    return m.select("seq", "product_id", "changed_at", "version", kind.alias("kind"))


def writes_with_op(mutations: DataFrame, width: int = DEFAULT_RANGE_WIDTH) -> DataFrame:
    """Ordered writes ``(seq, product_id, changed_at, version, kind)`` with the ``op``
    each one logs.

    A soft delete is a ``delete`` only when the row was live before it, i.e. it
    is the first soft delete since the last restore ("era" = restores so far).
    Both counts are skew-proof running sums, not one window per key."""
    m = running_sums(mutations, ["product_id"], "seq",
                     {"_era": (F.col("kind") == "restore").cast("int")}, width)
    m = running_sums(m, ["product_id", "_era"], "seq",
                     {"_sd_n": (F.col("kind") == "soft_delete").cast("int")}, width)
    op = (F.when(F.col("kind") == "insert", "insert")
          .when((F.col("kind") == "soft_delete") & (F.col("_sd_n") == 1), "delete")
          .otherwise("update"))
    return m.select("seq", "product_id", op.alias("op"), "version", "changed_at", "kind")


def derive_changes(mutations: DataFrame, width: int = DEFAULT_RANGE_WIDTH) -> DataFrame:
    """The change-log rows of ordered writes."""
    return writes_with_op(mutations, width).drop("kind")


def mutation_state(writes: DataFrame) -> DataFrame:
    """Per-row aggregate of all writes (with their op): last version and time,
    touches, last delete / restore positions. One partial+final aggregate keyed
    by id (hot ids are combined map-side before the shuffle), no join."""
    return writes.groupBy("product_id").agg(
        F.max("version").alias("m_version"),
        F.max("changed_at").alias("m_updated_at"),
        F.sum((F.col("kind") == "touch").cast("long")).alias("touches"),
        F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("last_delete_seq"),
        F.max(F.when(F.col("kind") == "restore", F.col("seq"))).alias("last_restore_seq"),
        F.max(F.when(F.col("op") == "delete", F.col("changed_at"))).alias("m_deleted_at"),
    )


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "id",
                  compare: list[str] | None = None) -> DataFrame:
    """Change rows from two snapshots (no triggers): full outer join on the key,
    null-safe comparison of the payload columns.

    new only -> insert; both and deleted_at null -> set -> delete; both and any
    compared column differs -> update; old only -> gone (hard delete, which the
    source never does but a snapshot can show)."""
    cols = compare or [c for c in new.columns if c != key]
    o = old.select(key, *[F.col(c).alias(f"o_{c}") for c in cols])
    n = new.select(key, *[F.col(c).alias(f"n_{c}") for c in cols])
    in_old = F.col("_in_old")
    in_new = F.col("_in_new")
    j = (o.withColumn("_in_old", F.lit(True))
         .join(n.withColumn("_in_new", F.lit(True)), key, "full_outer"))
    changed = None
    for c in cols:
        d = ~F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
        changed = d if changed is None else (changed | d)
    has_deleted = "deleted_at" in cols
    became_deleted = (F.col("o_deleted_at").isNull() & F.col("n_deleted_at").isNotNull()) if has_deleted else F.lit(False)
    op = (F.when(in_old.isNull(), "insert")
          .when(in_new.isNull(), "gone")
          .when(became_deleted, "delete")
          .when(changed, "update"))
    out = j.select(key, op.alias("op"), *[F.col(f"n_{c}").alias(c) for c in cols])
    return out.where(F.col("op").isNotNull())
