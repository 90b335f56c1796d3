"""Collapsing a page of changes and joining it to the current source rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PRODUCT_COLUMNS


def collapse_changes(changes: DataFrame, key: str = "product_id", order: str = "seq") -> DataFrame:
    """Many changes of one id -> one row; the last op by ``seq`` wins.

    ``max_by`` is a partial+final aggregate, so a hot id is combined map-side
    before the shuffle (never a per-key window)."""
    last = F.max_by(F.struct(F.col("op"), F.col("version"), F.col(order)), F.col(order))
    return (changes.groupBy(key)
            .agg(last.alias("_last"), F.count(F.lit(1)).alias("n_changes"))
            .select(F.col(key), F.col("_last.op").alias("op"),
                    F.col("_last.version").alias("change_version"),
                    F.col(f"_last.{order}").alias("last_seq"), "n_changes"))


def join_changes_current(collapsed: DataFrame, products: DataFrame, key: str = "id",
                         change_key: str = "product_id", broadcast_page: bool = False,
                         op_from: str = "page", changes: DataFrame | None = None) -> DataFrame:
    """Collapsed changes joined to the *current* row: ids missing at the source
    drop out. The row and event id come from the current row; the op comes from
    the page (``op_from='page'``, compatible) or, with ``op_from='version'``, from
    the change whose version equals the current row's (update when absent).

    A page is bounded by the batch size, so it may be broadcast; a whole-log
    pass is not, and AQE chooses the join from runtime sizes."""
    c = collapsed.select(F.col(change_key).alias(key), "op")
    if broadcast_page:
        c = F.broadcast(c)
    j = products.join(c, key, "inner")
    if op_from == "version":
        assert changes is not None
        v = changes.select(F.col(change_key).alias(key), "version", F.col("op").alias("_vop"))
        j = (j.join(v, [key, "version"], "left")
             .withColumn("op", F.coalesce(F.col("_vop"), F.lit("update"))).drop("_vop"))
    return j.select(*[c for c in PRODUCT_COLUMNS if c in products.columns], "op")
