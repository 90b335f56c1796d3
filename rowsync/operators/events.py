"""Event-store operators: in-batch dedupe, insert-if-absent, counts, reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_first(events: DataFrame, key: str = "event_id", order: str | list[str] = "delivery_id") -> DataFrame:
    """First delivery of each key wins (order kept by ``order``). ``min_by`` is
    a partial+final aggregate: a redelivered hot key is combined map-side.
    ``dropDuplicates`` would keep an arbitrary row, so it is not used here."""
    order_cols = [order] if isinstance(order, str) else list(order)
    rest = [c for c in events.columns if c != key]
    ordering = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), ordering)
    return events.groupBy(key).agg(first.alias("_f")).select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])


def anti_absent(batch: DataFrame, store: DataFrame, key: str = "event_id") -> DataFrame:
    """Batch rows whose key is not stored yet (the primary-key conflict check)."""
    return batch.join(store.select(key), key, "left_anti")


def insert_if_absent(batch: DataFrame, store: DataFrame, key: str = "event_id",
                     order: str | list[str] = "delivery_id") -> DataFrame:
    """Rows to append so that the store stays unique on ``key``: dedupe the
    batch (first wins), then drop keys already stored. Appending the result is
    idempotent: a replayed batch finds every key present and appends nothing."""
    return anti_absent(dedupe_first(batch, key, order), store, key)


def insert_counts(batch: DataFrame, store: DataFrame, key: str = "event_id",
                  order: str | list[str] = "delivery_id") -> DataFrame:
    """received / unique / stored / duplicates of one insert-if-absent batch;
    duplicates = in-batch repeats + keys already stored."""
    per_key = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    present = store.select(key).distinct().withColumn("_in", F.lit(True))
    c = per_key.join(present, key, "left").agg(
        F.sum("_n").cast("long").alias("received"),
        F.count(F.lit(1)).alias("unique"),
        F.count_if(F.col("_in").isNull()).alias("stored"))
    return c.withColumn("duplicates", F.col("received") - F.col("stored"))


def event_counts(store: DataFrame, approx: bool = False) -> DataFrame:
    """count(*), distinct products, distinct event ids (count − distinct = 0
    when the store is idempotent). ``approx`` uses HLL sketches for huge stores."""
    d = F.approx_count_distinct if approx else F.count_distinct
    return store.agg(F.count(F.lit(1)).alias("events"), d("product_id").alias("products"),
                     d("event_id").alias("event_ids"))


SKETCH_LG = 15  # 2^15 registers: about 0.6 % standard error, 32 KB at most a sketch


def sketch_columns() -> dict:
    """Aggregates that describe a batch of events: rows, and mergeable sketches of its
    distinct products and event ids. They can be observed on the batch's write."""
    return {"events": F.count(F.lit(1)), "products": F.hll_sketch_agg("product_id", SKETCH_LG), "event_ids": F.hll_sketch_agg("event_id", SKETCH_LG)}


def event_counts_of_sketches(sketches: DataFrame) -> DataFrame:
    """``event_counts`` (approximate but for the number of rows) of all batches, from
    their sketches alone: a few kilobytes a batch, whatever the batch holds."""
    union = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).cast("long").alias(c)
    return sketches.agg(F.coalesce(F.sum("events"), F.lit(0)).cast("long").alias("events"), union("products"), union("event_ids"))


def recent_events(store: DataFrame, limit: int = 50) -> DataFrame:
    """Newest events by consumed_at (event_id breaks ties), with the product
    name taken from the nested payload. A top-k: each task keeps its k best."""
    return (store.select("event_id", "product_id", "op", "version", "consumed_at",
                         F.get_json_object("payload", "$.product.name").alias("name"))
            .orderBy(F.col("consumed_at").desc(), F.col("event_id").asc()).limit(limit))


def last_n_per_key(store: DataFrame, n: int = 10, key: str = "product_id",
                   order=None) -> DataFrame:
    """Last ``n`` events per key by version desc. ``row_number() <= n`` is
    planned with a partial WindowGroupLimit before the shuffle, so a hot key
    ships at most ``n`` rows per map task."""
    order = order if order is not None else [F.col("version").desc(), F.col("event_id").asc()]
    w = Window.partitionBy(key).orderBy(*order)
    return store.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
