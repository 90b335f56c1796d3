"""Backfill and incremental replication at once, into the same sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from ..sinks.tables import Tables
from ..streaming.incremental import run_incremental
from .backfill import run_backfill


def run_both(tables: Tables, products_loader: Callable[[SparkSession], DataFrame], change_dir: str, checkpoint: str,
             run_id: str, as_of: Column, range_width: int = 65_536, waves: int | None = None,
             max_files_per_trigger: int | None = None) -> dict:
    """Drain the change log while the backfill runs: the incremental query runs in its
    own stream thread, the backfill's waves here, and neither waits for the other.

    Documents do not depend on which comes first (the highest version wins), nor does
    an entry's status where both read the same source row. Returns the backfill's figures."""
    spark = tables.spark
    query = run_incremental(spark, tables, change_dir, checkpoint, products_loader,
                            max_files_per_trigger=max_files_per_trigger, wait=False)
    try:
        done = run_backfill(tables, products_loader(spark), run_id, as_of, range_width, waves)
    except BaseException:
        query.stop()
        raise
    query.awaitTermination()
    return done
