"""Skew-proof running sums per key.

``Window.partitionBy(key).orderBy(seq)`` sends every row of a key to one task,
so a key holding a third of the table becomes one giant task. Here the order
column is cut into fixed-width ranges: each (key, range) group is bounded by
the range width, a tiny pre-aggregated table of per-range totals gives each
range its offset, and the local running sum plus the offset is the exact
running sum. The window and the join share the (key, range) partitioning, so
the big side is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_RANGE_WIDTH = 1 << 20


def running_sums(df: DataFrame, keys: list[str], order_col: str,
                 values: dict[str, object], width: int = DEFAULT_RANGE_WIDTH) -> DataFrame:
    """Add, for each ``out -> value expression``, the inclusive running sum of the
    value over rows of the same ``keys`` ordered by ``order_col`` (unique per key,
    non-negative integer). Results are LongType."""
    rng = "_rs_range"
    exprs = {out: (F.col(v) if isinstance(v, str) else v).cast("long") for out, v in values.items()}
    staged = df.withColumn(rng, F.floor(F.col(order_col) / F.lit(width)).cast("long"))
    for out, e in exprs.items():
        staged = staged.withColumn(f"_rs_v_{out}", e)

    local_w = (Window.partitionBy(*keys, rng).orderBy(order_col)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = staged
    for out in exprs:
        local = local.withColumn(f"_rs_l_{out}", F.sum(f"_rs_v_{out}").over(local_w))

    # per-range totals: partial aggregation before the shuffle, then a prefix
    # over ranges of one key (at most rows/width entries per key)
    totals = staged.groupBy(*keys, rng).agg(
        *[F.sum(f"_rs_v_{out}").alias(f"_rs_t_{out}") for out in exprs])
    prev_w = (Window.partitionBy(*keys).orderBy(rng)
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(
        *keys, rng,
        *[F.coalesce(F.sum(f"_rs_t_{out}").over(prev_w), F.lit(0)).cast("long").alias(f"_rs_o_{out}")
          for out in exprs])

    joined = local.join(offsets, on=[*keys, rng], how="inner")
    for out in exprs:
        joined = joined.withColumn(out, (F.col(f"_rs_l_{out}") + F.col(f"_rs_o_{out}")).cast("long"))
    drop = [rng] + [f"_rs_{k}_{out}" for out in exprs for k in ("v", "l", "o")]
    return joined.drop(*drop)
