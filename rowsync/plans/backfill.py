"""Bounded, resumable backfill as parallel key-range waves.

The pass ``(0, target]`` is cut into key ranges of ``range_width`` keys; a
wave processes ``ranges_per_wave`` ranges at once as one Spark job (one
parallel read with a pushed range filter, gate, both sinks), then records each
finished range in the progress table. A rerun skips recorded waves, and a
wave repeated after a crash replaces exactly its own partition (a wave of which only
some ranges were recorded is repeated whole). The driver
loops over waves only (a count bounded by configuration), never over rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import Tables
from ..sources.changes import range_column, snapshot_high_water
from .batch_writer import write_batch


def range_batch_id(run_id: str, r) -> str | Column:
    if isinstance(r, Column):
        return F.concat(F.lit(f"{run_id}-r"), r.cast("string"))
    return f"{run_id}-r{r}"


RANGES_PER_WAVE = 4096  # a wave is a sizeable parallel job; a stop costs at most one


def plan_ranges(target: int, width: int, waves: int | None = None) -> tuple[int, int]:
    """(number of ranges, ranges per wave). The width is the same at any table
    size, so a range stays one small write task and a larger table has more of
    them; ``waves`` asks for a number of waves instead of full ones."""
    n_ranges = math.ceil(max(0, target) / width)
    return n_ranges, max(1, math.ceil(n_ranges / waves)) if waves else RANGES_PER_WAVE


def run_backfill(tables: Tables, products: DataFrame, run_id: str, as_of: Column,
                 range_width: int = 65_536, waves: int | None = None,
                 crash_at: str | None = None, crash_wave: int | None = None, target: int | None = None) -> dict:
    """Run (or resume) backfill ``run_id``. Events are always ``insert``
    (soft-deleted rows included). Returns {target, waves, skipped}.

    Target and layout are stored when the run first starts and read back on
    resume, so a wave always means the same key ranges; rows that came later
    are the incremental job's, or another run's. A key range is the unit of
    resume position, so it is sized for Spark (tens of
    thousands of keys by default), not for a network round trip. On an
    id-clustered source a wave reads only the files of its key range. A wave is one folder
    of each sink, so files and listings follow the rows, however narrow the ranges are."""
    spark = products.sparkSession
    def plan() -> tuple[int, int, int]:
        end = int(snapshot_high_water(products).first()[0]) if target is None else target  # one number
        return end, range_width, plan_ranges(end, range_width, waves)[1]

    target, range_width, ranges_per_wave = tables.open_run(run_id, plan, as_of)
    n_ranges = plan_ranges(target, range_width)[0]
    n_waves = math.ceil(n_ranges / ranges_per_wave)
    done_all = tables.progress().where((F.col("mode") == "backfill") & (F.col("run_id") == run_id))
    skipped = 0
    for w in range(n_waves):
        r_lo, r_hi = w * ranges_per_wave, min((w + 1) * ranges_per_wave, n_ranges)
        done = done_all.where(F.col("range_id").between(r_lo, r_hi - 1)).select("range_id").distinct()
        if done.count() == r_hi - r_lo:
            skipped += 1
            continue
        lo, hi = r_lo * range_width, min(r_hi * range_width, target)
        k = F.col("id")
        rows = (products.where((k > lo) & (k <= hi))
                .withColumn("range_batch", range_batch_id(run_id, range_column(k, 0, range_width)))
                .withColumn("op", F.lit("insert")))
        write_batch(tables, rows, "backfill", f"{run_id}-w{w}", as_of,
                    batch_col="range_batch", small=False, key_range=(lo, hi),
                    crash_at=crash_at if crash_wave in (None, w) else None)
        # progress last: one row per finished range of the wave
        prog = (spark.range(r_lo, r_hi).select(
            F.lit("backfill").alias("mode"), F.lit(run_id).alias("run_id"),
            range_batch_id(run_id, F.col("id")).alias("batch_id"), F.col("id").alias("range_id"),
            F.least((F.col("id") + 1) * range_width, F.lit(target)).cast("long").alias("last_id"),
            F.lit(target).cast("long").alias("target_max_id"), F.lit(None).cast("long").alias("cursor_seq"),
            as_of.alias("committed_at"))
            .join(F.broadcast(done), "range_id", "left_anti"))   # bounded by ranges_per_wave
        tables.commit_progress(prog.coalesce(1), "backfill")  # one file: recorded as a whole
    return {"target": target, "waves": n_waves, "skipped": skipped}
