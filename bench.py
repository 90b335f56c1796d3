"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf", ...}.
Each query's full result is computed (written to the no-op sink), so the time
covers the whole plan, not a sample of it.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from rowsync.plans.catalog import QUERIES  # noqa: E402
from rowsync.plans.backfill import run_backfill  # noqa: E402
from rowsync.session import build_session, scratch_dir  # noqa: E402
from rowsync.sinks.tables import Tables  # noqa: E402
from rowsync.sources.changes import generate_rows  # noqa: E402
from rowsync.sources.fixtures import Fixtures  # noqa: E402

HEADLINE = [
    "change_batch_summary",   # flagship: page -> collapse -> current -> validate -> gate
    "run_backfill",           # resumable waves, both sinks, DLQ, progress
    "versioned_upsert",       # one batch of every row through the gate
    "insert_if_absent",       # lineitem-derived events with real repeats
    "insert_counts",
    "run_incremental",        # streaming foreachBatch over the change log
    "run_consumer",           # streaming consumer over the deliveries
    "reconcile",
    "record_trace",
    "search_scored",
    "search_scored_documents",
    "parse_event",
    "sliding_rate",
    "last_n_per_key",
    "stateful_version_gate",
]


def force(df) -> int:
    """Compute the whole result without collecting it."""
    df.write.format("noop").mode("overwrite").save()
    return 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", max(8, 2 * cpus), app_name="rowsync-bench",
                          extra={"spark.driver.memory": "16g"})
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    # warm-up: JVM, codegen and file listing caches (not timed)
    force(Fixtures(spark, sf_dir).products)

    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        force(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)

    # the reference's own workload: generate 1M source rows into a table,
    # then one full backfill of it into empty sinks (both sinks, DLQ, progress)
    src_dir = scratch_dir(spark, "bench-source")
    t0 = time.perf_counter()
    generate_rows(spark, 1_000_000, num_partitions=cpus).write.mode("overwrite").parquet(src_dir)
    times["generate_rows_1m"] = round(time.perf_counter() - t0, 3)
    source = spark.read.parquet(src_dir)
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    t0 = time.perf_counter()
    run_backfill(Tables.fresh(spark, "bench-backfill"), source, "bench", as_of)
    times["backfill_1m"] = round(time.perf_counter() - t0, 3)

    f = Fixtures(spark, sf_dir)
    n_products = f.products.count()
    n_events = f.event_log_large.count()
    rates = {
        "backfill_rows_per_sec": round(n_products / times["run_backfill"], 1),
        "upsert_rows_per_sec": round(n_products / times["versioned_upsert"], 1),
        "insert_if_absent_rows_per_sec": round(n_events / times["insert_if_absent"], 1),
        "generate_rows_per_sec": round(1_000_000 / times["generate_rows_1m"], 1),
        "backfill_1m_rows_per_sec": round(1_000_000 / times["backfill_1m"], 1),
    }
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "rates": rates,
                      "rows": {"products": n_products, "event_log_large": n_events}}))
    spark.stop()


if __name__ == "__main__":
    main()
