"""Job status and replication gates: every gate can fail, and modes without batches have no row."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rowsync.operators import monitor as mon

AT = datetime(2024, 1, 1)
COUNTERS = "job string, mode string, batch_id string, attempt int, counts map<string,bigint>"
ATTEMPTS = "mode string, batch_id string, attempt int, started_at timestamp_ntz, commit_seq long"
RUNS = "run_id string, target_max_id long, range_width long, ranges_per_wave long, created_at timestamp_ntz"


@pytest.fixture(scope="module")
def whole(spark):
    """The stores of a drained replication of four rows."""
    return {
        "source": spark.createDataFrame([(i, 1) for i in range(1, 5)], "id long, version long"),
        "docs": spark.createDataFrame([(i, 1) for i in range(1, 5)], "id long, version long"),
        "events": spark.createDataFrame([(f"{i}:1", i, 1) for i in range(1, 5)], "event_id string, product_id long, version long"),
        "dlq": spark.createDataFrame([(1, "resolved")], "record_id long, status string"),
        "counters": spark.createDataFrame([("writer", "incremental", "i", 1, {"ok": 0, "duplicate": 2}), ("consumer", "consumer", "c", 1, {"duplicates": 1})], COUNTERS),
        "progress": spark.createDataFrame([("incremental", 9), ("backfill", None)], "mode string, cursor_seq long"),
        "change_log": spark.createDataFrame([(8,), (9,)], "seq long"),
    }


def failed(stores):
    return {r["check"] for r in mon.replication_gates(**stores).collect() if not r["pass"]}


def test_gates_of_a_whole_replication_pass(whole):
    assert failed(whole) == set()


def test_every_gate_can_fail(spark, whole):
    d, e, v = whole["docs"], whole["events"], F.col("version")
    assert failed(whole | {"docs": d.where("id > 1")}) == {"docs_eq_source", "docs_of_other_version"}
    # versions that cancel out in a sum
    swapped = d.withColumn("version", v + F.when(F.col("id") == 1, 1).when(F.col("id") == 2, -1).otherwise(0))
    assert failed(whole | {"docs": swapped}) == {"docs_of_other_version"}
    assert failed(whole | {"events": e.unionByName(e.where("product_id = 2"))}) == {"events_twice"}
    assert failed(whole | {"events": e.where("product_id > 1")}) == {"events_eq_products", "products_without_event"}
    other = e.withColumn("product_id", F.when(F.col("product_id") == 1, 99).otherwise(F.col("product_id")))
    assert failed(whole | {"events": other}) == {"products_without_event", "events_without_product"}
    none = whole["counters"].withColumn("counts", F.create_map(F.lit("ok"), F.lit(1).cast("long")))
    assert failed(whole | {"counters": none}) == {"documents_absorbed_replays", "events_absorbed_replays"}
    assert failed(whole | {"progress": whole["progress"].limit(0)}) == {"changes_left"}
    assert failed(whole | {"dlq": whole["dlq"].withColumn("status", F.lit("open"))}) == {"open_dlq"}


def test_gates_of_empty_stores(whole):
    empty = {n: df.limit(0) for n, df in whole.items()}
    assert failed(empty) == {"documents_absorbed_replays", "events_absorbed_replays"}


def test_job_status(spark):
    counters = spark.createDataFrame([
        ("writer", "backfill", "a-b-w0", 1, {"ok": 5, "published": 5}), ("writer", "backfill", "a-b-w1", 2, {"ok": 1, "dlq": 2, "published": 3}),
        ("consumer", "consumer", "c", 1, {"received": 8, "stored": 6, "duplicates": 1, "malformed": 1})], COUNTERS)
    attempts = spark.createDataFrame([("backfill", "a-b-w0", 1, AT, 1), ("backfill", "a-b-w1", 1, AT, 2), ("backfill", "a-b-w1", 2, AT.replace(second=4), 3)], ATTEMPTS)
    runs = spark.createDataFrame([("a-b", 14, 5, 2, AT)], RUNS)
    events = spark.createDataFrame([(AT,)] * 6, "consumed_at timestamp_ntz")
    got = {r["mode"]: r.asDict() for r in mon.job_status(counters, attempts, runs, events).collect()}
    assert set(got) == {"backfill", "consumer"}
    b, c = got["backfill"], got["consumer"]
    assert (b["batches"], b["repeated"], b["records"], b["written"], b["rejected"], b["published"]) == (2, 1, 8, 6, 2, 8)
    assert (b["resumed_from"], b["last_batch_at"], b["rate"]) == (10, AT.replace(second=4), 2)  # 8 records in 4 s
    assert (c["records"], c["written"], c["absorbed"], c["rejected"], c["resumed_from"], c["rate"]) == (8, 6, 1, 1, None, 6)
    assert mon.job_status(counters.limit(0), attempts.limit(0), runs.limit(0), events.limit(0)).count() == 0
