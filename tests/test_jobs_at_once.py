"""Jobs that run at once, the consumer on the published stream, counters observed on
writes, and the eviction of the bounded dedupe."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rowsync.plans import both
from rowsync.plans import catalog as C
from rowsync.plans.backfill import run_backfill
from rowsync.plans.batch_writer import InjectedCrash, write_batch
from rowsync.session import scratch_dir
from rowsync.sinks.tables import Tables, next_commit_seq
from rowsync.sources.fixtures import Fixtures
from rowsync.streaming import consumer as cons
from rowsync.streaming import stateful as st


def state(t):
    docs = sorted((r["id"], r["version"]) for r in t.docs().select("id", "version").collect())
    dlq = sorted((r["record_id"], r["version"], r["status"], r["attempts"]) for r in t.dlq().collect())
    return docs, dlq


def test_both_jobs_overlap_and_agree_with_either_order(spark):
    f = Fixtures(spark, SF001)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    loader = lambda s: Fixtures(s, SF001).products
    a = C.seeded_tables(spark, f, "at-once")
    both.run_both(a, loader, C.change_files(f), scratch_dir(spark, "ckpt"), "b", as_of, 50, 4, max_files_per_trigger=1)
    began = {m: [r["commit_seq"] for r in a.attempts().where(F.col("mode") == m).collect()] for m in ("backfill", "incremental")}
    assert len(began["backfill"]) == 4 and len(began["incremental"]) == 4
    assert min(began["incremental"]) < max(began["backfill"]) and min(began["backfill"]) < max(began["incremental"])
    for first in (0, 1):
        b = C.seeded_tables(spark, f, "one-by-one")
        for k in (first, 1 - first):
            if k:
                run_backfill(b, f.products, "b", as_of, 50, 4)
            else:
                C.incremental_into(spark, SF001, b, f, max_files=1)
        assert state(b) == state(a)
    assert a.progress().where(F.col("mode") == "backfill").count() == 4
    assert a.messages().select("delivery_id").distinct().count() == a.messages().count()


def test_commit_sequences_rise():
    seen = [next_commit_seq() for _ in range(1000)]
    assert seen == sorted(set(seen))


def test_consumer_on_the_published_stream(spark):
    """Batches published after a first drain are consumed by the next one; what a
    crash published twice is stored once; a delivery keeps its id."""
    f = Fixtures(spark, SF001)
    t = Tables.fresh(spark, "published", 8)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    rows, checkpoint = f.products.withColumn("op", F.lit("insert")), scratch_dir(spark, "ckpt")
    with pytest.raises(InjectedCrash):
        write_batch(t, rows.where("id % 2 = 0"), "backfill", "even", as_of, crash_at="after_events")
    before = {r["delivery_id"] for r in t.messages().collect()}
    write_batch(t, rows.where("id % 2 = 0"), "backfill", "even", as_of)
    assert before < {r["delivery_id"] for r in t.messages().collect()}
    cons.run_consumer(spark, t, None, checkpoint, as_of)
    even = f.products.where("id % 2 = 0").count()
    assert t.events_raw().count() == even and t.messages().count() == 2 * even
    write_batch(t, rows.where("id % 2 = 1"), "incremental", "odd", as_of)
    cons.run_consumer(spark, t, None, checkpoint, as_of)
    assert t.events_raw().count() == f.products.count() == t.events().count()
    c = {n: v for r in t.counters().where(F.col("job") == "consumer").collect() for n, v in r["counts"].items() if r["batch_id"].endswith("-0")}
    assert c == {"received": 2 * even, "malformed": 0, "stored": even, "duplicates": even}
    w = {(r["batch_id"], r["attempt"]): r["counts"]["published"] for r in t.counters().where(F.col("job") == "writer").collect()}
    assert w == {("even", 2): even, ("odd", 1): f.products.count() - even}


def test_counts_cost_no_job_of_their_own(spark):
    """Outcomes are counted by the write that stores them."""
    t = Tables.fresh(spark, "counted", 8)
    rows = spark.range(10).select(F.lit("m").alias("mode"), F.lit("b").alias("batch_id"), F.lit("es").alias("sink"), "id",
                                  F.lit(1).cast("long").alias("version"), F.when(F.col("id") < 3, "dlq").otherwise("ok").alias("outcome"),
                                  F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("attempt"))
    spark.sparkContext.setJobGroup("counted", "")
    try:
        assert t.write_outcomes(rows) == {"ok": 7, "duplicate": 0, "retry": 0, "dlq": 3}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs == 1
    assert t.write_outcomes(rows.where("id < 0")) == {"ok": 0, "duplicate": 0, "retry": 0, "dlq": 0}


def test_dedupe_state_is_evicted(spark):
    """A copy within the delay is dropped, one after it passes; the state store holds
    only keys whose time is not over."""
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("in", "out", "ckpt"))
    batches = [[("a", 0), ("b", 0)], [("a", 5), ("c", 5)], [("d", 21)], [("e", 22)], [("a", 23), ("c", 23)]]
    schema = "event_id string, consumed_at timestamp"
    for rows in batches:
        spark.createDataFrame([(k, day(n)) for k, n in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    st.drain(st.stream_dedupe_bounded(stream, delay="10 days"), out, checkpoint)
    got = sorted((r.event_id, r.consumed_at) for r in spark.read.schema(schema).parquet(out).collect())
    # a (state until day 10) is gone when day 21 was seen; c (until day 15) is not: the mark stands at day 12
    assert got == sorted([("a", day(0)), ("b", day(0)), ("c", day(5)), ("d", day(21)), ("e", day(22)), ("a", day(23))])
    held = {r.key.event_id for r in spark.read.format("statestore").load(checkpoint).collect()}
    assert held == {"a", "c", "d", "e"}
