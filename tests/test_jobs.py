"""Fault injection and order/batching properties of the jobs (sf0.001)."""
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rowsync.functions.validate import validate_strict
from rowsync.plans import catalog as C
from rowsync.plans.backfill import RANGES_PER_WAVE, plan_ranges, run_backfill
from rowsync.plans.batch_writer import InjectedCrash, write_batch
from rowsync.plans.replay import dlq_replay
from rowsync.session import scratch_dir
from rowsync.sources.fixtures import Fixtures
from rowsync.streaming import consumer as cons
from rowsync.streaming import incremental as inc


def docs_state(t):
    return sorted((r["id"], r["version"]) for r in t.docs().select("id", "version").collect())


@pytest.fixture(scope="module")
def reference_state(spark):
    f = Fixtures(spark, SF001)
    t = C.seeded_tables(spark, f, "ref")
    C.incremental_into(spark, SF001, t, f, max_files=4)
    return docs_state(t)


@pytest.mark.parametrize("point", ["after_docs", "after_events", "after_dlq", "before_commit"])
def test_incremental_crash_then_resume(spark, reference_state, point):
    """A micro-batch failing after a sink wrote is re-run with the same batch id
    and rows; the final documents equal an uninterrupted run and the replay is
    recorded (attempt 2)."""
    f = Fixtures(spark, SF001)
    t = C.seeded_tables(spark, f, f"crash-{point}")
    changes, ckpt = C.change_files(f), scratch_dir(spark, "ckpt")
    loader = lambda s: Fixtures(s, SF001).products
    crash = {"epoch": 1, "at": point, "left": 1}
    with pytest.raises(Exception):
        inc.run_incremental(spark, t, changes, ckpt, loader, max_files_per_trigger=1, crash=crash)
    inc.run_incremental(spark, t, changes, ckpt, loader, max_files_per_trigger=1, crash=crash)
    assert docs_state(t) == reference_state
    assert t.outcomes().where((F.col("batch_id").endswith("-1")) & (F.col("attempt") == 2)).count() > 0
    # the published stream holds the replayed batch twice; the consumer absorbs it
    msgs = t.messages()
    assert msgs.count() > msgs.select("message_id").distinct().count()


def test_batching_does_not_change_the_result(spark, reference_state):
    f = Fixtures(spark, SF001)
    for n in (1, 2):
        t = C.seeded_tables(spark, f, f"batching-{n}")
        C.incremental_into(spark, SF001, t, f, max_files=n)
        assert docs_state(t) == reference_state


def test_backfill_resume_skips_finished_waves(spark):
    f = Fixtures(spark, SF001)
    t = C.seeded_tables(spark, f, "resume")
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    with pytest.raises(InjectedCrash):
        run_backfill(t, f.products, "b", as_of, 50, 4, crash_at="after_events", crash_wave=2)
    res = run_backfill(t, f.products, "b", as_of, 50, 4)
    assert res["skipped"] == 2          # waves 0 and 1 were committed before the crash
    again = run_backfill(t, f.products, "b", as_of, 50, 4)
    assert again["skipped"] == again["waves"]
    u = C.seeded_tables(spark, f, "resume-ref")
    run_backfill(u, f.products, "b", as_of, 50, 4)
    assert docs_state(t) == docs_state(u)


def test_backfill_and_incremental_in_any_order(spark):
    f = Fixtures(spark, SF001)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    a = C.seeded_tables(spark, f, "order-a")
    run_backfill(a, f.products, "b", as_of, 50, 2)
    C.incremental_into(spark, SF001, a, f, max_files=2)
    b = C.seeded_tables(spark, f, "order-b")
    C.incremental_into(spark, SF001, b, f, max_files=2)
    run_backfill(b, f.products, "b", as_of, 50, 2)
    assert docs_state(a) == docs_state(b)


def test_consumer_failure_is_absorbed(spark):
    """A flush that fails after storing is re-run; the anti join absorbs what
    the failed attempt stored, so the store stays unique."""
    f = Fixtures(spark, SF001)
    folder, ckpt = C.delivery_files(f), scratch_dir(spark, "ckpt")
    t = C.Tables.fresh(spark, "consumer-fail", 8)
    fail = {"epoch": 0, "left": 1}
    with pytest.raises(Exception):
        cons.run_consumer(spark, t, folder, ckpt, F.lit(None).cast("timestamp_ntz"), 1, fail)
    cons.run_consumer(spark, t, folder, ckpt, F.lit(None).cast("timestamp_ntz"), 1, fail)
    ev = t.events_raw()
    assert ev.count() == ev.select("event_id").distinct().count()
    good = C.parse_event(f.deliveries).where(F.col("error").isNull()).select("event_id").distinct().count()
    assert ev.count() == good


def test_plan_ranges_same_width_at_any_size():
    assert plan_ranges(2000, 500, 2) == (4, 2)
    assert plan_ranges(0, 500) == (0, RANGES_PER_WAVE)
    n, per = plan_ranges(10**11, 65_536)
    assert n == -(-10**11 // 65_536) and per == RANGES_PER_WAVE


def sample_rows(f):
    """(a valid row, a rejected row) of the source as one-row frames."""
    judged = validate_strict(f.products)
    cols = f.products.columns
    good = judged.where(F.col("error").isNull()).orderBy("id").select(*cols).limit(1)
    bad = judged.where(F.col("error").isNotNull()).orderBy("id").select(*cols).limit(1)
    return good.withColumn("op", F.lit("update")), bad.withColumn("op", F.lit("update"))


def at(text):
    return F.lit(text).cast("timestamp_ntz")


def dlq_state(t):
    return sorted((r["record_id"], r["status"]) for r in t.dlq().collect())


def test_resume_after_growth_keeps_the_quarantine(spark):
    """A run's target is fixed at its first start: resumed over a grown source
    it writes nothing new and loses nothing; later rows are another run's."""
    f = Fixtures(spark, SF001)
    t = C.Tables.fresh(spark, "growth", 8)
    first = run_backfill(t, f.products, "g", at("2026-01-01"), 100, 2, target=400)
    state = docs_state(t), dlq_state(t), t.outcomes().count()
    assert state[1]
    again = run_backfill(t, f.products, "g", at("2026-01-02"), 50, 3, target=2000)
    assert again["target"] == first["target"] == 400 and again["skipped"] == again["waves"]
    assert (docs_state(t), dlq_state(t), t.outcomes().count()) == state
    run_backfill(t, f.products, "h", at("2026-01-02"), 100, 2)
    assert set(state[1]) <= set(dlq_state(t)) and set(state[0]) <= set(docs_state(t))


def test_two_replays_keep_each_others_rows(spark):
    f = Fixtures(spark, SF001)
    t = C.Tables.fresh(spark, "replays", 8)
    ids = [r["id"] for r in validate_strict(f.products).where(F.col("error").isNull()).orderBy("id").limit(2).collect()]
    broken = f.products.where(F.col("id").isin(ids))
    write_batch(t, broken.withColumn("attributes", F.lit("{")).withColumn("op", F.lit("insert")), "backfill", "b1",
                at("2026-01-01"), small=False)
    assert dlq_state(t) == [(i, "open") for i in ids]
    for i in ids:
        one = spark.range(i, i + 1).select(F.col("id").alias("record_id"))
        got = dlq_replay(t, f.products, at("2026-01-02"), ids=one).first()
        assert (got["replayed"], got["resolved"], got["failed"]) == (1, 1, 0)
    assert dlq_state(t) == [(i, "resolved") for i in ids]
    assert [i for i, _ in docs_state(t)] == ids


def test_a_new_incremental_query_keeps_the_old_ones_documents(spark, reference_state):
    f = Fixtures(spark, SF001)
    t = C.seeded_tables(spark, f, "two-queries")
    mid = f.change_log.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    loader = lambda s: Fixtures(s, SF001).products
    for part in (F.col("seq") <= mid, F.col("seq") > mid):
        folder = C.ordered_files(f.change_log.where(part), "seq", 1, "half")
        inc.run_incremental(spark, t, folder, scratch_dir(spark, "ckpt"), loader)
    assert docs_state(t) == reference_state


def test_compaction_keeps_a_batch_written_meanwhile(spark, monkeypatch):
    f = Fixtures(spark, SF001)
    t = C.Tables.fresh(spark, "compaction", 8)
    good, _ = sample_rows(f)
    one = good.first()["id"]
    write_batch(t, good, "backfill", "b1", at("2026-01-01"), small=False)
    write_base = C.Tables._write_base

    def meanwhile(self, rows, gen):
        other = good.withColumn("id", F.lit(one + 10**6).cast("long"))
        write_batch(t, other, "backfill", "b2", at("2026-01-02"), small=False)
        write_base(self, rows, gen)
    monkeypatch.setattr(C.Tables, "_write_base", meanwhile)
    t.compact()
    monkeypatch.undo()
    both = [one, one + 10**6]
    assert [i for i, _ in docs_state(t)] == both
    t.vacuum()
    assert [i for i, _ in docs_state(t)] == both
    # stopped after the fold was recorded, before the base was committed
    monkeypatch.setattr(C.Tables, "_write_base", lambda self, rows, gen: (_ for _ in ()).throw(InjectedCrash("stop")))
    with pytest.raises(InjectedCrash):
        t.compact()
    monkeypatch.undo()
    t.vacuum()
    assert [i for i, _ in docs_state(t)] == both
    t.compact()
    t.compact()
    t.vacuum()
    assert [i for i, _ in docs_state(t)] == both


def test_a_later_reject_reopens_the_entry(spark):
    """The batch written last decides, whatever the times in its data."""
    f = Fixtures(spark, SF001)
    t = C.Tables.fresh(spark, "reopen", 8)
    good, bad = sample_rows(f)
    i = bad.first()["id"]
    repaired = good.withColumn("id", F.lit(i).cast("long"))
    write_batch(t, bad, "incremental", "b1", at("2026-05-01"), small=False)
    assert dlq_state(t) == [(i, "open")]
    write_batch(t, repaired, "incremental", "b2", at("2026-05-03"), small=False)
    assert dlq_state(t) == [(i, "resolved")]
    write_batch(t, bad, "incremental", "b3", at("2026-05-02"), small=False)
    assert dlq_state(t) == [(i, "open")]
    assert [r["attempts"] for r in t.dlq().collect()] == [2]


@pytest.mark.parametrize("point", ["after_docs", "after_events", "after_dlq", "before_commit"])
def test_a_repeated_batch_with_a_repaired_row_leaves_no_open_entry(spark, point):
    f = Fixtures(spark, SF001)
    t = C.Tables.fresh(spark, "repaired", 8)
    good, bad = sample_rows(f)
    i = bad.first()["id"]
    with pytest.raises(InjectedCrash):
        write_batch(t, bad, "incremental", "b1", at("2026-05-01"), small=False, crash_at=point)
    out = write_batch(t, good.withColumn("id", F.lit(i).cast("long")), "incremental", "b1", at("2026-05-01"), small=False)
    assert [(r["id"], r["outcome"], r["attempt"]) for r in out.collect()] == [(i, "ok", 2)]
    assert [k for k, _ in docs_state(t)] == [i]
    assert dlq_state(t) == []


def test_stateful_gate_independent_of_arrow_chunks(spark):
    """A key's rows of one micro-batch can arrive in several Arrow chunks, in
    any order; the gate must judge them in delivery order all the same."""
    from rowsync.streaming import stateful as st
    from pyspark.sql import Window as W
    f = Fixtures(spark, SF001)
    good = C.parse_event(f.deliveries).where(F.col("error").isNull()).select("product_id", "delivery_id", "version")
    w = W.partitionBy("product_id").orderBy("delivery_id").rowsBetween(W.unboundedPreceding, -1)
    prev = F.max("version").over(w)
    expected = good.select("product_id", "delivery_id", "version",
                           F.when(prev.isNull() | (F.col("version") > prev), "accepted")
                            .when(F.col("version") == prev, "replay").otherwise("stale").alias("outcome"))
    src_dir = C.ordered_files(good, "delivery_id", 2, "gate-chunks")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "3")
    try:
        stream = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", "1").parquet(src_dir)
        out = scratch_dir(spark, "gate-chunks-out")
        st.drain(st.stateful_version_gate(stream), out, scratch_dir(spark, "ckpt"))
    finally:
        spark.conf.set(key, old)
    got = spark.read.parquet(out)
    assert got.count() == expected.count()
    assert got.exceptAll(expected).count() == 0


def test_unbroadcast_batches_give_the_same_state(spark, reference_state, monkeypatch):
    """A micro-batch over the broadcast bound takes the size-checked join path;
    the documents, event store and DLQ come out the same."""
    import rowsync.session as S
    f = Fixtures(spark, SF001)
    monkeypatch.setattr(S, "BROADCAST_MAX_BYTES", 0)
    t = C.seeded_tables(spark, f, "no-broadcast")
    C.incremental_into(spark, SF001, t, f, max_files=4)
    assert docs_state(t) == reference_state
    ev = C.Tables.fresh(spark, "consumer-nb", 8)
    cons.run_consumer(spark, ev, C.delivery_files(f), scratch_dir(spark, "ckpt"), F.lit(None).cast("timestamp_ntz"), 1)
    monkeypatch.setattr(S, "BROADCAST_MAX_BYTES", 64 << 20)
    good = C.parse_event(f.deliveries).where(F.col("error").isNull()).select("event_id").distinct().count()
    assert ev.events_raw().count() == good
