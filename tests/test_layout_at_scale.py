"""Files, folders and tasks follow rows and batches, not key ranges, key counts or a fixed task."""
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from rowsync.functions.validate import validate_strict
from rowsync.plans import catalog as C
from rowsync.plans.backfill import run_backfill
from rowsync.plans.batch_writer import InjectedCrash
from rowsync.session import scratch_dir
from rowsync.sinks.tables import Tables, _children, data_files
from rowsync.sources.fixtures import Fixtures
from rowsync.streaming import stateful as st


def test_a_wave_is_one_folder_however_many_ranges_it_has(spark, monkeypatch):
    """40 ranges in two waves: two folders of each sink, and a repeat clears a wave at
    once; outcomes keep the batch id of their range."""
    f = Fixtures(spark, SF001)
    t = Tables.fresh(spark, "wave-folders", 8)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    cleared = []
    clear = Tables.clear
    monkeypatch.setattr(Tables, "clear", lambda self, table, **p: (cleared.append((table, p)), clear(self, table, **p))[1])
    with pytest.raises(InjectedCrash):
        run_backfill(t, f.products, "r", as_of, 5, 2, crash_at="after_docs", crash_wave=1)
    run_backfill(t, f.products, "r", as_of, 5, 2)
    for table in ("docs", "outcomes"):
        assert sorted(_children(spark, f"{t.path(table)}/mode=backfill")) == ["batch_id=r-w0", "batch_id=r-w1"]
    assert len(cleared) == 3  # documents, outcomes and entries of wave 1
    ranges = f.products.select(F.floor((F.col("id") - 1) / 5).alias("r")).distinct().count()
    assert ranges == 40 == t.progress().count() == t.outcomes().select("batch_id").distinct().count()
    assert t.outcomes().count() == f.products.count()


def test_a_wave_recorded_in_part_is_repeated_whole(spark):
    """Ranges of a wave whose record was torn: the repeat loses no document and records
    each range once."""
    f = Fixtures(spark, SF001)
    t = Tables.fresh(spark, "torn-progress", 8)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    run_backfill(t, f.products, "r", as_of, 50, 1)
    docs = sorted(map(tuple, t.docs().select("id", "version").collect()))
    part = t.progress().where("range_id < 2")
    kept = spark.createDataFrame(part.collect(), part.schema)
    t.clear("progress", mode="backfill")
    t.commit_progress(kept, "backfill")
    run_backfill(t, f.products, "r", as_of, 50, 1)
    assert sorted(map(tuple, t.docs().select("id", "version").collect())) == docs
    assert sorted(r["range_id"] for r in t.progress().collect()) == [0, 1, 2, 3]
    assert t.outcomes().count() == f.products.count()


def test_a_filter_on_the_error_parses_each_row_once(spark):
    """The rules are not written again into a filter on the error, or on an outcome of it."""
    rows = validate_strict(Fixtures(spark, SF001).products)
    for found in (rows.where(F.col("error").isNotNull()),
                  rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "dlq").otherwise("ok")).where("outcome = 'ok'")):
        plan = found.select("id")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") <= 1, plan


def test_groups_of_a_large_stream_are_several_files_each(spark):
    """Every group has the same number of files, none a whole group, in key order; a
    short group is filled up, so a trigger takes exactly one group."""
    df = spark.range(4000).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    folder = C.ordered_files(df, "id", 4, "ranges", file_bytes=20_000)
    assert folder.files_each > 1
    out = scratch_dir(spark, "ranges-out")
    seen = []

    def keep(batch, epoch):
        seen.append(batch.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first())
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(folder.of(1))).parquet(folder)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", out).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sum(r[2] for r in seen) == 4000
    assert all(a[1] < b[0] for a, b in zip(seen, seen[1:]))
    uneven = spark.range(3001).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    folder = C.grouped_files(uneven, F.floor(F.col("id") / 3000), "uneven", file_bytes=20_000)
    assert data_files(spark, folder) == 2 * folder.files_each > 2
    assert spark.read.parquet(folder).count() == 3001


def test_gate_judges_blocks_of_keys_over_batches(spark):
    """Keys of one block and of others, negative ones too, in three batches: one state row a block."""
    batches = [[(1, 1, 5), (2, 2, 1), (1, 3, 4), (2000, 4, 1), (-1, 5, 2)], [(3, 6, 9), (1, 8, 5), (1, 7, 6), (-1, 9, 2)], [(1, 11, 6), (2, 10, 2), (3, 12, 1)]]
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("blocks", "blocks-out", "blocks-ckpt"))
    schema = "product_id long, delivery_id long, version long"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(folder)
    st.drain(st.stateful_version_gate(stream), out, checkpoint)
    got = {r["delivery_id"]: (r["product_id"], r["version"], r["outcome"]) for r in spark.read.parquet(out).collect()}
    best, want = {}, {}
    for p, d, v in (x for rows in batches for x in sorted(rows, key=lambda r: r[1])):
        want[d] = (p, v, "accepted" if p not in best or v > best[p] else "replay" if v == best[p] else "stale")
        best[p] = max(v, best.get(p, v))
    assert got == want
    assert spark.read.format("statestore").load(checkpoint).count() == 3


def test_a_large_flush_writes_a_bucket_as_several_files(spark, monkeypatch):
    monkeypatch.setattr(Tables, "EVENTS_PER_FILE", 100)
    t = Tables.fresh(spark, "large-flush", 2)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("event_id"), F.col("id").alias("product_id"), F.lit("insert").alias("op"),
                                    F.lit(1).cast("long").alias("version"), F.lit("{}").alias("payload"), F.lit("2024-01-01").cast("timestamp_ntz").alias("consumed_at"))
    assert t.append_events(rows, n_rows=1000) == 1000
    assert all(2 <= data_files(spark, f"{t.path('events')}/bucket={b}") <= 5 for b in range(2))
    assert t.append_events(rows, n_rows=1000) == 0 and t.events().count() == 1000
