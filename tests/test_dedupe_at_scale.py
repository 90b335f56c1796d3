"""The duplicate removal's state is bounded in memory, and its job runs in parallel."""
from pyspark.sql import functions as F

from conftest import SF001
from rowsync.plans import catalog as C
from rowsync.plans.oracle import ORACLE
from rowsync.session import scratch_dir
from rowsync.sinks.tables import _children, data_files
from rowsync.streaming import stateful as st


def test_dedupe_by_year_keeps_its_keys_on_disk(spark, duck001):
    """Each partition's state is files of the on-disk store, none of the store on the heap;
    the setting is the stream's own, and the reader needs no other one."""
    before = {k: spark.conf.get(k, None) for k in st.STATE_ON_DISK}
    _, checkpoint, _ = C.dedupe_by_year(spark, SF001)
    assert {k: spark.conf.get(k, None) for k in st.STATE_ON_DISK} == before
    parts = [c for c in _children(spark, f"{checkpoint}/state/0") if c.isdigit()]
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    for p in parts:
        files = _children(spark, f"{checkpoint}/state/0/{p}")
        assert any(c.endswith(".zip") for c in files)
        assert not any(c.endswith((".delta", ".snapshot")) for c in files)
    held = sorted(r[0] for r in st.read_state(spark, checkpoint).select("key.event_id").collect())
    want = sorted(r[0] for r in duck001.sql(ORACLE["stream_dedupe_state"]).fetchall())
    assert held == want
    # the plain reader, without the settings, reads the same
    assert spark.read.format("statestore").load(checkpoint).count() == len(want)


def test_settings_of_one_stream_are_put_back(spark):
    key = next(iter(st.STATE_ON_DISK))
    try:
        with st._with_conf(spark, {key: "inside"}):
            assert spark.conf.get(key) == "inside"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(key, None) != "inside"
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        with st._with_conf(spark, {"spark.sql.files.maxRecordsPerFile": "8"}):
            pass
        assert spark.conf.get("spark.sql.files.maxRecordsPerFile") == "7"
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_a_group_of_one_file_is_copied_on_all_cores(spark, monkeypatch):
    """A group that one file would hold is copied as a file for each core; a
    trigger still takes one whole group, in order."""
    monkeypatch.setattr(C, "LEAST_FILE_BYTES", 4_000, raising=False)
    df = spark.range(60_000).repartition(16).select("id", F.md5(F.col("id").cast("string")).alias("text"))
    folder = C.grouped_files(df, F.floor(F.col("id") / 20_000), "cores")
    assert folder.files_each == spark.sparkContext.defaultParallelism > 1
    assert data_files(spark, folder) == 3 * folder.files_each
    checkpoint = scratch_dir(spark, "cores-ckpt")
    seen = []

    def keep(batch, epoch):
        seen.append(tuple(batch.agg(F.min("id"), F.max("id"), F.count(F.lit(1))).first()))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", str(folder.of(1))).parquet(folder)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert seen == [(g * 20_000, g * 20_000 + 19_999, 20_000) for g in range(3)]
