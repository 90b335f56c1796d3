"""The change log polled as a prefix-safe stream."""
import datetime as dt

from pyspark.sql import functions as F

from rowsync.schemas import CHANGE_LOG
from rowsync.session import scratch_dir
from rowsync.streaming import polled
from rowsync.streaming.stateful import drain

T0 = dt.datetime(2024, 1, 1)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def log(spark, seqs):
    """One change a minute: seq s was changed at minute s."""
    rows = [(s, s % 5, "update", s, at(s)) for s in seqs]
    return spark.createDataFrame(rows, "seq long, product_id long, op string, version long, changed_at timestamp_ntz")


def poll(spark, folder, out, checkpoint, minute, rows=7):
    drain(polled.stream_polled_changes(spark, folder, 10 * 60_000, at(minute).isoformat(), rows), out, checkpoint)
    return sorted(r.seq for r in spark.read.schema(CHANGE_LOG).parquet(out).collect())


def test_late_low_sequences_and_resume(spark):
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "out", "ckpt"))
    log(spark, [s for s in range(1, 41) if s not in (35, 38)]).coalesce(2).write.mode("append").parquet(folder)
    # the window holds back what was changed after minute 30
    assert poll(spark, folder, out, checkpoint, 40) == list(range(1, 31))
    # 35 and 38 are committed late, after higher sequences were seen
    log(spark, [35, 38, 41]).coalesce(1).write.mode("append").parquet(folder)
    assert poll(spark, folder, out, checkpoint, 46) == list(range(1, 36 + 1))
    assert poll(spark, folder, out, checkpoint, 46) == list(range(1, 36 + 1))  # nothing new, nothing twice
    assert poll(spark, folder, out, checkpoint, 100) == list(range(1, 42))


def test_offset_holds_sequence_and_window(spark):
    folder = scratch_dir(spark, "log")
    log(spark, range(1, 21)).coalesce(1).write.parquet(folder)
    reader = polled.ChangeLogPollReader({"path": folder, "window_ms": "300000", "as_of": at(20).isoformat(), "rows_per_partition": "4"})
    assert reader.initialOffset() == {"seq": 0, "window_ms": 300000}
    end = reader.latestOffset()
    assert end == {"seq": 15, "window_ms": 300000}
    parts = reader.partitions({"seq": 2, "window_ms": 300000}, end)
    assert [(p.lo, p.hi) for p in parts] == [(2, 6), (6, 10), (10, 14), (14, 15)]
    got = [s for p in parts for b in reader.read(p) for s in b.column("seq").to_pylist()]
    assert sorted(got) == list(range(3, 16))
    # a known file's footer is not read again, and the offset never goes back
    known = dict(reader.groups.files)
    log(spark, [16]).withColumn("changed_at", F.lit(at(1)).cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
    assert reader.latestOffset()["seq"] == 15 and known.items() <= reader.groups.files.items()


def test_empty_folder_of_rows(spark):
    folder, out, checkpoint = (scratch_dir(spark, n) for n in ("log", "out", "ckpt"))
    log(spark, []).write.parquet(folder)
    drain(polled.stream_polled_changes(spark, folder, 0, at(1).isoformat()), out, checkpoint)
    assert spark.read.schema(CHANGE_LOG).parquet(out).count() == 0 if __import__("os").path.exists(out) else True
