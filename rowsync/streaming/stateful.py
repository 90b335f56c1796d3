"""Optional state-store variants: a per-key version gate kept in streaming state,
and bounded-memory duplicate removal with a watermark."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GATE_OUTPUT = "product_id long, delivery_id long, version long, outcome string"
GATE_STATE = "ids binary, max_versions binary"  # of one block, sorted by id, 8 bytes each
BLOCK_IDS = 1024  # product ids a block spans: one call and one state row serve them all
_OUT_ROWS = 65_536  # output rows per yielded frame


def _gate(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of one block of keys, each key's in delivery order: accepted iff the version
    is higher than every version of its key seen before (state keeps the maxima), else
    replay (equal) or stale (older).

    A block's rows of one micro-batch may arrive in several Arrow chunks in any order,
    so the needed columns are gathered first (24 bytes a row, one block of one
    micro-batch) and judged once, all keys together: numpy calls are per block, not
    per key."""
    chunks = [tuple(pdf[c].to_numpy(np.int64) for c in ("product_id", "delivery_id", "version")) for pdf in pdfs]
    if not chunks:
        return
    p, d, v = (np.concatenate(x) for x in zip(*chunks))
    order = np.lexsort((d, p))
    p, d, v = p[order], d[order], v[order]
    first = np.ones(len(p), bool)
    first[1:] = p[1:] != p[:-1]
    at, ids = np.cumsum(first) - 1, p[first]
    # running maximum within a key: ranks of the versions, lifted above all of the key before
    values, rank = np.unique(v, return_inverse=True)
    lift = at * len(values)
    best = values[np.maximum.accumulate(rank + lift) - lift]
    # prev[i] = highest version of the key before row i (state included); none for the very first
    prev = np.empty(len(v), np.int64)
    prev[1:] = best[:-1]
    known, tops = (np.frombuffer(x, np.int64) for x in state.get) if state.exists else (np.empty(0, np.int64),) * 2
    where = np.searchsorted(known, ids)
    had = np.zeros(len(ids), bool)
    inside = where < len(known)
    had[inside] = known[where[inside]] == ids[inside]
    before = np.zeros(len(ids), np.int64)
    before[had] = tops[where[had]]
    prev = np.where(first, before[at], np.where(had[at], np.maximum(prev, before[at]), prev))
    seen = had[at] | ~first
    outcome = np.where(seen & (v == prev), "replay", np.where(seen & (v < prev), "stale", "accepted"))
    last = best[np.append(np.flatnonzero(first)[1:], len(p)) - 1]
    all_ids = np.concatenate([known, ids])
    all_tops = np.concatenate([tops, np.where(had, np.maximum(last, before), last)])
    keep, newest = np.unique(all_ids[::-1], return_index=True)  # this batch's value of an id comes last
    state.update((keep.tobytes(), all_tops[::-1][newest].tobytes()))
    for a in range(0, len(d), _OUT_ROWS):
        b = a + _OUT_ROWS
        yield pd.DataFrame({"product_id": p[a:b], "delivery_id": d[a:b], "version": v[a:b], "outcome": outcome[a:b]})


def stateful_version_gate(events: DataFrame) -> DataFrame:
    """Gate a stream of (product_id, delivery_id, version) in the state store: one
    value per key, kept by blocks of ``BLOCK_IDS`` consecutive ids, so state is bounded
    by the number of keys and calls into Python by that of blocks."""
    block = F.floor(F.col("product_id") / F.lit(BLOCK_IDS)).cast("long")
    return (events.select("product_id", "delivery_id", "version", block.alias("block"))
            .groupBy("block")
            .applyInPandasWithState(_gate, GATE_OUTPUT, GATE_STATE, "append", GroupStateTimeout.NoTimeout))


def stream_dedupe_bounded(events: DataFrame, key: str = "event_id", event_time: str = "consumed_at",
                          delay: str = "30 days") -> DataFrame:
    """Drop repeated keys seen within the watermark delay; state older than the
    watermark is evicted, so memory stays bounded (the default path stays the
    unbounded anti join against the store)."""
    if dict(events.dtypes)[event_time] == "timestamp_ntz":
        events = events.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return events.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


# State of one row a key (duplicate removal) lies in RocksDB, on the executors' disks: the
# default store keeps every key, twice while a batch commits, as objects on their heap.
# All stores of an executor share one bounded cache; rows are not counted on each put,
# which would look every key up once more.
_STORE = "spark.sql.streaming.stateStore"
STATE_ON_DISK = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STORE}.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _with_conf(spark: SparkSession, conf: dict[str, str]):
    """Session settings for what is started inside: a stream keeps those of its start."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(df: DataFrame, out_dir: str, checkpoint: str, fmt: str = "parquet", conf: dict[str, str] | None = None) -> None:
    """Run a streaming DataFrame with availableNow into an append file sink; ``conf``
    holds for this stream only."""
    w = (df.writeStream.format(fmt).option("path", out_dir).option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True))
    with _with_conf(df.sparkSession, conf or {}):
        q = w.start()
    q.awaitTermination()


def read_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stream with its state on disk holds after its last batch."""
    with _with_conf(spark, STATE_ON_DISK):
        return spark.read.format("statestore").load(checkpoint)
