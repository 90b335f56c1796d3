"""The change log as a stream polled from a table, by sequence.

A Python data source (``spark.readStream.format("change_log_poll")``). The offset is
the sequence up to which the log is read, with the safety window it was read under.
It is prefix-safe: it stops before the first change that is still inside the window,
so a low sequence committed late, but within the window, is never stepped over.

How far the log is safe is read from the Parquet footers: row groups whose newest
change is old count by their statistics, only those with young changes are read (two
columns). Footers of known files are kept, so a poll costs what is new. A batch is
split by sequence ranges, which its tasks push into their scans as Arrow batches; no
row passes through the driver.

Options: ``path`` (a folder of Parquet files of the change log, any file system
pyarrow knows), ``window_ms``, ``as_of`` (reading time as text, now by default) and
``rows_per_partition``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..schemas import CHANGE_LOG

FORMAT = "change_log_poll"
_COLUMNS = [f.name for f in CHANGE_LOG.fields]


def _dataset(path: str) -> ds.Dataset:
    if ":" in path.split("/")[0]:
        fs, path = pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        fs = pafs.LocalFileSystem()
    return ds.dataset(path, filesystem=fs, format="parquet")


class SeqRange(InputPartition):
    """Changes with lo < seq <= hi."""

    def __init__(self, lo: int, hi: int):
        super().__init__(f"{lo}-{hi}")
        self.lo, self.hi = lo, hi


class _Groups:
    """What the footers say: per file the row groups' (largest seq, newest change)."""

    def __init__(self):
        self.files: dict[str, list[tuple[int, dt.datetime | None]]] = {}

    def read(self, data: ds.Dataset):
        for piece in data.get_fragments():
            if piece.path not in self.files:
                piece.ensure_complete_metadata()
                names = piece.physical_schema.names
                at_seq, at_time = names.index("seq"), names.index("changed_at")
                self.files[piece.path] = [self._group(g, at_seq, at_time) for g in (piece.metadata.row_group(i) for i in range(piece.metadata.num_row_groups))]
            yield piece, self.files[piece.path]

    @staticmethod
    def _group(group, at_seq: int, at_time: int) -> tuple[int, dt.datetime | None]:
        seq, time = group.column(at_seq).statistics, group.column(at_time).statistics
        newest = time.max if time is not None and time.has_min_max else None  # unknown: must be read
        return (seq.max if seq is not None and seq.has_min_max else None), newest


class ChangeLogPollReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.window_ms = int(options.get("window_ms", "0"))
        self.as_of = options.get("as_of")
        self.rows = int(options.get("rows_per_partition", "1000000"))
        self.groups = _Groups()
        self.reached = 0

    def initialOffset(self) -> dict:
        return {"seq": 0, "window_ms": self.window_ms}

    def safe_seq(self) -> int:
        """The last sequence before the first change inside the window."""
        now = dt.datetime.fromisoformat(self.as_of) if self.as_of else dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        cutoff = now - dt.timedelta(milliseconds=self.window_ms)
        last, young = 0, None
        for piece, groups in self.groups.read(_dataset(self.path)):
            unread = []
            for i, (seq, newest) in enumerate(groups):
                if seq is not None and newest is not None and newest <= cutoff:
                    last = max(last, seq)
                else:
                    unread.append(i)
            if not unread:
                continue
            for batch in piece.subset(row_group_ids=unread).to_batches(columns=["seq", "changed_at"]):
                seq = batch.column("seq")
                is_young = pa.compute.greater(batch.column("changed_at"), pa.scalar(cutoff, batch.column("changed_at").type))
                old, new = seq.filter(pa.compute.invert(is_young)), seq.filter(is_young)
                if len(old):
                    last = max(last, pa.compute.max(old).as_py())
                if len(new):
                    least = pa.compute.min(new).as_py()
                    young = least if young is None else min(young, least)
        return last if young is None else min(last, young - 1)

    def latestOffset(self) -> dict:
        self.reached = max(self.reached, self.safe_seq())
        return {"seq": self.reached, "window_ms": self.window_ms}

    def partitions(self, start: dict, end: dict) -> list[SeqRange]:
        lo, hi = start["seq"], end["seq"]
        self.reached = max(self.reached, lo)  # after a restart: never behind what was read
        return [SeqRange(a, min(a + self.rows, hi)) for a in range(lo, hi, self.rows)]

    def read(self, partition: SeqRange) -> Iterator[pa.RecordBatch]:
        seq = ds.field("seq")
        yield from _dataset(self.path).to_batches(columns=_COLUMNS, filter=(seq > partition.lo) & (seq <= partition.hi))


class ChangeLogPoll(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self):
        return CHANGE_LOG

    def streamReader(self, schema) -> ChangeLogPollReader:
        return ChangeLogPollReader(self.options)


def stream_polled_changes(spark: SparkSession, path: str, window_ms: int, as_of: str | None = None,
                          rows_per_partition: int | None = None) -> DataFrame:
    """The change log under ``path`` as a prefix-safe stream."""
    spark.dataSource.register(ChangeLogPoll)
    r = spark.readStream.format(FORMAT).option("path", path).option("window_ms", str(window_ms))
    if as_of is not None:
        r = r.option("as_of", as_of)
    if rows_per_partition is not None:
        r = r.option("rows_per_partition", str(rows_per_partition))
    return r.load()
