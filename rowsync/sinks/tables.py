"""Table layout of the sinks on plain Parquet (no MERGE/UPDATE needed).

* documents: append-only log partitioned by ``mode/batch_id``; a batch (of a backfill:
  a wave) writes only its own partition with dynamic overwrite, so a replayed batch replaces
  itself, and folders grow with batches, not with key ranges or rows. Current state = highest version per id (commutative, idempotent,
  hence backfill/incremental order does not matter). ``compact()`` folds the
  log into a new base generation partitioned by ``bucket`` (hash of the id)
  so point reads and the version gate prune files; ``vacuum()`` later deletes
  what it folded. A batch written in between is kept.
* events: append what is absent (anti join on event_id); readers dedupe on
  event_id, so a torn append is harmless. Never overwritten by batch (a replay
  re-reads the current row, which may have moved on).
* outcomes: one row per record and batch, partition-overwritten by batch; a wave's rows
  keep the batch id of their key range in a column.
* dlq: an event log (reject / resolve / bump rows, partitioned by batch) folded
  into the keyed state by an aggregate, in the order batches began writing
  (``commit_seq``), not of the times in their data.
* consumer_dlq: malformed deliveries, partition-overwritten by batch (keyed by
  batch id: a failed flush cannot duplicate them).
* progress: one row per finished backfill key range or committed batch.
* runs: target and layout of each backfill run, fixed when it first starts.
* counters: what each attempt of a batch wrote, observed on its writes.

Jobs may run at once: every append goes to a folder of its mode (two appends to
one folder would share its ``_temporary``), every overwrite stages under a name of its
own, and commit sequences come from the clock, not from a table read before a write.

A batch that is repeated clears its own partitions first (``begin_attempt``
tells), so it replaces its rows also where it now writes none.
"""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.events import sketch_columns
from ..operators.gate import current_state
from ..schemas import CONSUMED_EVENTS, CONSUMER_DLQ, OUTCOMES, PRODUCTS
from ..session import scratch_dir

DEFAULT_BUCKETS = 64
DLQ_LOG_SCHEMA = "sink string, record_id long, version long, payload string, error string, batch_id string, " \
                 "mode string, kind string, attempts int, status string, updated_at timestamp_ntz, commit_seq long"
ATTEMPTS_SCHEMA = "mode string, batch_id string, attempt int, started_at timestamp_ntz, commit_seq long"
COUNTERS_SCHEMA = "job string, mode string, batch_id string, attempt int, counts map<string,bigint>"
RUNS_SCHEMA = "run_id string, target_max_id long, range_width long, ranges_per_wave long, created_at timestamp_ntz"
PROGRESS_SCHEMA = "mode string, run_id string, batch_id string, range_id long, last_id long, " \
                  "target_max_id long, cursor_seq long, committed_at timestamp_ntz"


_clock_lock, _clock_last = threading.Lock(), [0]


def next_commit_seq() -> int:
    """The clock in microseconds, never twice and never backwards in a driver."""
    with _clock_lock:
        _clock_last[0] = max(time.time_ns() // 1000, _clock_last[0] + 1)
        return _clock_last[0]


def metrics_of(seen: Observation) -> dict:
    """What was observed on a write that has ended. A plan that proves empty while it
    runs drops its counters and leaves a row without columns, which PySpark cannot
    convert: nothing was counted."""
    try:
        return dict(seen.get)
    except Py4JJavaError:
        return {}


def observed(df: DataFrame, **counts: Column) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df`` with counters on its plan, and a function that reads them after the
    write that runs it: counting costs no job of its own."""
    seen = Observation()
    out = df.observe(seen, *[c.alias(n) for n, c in counts.items()])

    def read() -> dict[str, int]:
        got = metrics_of(seen)
        return {n: int(got.get(n) or 0) for n in counts}
    return out, read


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def empty_frame(spark: SparkSession, schema) -> DataFrame:
    """An empty DataFrame the optimizer can see is empty (a pruned filter
    becomes an empty local relation), so joins and aggregates over a table
    that has no data yet are removed at planning time instead of shuffling."""
    st = spark.createDataFrame([], schema).schema
    return spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields]).where(F.lit(False))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (works on any shared store)."""
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _has_data(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return any(not st.getPath().getName().startswith(("_", ".")) for st in fs.listStatus(p))


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def path_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def data_files(spark: SparkSession, path: str) -> int:
    """Number of data files of a folder without partitions."""
    return sum(not c.startswith(("_", ".")) for c in _children(spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Attempt:
    """``number`` 1 is the first attempt of a batch, a higher one a replay;
    ``commit_seq`` grows from one attempt to the next, whatever the batch."""

    number: int
    commit_seq: int


@dataclass
class Tables:
    """All sink tables of one replication under ``root`` (a shared folder)."""

    spark: SparkSession
    root: str
    buckets: int = DEFAULT_BUCKETS

    @classmethod
    def fresh(cls, spark: SparkSession, name: str = "tables", buckets: int = DEFAULT_BUCKETS) -> "Tables":
        return cls(spark, scratch_dir(spark, name), buckets)

    def path(self, t: str) -> str:
        return f"{self.root}/{t}"

    def clear(self, t: str, **partition: str) -> None:
        """Delete one partition folder of ``t`` (a repeated batch's earlier rows), and
        the folders above it that hold nothing else: a table of folders without
        files would be read without its partition columns."""
        parts = [f"{k}={v}" for k, v in partition.items()]
        _delete(self.spark, "/".join([self.path(t), *parts]))
        while parts:
            parts.pop()
            above = "/".join([self.path(t), *parts])
            if not path_exists(self.spark, above) or any(not c.startswith(("_", ".")) for c in _children(self.spark, above)):
                break
            _delete(self.spark, above)

    def _read(self, t: str, schema) -> DataFrame:
        # re-created on every call: file listings of growing tables are cached per DataFrame
        if not _has_data(self.spark, self.path(t)):
            return empty_frame(self.spark, schema)
        return self.spark.read.schema(schema).option("basePath", self.path(t)).parquet(self.path(t))

    # ------------------------------------------------------------ documents
    DOC_LOG_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in PRODUCTS.fields) + \
        ", bucket int, mode string, batch_id string"

    def _base_generations(self) -> list[int]:
        """Committed base generations, oldest first (``_SUCCESS`` is written last)."""
        names = _children(self.spark, self.path("docs_base"))
        return sorted(int(g[4:]) for g in names if g.startswith("gen=")
                      and path_exists(self.spark, f"{self.path('docs_base')}/{g}/_SUCCESS"))

    def _base(self) -> DataFrame:
        gens = self._base_generations()
        return self._read(f"docs_base/gen={gens[-1]}" if gens else "docs_base/none", self.DOC_LOG_SCHEMA)

    def doc_log(self) -> DataFrame:
        return self._base().unionByName(self._read("docs", self.DOC_LOG_SCHEMA))

    def docs(self) -> DataFrame:
        """Current documents: highest version per id."""
        log = self.doc_log().drop("mode", "batch_id", "bucket")
        return current_state(log)

    def doc(self, doc_id: int) -> DataFrame:
        """One document: only its bucket of the base is read, and the log with the id
        pushed into its scan."""
        key = F.lit(doc_id).cast("long")
        mine = self._base().where(F.col("bucket") == bucket_of(key, self.buckets)).unionByName(self._read("docs", self.DOC_LOG_SCHEMA))
        return current_state(mine.where(F.col("id") == key).drop("mode", "batch_id", "bucket"))

    def write_docs(self, accepted: DataFrame, mode: str, batch_id: str) -> None:
        """Write accepted documents into their batch's partition."""
        rows = (accepted.select(*[c.name for c in PRODUCTS.fields], F.lit(batch_id).alias("batch_id"))
                .withColumn("bucket", bucket_of(F.col("id"), self.buckets))
                .withColumn("mode", F.lit(mode)))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("mode", "batch_id").parquet(self.path("docs")))

    def seed_docs(self, docs: DataFrame) -> None:
        """Start the document sink from an existing state (a base generation)."""
        cols = []
        for f in PRODUCTS.fields:
            cols.append(F.col(f.name).cast(f.dataType) if f.name in docs.columns
                        else F.lit(None).cast(f.dataType).alias(f.name))
        rows = docs.select(*cols).withColumn("bucket", bucket_of(F.col("id"), self.buckets)) \
                   .withColumn("mode", F.lit("seed")).withColumn("batch_id", F.lit("seed"))
        self._write_base(rows, 0)

    def _write_base(self, rows: DataFrame, gen: int) -> None:
        # a bucket is one task's file until it is large: AQE then splits it by size
        (rows.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy("bucket").parquet(f"{self.path('docs_base')}/gen={gen}"))

    def compact(self) -> None:
        """Fold base + log into the next base generation (highest version per
        id). Its ``_SUCCESS`` file commits it; nothing is edited or deleted.

        The log files that were folded are recorded first. They stay readable
        (folding twice gives the same state, the highest version), so readers of
        the old generation go on, a batch written meanwhile is not touched, and
        a stop at any point loses nothing; ``vacuum()`` deletes them later."""
        log = self._read("docs", self.DOC_LOG_SCHEMA)
        files = log.inputFiles()  # the listing that the fold below reads
        gens = self._base_generations()
        gen = gens[-1] + 1 if gens else 1
        if files:
            (self.spark.createDataFrame([(f,) for f in files], "file string").coalesce(1)
             .write.mode("overwrite").parquet(f"{self.path('docs_folded')}/gen={gen}"))
        state = current_state(self._base().unionByName(log).drop("mode", "batch_id", "bucket"))
        self._write_base(state.withColumn("bucket", bucket_of(F.col("id"), self.buckets))
                         .withColumn("mode", F.lit("seed")).withColumn("batch_id", F.lit("compacted")), gen)

    def vacuum(self) -> None:
        """Delete what committed compactions replaced: the log files they folded
        and all generations but the newest. Run it when no reader of an older
        state is left. A batch repeated since then has files of other names,
        which stay."""
        gens = self._base_generations()
        for g in _children(self.spark, self.path("docs_folded")):
            if int(g[4:]) in gens:
                folded = self.spark.read.schema("file string").parquet(f"{self.path('docs_folded')}/{g}")
                for r in folded.toLocalIterator():
                    _delete(self.spark, unquote(r["file"]))  # paths come URL-encoded
                _delete(self.spark, f"{self.path('docs_folded')}/{g}")
        for g in gens[:-1]:
            _delete(self.spark, f"{self.path('docs_base')}/gen={g}")

    # ------------------------------------------------------------ events
    def events_raw(self) -> DataFrame:
        return self._read("events", ", ".join(f"{f.name} {f.dataType.simpleString()}"
                                              for f in CONSUMED_EVENTS.fields) + ", bucket int")

    def events(self) -> DataFrame:
        """Event store, unique on event_id (a torn append cannot show twice)."""
        raw = self.events_raw().drop("bucket")
        rest = [c for c in raw.columns if c != "event_id"]
        first = F.min_by(F.struct(*rest), F.struct("consumed_at", "version"))
        return raw.groupBy("event_id").agg(first.alias("_e")).select("event_id", *[F.col(f"_e.{c}").alias(c) for c in rest])

    EVENTS_PER_FILE = 1_000_000

    def append_events(self, rows: DataFrame, small: bool = False, n_rows: int = 0) -> int:
        """Append rows whose event_id is not stored yet; returns how many.

        The store is partitioned by a hash bucket of event_id. With ``small``
        (the caller counted the batch: ``session.fits_broadcast``) the batch's
        ids are broadcast into a semi join with the store, which prunes the
        store to the touched buckets and finds the ids already present; the
        batch is then anti-joined with that small set. Otherwise AQE picks the
        join from runtime sizes. ``n_rows`` is the batch's counted size (at most)."""
        ids = rows.select("event_id", bucket_of(F.col("event_id"), self.buckets).alias("bucket")).distinct()
        probe = F.broadcast(ids) if small else ids
        present = self.events_raw().join(probe, ["bucket", "event_id"], "left_semi").select("event_id")
        new = (rows.join(present, "event_id", "left_anti").select(*CONSUMED_EVENTS.fieldNames())
               .withColumn("bucket", bucket_of(F.col("event_id"), self.buckets)))
        # one file per touched bucket and flush, not one per task and bucket
        # (event ids are unique here and hashed, so the buckets are even)
        seen = Observation()
        new = new.observe(seen, *[c.alias(n) for n, c in sketch_columns().items()])
        # a large flush writes a bucket as several files, so a task's share does not grow
        # with the flush
        files = max(1, -(-n_rows // (self.buckets * self.EVENTS_PER_FILE)))
        at = ["bucket"] if files == 1 else [self.buckets * files, "bucket", F.pmod(F.xxhash64("event_id", F.lit(files)), F.lit(files))]
        new.repartition(*at).write.mode("append").partitionBy("bucket").parquet(self.path("events"))
        got = metrics_of(seen)
        if got.get("events"):
            self._write_sketches(got)
        return int(got.get("events") or 0)

    SKETCHES_SCHEMA = "events long, products binary, event_ids binary"

    def event_sketches(self) -> DataFrame:
        """One row for each append: its rows and sketches of their keys. Sketches of an
        append that was torn and repeated merge to the same, its rows count twice."""
        return self._read("event_sketches", self.SKETCHES_SCHEMA)

    def _write_sketches(self, seen: dict) -> None:
        row = self.spark.range(0, 1, 1, 1).select(F.lit(int(seen["events"])).cast("long").alias("events"), *[
            F.lit(bytearray(seen[c])).alias(c) for c in ("products", "event_ids")])
        row.write.mode("append").parquet(self.path("event_sketches"))

    # ------------------------------------------------------------ published stream
    MESSAGE_SCHEMA = "delivery_id long, message_id string, body string, published_at timestamp_ntz, batch_id string, " \
                     "mode string, op string"

    def messages(self) -> DataFrame:
        return self._read("messages", self.MESSAGE_SCHEMA)

    def stream_messages(self, max_files_per_trigger: int | None = None) -> DataFrame:
        """The published stream as a streaming DataFrame: what the consumer reads."""
        r = self.spark.readStream.schema(self.MESSAGE_SCHEMA).option("basePath", self.path("messages"))
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
        return r.parquet(self.path("messages"))

    def publish(self, events: DataFrame, batch_id: str, published_at, mode: str, attempt: int = 1) -> int:
        """Publish one message per event (routing key = op, message id =
        event_id, body = the event as JSON); returns how many. At-least-once: a
        replayed batch publishes again and the consumer absorbs the copies. The
        delivery id names one message of one attempt, so it is the same
        whenever that message is read or written again."""
        body = F.to_json(F.struct(*[F.col(c) for c in events.columns]))
        rows = events.select(F.xxhash64("event_id", F.lit(mode), F.lit(batch_id), F.lit(attempt)).alias("delivery_id"),
                             F.col("event_id").alias("message_id"), body.alias("body"), "op",
                             published_at.alias("published_at"), F.lit(batch_id).alias("batch_id"))
        rows, read = observed(rows, published=F.count(F.lit(1)))
        rows.write.mode("append").partitionBy("op").parquet(f"{self.path('messages')}/mode={mode}")
        return read()["published"]

    # ------------------------------------------------------------ outcomes
    def outcomes(self) -> DataFrame:
        return self._outcomes(self._read("outcomes", self.OUTCOMES_SCHEMA))

    OUTCOMES_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OUTCOMES.fields) + ", range_batch string"

    @staticmethod
    def _outcomes(stored: DataFrame) -> DataFrame:
        return stored.withColumn("batch_id", F.coalesce("range_batch", "batch_id")).select(*OUTCOMES.fieldNames())

    def outcomes_of(self, mode: str, batch_id: str) -> DataFrame:
        """Outcomes of one batch, read from its own partition."""
        return self._outcomes(self._read("outcomes", self.OUTCOMES_SCHEMA).where((F.col("mode") == mode) & (F.col("batch_id") == batch_id)))

    def write_outcomes(self, rows: DataFrame, wave: str | None = None) -> dict[str, int]:
        """Write a batch's outcomes; returns how many there are of each. Rows of several
        key ranges go to the partition of their ``wave``."""
        names = ("ok", "duplicate", "retry", "dlq")
        rows, read = observed(rows.select(*OUTCOMES.fieldNames()), **{n: F.count_if(F.col("outcome") == n) for n in names})
        rows = rows.withColumn("range_batch", F.col("batch_id") if wave is not None else F.lit(None).cast("string"))
        if wave is not None:
            rows = rows.withColumn("batch_id", F.lit(wave))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("mode", "batch_id").parquet(self.path("outcomes")))
        return read()

    # ------------------------------------------------------------ counters
    def counters(self) -> DataFrame:
        return self._read("counters", COUNTERS_SCHEMA)

    def write_counters(self, job: str, mode: str, batch_id: str, attempt: int, counts: dict[str, int]) -> None:
        """One row for one attempt of a batch; written again, it replaces itself."""
        pairs = F.create_map(*[x for n, v in counts.items() for x in (F.lit(n), F.lit(v).cast("long"))])
        folder = f"{self.path('counters')}/job={job}/mode={mode}/batch_id={batch_id}/attempt={attempt}"
        self.spark.range(0, 1, 1, 1).select(pairs.alias("counts")).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").parquet(folder)

    # ------------------------------------------------------------ dlq
    def dlq_log(self, exclude_log_batch: str | None = None) -> DataFrame:
        log = self._read("dlq", DLQ_LOG_SCHEMA + ", log_batch string")
        if exclude_log_batch is not None:
            log = log.where(F.col("log_batch") != exclude_log_batch)
        return log.drop("log_batch")

    def write_dlq_rows(self, rows: DataFrame, batch_id: str, commit_seq: int) -> None:
        (rows.withColumn("commit_seq", F.lit(commit_seq).cast("long")).select(*[c.split(" ")[0] for c in DLQ_LOG_SCHEMA.split(", ")])
         .withColumn("log_batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("log_batch").parquet(self.path("dlq")))

    def seed_dlq(self, state: DataFrame) -> None:
        rows = state.select("sink", "record_id", "version",
                            (F.col("payload") if "payload" in state.columns else F.lit(None).cast("string")).alias("payload"),
                            "error", "batch_id", "mode", F.lit("state").alias("kind"),
                            F.col("attempts").cast("int").alias("attempts"), "status",
                            F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
        self.write_dlq_rows(rows, "seed", 0)

    def dlq(self, exclude_log_batch: str | None = None, record_ids: DataFrame | None = None,
            id_range: tuple[int, int] | None = None) -> DataFrame:
        """Fold the DLQ log into keyed state. attempts = seeded attempts + one per
        reject or bump; status = the latest reject (open) / resolve (resolved);
        version, payload, batch and mode = the latest reject; error = latest
        reject or bump. Ordered by commit sequence: the batch that wrote last
        wins, whatever the times in its data — partial+final aggregates, no
        per-key window.

        A batch needs the state of its own ids only: ``record_ids`` (a one
        column frame for a semi join; the caller chooses the broadcast) or ``id_range`` (``lo < id <= hi``,
        pushed into the scan) restrict the log before the fold, which is exact
        because the fold is per key, so the work follows the batch, not the
        whole DLQ history."""
        log = self.dlq_log(exclude_log_batch)
        if id_range is not None:
            log = log.where((F.col("record_id") > id_range[0]) & (F.col("record_id") <= id_range[1]))
        if record_ids is not None:
            log = log.join(record_ids, "record_id", "left_semi")
        rank = F.when(F.col("kind") == "state", 0).when(F.col("kind") == "reject", 1) \
                .when(F.col("kind") == "bump", 2).otherwise(3)
        order = F.struct(F.coalesce("commit_seq", F.lit(0)).alias("seq"), F.col("updated_at"), rank.alias("r"),
                         F.col("batch_id"))
        is_rej = F.col("kind").isin("reject", "state")
        is_status = F.col("kind").isin("reject", "state", "resolve")
        is_err = F.col("kind").isin("reject", "state", "bump")
        g = log.groupBy("sink", "record_id").agg(
            F.sum(F.when(F.col("kind") == "state", F.col("attempts"))
                  .when(F.col("kind").isin("reject", "bump"), F.lit(1)).otherwise(F.lit(0))).alias("attempts"),
            F.max_by(F.when(is_rej, F.struct("version", "payload", "batch_id", "mode")),
                     F.when(is_rej, order)).alias("_rej"),
            F.max_by(F.when(is_status, F.when(F.col("kind") == "resolve", F.lit("resolved"))
                            .when(F.col("kind") == "state", F.col("status")).otherwise(F.lit("open"))),
                     F.when(is_status, order)).alias("status"),
            F.max_by(F.when(is_err, F.col("error")), F.when(is_err, order)).alias("error"),
            F.max("updated_at").alias("updated_at"))
        return g.select("sink", "record_id", F.col("_rej.version").alias("version"),
                        F.col("_rej.payload").alias("payload"), "error",
                        F.col("_rej.batch_id").alias("batch_id"), F.col("_rej.mode").alias("mode"),
                        F.col("attempts").cast("int").alias("attempts"), "status", "updated_at")

    # ------------------------------------------------------------ consumer dlq
    def consumer_dlq(self) -> DataFrame:
        return self._read("consumer_dlq", CONSUMER_DLQ)

    def write_consumer_dlq(self, rows: DataFrame, batch_id: str) -> int:
        rows, read = observed(rows, malformed=F.count(F.lit(1)))
        (rows.select(*CONSUMER_DLQ.fieldNames()).withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(self.path("consumer_dlq")))
        return read()["malformed"]

    # ------------------------------------------------------------ attempts
    def begin_attempt(self, mode: str, batch_id: str, started_at) -> Attempt:
        """Record that a batch attempt starts. A later attempt of the same batch
        is a replay, counted as absorbed. Only the batch's own folder is listed, one
        folder per attempt; the commit sequence is the clock (``next_commit_seq``)."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):  # it names folders
            raise ValueError(f"batch id {batch_id!r}: letters, digits, '_', '.' and '-' only")
        folder = f"{self.path('attempts')}/mode={mode}/batch_id={batch_id}"
        earlier = [int(c.split("=")[1]) for c in _children(self.spark, folder) if c.startswith("attempt=")]
        now = Attempt(max(earlier, default=0) + 1, next_commit_seq())
        row = self.spark.range(0, 1, 1, 1).select(started_at.cast("timestamp_ntz").alias("started_at"), F.lit(now.commit_seq).cast("long").alias("commit_seq"))
        row.write.mode("append").parquet(f"{folder}/attempt={now.number}")
        return now

    def attempts(self) -> DataFrame:
        return self._read("attempts", ATTEMPTS_SCHEMA)

    # ------------------------------------------------------------ runs
    def open_run(self, run_id: str, plan: Callable[[], tuple[int, int, int]], created_at) -> tuple[int, int, int]:
        """(target, range width, ranges a wave) of a backfill run: what its first
        start stored, else what ``plan`` gives, stored before anything is written."""
        path = f"{self.path('runs')}/run_id={run_id}"
        if not path_exists(self.spark, f"{path}/_SUCCESS"):
            target, width, per_wave = plan()
            self.spark.range(0, 1, 1, 1).select(
                F.lit(target).cast("long").alias("target_max_id"), F.lit(width).cast("long").alias("range_width"),
                F.lit(per_wave).cast("long").alias("ranges_per_wave"),
                created_at.cast("timestamp_ntz").alias("created_at")).write.mode("overwrite").parquet(path)
        r = self.runs().where(F.col("run_id") == run_id).first()
        return r["target_max_id"], r["range_width"], r["ranges_per_wave"]

    def runs(self) -> DataFrame:
        return self._read("runs", RUNS_SCHEMA)

    # ------------------------------------------------------------ progress
    def progress(self) -> DataFrame:
        return self._read("progress", PROGRESS_SCHEMA)

    def commit_progress(self, rows: DataFrame, mode: str) -> None:
        """Written last, after every sink of the batch acknowledged."""
        rows.select(*[c.split(" ")[0] for c in PROGRESS_SCHEMA.split(", ") if not c.startswith("mode ")]).write.mode("append").parquet(
            f"{self.path('progress')}/mode={mode}")
