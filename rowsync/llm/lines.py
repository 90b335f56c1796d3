"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (key digest, number of documents, keeper), bucketed and
sorted by the digest, so that joins of runs with each other and with a batch
move no stored row. A new batch is counted by key, merge-joined with the runs
(its unmatched keys, the anti-join, are the ones first seen here: their keeper is
the batch's largest id) and added as a run of level 0. ``fanout`` runs of a level
are compacted into one of the next, so a key is rewritten a logarithmic number
of times.

Batches arrive by descending id. So the first batch that holds a key holds the
largest id with it, and a keeper never changes. Frequent keys are known when all
batches are in; their lines go from every document but the keeper.

Hot lines: documents are counted by partial aggregates on (key, id), then key.
Keys that hold over 1/1024 of all (key, document) pairs are at most 1,024, and
only these are broadcast to the pairs; all others are joined by shuffle.

Defined results: null text is one empty line. A null id counts as -2^63, one
document below all others; rows that repeat an id are one document, and each
gives its own row. Ids are cast to long. A text of any length is split in one
task; an empty table gives no rows. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, slices, written

LEAST_CHARS, LEAST_DOCS = 40, 5
HOT = 1024  # a key with over 1/HOT of all pairs is broadcast
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LEAST_ID = -(1 << 63)


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """Digest of a line's key, None if the key is short."""
    key = line.strip(SPACES)
    if len(key) < least_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "replace")) < least_chars:
        return None
    return hashlib.blake2b(key.translate(LOWER), digest_size=16).digest()


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64("text").alias("version"), "text")


def key_pairs(numbered: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(key, id, version of the text): the distinct long keys of every text."""
    def task(batches):
        for b in slices(batches, "text"):
            keys, row = [], []
            for i, text in enumerate(as_bytes(b.column("text"))):
                found = {line_key(x, least_chars) for x in text.split(b"\n")} - {None}
                keys += found
                row += [i] * len(found)
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("id").take(row), b.column("version").take(row)], ["key", "id", "version"])

    return numbered.select("id", "version", "text").mapInArrow(task, "key binary, id long, version long")


class LineRuns:
    """Levels of runs, each a bucketed table (key, n, keeper) in the warehouse."""

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"
        self.made = 0

    def _store(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.repartition(self.buckets, "key").write.bucketBy(self.buckets, "key").sortBy("key").format("parquet").saveAsTable(name)
        return name

    def _fold(self, names: list[str]) -> DataFrame | None:
        """Runs merged by sort-merge joins: counts add up, one run holds the keeper."""
        out = None
        for name in names:
            one = self.spark.table(name)
            if out is None:
                out = one
                continue
            more = one.select("key", F.col("n").alias("m"), F.col("keeper").alias("other")).hint("merge")
            out = out.join(more, "key", "full").select("key", F.expr("coalesce(n, 0L) + coalesce(m, 0L) AS n"), F.coalesce("keeper", "other").alias("keeper"))
        return out

    def merged(self) -> DataFrame | None:
        """One entry per key of all runs."""
        return self._fold([name for level in self.levels for name in level])

    def judged(self, counted: DataFrame) -> DataFrame:
        """A batch's (key, n, top) as entries: keeper only where no run has the key."""
        own = counted
        for level in self.levels:
            for name in level:
                known = self.spark.table(name).filter("keeper IS NOT NULL").select("key", F.lit(True).alias("known"))
                own = own.join(known.hint("merge"), "key", "left").withColumn("top", F.expr("IF(known, NULL, top)")).drop("known")
        return own.select("key", "n", F.col("top").alias("keeper"))

    def add(self, pairs: DataFrame) -> None:
        """Merge-anti-join a batch's (key, id) with the runs and add its own run.
        No later batch may hold larger ids."""
        per_doc = pairs.select("key", "id").distinct()
        counted = per_doc.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
        run = self._store(self.judged(counted))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(run)
        at = 0
        while len(self.levels[at]) >= self.fanout:
            self._compact(at)
            at += 1

    def _compact(self, at: int) -> None:
        old = self.levels[at]
        run = self._store(self._fold(old))
        if len(self.levels) == at + 1:
            self.levels.append([])
        self.levels[at] = []
        self.levels[at + 1].append(run)
        for n in old:
            self.spark.sql(f"DROP TABLE {n}")

    def drop(self) -> None:
        for level in self.levels:
            for n in level:
                self.spark.sql(f"DROP TABLE {n}")
        self.levels = []


def _bounds(numbered: DataFrame, batches: int) -> list[int]:
    """Ids that cut the table in about equal batches, ascending."""
    shares = ", ".join(str((k + 1) / batches) for k in range(batches - 1))
    found = numbered.agg(F.expr(f"percentile_approx(id, array({shares}), 1000)").alias("x")).first().x if batches > 1 else []
    return sorted(set(found or []))


def repeated_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(id, version, keys): for each text the digests of the keys whose lines go."""
    numbered = _numbered(docs)
    every = written(key_pairs(numbered, least_chars), "line-keys")
    runs, edges = LineRuns(docs.sparkSession, fanout), [None, *_bounds(numbered, batches), None]
    for low, high in reversed(list(zip(edges[:-1], edges[1:]))):
        part = every
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        runs.add(part)
    frequent = written(runs.merged().filter(F.col("n") >= least_docs), "line-frequent")
    runs.drop()
    n_pairs = every.count()
    hot = frequent.filter(F.col("n") * HOT > n_pairs).select("key", F.col("keeper").alias("hot_keeper"))
    rest = frequent.filter(F.col("n") * HOT <= n_pairs).select("key", "keeper")
    seen = every.join(F.broadcast(hot), "key", "left")
    gone = seen.filter("id <> hot_keeper").select("id", "version", "key").unionByName(
        seen.filter("hot_keeper IS NULL").join(rest, "key").filter("id <> keeper").select("id", "version", "key"))
    return gone.groupBy("id", "version").agg(F.collect_set("key").alias("keys"))


def drop_lines(docs: DataFrame, digest: bool = False, least_chars: int = LEAST_CHARS, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text of every row; its digest
    instead of the text if ``digest``."""
    gone = repeated_lines(docs, least_chars=least_chars, **how)
    both = _numbered(docs).join(gone, ["id", "version"], "left").select("doc_id", "text", "keys")
    name = "kept_sha256" if digest else "kept"

    def task(batches):
        for b in slices(batches, "text"):
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(as_bytes(b.column("text")), b.column("keys").to_pylist()):
                lines, keys = text.split(b"\n"), set(keys or ())
                stay = [x for x in lines if line_key(x, least_chars) not in keys] if keys else lines
                out = b"\n".join(stay)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", name])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(task, f"doc_id {kind}, n_lines long, n_dropped long, {name} string")


def line_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_lines(docs, digest=True)
