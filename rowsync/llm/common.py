"""Helpers shared by the operators: table access, written intermediates, and
the vectorised tokenisation used inside Arrow tasks."""

from __future__ import annotations

import shutil
import tempfile
import weakref
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

# Bytes of text that one numpy pass works on; it bounds a task's memory apart
# from the longest single document.
PIECE = 1 << 18
SLICE = 4 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this library to the executors (once a session), so that tasks can
    import it wherever the driver was started."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(made)
        _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it again: the
    lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # its shuffle files are of no further use
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


_paths: dict[int, tuple] = {}


def discard(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more: all that came of
    it is written itself."""
    ref, path = _paths.pop(id(df))
    assert ref() is df
    jvm = df.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few literal rows (no RDD or Arrow)."""
    def literal(v):
        if isinstance(v, str):
            return f"cast(X'{v.encode().hex()}' AS STRING)"
        return "NULL" if v is None else f"{v!r}D" if isinstance(v, float) else f"{v}L"

    names = [c.split() for c in schema.split(", ")]
    cast = ", ".join(f"cast({n} AS {kind}) AS {n}" for n, kind in names)
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows or [(None,) * len(names)])
    out = spark.sql(f"SELECT {cast} FROM VALUES {values} AS t({', '.join(n for n, _ in names)})")
    return out if rows else out.limit(0)


def crc_mod(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod`` (null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))), F.lit(mod))


def slices(batches, column: str, limit: int = SLICE):
    """Cut record batches so that each holds about ``limit`` bytes of ``column``."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        piece = (np.cumsum(size) - size) // limit
        cuts = np.flatnonzero(np.diff(piece)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def as_bytes(column) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2^64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        if size > PIECE * 4:  # one very long word: not kept
            return _make_powers(size)
        _powers[size] = _make_powers(size)
    return _powers[size]


def _make_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def translation(word_bytes) -> bytes:
    """A bytes.translate table: A-Z lower-cased, every byte outside
    ``word_bytes`` turned into a space."""
    low = [b + 32 if 65 <= b <= 90 else b for b in range(256)]
    return bytes(b if b in word_bytes else 32 for b in low)


def words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each maximal run of non-space bytes of ``raw``."""
    hashes, starts, ends = [], [], []
    at, n = 0, len(raw)
    while at < n:
        stop = min(n, at + PIECE)
        if stop < n:  # cut at a space, so that no word is split
            cut = raw.rfind(b" ", at, stop)
            if cut <= at:
                cut = raw.find(b" ", stop)
            stop = n if cut < 0 else cut + 1
        part = np.frombuffer(raw, np.uint8, stop - at, at)
        inside = np.empty(len(part) + 2, np.int8)
        inside[0] = inside[-1] = 0
        np.not_equal(part, 32, out=inside[1:-1].view(np.bool_))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        a, b = edge[0::2], edge[1::2]
        if len(a):
            pw, inv = powers(len(part))
            with np.errstate(over="ignore"):
                run = np.zeros(len(part) + 1, np.uint64)
                np.cumsum(BYTE_HASH[part] * pw[: len(part)], out=run[1:])
                h = (run[b] - run[a]) * inv[a]
                hashes.append(mix(h + (b - a).astype(np.uint64) * _BASE))
            starts.append(a + at)
            ends.append(b + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)


def joined(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray]:
    """All texts as one translated buffer with a space after each, and where
    each begins (one more entry at the end)."""
    raw = b" ".join(texts).translate(table) + b" "
    size = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return raw, np.concatenate([[0], np.cumsum(size)])


def sequence_hash(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive entries of ``w``."""
    if len(w) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(len(w) - n + 1, np.uint64(n), np.uint64)
        for j in range(n):
            out = out * _BASE + w[j : len(w) - n + 1 + j]
    return mix(out)
