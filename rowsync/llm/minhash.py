"""Near-duplicate documents by HyperMinHash sketches, banding and verification.

A document's set holds the hashes of its distinct five-word shingles. Its sketch
has 256 buckets (the hash's top byte); each keeps the least hash of the bucket
as a leading-zero count and 26 mantissa bits, four bytes in all (with ten bits the
sparse bands of short documents collided by chance and chained into one cluster). Documents of
equal sets form a class; classes are compared, copies are not.

1. For banding, each empty bucket borrows the register of the first filled one in
   an order of its own (one fixed pseudorandom order a bucket), so that registers
   agree about as often as the Jaccard similarity says, also of short documents;
   without it, one common passage filled whole bands of them and chained thousands.
   The sketch is cut into 32 bands of eight registers; a bucket is the classes
   that share a band. Its smallest class is its leader.
2. Every member is confirmed against its leaders on the full sets, in units of one
   leader and at most about ``BLOCK`` members. Confirmed links make groups.
3. Only buckets that still hold two groups are compared further: chains of them make
   clusters, compared in units of two blocks of about ``BLOCK`` members, so that
   one of any size is split over tasks. Pairs of one group need no test. The
   collision-corrected estimate of the Jaccard similarity (HyperMinHash, Yu and
   Weber) rejects a pair only where it is more than six standard deviations too low;
   all others are confirmed on the full sets. A unit reports fewer links than
   members.

No pair of a bucket goes untested unless confirmed links already join it, so
components are those of all links that banding finds. A pair at 0.85 is missed
by all 32 bands with probability (1 - 0.85^8)^32, about 4e-5; chains of copies
lower that further. What is compared within a cluster of near texts that do
not link grows with the square of their number, rows do not.

Defined results: null or empty text, or white space, has an empty set and links
with nothing. Rows that repeat an id are one document: what one of them links
to, the other does too. A null id gets its n_shingles, a null component and is
kept. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, joined, mix, sequence_hash, slices, translation, words, written
from .components import connected_components

SHINGLE, NUM, DEN = 5, 85, 100  # linked: DEN * intersection >= NUM * union
BUCKETS, BANDS, MANTISSA = 256, 32, 26
BLOCK = 1024
# Word bytes: all but space, tab, line feed, vertical tab, form feed, return.
WORDS = translation({b for b in range(256) if b != 32 and not 9 <= b <= 13})
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56)
# HyperMinHash: expected share of chance collisions of unrelated registers.
CHANCE = 0.169919487159739093975315012348


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, np.uint32)
    if not len(s):
        return out
    at = np.searchsorted(s, _EDGES)
    at[at == len(s)] = len(s) - 1
    least = s[at]  # sorted, so the first of a bucket is its least
    full = (least >> np.uint64(56)) == np.arange(BUCKETS, dtype=np.uint64)
    rest = ((least & np.uint64((1 << 56) - 1)) >> np.uint64(3)).astype(np.float64)  # 53 bits: exact
    part, power = np.frexp(rest)  # part in [0.5, 1): its bits after the first are the mantissa
    zeros = np.where(rest > 0, 53 - power, 60)
    bits = np.where(rest > 0, np.floor((part * 2 - 1) * (1 << MANTISSA)), 0)
    return np.where(full, ((zeros + 1).astype(np.int64) << MANTISSA) + bits.astype(np.int64), 0).astype(np.uint32)


# For each bucket, the order in which it asks the others, and their places in it.
ORDER = np.argsort(mix(np.arange(1, BUCKETS * BUCKETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(BUCKETS, BUCKETS), axis=1)
PLACE = np.argsort(ORDER, axis=1)
ASKED = 12  # steps taken by all sketches at once; rows still lacking go one by one


def densify(reg: np.ndarray) -> np.ndarray:
    """Sketches whose empty buckets borrow from filled ones (none: left empty)."""
    out = reg.copy()
    row, at = np.nonzero((reg == 0) & (reg > 0).any(axis=1)[:, None])
    for step in range(ASKED):
        lent = reg[row, ORDER[at, step]]
        hit = lent > 0
        out[row[hit], at[hit]] = lent[hit]
        row, at = row[~hit], at[~hit]
    cut = np.flatnonzero(np.diff(row)) + 1
    for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(row)]):
        if z > a:
            full = np.flatnonzero(reg[row[a]])
            out[row[a], at[a:z]] = reg[row[a], full[PLACE[at[a:z]][:, full].argmin(axis=1)]]
    return out


def estimate(same: np.ndarray, filled: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate from equal and filled registers."""
    ratio = np.minimum(n, m) / np.maximum(np.maximum(n, m), 1)
    chance = CHANCE * 2.0 ** -MANTISSA * 4 * ratio / (1 + ratio) ** 2 * filled
    return np.maximum(same - chance, 0) / np.maximum(filled - chance, 1e-9)


def may_link(same, filled, n, m) -> np.ndarray:
    """Whether the estimate leaves a link possible (six standard deviations)."""
    j = NUM / DEN
    return estimate(same, filled, n, m) >= j - 6 * np.sqrt(j * (1 - j) / np.maximum(filled, 1)) - 1e-9


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw, starts = joined(texts, WORDS)
    w, a, _ = words(raw)
    edge = np.searchsorted(a, starts)
    h = sequence_hash(w, SHINGLE)
    out = []
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if y - x >= SHINGLE:
            out.append(np.unique(h[x:y - SHINGLE + 1]))
        else:
            out.append(sequence_hash(w[x:y], y - x) if y > x else np.zeros(0, np.uint64))
    return out


def band_keys(reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, whether any register of the band is filled) of sketches."""
    wide = np.ascontiguousarray(reg).view(np.uint64).reshape(len(reg), BANDS, -1)
    key = np.zeros(wide.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(wide.shape[2]):
            key = mix(key * np.uint64(31) + wide[:, :, j])
    return key, wide.any(axis=2)


def _digest(s: np.ndarray, salt: int = 0) -> int:
    with np.errstate(over="ignore"):
        return int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64).view(np.int64))


def _sketches(batches):
    for b in slices(batches, "text"):
        sets = shingle_sets(as_bytes(b.column("text")))
        d1, d2 = [_digest(s) for s in sets], [_digest(s, 0x5851F42D4C957F2D) for s in sets]
        key, filled = band_keys(densify(np.array([sketch(s) for s in sets]).reshape(-1, BUCKETS)))
        ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)  # an empty set has no band
        bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(key[filled].view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), bands],
            ["doc_id", "n", "d1", "d2", "bands"])


def _sets(batches):
    for b in slices(batches, "text"):
        sets = shingle_sets(as_bytes(b.column("text")))
        d1 = [_digest(s) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()),
                                          pa.array([s.tobytes() for s in sets], pa.binary())], ["rep", "n", "size", "d1", "members"])


def linked(both, n, m) -> np.ndarray:
    return DEN * both >= NUM * (n + m - both)


def _confirm(key, rows):
    """Links of a leader with the members of one unit."""
    leader = key[0].as_py()
    rep = np.asarray(rows.column("rep"))
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    reg, flat, found = np.array([sketch(x) for x in sets]).reshape(-1, BUCKETS), np.concatenate(sets), []
    for h in np.flatnonzero(rep == leader).tolist():  # one, unless its id repeats
        head, own = sets[h], reg[h]
        near = (rep != leader) & may_link(((reg == own) & (own > 0)).sum(axis=1), ((reg | own) > 0).sum(axis=1), n, len(head))
        at = np.minimum(np.searchsorted(head, flat), len(head) - 1)
        both = np.add.reduceat((head[at] == flat).astype(np.int64), np.cumsum(n) - n)
        found += rep[near & linked(both, n, len(head))].tolist()
    return pa.table({"a": pa.array([leader] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})


def _compare(key, rows):
    """Links that join groups within one unit: a block with itself, or with another."""
    lo, hi = key[1].as_py(), key[2].as_py()
    rows = rows.sort_by("rep")
    side, rep, group = (np.asarray(rows.column(c)).copy() for c in ("side", "rep", "label"))
    if len(np.unique(group)) < 2:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("members").to_pylist()]
    n = np.array([len(x) for x in sets], np.int64)
    reg = np.array([sketch(x) for x in sets]).reshape(-1, BUCKETS)
    # where each shingle of the unit occurs
    shingle = np.unique(np.concatenate(sets), return_inverse=True)[1]
    edge = np.concatenate([[0], np.cumsum(n)])
    holder = np.repeat(np.arange(len(rep)), n)[np.argsort(shingle, kind="stable")]
    posting = np.concatenate([[0], np.cumsum(np.bincount(shingle))]).tolist()
    a, b = [], []
    left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
    for i in left.tolist():
        other = right if lo != hi else right[rep[right] > rep[i]]
        other = other[(group[other] != group[i]) & (DEN * np.minimum(n[other], n[i]) >= NUM * np.maximum(n[other], n[i]))]
        if not len(other):
            continue
        same = ((reg[other] == reg[i]) & (reg[i] > 0)).sum(axis=1)
        other = other[may_link(same, ((reg[other] | reg[i]) > 0).sum(axis=1), n[other], n[i])]
        if not len(other):
            continue
        met = [holder[posting[x]:posting[x + 1]] for x in shingle[edge[i]:edge[i + 1]].tolist()]
        both = np.bincount(np.concatenate(met), minlength=len(rep))[other]
        for j in other[linked(both, n[other], n[i])].tolist():
            if group[i] != group[j]:
                group[group == group[j]] = group[i]
                a.append(rep[i])
                b.append(rep[j])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(docs.mapInArrow(_sketches, "doc_id long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    filled = sketches.filter("n > 0 AND doc_id IS NOT NULL")
    reps = written(filled.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep")), "classes")
    # copies: each distinct id and class once
    copies = filled.select("doc_id", "d1", "d2", "n").join(reps, ["d1", "d2", "n"]).select(
        F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    own = filled.join(reps.select("rep", *[F.col(c).alias(f"_{c}") for c in ("d1", "d2")]),
                      (F.col("doc_id") == F.col("rep")) & (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")))
    buckets = written(own.select("rep", "n", F.explode("bands").alias("bucket")).distinct(), "bands")
    heads = buckets.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = written(buckets.join(heads, "bucket").select("bucket", "rep", "n", "head"), "shared")
    fits = f"rep <> head.rep AND {DEN} * least(n, head.n) >= {NUM} * greatest(n, head.n)"
    star = written(shared.filter(fits).select(F.col("head.rep").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    # an id may repeat with another text: it has the sets of all that are as large
    named = shared.select("rep", "n").distinct()
    texts = docs.join(named, F.col("doc_id") == F.col("rep")).select("rep", "n", "text")
    sets = written(texts.mapInArrow(_sets, "rep long, n long, size long, d1 long, members binary").filter("n = size").dropDuplicates(["rep", "d1"]).select("rep", "members"), "sets")

    parts = star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    pairs = star.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    units = pairs.select("a", "part", F.col("b").alias("rep")).unionByName(pairs.select("a", "part", F.col("a").alias("rep")).distinct())
    links = written(units.join(sets, "rep").select("a", "part", "rep", "members").groupBy("a", "part").applyInArrow(_confirm, "a long, b long"), "links")

    groups = connected_components(links).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    shared = shared.select("bucket", "rep").join(groups, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    open_ = shared.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    shared = written(shared.join(open_, "bucket").select("rep", "label", "low").distinct(), "open")
    clusters = connected_components(shared.select(F.col("low").alias("a"), F.col("label").alias("b"))).withColumnRenamed("component", "cluster")
    info = shared.select("rep", "label").distinct().join(clusters, F.col("label") == F.col("node")).drop("node")
    sizes = info.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    info = info.join(sizes, "cluster").withColumn("side", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    members = info.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = members.select("cluster", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rep", "label", "members")
    more = written(units.groupBy("cluster", "lo", "hi").applyInArrow(_compare, "a long, b long"), "links")
    joined_ = connected_components(links.unionByName(more).unionByName(copies))
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(joined_, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
