"""Removal of repeated byte strings by longest-previous-factor arrays.

Each byte of a text that lies in a string of ``length`` bytes which also starts
earlier in the corpus (smaller id, or same document and earlier start) goes; the
first of all copies stays. The corpus is one ordered text; no match crosses
documents. A position starts a repeat where its longest previous factor (the
longest match with an earlier position) reaches ``length``.

To compare only what can match, every window of ``length`` bytes names an
anchor: the k-gram of least hash within it, the leftmost of equals. Equal
windows have equal anchors, so the windows of one anchor k-gram are a shard of
the suffix order that can be judged by itself.

1. Consecutive windows of one anchor are a run; a run whose anchor hash is a
   multiple of ``CHUNK`` begins a chunk. Equal chunks (digests) are grouped, and
   every later one is a repeat as a whole: long copies end here. The other
   chunks' runs are counted by anchor hash; hashes met once are done with.
2. Documents that have other runs give the runs' text (segments). Equal segments
   are reduced to the first by partial aggregation; every later one is a repeat
   as a whole. So digests only shrink exact copies.
3. The distinct segments of an anchor are a shard: their windows in suffix order
   (prefix doubling from 8 bytes up to ``length``), the common prefixes of
   neighbours, and, by one pass with a stack, for each window the previous and
   next one in suffix order that lies earlier in the corpus (PSV, NSV). The longer
   of the two common prefixes is its longest previous factor; a window whose
   factor reaches ``length`` is a repeat.
4. An anchor with more than ``group`` distinct segments is split: its windows go
   on alone, keyed by their text, and partial aggregates find the first of each.

Defined results: null or empty text has no bytes and nothing removed. Rows that
repeat an id are one document to the order (neither is earlier), each judged by
its own text; so repeated rows get equal results. Null ids come last. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_HASH, as_bytes, discard, mix, slices, written

LENGTH, GRAM = 100, 24
GROUP, CHUNK = 16_384, 32
_LAST = (1 << 63) - 1
_POSITION = np.uint64(21)  # a piece is shorter than 2^21
PIECE = 1 << 18
LOT = 1 << 19  # bytes of segments judged, or cut, at a time
_MULTIPLIER = 0xD6E8FEB86659FD93


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Hashes of all k-byte strings, by doubling."""
    with np.errstate(over="ignore"):
        by_bit, size, have = {}, 1, BYTE_HASH[b]
        while size <= k:
            by_bit[size] = have
            if size * 2 > k:
                break
            have = have[: len(have) - size] * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + have[size:]
            size *= 2
        out, done = None, 0
        n = len(b) - k + 1
        for size in sorted(by_bit, reverse=True):
            if k - done >= size:
                part = by_bit[size][done: done + n]
                out = part if out is None else out * np.uint64(pow(_MULTIPLIER, size, 1 << 64)) + part
                done += size
        return mix(out)


def runs_of(b: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, number of windows) of the runs of one piece."""
    n = len(b) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = gram_hashes(b, k)
    low = (h >> _POSITION << _POSITION) | np.arange(len(h), dtype=np.uint64)
    size, span = 1, length - k + 1
    while size * 2 <= span:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size:])
    anchor = (low & np.uint64((1 << 21) - 1)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1])
    return h[anchor[first]], first, np.diff(np.concatenate([first, [n]]))


def _text_runs(t: bytes, length: int):
    """Runs of a whole text, piece by piece (a piece shares length - 1 bytes with the next)."""
    b = np.frombuffer(t, np.uint8)
    for at in range(0, max(0, len(b) - length + 1), PIECE):
        h, first, n = runs_of(b[at: at + PIECE + length - 1], length)
        yield h, first + at, n


def _chunks(t: bytes, length: int):
    """(start, windows, anchor hashes and starts of the runs) of the chunks of a
    whole text: whole runs, up to the next run whose anchor hash is a multiple
    of CHUNK."""
    n = len(t) - length + 1
    if n <= 0:
        return
    found = list(_text_runs(t, length))
    h, first = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    edge = np.unique(np.concatenate([[0], first[h % np.uint64(CHUNK) == 0], [n]]))
    at = np.searchsorted(first, edge).tolist()
    edge = edge.tolist()
    for k in range(len(edge) - 1):
        yield edge[k], edge[k + 1] - edge[k], h[at[k]:at[k + 1]].view(np.int64), first[at[k]:at[k + 1]]


def _digests(t: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(t, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def suffix_order(b: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``starts`` in suffix order by their first ``length`` bytes, equal
    ones by ``order``, and the bytes (``length`` at most) that each shares with the
    one before it (0 for the first). ``length`` bytes follow each start."""
    pad = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = pad
    for size in (1, 2, 4):  # the 8 bytes from each position on, as a number
        words = words[:-size] << np.uint64(8 * size) | words[size:]
    words = words[:len(b)]
    size = min(8, length)
    ranks = {size: np.unique(words >> np.uint64(64 - 8 * size), return_inverse=True)[1]}

    def pair(size, apart):
        """Number of the first ``size`` bytes and those ``apart`` further on."""
        there = np.concatenate([ranks[size][apart:], np.zeros(min(apart, len(b)), np.int64)])
        return ranks[size] * np.int64(len(b) + 1) + there

    while size * 2 <= length:
        ranks[size * 2] = np.unique(pair(size, size), return_inverse=True)[1]
        size *= 2
    key = pair(size, length - size)[starts] if size < length else ranks[size][starts]
    suffix = np.lexsort((order, key))
    p, q = starts[suffix[:-1]], starts[suffix[1:]]
    shared = np.zeros(len(p), np.int64)
    for size in sorted(ranks, reverse=True):  # longest known lengths first
        fits = np.flatnonzero(shared + size <= length)
        same = ranks[size][p[fits] + shared[fits]] == ranks[size][q[fits] + shared[fits]]
        shared[fits[same]] += size
    left = np.flatnonzero(shared < length)
    apart = words[np.minimum(p[left] + shared[left], len(b) - 1)] ^ words[np.minimum(q[left] + shared[left], len(b) - 1)]
    more = np.zeros(len(left), np.int64)
    for k in range(1, 8):
        more += (apart >> np.uint64(64 - 8 * k)) == 0
    shared[left] = np.minimum(shared[left] + more, length)
    return suffix, np.concatenate([[0], shared])[:len(suffix)]


def previous_factors(place: list[int], shared: list[int]) -> list[int]:
    """Longest previous factors in suffix order, by one pass over positions: the
    stack holds rising positions, so what lies below an entry is its previous
    smaller value, and what pops it is its next smaller one. Equal positions are
    neither before the other."""
    out, stack = [0] * len(place), []  # entries: index, bytes shared with the entry below, with its previous smaller
    for i, now in enumerate(place):
        common = shared[i]
        while stack and place[stack[-1][0]] > now:
            j, below, psv = stack.pop()
            out[j] = max(psv, common)
            common = min(common, below)
        psv = common if stack else 0
        if stack and place[stack[-1][0]] == now:
            psv = min(common, stack[-1][2])
        stack.append((i, common if stack else 0, psv))
    for j, _, psv in stack:
        out[j] = max(out[j], psv)
    return out


def factor_lengths(text: bytes, starts: np.ndarray, order: np.ndarray, length: int = LENGTH, least: int = 1) -> np.ndarray:
    """For each start the longest match (``length`` at most) with a start of smaller
    ``order``. Matches below ``least`` bytes count as 0: neighbours that share
    less part the suffix order, and what stands alone is not passed over."""
    out = np.zeros(len(starts), np.int64)
    if not len(starts):
        return out
    suffix, shared = suffix_order(np.frombuffer(text, np.uint8), starts, order, length)
    near = np.append(shared >= least, False)
    shared = np.where(near[:-1], shared, 0)
    some = np.flatnonzero(near[:-1] | near[1:])
    out[suffix[some]] = previous_factors(order[suffix[some]].tolist(), shared[some].tolist())
    return out


def longest_previous_factor(text: bytes, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each start, whether its longest previous factor reaches ``length``."""
    return factor_lengths(text, starts, order, length, length) >= length


def _merge(spans: list) -> list:
    """Union of (start, stop) intervals."""
    out: list = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1][1] = z
        else:
            out.append([a, z])
    return out


def repeated_spans(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(ord, key, start, stop): byte intervals of documents that are repeats.
    ``docs`` has ord, key and text; ord and key name a row's text."""
    def chunks(batches):
        for b in slices(batches, "text"):
            rows = {c: [] for c in ("d1", "d2", "ord", "key", "start", "n")}
            anchors, firsts, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
            for t, o, k in zip(as_bytes(b.column("text")), b.column("ord").to_pylist(), b.column("key").to_pylist()):
                for start, n, h, first in _chunks(t, length):
                    for c, v in zip(rows, (*_digests(t[start:start + n + length - 1]), o, k, start, n)):
                        rows[c].append(v)
                    anchors.append(h)
                    firsts.append(first)
                    size.append(len(h))
            edge = pa.array(np.cumsum(size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(np.concatenate(x))) for x in (anchors, firsts)]
            yield pa.RecordBatch.from_arrays([*[pa.array(v, pa.int64()) for v in rows.values()], *lists], [*rows, "anchors", "firsts"])

    whole = written(docs.mapInArrow(chunks, "d1 long, d2 long, ord long, key long, start long, n long, anchors array<long>, firsts array<long>"), "chunks")
    often = whole.groupBy("d1", "d2").agg(F.min(F.struct("ord", "start")).alias("head"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    marked = whole.join(often, ["d1", "d2"], "left")
    later = ((F.col("head.ord") < F.col("ord")) | ((F.col("head.ord") == F.col("ord")) & (F.col("head.start") < F.col("start"))))
    copied = written(whole.select("d1", "d2", "ord", "key", "start", "n").join(often, ["d1", "d2"]).filter(later).select("ord", "key", "start", "n"), "copied")
    # the runs of all other chunks; a run ends where the next one begins
    stay = marked.filter(F.col("times").isNull() | ~later)
    run = F.explode(F.expr("arrays_zip(anchors, firsts, concat(slice(firsts, 2, size(firsts)), array(start + n)))")).alias("r")
    names = [F.col("r.anchors").alias("anchor"), "ord", "key", F.col("r.firsts").alias("first"), (F.col("r.2") - F.col("r.firsts")).alias("n")]
    runs = written(stay.select("ord", "key", run).select(*names), "runs")
    discard(whole)
    often = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("anchor")
    met = written(runs.join(often, "anchor"), "met")
    discard(runs)
    mine = met.groupBy("ord", "key").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("runs"))
    own = (F.col("ord") == F.col("_ord")) & (F.col("key") == F.col("_key"))

    def cut(batches):
        for b in slices(batches, "text", LOT):
            rows = {c: [] for c in ("anchor", "d1", "d2", "ord", "key", "first", "n", "segment")}
            for t, o, k, found in zip(as_bytes(b.column("text")), b.column("ord").to_pylist(), b.column("key").to_pylist(), b.column("runs").to_pylist()):
                for r in found:
                    s = t[r["first"]: r["first"] + r["n"] + length - 1]
                    d = _digests(s)
                    for c, v in zip(rows, (r["anchor"], *d, o, k, r["first"], r["n"], s)):
                        rows[c].append(v)
            if rows["ord"]:
                yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, {"n": pa.int32(), "segment": pa.binary()}.get(c, pa.int64())) for c in rows]))

    texts = docs.join(mine.withColumnsRenamed({"ord": "_ord", "key": "_key"}), own)
    segments = written(texts.select("ord", "key", "text", "runs").mapInArrow(
        cut, "anchor long, d1 long, d2 long, ord long, key long, first long, n int, segment binary"), "segments")

    discard(met)
    by_text = ["anchor", "d1", "d2"]
    head = F.min(F.struct("ord", "first")).alias("head")
    distinct = written(segments.groupBy(*by_text).agg(head, F.max("segment").alias("segment")), "distinct")
    # every later copy of a segment is a repeat as a whole
    later = segments.drop("segment").join(distinct.select(*by_text, "head"), by_text).filter(
        (F.col("head.ord") < F.col("ord")) | ((F.col("head.ord") == F.col("ord")) & (F.col("head.first") < F.col("first"))))
    later = later.select("ord", "key", F.col("first").alias("start"), (F.col("first") + F.col("n") + length - 1).alias("stop"))

    sizes = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    sized = distinct.join(sizes, "anchor")

    same = ["d1", "d2", "ord", "first"]  # a segment where it comes first

    def judge(batches):
        """Whole anchors (rows sorted by anchor) in lots of about ``LOT`` bytes."""
        def lot(parts):
            rows = pa.Table.from_batches(parts).combine_chunks()
            segment = rows.column("segment").combine_chunks().cast(pa.large_binary())
            text = b"".join(segment.to_pylist())
            size = pa.compute.binary_length(segment).to_numpy()
            at = np.cumsum(size) - size
            back = np.repeat(np.arange(len(size)), size - length + 1)
            starts = np.arange(len(back)) + back * (length - 1)
            first, doc = rows.column("first").to_numpy(), np.unique(rows.column("ord").to_numpy(), return_inverse=True)[1]
            order = (doc[back] << 40) + first[back] + starts - at[back]
            hit = np.flatnonzero(longest_previous_factor(text, starts, order, length))
            new = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(back[hit]) > 0)])[:len(hit)]
            a = hit[new]
            z = hit[np.append(new[1:], True)[:len(hit)]]
            row = back[a]
            begin = first[row] - at[row]
            return pa.RecordBatch.from_arrays([*[rows.column(c).combine_chunks().take(pa.array(row)) for c in same],
                                               pa.array(begin + starts[a]), pa.array(begin + starts[z] + length)], [*same, "start", "stop"])

        parts, size, now = [], 0, None
        for b in batches:
            anchor = b.column("anchor").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]]).tolist()
            filled = np.concatenate([[0], np.cumsum(pa.compute.binary_length(b.column("segment")).to_numpy())]).tolist()
            begin = 0
            for x in edges[:-1]:  # a lot may end before each anchor
                if anchor[x] != now and size + filled[x] - filled[begin] >= LOT:
                    if x > begin:
                        parts.append(b.slice(begin, x - begin))
                    yield lot(parts)
                    parts, size, begin = [], 0, x
                now = anchor[x]
            parts.append(b.slice(begin))
            size += filled[-1] - filled[begin]
        if parts:
            yield lot(parts)

    sized = sized.select("anchor", "m", "d1", "d2", F.col("head.ord").alias("ord"), F.col("head.first").alias("first"), "segment")
    small = sized.filter(F.col("m") <= group).drop("m").repartition("anchor").sortWithinPartitions("anchor")
    found = small.mapInArrow(judge, "d1 long, d2 long, ord long, first long, start long, stop long")

    def windows(batches):
        for b in slices(batches, "segment", 1 << 16):
            rows = {c: [] for c in ("w1", "w2", *same, "start")}
            for s, *place in zip(*(b.column(c).to_pylist() for c in ("segment", *same))):
                for i in range(len(s) - length + 1):
                    for c, v in zip(rows, (*_digests(s[i:i + length]), *place, place[-1] + i)):
                        rows[c].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([(c, pa.int64()) for c in rows]))

    alone = sized.filter(F.col("m") > group).drop("m", "anchor").mapInArrow(windows, "w1 long, w2 long, d1 long, d2 long, ord long, first long, start long")
    firsts = alone.groupBy("w1", "w2").agg(F.min(F.struct("ord", "start")).alias("head"))
    apart = alone.join(firsts, ["w1", "w2"]).filter(
        (F.col("head.ord") < F.col("ord")) | ((F.col("head.ord") == F.col("ord")) & (F.col("head.start") < F.col("start"))))
    apart = apart.select(*same, "start", (F.col("start") + length).alias("stop"))
    # the rows that have this very segment there
    heads = segments.select(*same, "key").distinct()
    named = found.unionByName(apart).distinct().join(heads, same)
    whole = copied.select("ord", "key", "start", (F.col("start") + F.col("n") + length - 1).alias("stop"))
    spans = written(whole.unionByName(later).unionByName(named.select("ord", "key", "start", "stop")), "spans")
    for done in (copied, segments, distinct):
        discard(done)
    return spans


def remove_repeats(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """doc_id, text_bytes kept (binary), n_bytes, n_removed and n_spans of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("ord"), F.xxhash64(text).alias("key"), text.alias("text"))
    spans = repeated_spans(rows.select("ord", "key", "text"), length, group)
    spans = spans.groupBy("ord", "key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def take(batches):
        for b in slices(batches, "text"):
            kept, gone, count = [], [], []
            for t, found in zip(as_bytes(b.column("text")), b.column("spans").to_pylist()):
                merged = _merge([(s["start"], s["stop"]) for s in found or ()])
                out, at = [], 0
                for a, z in merged:
                    out.append(t[at:a])
                    at = z
                out.append(t[at:])
                kept.append(b"".join(out))
                gone.append(len(t) - len(kept[-1]))
                count.append(len(merged))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(k) + g for k, g in zip(kept, gone)], pa.int64()), pa.array(gone, pa.int64()),
                                              pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    spans = spans.withColumnsRenamed({"ord": "_ord", "key": "_key"})
    both = rows.join(spans, (F.col("ord") == F.col("_ord")) & (F.col("key") == F.col("_key")), "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(take, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def repeats_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
