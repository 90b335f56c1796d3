"""Benchmark decontamination as a prefix-filtered set join.

The query set is the benchmark's windows: ten consecutive words of an item, or a
whole shorter item. A window is a sequence of shingles (three words, or the
whole of a shorter window). Its shingles are ordered by how rare they are in the
corpus; as all of a window must occur, a prefix of one, the rarest, is necessary.
A document's shingles meet the prefixes; the position of the shingle within the
window fixes where the window must begin and end (length and positional bounds),
and there the words are compared, first as hashes, then as bytes.

The query set is stated, so it goes to the tasks in blocks of at most
``BLOCK`` windows (a bound on what is broadcast); each block passes over all
documents, and the hits of a document's blocks are united.

Defined results: null or empty text has no words and no hits. An item without
words has no window. Items that repeat a text are all counted; an item id that
repeats counts once; a null item id is left out of the list. Repeated documents
each get their row; null document ids are kept. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, joined, sequence_hash, slices, translation, words, written

WINDOW, SHINGLE = 10, 3
BLOCK = 500_000
FOUND = ["n_words", "runs", "items"]
# Word bytes: digits, letters and every byte of a non-ASCII character.
WORDS = translation({*range(48, 58), *range(97, 123), *range(128, 256)})
_BITS = 20


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, words): the distinct windows of every item, as normalised text."""
    def task(batches):
        for b in slices(batches, "text", 1 << 20):
            items, out = [], []
            for item, t in zip(b.column("item").to_pylist(), as_bytes(b.column("text"))):
                w = t.translate(WORDS).split()
                n = min(window, len(w))
                found = {b" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if n else ()
                items += [item] * len(found)
                out += sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array([x.decode() for x in out], pa.string())], ["item", "words"])

    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    return rows.mapInArrow(task, "item string, words string").distinct()


class Windows:
    """A block of windows, as arrays for the tasks."""

    def __init__(self, rows: list[tuple[str, str]]):
        by_text: dict[bytes, set] = {}
        for item, text in rows:
            by_text.setdefault(text.encode(), set()).add(item)
        self.text = sorted(by_text)
        self.items = [sorted(x for x in by_text[t] if x is not None) for t in self.text]
        hashes = [words(t + b" ")[0] for t in self.text]
        self.length = np.array([len(h) for h in hashes], np.int64)
        self.words = np.zeros((len(hashes), max(self.length, default=1)), np.uint64)
        for i, h in enumerate(hashes):
            self.words[i, :len(h)] = h
        self.sizes = sorted({min(SHINGLE, int(n)) for n in self.length})
        tokens = [sequence_hash(h, min(SHINGLE, len(h))) for h in hashes]
        self.tokens = np.unique(np.concatenate(tokens)) if tokens else np.zeros(0, np.uint64)
        self.per_window = tokens

    def choose(self, counts: dict[int, int]) -> None:
        """Each window's rarest shingle (ties: the smaller hash), sorted by it."""
        token, at = [], []
        for t in self.per_window:
            i = min(range(len(t)), key=lambda i: (counts.get(int(t[i]), 0), int(t[i]), i))
            token.append(t[i])
            at.append(i)
        token, at = np.array(token, np.uint64), np.array(at, np.int64)
        order = np.argsort(token, kind="stable")
        self.prefix, self.prefix_at, self.prefix_window = token[order], at[order], order
        self.per_window = None


class Members:
    """Which of many hashes are in a sorted set: a bitmap first, then a search."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.bits = np.zeros(1 << _BITS, np.bool_)
        self.bits[(known >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def where(self, h: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(i):
            return i
        k = np.searchsorted(self.known, h[i])
        k[k == len(self.known)] = 0
        return i[self.known[k] == h[i]]


def _shingles(w: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of one document, and a mask of the valid."""
    h = sequence_hash(w, n)
    return h, doc[n - 1:] == doc[:len(doc) - n + 1] if len(h) else np.zeros(0, bool)


def token_counts(docs: DataFrame, block: Windows) -> dict[int, int]:
    """How often each shingle of the block occurs in the corpus. The answer has
    at most the block's shingles, so it is bounded."""
    known = docs.sparkSession.sparkContext.broadcast((block.tokens, block.sizes))

    def task(batches):
        tokens, sizes = known.value
        members, total = Members(tokens), np.zeros(len(tokens), np.int64)
        for b in slices(batches, "text"):
            raw, starts = joined(as_bytes(b.column("text")), WORDS)
            w, a, _ = words(raw)
            doc = np.searchsorted(starts, a, "right")
            for n in sizes:
                h, ok = _shingles(w, doc, n)
                i = members.where(h)
                i = i[ok[i]]
                np.add.at(total, np.searchsorted(tokens, h[i]), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(tokens[at].view(np.int64)), pa.array(total[at])], ["token", "n"])

    found = docs.select("text").mapInArrow(task, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"] & 0xFFFFFFFFFFFFFFFF: r["n"] for r in found.toLocalIterator()}


def _hits(block: Windows, members: Members, raw: bytes, starts: np.ndarray):
    """Verified (first word, window) pairs; the words and their documents."""
    w, a, z = words(raw)
    doc = np.searchsorted(starts, a, "right") - 1
    first, which = [], []
    for n in block.sizes:
        h, ok = _shingles(w, doc, n)
        i = members.where(h)
        i = i[ok[i]]
        lo, hi = np.searchsorted(block.prefix, h[i], "left"), np.searchsorted(block.prefix, h[i], "right")
        each = np.repeat(np.arange(len(i)), hi - lo)
        k = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
        win, begin = block.prefix_window[k], i[each] - block.prefix_at[k]
        end = begin + block.length[win] - 1
        fits = (begin >= 0) & (end < len(w)) & (np.minimum(SHINGLE, block.length[win]) == n)
        win, begin, end = win[fits], begin[fits], end[fits]
        same = doc[begin] == doc[end]
        win, begin = win[same], begin[same]
        for size in np.unique(block.length[win]):
            pick = block.length[win] == size
            wi, be = win[pick], begin[pick]
            for j in range(size):
                alike = w[be + j] == block.words[wi, j]
                wi, be = wi[alike], be[alike]
            first.append(be)
            which.append(wi)
    if not first:
        return w, doc, np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, which = np.concatenate(first), np.concatenate(which)
    last = first + block.length[which] - 1
    exact = [b" ".join(raw[p:q].split()) == block.text[k] for p, q, k in zip(a[first].tolist(), z[last].tolist(), which.tolist())]
    exact = np.array(exact, bool)
    return w, doc, first[exact], which[exact]


def find_windows(docs: DataFrame, block: Windows, kept: list[str]) -> DataFrame:
    """The ``kept`` columns of each row, with n_words, hit runs of words (begin,
    end exclusive) and the sorted items whose windows occur."""
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def task(batches):
        own = shared.value
        members = Members(np.unique(own.prefix))
        for b in slices(batches, "text"):
            raw, starts = joined(as_bytes(b.column("text")), WORDS)
            w, doc, first, which = _hits(own, members, raw, starts)
            n = np.bincount(doc, minlength=b.num_rows)
            base = np.cumsum(n) - n
            cover = np.zeros(len(w) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + own.length[which], -1)
            hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
            begin, end = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(~hit[1:] & hit[:-1])
            runs, items = [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            for x, y in zip(begin.tolist(), end.tolist()):
                while x < y:  # a run may go on into the next document
                    d = int(doc[x])
                    stop = min(y, int(base[d] + n[d]))
                    runs[d].append({"begin": x - int(base[d]), "end": stop - int(base[d])})
                    x = stop
            pairs = np.unique(np.stack([doc[first], which]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
            for d, k in pairs.T.tolist():
                items[d].update(own.items[k])
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                 pa.array([sorted(s) for s in items], pa.list_(pa.string()))], [*kept, *FOUND])

    schema = T.StructType([*[docs.schema[c] for c in kept], *T.StructType.fromDDL("n_words long, runs array<struct<begin:long,end:long>>, items array<string>").fields])
    return docs.select(*kept, *[c for c in ["text"] if c not in kept]).mapInArrow(task, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, kept: list[str] | None = None, block_windows: int = BLOCK) -> DataFrame:
    """The ``kept`` columns (doc_id if not given) of every row of ``docs``, with
    n_words, runs (hit words) and items; these replace columns of their names."""
    kept = ["doc_id"] if kept is None else [c for c in kept if c not in FOUND]
    windows = written(item_windows(benchmark), "windows")
    n = windows.count()
    blocks = max(1, -(-n // block_windows))
    if blocks == 1:
        block = Windows([(r[0], r[1]) for r in windows.collect()])
        block.choose(token_counts(docs, block))
        return find_windows(docs, block, kept)
    # more blocks: a written row number ties the parts of a row together
    rows = written(docs.select(F.struct(*kept).alias("kept"), "text").withColumn("row", F.monotonically_increasing_id()), "rows")
    parts = None
    for k in range(blocks):
        # all items of a window text are in one block
        mine = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).select("item", "words")
        block = Windows([(r[0], r[1]) for r in mine.collect()])
        block.choose(token_counts(rows, block))
        part = written(find_windows(rows, block, ["row"]), "hits")
        parts = part if parts is None else parts.unionByName(part)
    both = parts.groupBy("row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("all_runs"),
                                    F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    start = F.array().cast("array<struct<begin:long,end:long>>")

    def unite(acc, r):
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["begin"].alias("begin"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (r["begin"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(r)))

    united = F.aggregate(F.array_sort("all_runs"), start, unite)
    return rows.select("row", "kept").join(both.withColumn("runs", united), "row").select("kept.*", *FOUND)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = decontaminate(docs, benchmark)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["begin"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)
