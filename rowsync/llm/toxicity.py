"""Toxicity by compression distance under two zstandard dictionaries.

One dictionary is trained on ordinary text, one on toxic text (reduced to the
words that are much commoner in toxic than in ordinary rows, with each of them
repeated; the rest of a toxic text is ordinary). A window is one word between spaces, followed by a marker
that both dictionaries hold, so that even a short word makes a compressed
block; a word longer than ``WINDOW`` bytes is several overlapping windows. Its
saving is (length under the ordinary dictionary - length under the toxic one) /
bytes. Windows whose saving reaches a threshold are toxic; the threshold and a
logistic score over a text's toxic windows are calibrated on labelled rows that
the dictionaries have not seen.

The fit takes about ``PER_CLASS`` labelled rows a class (chosen by a hash of the
id, after counting) and ``TRAIN_CHARS`` characters of each: documented bounds.
Every window of every whole text is scored.

Defined results: null text counts as empty and gets the score of a text without
toxic windows. Labelled ids missing from the documents, null ids and null labels
are ignored; an id labelled twice is toxic if any label is. Without rows of both
classes every score is 0. Repeated rows each get their row. Extra columns are
not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from math import lgamma

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, slices

PER_CLASS, TRAIN_CHARS = 1500, 8192
ORDINARY_BYTES, HEADER_BYTES = 6400, 512  # the toxic dictionary has what its words take
LEAST_ROWS, LEAST_RATIO = 4, 8  # of a word that marks toxic text
REPEATS = 8  # of each word, added to the toxic dictionary's training text
STEM = 4  # letters of the shortest beginning that words are grouped by
WINDOW, OVERLAP = 64, 16
KEEP_WINDOWS = 400_000  # a task's cache
# The marker both dictionaries hold: control bytes, which text hardly has.
MARKER = bytes(range(1, 9)) + bytes(range(14, 22))
STRIP = b"".join(bytes([b]) for b in range(33, 127) if not chr(b).isalnum())


def window_list(text: bytes) -> list[bytes]:
    """The lower-cased words of a text; long ones in overlapping parts."""
    out = text.decode("utf-8", "replace").lower().encode().split()
    if max(map(len, out), default=0) > WINDOW:
        out = [w[a:a + WINDOW] for w in out for a in range(0, max(1, len(w) - OVERLAP), WINDOW - OVERLAP)]
    return out


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    # the end of a dictionary is not indexed, so spaces follow the marker
    known = zstd.ZstdCompressionDict(content + MARKER + b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    params = zstd.ZstdCompressionParameters(
        strategy=zstd.STRATEGY_GREEDY, min_match=4, search_log=4, window_log=14, chain_log=13, hash_log=13,
        write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstd.ZstdCompressor(dict_data=known, compression_params=params)


def _dictionary(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; too little text is a dictionary by itself."""
    try:
        return zstd.train_dictionary(size, samples, k=32, d=6).as_bytes()[-size:]
    except zstd.ZstdError:
        return b"".join(samples)[:size]


class Distance:
    """Savings of windows, kept for windows met again."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = _compressor(ordinary), _compressor(toxic)
        self.kept: dict[bytes, float] = {}

    def saving(self, window: bytes) -> float:
        word = window.strip(STRIP)
        framed = b" " + word + b" " + MARKER
        gain = len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))
        if len(self.kept) >= KEEP_WINDOWS:
            self.kept.clear()
        out = self.kept[window] = gain / (len(word) + 2) if word else 0.0
        return out

    def savings(self, text: bytes) -> list[float]:
        found = window_list(text)
        out = list(map(self.kept.get, found))
        if None in out:
            saving = self.saving
            out = [saving(w) if s is None else s for w, s in zip(found, out)]
        return out


def features(savings: list[float], threshold: float) -> tuple[float, float, float]:
    """(any toxic window, log of their number, their share of all windows)."""
    hits = sum(s >= threshold for s in savings)
    return float(hits > 0), float(np.log1p(hits)), hits / max(1, len(savings))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
    return w


def beginnings(word: bytes) -> list[str]:
    """The beginnings of a word, of STEM letters or more; a shorter word's own."""
    w = word.decode("utf-8", "replace")
    return [w[:k] for k in range(min(STEM, len(w)), len(w) + 1)]


def _log_chance(n: int, m: int, p: float) -> float:
    """Log of the probability that n or more of n + m rows are toxic, by chance p."""
    k = np.arange(n, n + m + 1)
    term = np.array([lgamma(n + m + 1) - lgamma(x + 1) - lgamma(n + m - x + 1) for x in k]) + k * np.log(p) + (n + m - k) * np.log(1 - p)
    return float(term.max() + np.log(np.exp(term - term.max()).sum()))


def marking_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """The words that mark toxic text: in LEAST_ROWS toxic rows, LEAST_RATIO times
    commoner there, and (by themselves or with the words of a common beginning) so
    often that chance would make less than one such word of all. How many of the
    toxic rows hold a word does not matter: a rare language has its words, too."""
    words, parts = {1: Counter(), 0: Counter()}, {1: Counter(), 0: Counter()}
    for group, y in ((toxic, 1), (ordinary, 0)):
        for t in group:
            found = {w.strip(STRIP) for w in window_list(t)} - {b""}
            words[y].update(found)
            parts[y].update({p for w in found for p in beginnings(w)})
    share = len(toxic) / (len(toxic) + len(ordinary))
    least = -np.log(max(1, len(words[1].keys() | words[0].keys())))
    often = lambda n, m: n >= LEAST_ROWS and n / len(toxic) > LEAST_RATIO * (m + 1) / (len(ordinary) + 1)
    sure: dict[str, bool] = {}

    def beyond_chance(p: str) -> bool:
        if p not in sure:
            n, m = parts[1][p], parts[0][p]
            sure[p] = often(n, m) and _log_chance(n, m, share) < least
        return sure[p]

    return {w for w, n in words[1].items() if often(n, words[0][w]) and any(map(beyond_chance, beginnings(w)))}


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> dict:
    """The two trained dictionaries."""
    marks = marking_words(toxic, ordinary)
    reduced = [b" " + b" ".join(w) + b" " for t in toxic if (w := [x for x in (v.strip(STRIP) for v in window_list(t)) if x in marks])]
    # and each word as often as any other, in mixed orders: what is rare gets its place
    for k in range(REPEATS):
        order = sorted(marks, key=lambda w: hashlib.sha256(b"%d " % k + w).digest())
        reduced += [b" " + b" ".join(order[a:a + REPEATS]) + b" " for a in range(0, len(order), REPEATS)]
    plain = [t[a:a + 512] for t in (x.decode("utf-8", "replace").lower().encode() for x in ordinary) for a in range(0, min(len(t), 4096), 512)]
    return {"ordinary": _dictionary(ORDINARY_BYTES, plain), "toxic": _dictionary(HEADER_BYTES + 2 * sum(len(w) + 1 for w in marks), reduced) if reduced else b""}


def fit(texts: list[bytes], labels: list[int]) -> dict | None:
    """Dictionaries of one half of the rows; threshold and weights, which hold for
    these dictionaries only, are calibrated on the other half."""
    toxic, ordinary = ([t for t, y in zip(texts, labels) if y == k] for k in (1, 0))
    if min(len(toxic), len(ordinary)) < 2:
        return None
    trained = dictionaries(toxic[::2], ordinary[::2])
    distance = Distance(**trained)
    savings = [distance.savings(t) for t in [*toxic[1::2], *ordinary[1::2]]]
    y = np.repeat([1.0, 0.0], [len(toxic[1::2]), len(ordinary[1::2])])
    most = np.array([max(s, default=0.0) for s in savings])
    # the threshold that tells the classes apart best, in the middle of its gap
    levels = np.unique(np.maximum(most, 0))
    right = [np.mean(most[y == 1] >= t) - np.mean(most[y == 0] >= t) if t > 0 else -1.0 for t in levels]
    at = int(np.argmax(right))
    threshold = float((levels[at] + levels[at - 1]) / 2) if at else float("inf")
    x = np.array([features(s, threshold) for s in savings])
    return trained | {"threshold": threshold, "weights": _logistic(x, y)}


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Fit on about ``per_class`` labelled rows a class, read by the driver."""
    known = labels.dropna(subset=["doc_id", "toxic"]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    # about 2 * per_class rows of two numbers: a bounded broadcast
    rows = docs.filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    at = (F.pmod(F.xxhash64("doc_id", "toxic"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1) + 1).cast("int")
    rows = rows.select("doc_id", "toxic", F.col("text").substr(at, F.lit(TRAIN_CHARS)).alias("t"))
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("t").alias("t"))  # one text an id
    got = sorted({(r["t"], r["toxic"]) for r in rows.collect()})
    order = sorted(got, key=lambda r: (r[1], hash_of(r[0])))
    return fit([t.encode() for t, _ in order], [y for _, y in order])


def hash_of(text: str) -> bytes:
    """An order that mixes similar texts."""
    return hashlib.sha256(text.encode()).digest()


def score_toxicity(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` without its text, with score, n_windows and n_toxic_windows."""
    kept = [c for c in docs.columns if c not in (text, "score", "n_windows", "n_toxic_windows")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        m = shared.value
        distance = Distance(m["ordinary"], m["toxic"]) if m else None
        for b in slices(batches, text):
            rows = []
            for t in as_bytes(b.column(text)):
                s = distance.savings(t) if distance else []
                if not m:
                    rows.append((0.0, len(window_list(t)), 0))
                    continue
                f = features(s, m["threshold"])
                z = float(np.dot(f, m["weights"][:-1]) + m["weights"][-1])
                rows.append((1 / (1 + np.exp(-np.clip(z, -30, 30))), len(s), round(np.expm1(f[1]))))
            score, n, hits = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array(score, pa.float64()), pa.array(n, pa.int64()), pa.array(hits, pa.int64())],
                [*kept, "score", "n_windows", "n_toxic_windows"])

    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType()),
                           T.StructField("n_windows", T.LongType()), T.StructField("n_toxic_windows", T.LongType())])
    return docs.select(*kept, text).mapInArrow(task, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns; rows with crc32(doc_id) mod 5 = 0 are held out."""
    held = crc_mod("doc_id", 5) == 0
    model = fit_toxicity(docs.filter(~held), labels.select("doc_id", "toxic").filter(~held))
    scored = score_toxicity(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_windows", "n_toxic_windows")
