"""Language identification by a byte convolutional network.

Byte embeddings, filters of several widths, max pooling over each fixed-length
window and a softmax, trained in numpy on labelled text. A text is cut into
windows of ``WINDOW`` bytes, all of which are scored in batches; the prediction
is the mean of the windows' probabilities, weighted by their bytes.

Training takes one window of text from a sample of about ``PER_LANG`` labelled
rows a language (chosen by a hash of the row, after counting), a documented
bound that keeps the fit's cost fixed; every whole text is predicted.

Defined results: null text, or text without a letter, is ``und`` with score 1.
Without labelled rows every text is ``und`` with score 0. Rows with null lang
are predicted but not learned from. Repeated rows each get their row (and count
once in training). Extra or clashing columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, crc_mod, slices

WINDOW = 512
WIDTHS, FILTERS, DIM = (2, 3, 4), 10, 8
PER_LANG = 1500
STEPS, BATCH, RATE = 500, 96, 0.01
UNKNOWN = "und"
ENOUGH = 100  # labelled texts behind a least score


def windows(texts: list[bytes], size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows (rows of bytes) of all texts, and how many each has."""
    n = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    out = np.frombuffer(b"".join(t.ljust(k * size, b"\0") for t, k in zip(texts, n.tolist())), np.uint8)
    return out.reshape(-1, size), n


def _patches(x: np.ndarray, width: int, offset: int) -> np.ndarray:
    """Every width-th patch from offset on, as a view (windows, values, patches)."""
    b, size, d = x.shape
    s = x.strides
    return np.lib.stride_tricks.as_strided(x[:, offset:], (b, width * d, (size - offset) // width), (s[0], s[2], s[1] * width))


def pooled(model: dict, w: np.ndarray) -> np.ndarray:
    """Max-pooled filter outputs of each window. Maxima do not depend on order,
    so the patches are taken width by width without copies."""
    x = np.ascontiguousarray(model["embed"][w])
    out = []
    for width, f in zip(WIDTHS, model["filters"]):
        flat = np.ascontiguousarray(f.T)
        best = None
        for offset in range(width):
            y = np.matmul(flat, _patches(x, width, offset)).max(axis=2)
            best = y if best is None else np.maximum(best, y)
        out.append(best)
    return np.maximum(np.concatenate(out, axis=1) + model["shift"], 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(w: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> dict:
    """Fit the network with Adam on windows ``w`` and class numbers ``y``."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    p = {"embed": rng.normal(0, 0.5, (256, DIM)).astype(f32), "shift": np.zeros(len(WIDTHS) * FILTERS, f32),
         "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(f32), "bias": np.zeros(classes, f32)}
    for i, width in enumerate(WIDTHS):
        p[f"f{i}"] = rng.normal(0, (width * DIM) ** -0.5, (width * DIM, FILTERS)).astype(f32)
    p["embed"][0] = 0
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    # classes are drawn evenly
    weight = 1.0 / np.bincount(y, minlength=classes)[y]
    weight /= weight.sum()
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(y), BATCH, p=weight)
        b, t = w[pick], y[pick]
        x = p["embed"][b]
        best, where = [], []
        for i, width in enumerate(WIDTHS):
            n = WINDOW - width + 1
            cols = np.lib.stride_tricks.as_strided(x, (BATCH, n, width * DIM), x.strides[:2] + (x.strides[2],))
            z = np.matmul(cols, p[f"f{i}"])
            k = z.argmax(axis=1)
            where.append(k)
            best.append(np.take_along_axis(z, k[:, None, :], 1)[:, 0])
        z = np.concatenate(best, axis=1) + p["shift"]
        h = np.maximum(z, 0)
        d = softmax(h @ p["out"] + p["bias"])
        d[np.arange(BATCH), t] -= 1
        d /= BATCH
        g = {"out": h.T @ d, "bias": d.sum(axis=0)}
        dz = (d @ p["out"].T) * (z > 0)
        g["shift"] = dz.sum(axis=0)
        ge = np.zeros_like(p["embed"])
        for i, width in enumerate(WIDTHS):
            dzi = dz[:, i * FILTERS:(i + 1) * FILTERS]
            at = where[i][..., None] + np.arange(width)  # (batch, filter, width)
            rows = np.arange(BATCH)[:, None, None]
            patch = x[rows, at].reshape(BATCH, FILTERS, width * DIM)
            g[f"f{i}"] = np.einsum("bfk,bf->kf", patch, dzi)
            back = (dzi[..., None] * p[f"f{i}"].T[None]).reshape(-1, DIM)
            np.add.at(ge, b[rows, at].reshape(-1), back)
        ge[0] = 0
        g["embed"] = ge
        rate = RATE * (1 - step / (STEPS + 1))
        for k, v in p.items():
            m, s = moment[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] ** 2 - s)
            v -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.99 ** step)) + 1e-8)).astype(f32)
    return {"embed": p["embed"], "filters": [p[f"f{i}"] for i in range(len(WIDTHS))], "shift": p["shift"], "out": p["out"], "bias": p["bias"]}


def predict(model: dict, texts: list[bytes]) -> np.ndarray:
    """Class probabilities of each whole text."""
    out = np.zeros((len(texts), len(model["bias"])))
    w, n = windows(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    last = np.cumsum(n) - 1
    size = np.full(len(w), WINDOW, np.float64)
    size[last] = [len(t) - (k - 1) * WINDOW for t, k in zip(texts, n.tolist())]
    for a in range(0, len(w), 256):
        prob = softmax(pooled(model, w[a:a + 256]) @ model["out"] + model["bias"])
        np.add.at(out, doc[a:a + 256], prob * np.maximum(size[a:a + 256], 1)[:, None])
    return out / out.sum(axis=1, keepdims=True)


def fit_languages(docs: DataFrame, per_lang: int = PER_LANG, text: str = "text", lang: str = "lang") -> dict | None:
    """Train on about ``per_lang`` rows a language of ``docs``; None without rows."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a language
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r[lang]), F.lit(min(1.0, per_lang / r["n"])))])
    key = F.xxhash64(text, lang)
    chosen = rows.filter(F.pmod(key, F.lit(1 << 20)) < share[F.col(lang)] * (1 << 20))
    at = (F.pmod(F.shiftright(key, 20), F.greatest(F.length(text) - WINDOW, F.lit(0)) + 1) + 1).cast("int")
    sample = chosen.select(F.col(text).substr(at, F.lit(WINDOW)).alias("t"), F.col(lang).alias("l")).distinct()
    got = sorted((r["l"], r["t"].encode()) for r in sample.collect())  # per_lang windows a language
    names = sorted({l for l, _ in got})
    if not names:
        return None
    w = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW, b"\0") for _, t in got), np.uint8).reshape(-1, WINDOW)
    model = train(w, np.array([names.index(l) for l, _ in got]), len(names))
    return model | {"names": names}


def predict_languages(docs: DataFrame, model: dict | None, kept: list[str] | None = None, text: str = "text") -> DataFrame:
    """The ``kept`` columns of ``docs`` (all but the text if not given), with
    lang_pred and score, which replace columns of their names."""
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    kept = [c for c in (kept or [c for c in docs.columns if c != text]) if c not in ("lang_pred", "score", "_letter")]
    if model is None:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.when(has, 0.0).otherwise(1.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        net = shared.value
        names = np.array(net["names"], object)
        for b in slices(batches, text):
            prob = predict(net, as_bytes(b.column(text)))
            letter = np.asarray(b.column("_letter").to_numpy(zero_copy_only=False), dtype=bool)
            pred = np.where(letter, names[prob.argmax(axis=1)], UNKNOWN)
            score = np.where(letter, prob.max(axis=1), 1.0)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             [*kept, "lang_pred", "score"])

    rows = docs.select(*kept, *[c for c in [text] if c not in kept], has.alias("_letter"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(task, schema)


def length_class(text: str = "text") -> Column:
    """The power of two that a text's bytes reach."""
    return F.floor(F.log2(F.greatest(F.octet_length(F.col(text)), F.lit(1)))).cast("int")


def least_scores(docs: DataFrame, model: dict, text: str = "text", lang: str = "lang") -> dict[int, float]:
    """By length class: the least score of all rows of ``docs`` so long or longer
    whose language the network gets right. Short texts have lower scores; a class
    needs ENOUGH such rows, longer texts than those of the last one go by it."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(text, F.col(lang).alias("_lang"), length_class(text).alias("_size"))
    right = predict_languages(rows, model, ["_lang", "_size"], text).filter(F.col("lang_pred") == F.col("_lang"))
    out, n, least = {}, 0, 1.0
    for r in right.groupBy("_size").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).orderBy(F.desc("_size")).collect():
        n, least = n + r["n"], min(least, r["least"])
        if n >= ENOUGH:
            out[r["_size"]] = least
    return out


def least_score(least: dict[int, float], text: str = "text") -> Column:
    """The least score for a text; 0 for one shorter than any class."""
    out = F.lit(0.0)
    for size in sorted(least):
        out = F.when(length_class(text) >= size, F.lit(least[size] - 1e-9)).otherwise(out)
    return out


def language_digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; rows with crc32(doc_id) mod 3 = 1 are held out."""
    held = crc_mod("doc_id", 3) == 1
    model = fit_languages(docs.filter(~held))
    return predict_languages(docs.select("doc_id", held.alias("held_out"), "text"), model)
