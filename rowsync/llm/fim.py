"""Fill-in-middle: a text is cut in three and written with its middle last.

Tokens are found on the bytes of many texts at once (the white space that parts
them is ASCII). What is not ASCII is kept as a sparse exception index: for each
multibyte character only where it begins and by how much its bytes exceed one.
Searchsorted over it turns a byte cut into a code-point cut and back; between
exceptions both are plain arithmetic, so a span of ASCII costs nothing.

Defined results: null text is empty, an empty text is plain with 0 tokens. A null
id draws as the empty decimal does. Every row gives one row, repeated ones too.
Texts are cut whole, whatever their length; a task holds one lot of about
``SLICE`` bytes or one longer text. Columns other than id and text are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, slices

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SPACE = np.zeros(256, np.bool_)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


class CutIndex:
    """Code points and bytes of a UTF-8 buffer, by its multibyte characters."""

    def __init__(self, raw: bytes):
        byte = np.frombuffer(raw, np.uint8)
        self.at = np.flatnonzero(byte >= 0xC0)  # first bytes
        lead = byte[self.at]
        over = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        self.over = np.concatenate([[0], np.cumsum(over)])  # excess bytes before each exception
        self.chars = self.at - self.over[:-1]  # their code-point positions

    def to_chars(self, cut):
        """Code-point positions of byte positions (at character boundaries)."""
        return cut - self.over[np.searchsorted(self.at, cut, "left")]

    def to_bytes(self, cut):
        """Byte positions of code-point positions."""
        return cut + self.over[np.searchsorted(self.chars, cut, "left")]


def token_ends(raw: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the tokens of texts joined as ``raw`` (text i from starts[i] to
    starts[i + 1]), and each text's first entry among them (one more at the end).

    A token ends with each run of other characters, and with a text that ends in
    white space."""
    space = SPACE[np.frombuffer(raw, np.uint8)]
    last = np.zeros(len(space), np.bool_)  # bytes after which a token ends
    if len(space):
        last[:-1] = ~space[:-1] & space[1:]
        final = starts[1:][np.diff(starts) > 0] - 1
        last[final] = True
    ends = np.flatnonzero(last) + 1
    return ends, np.searchsorted(ends, starts, "right")


def draws(seed: int, name) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of an id."""
    said = "" if name is None else str(name)
    x = hashlib.sha256(f"{seed}:{said}".encode()).digest()
    return tuple(int.from_bytes(x[i:i + 4], "big") for i in (0, 4, 8, 12))


def arrange(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "psm":
        return b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle])
    return b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle])


def restore(form: str, output: bytes) -> bytes:
    """The text that was cut, from what was written. No cut text holds a
    sentinel, and none can arise across a seam: each begins with ``<`` and has
    it nowhere else."""
    if form == "plain":
        return output
    if form == "psm":
        prefix, _, rest = output[len(PREFIX):].partition(SUFFIX)
        suffix, _, middle = rest.partition(MIDDLE)
    else:
        suffix, _, rest = output[len(SUFFIX):].partition(PREFIX)
        prefix, _, middle = rest.partition(MIDDLE)
    return prefix + middle + suffix


class Cutter:
    """Cuts lots of texts; ``rate`` and ``spm_rate`` in percent."""

    def __init__(self, seed: int, rate: int, spm_rate: int):
        self.seed, self.rate, self.spm_rate = seed, rate, spm_rate

    def lot(self, names: list, texts: list[bytes]):
        """Yield (n tokens, form, prefix end, middle end in code points or None, output)."""
        starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        raw = b"".join(texts)
        ends, first = token_ends(raw, starts)
        index = CutIndex(raw)
        n = np.diff(first)
        forms, units = [], np.zeros((2, len(texts)), np.int64)
        for i, (name, text) in enumerate(zip(names, texts)):
            h1, h2, h3, h4 = draws(self.seed, name)
            if not text or h3 % 100 >= self.rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
                forms.append("plain")
                continue
            forms.append("spm" if h4 % 100 < self.spm_rate else "psm")
            k = int(n[i]) + 1
            units[:, i] = sorted((h1 % k, h2 % k))
        # byte cuts: the end of the unit before the cut, or the text's beginning
        ends = np.concatenate([[0], ends])
        cuts = np.where(units > 0, ends[first[:-1] + units], starts[:-1])
        chars = index.to_chars(cuts) - index.to_chars(starts[:-1])
        for i, (text, form) in enumerate(zip(texts, forms)):
            if form == "plain":
                yield int(n[i]), form, None, None, text
            else:
                a, z = (cuts[:, i] - starts[i]).tolist()
                yield int(n[i]), form, int(chars[0, i]), int(chars[1, i]), arrange(form, text[:a], text[a:z], text[z:])


def _run(docs: DataFrame, make, fields, id_col: str, text_col: str) -> DataFrame:
    """One row per row of ``docs``: its id and ``make(row of Cutter.lot)``."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *fields])

    def task(batches):
        kind = None
        for b in slices(batches, text_col):
            texts = as_bytes(b.column(text_col))
            rows = make(b.column(id_col).to_pylist(), texts)
            kind = kind or [{"long": pa.int64(), "string": pa.string()}[f.dataType.simpleString().replace("bigint", "long")] for f in fields]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), kind)]
            yield pa.RecordBatch.from_arrays([b.column(id_col), *columns], [id_col, *[f.name for f in fields]])

    return docs.select(id_col, text_col).mapInArrow(task, schema)


def _fields(spec: str) -> list[T.StructField]:
    kinds = {"long": T.LongType(), "string": T.StringType()}
    return [T.StructField(n, kinds[k]) for n, k in (c.split() for c in spec.split(", "))]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n (tokens), form, prefix_chars, middle_chars (null: plain) and the
    output text of every whole text."""
    def make(names, texts):
        for n, form, a, z, out in Cutter(seed, rate, spm_rate).lot(names, texts):
            yield n, form, a, None if a is None else z - a, out.decode("utf-8", "replace")

    return _run(docs, make, _fields("n long, form string, prefix_chars long, middle_chars long, output string"), id_col, text_col)


def fim_digest(docs: DataFrame, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """The contract's columns; texts are digested where they are made, so that
    none goes back to the JVM."""
    def sha(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def make(names, texts):
        for n, form, a, z, out in Cutter(seed, rate, spm_rate).lot(names, texts):
            yield n, form, a, None if a is None else z - a, sha(out), sha(restore(form, out))

    spec = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return _run(docs, make, _fields(spec), "doc_id", "text")
