"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

Text is cut as the public byte-level pre-tokenizer cuts it. Within a piece the
ranks of adjacent pairs are the leaves of a segment tree; its root is the
leftmost pair of lowest rank. A merge changes three leaves, each a logarithmic
update, until no mergeable pair is left: a piece of n bytes takes O(n log n),
also where a whole long text is one piece. Short pieces are merged many at a
time, their trees the rows of one matrix.

Pieces repeat, so each task keeps the codes of pieces it has met (bounded, by
number and length). The vocabulary (read by the driver from a tokenizer file
given as a parameter, about 1.5 MB) is broadcast.

Defined results: null text is encoded as empty (no ids). Special tokens found in
the text are one id each. Ids outside the vocabulary decode to nothing; bytes
that are not UTF-8 decode to U+FFFD. Every row gives one row, repeated ones
too. The id column keeps its type; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_bytes, slices

# Fixed value: the public pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

KEEP_BYTES, KEEP_LENGTH, KEEP_COST = 32 << 20, 64, 200  # a task's cache: two generations of so much, bytes of an entry besides its texts
LONG, ROWS = 65, 8192  # longer pieces are merged one by one; rows merged at a time
LOT = 1 << 19  # bytes of text encoded at a time
NONE = 1 << 62


@lru_cache(1)
def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary:
    printable Latin-1 for itself, the rest from U+0100 on in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Byte ids, the rank of each mergeable pair and the id it makes, the bytes
    of each id, and special tokens of a ``tokenizers`` JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, vocab = byte_characters(), spec["model"]["vocab"]
    rank_of, id_of = {}, []
    for rank, pair in enumerate(spec["model"]["merges"]):
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        rank_of.setdefault(vocab[a] << 20 | vocab[b], rank)
        id_of.append(vocab[a + b])
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    as_bytes_ = {i: bytes(chars[c] for c in token) for token, i in vocab.items() if token not in special}
    as_bytes_ |= {i: t.encode() for t, i in special.items()}
    return {"bytes": [vocab[c] for c, _ in sorted(chars.items(), key=lambda x: x[1])], "rank_of": rank_of, "id_of": id_of,
            "tokens": as_bytes_, "special": special}


def merge_piece(ids: list[int], rank_of: dict[int, int], id_of: list[int]) -> list[int]:
    """Apply merges, lowest rank first and leftmost among equals. ``rank_of`` has
    the rank of a mergeable pair (a << 20 | b), ``id_of`` the id it makes."""
    n = len(ids)
    if n < 2:
        return ids
    size = 1
    while size < n - 1:
        size *= 2
    # a leaf is rank * n + position, so the least is the leftmost of lowest rank
    tree = [NONE] * (2 * size)
    get = rank_of.get
    a = ids[0]
    for i in range(1, n):
        b = ids[i]
        r = get(a << 20 | b)
        if r is not None:
            tree[size + i - 1] = r * n + i - 1
        a = b
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(k, value):
        if tree[k] == value:
            return
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if tree[k] == value:  # nothing changes above
                return
            tree[k] = value

    best = tree[1]
    while best != NONE:
        r, i = divmod(best, n)
        j = after[i]
        new = ids[i] = id_of[r]
        k = after[i] = after[j]
        ids[j] = -1
        if j < n - 1:
            put(size + j, NONE)
        if k < n:
            before[k] = i
            r = get(new << 20 | ids[k])
            put(size + i, NONE if r is None else r * n + i)
        else:
            put(size + i, NONE)
        p = before[i]
        if p >= 0:
            r = get(ids[p] << 20 | new)
            put(size + p, NONE if r is None else r * n + p)
        best = tree[1]
    return [x for x in ids if x >= 0]


class Merger:
    """Merges many short pieces at once: one segment tree a piece, as rows of a
    numpy matrix. Each step merges the root's pair in every row and updates the
    leaves it touches level by level, until no root is left."""

    def __init__(self, vocabulary: dict):
        keys = sorted(vocabulary["rank_of"])
        self.keys = np.array([*keys, NONE], np.int64)  # the last one stops every search
        self.ranks = np.array([*map(vocabulary["rank_of"].get, keys), NONE], np.int64)
        self.id_of = np.array(vocabulary["id_of"], np.int64)
        self.bytes = np.array(vocabulary["bytes"], np.int64)

    def leaf(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, size: int, there: np.ndarray) -> np.ndarray:
        """Leaves of the pairs (a, b) at the positions ``at``: rank * size + position."""
        key = a << 20 | b
        found = np.searchsorted(self.keys, key)
        return np.where(there & (self.keys[found] == key), self.ranks[found] * size + at, NONE)

    def rows(self, raw: list[bytes], size: int) -> list[bytes]:
        """Packed ids of pieces of 2 to size + 1 bytes (size: a power of two)."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        wide = size + 1  # positions; column size of the next-position table ends every row
        place = np.arange(wide)
        text = np.frombuffer(b"".join(x.ljust(wide, b"\0") for x in raw), np.uint8).reshape(-1, wide)
        inside = place < n[:, None]
        ids = np.where(inside, self.bytes[text], -1)
        tree = np.full((len(raw), 2 * size), NONE, np.int64)
        tree[:, size:] = self.leaf(ids[:, :-1], ids[:, 1:], place[:-1], size, inside[:, 1:])
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        after = np.repeat(place[None, :] + 1, len(raw), 0)
        before = np.repeat(np.arange(-1, wide)[None, :], len(raw), 0)
        row = np.arange(len(raw))
        while True:
            best = tree[row, 1]
            row, best = row[best != NONE], best[best != NONE]
            if not len(row):
                break
            rank, i = best // size, best % size
            new = self.id_of[rank]
            j = after[row, i]
            k = after[row, j]
            ids[row, i], ids[row, j] = new, -1
            after[row, i], before[row, k] = k, i
            p = before[row, i]
            right = self.leaf(new, ids[row, np.minimum(k, size)], i, size, k < n[row])
            left = self.leaf(ids[row, np.maximum(p, 0)], new, p, size, p >= 0)
            inner, some = j < size, p >= 0
            tree[row[inner], size + j[inner]] = NONE
            tree[row, size + i] = right
            tree[row[some], size + p[some]] = left[some]
            many = np.concatenate([row, row, row[some]])
            node = size + np.concatenate([i, np.minimum(j, size - 1), p[some]])
            while node[0] > 1:
                node >>= 1
                tree[many, node] = np.minimum(tree[many, 2 * node], tree[many, 2 * node + 1])
        kept = ids >= 0
        flat = ids[kept].astype(np.int32).tobytes()
        ends = np.concatenate([[0], np.cumsum(kept.sum(axis=1))]) * 4
        return [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


class Encoder:
    """Text to packed 32-bit ids, with a bounded cache of pieces."""

    def __init__(self, vocabulary: dict):
        self.rank_of, self.id_of = vocabulary["rank_of"], vocabulary["id_of"]
        self.bytes, self.special = vocabulary["bytes"], vocabulary["special"]
        self.merger = Merger(vocabulary)
        self.find = regex.compile(PATTERN).findall
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.spaced = re.compile(r"\s$| \s").search  # runs of white space: cut with more care
        self.at_words = re.compile(r"(?= \S)").split
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of ``kept``

    def merge(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of each piece: short ones by size, many at a time."""
        out, by_size = {}, {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                out[p] = array("i", [self.bytes[raw[0]]]).tobytes()
            elif len(raw) > LONG:
                out[p] = array("i", merge_piece([self.bytes[b] for b in raw], self.rank_of, self.id_of)).tobytes()
            else:
                by_size.setdefault(1 << (len(raw) - 2).bit_length(), []).append((p, raw))
        for size, found in by_size.items():
            for at in range(0, len(found), ROWS):
                names, raws = zip(*found[at:at + ROWS])
                out.update(zip(names, self.merger.rows(raws, size)))
        return out

    def chunks(self, text: str) -> list[str]:
        """``text`` in parts that no piece crosses the ends of. A space before a
        character that is not white space always begins a piece."""
        if self.spaced(text):
            return [c for c in self.at_words(text) if c]
        first, *rest = text.split(" ")
        rest = [" " + p for p in rest]
        return [first, *rest] if first else rest

    def parts(self, text: str) -> list[str]:
        """Special tokens and the chunks between them."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.chunks(text)
        return [c for part in self.cut.split(text) for c in ([part] if part in self.special else self.chunks(part))]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. What the cache lacks is merged together."""
        cut = [self.parts(t) for t in texts]
        # a special token never is an ordinary chunk: it would have been cut out
        known = {s: array("i", [i]).tobytes() for s, i in self.special.items()}
        pieces_of = {}
        for c in set().union(*cut) - known.keys():
            ids = self.kept.get(c) or self.older.get(c)
            if ids is None:
                pieces_of[c] = self.find(c)
            else:
                known[c] = ids
        lacking = {p for found in pieces_of.values() for p in found if p not in known}
        for p in lacking:
            ids = self.kept.get(p) or self.older.get(p)
            if ids is not None:
                known[p] = ids
        known |= self.merge([p for p in lacking if p not in known])
        for c, found in pieces_of.items():
            if len(found) > 1:
                known[c] = b"".join([known[p] for p in found])
        # two generations: what was not asked for since the last turn goes
        for c, ids in known.items():
            if len(c) <= KEEP_LENGTH and c not in self.kept:
                self.kept[c] = ids
                self.held += 2 * len(c) + len(ids) + KEEP_COST
        if self.held >= KEEP_BYTES:
            self.older, self.kept, self.held = self.kept, {}, 0
        get = known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def _id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType)


def _lists(rows: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens and ids (array<int>) of every whole text."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))

    def task(batches):
        encoder = Encoder(vocabulary.value)
        for b in slices(batches, text_col, LOT):
            rows = encoder.encode_all([t.decode("utf-8", "replace") for t in as_bytes(b.column(text_col))])
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array([len(r) // 4 for r in rows], pa.int64()), _lists(rows)], [id_col, "n_tokens", "ids"])

    schema = T.StructType([_id_field(docs, id_col), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, text_col).mapInArrow(task, schema)


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer)["tokens"])

    def task(batches):
        tokens = [vocabulary.value.get(i, b"") for i in range(max(vocabulary.value) + 1)]
        size = np.array([len(t) for t in tokens], np.int64)
        for batch in batches:
            at = batch.schema.get_field_index(ids_col)
            # about SLICE bytes of ids at a time
            n = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch.column(at)), 0))
            piece = (np.cumsum(n) - n) // (1 << 20)
            edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges[:-1], edges[1:]):
                if x == y:
                    continue
                b = batch.slice(x, y - x)
                ids = b.column(at)
                flat = np.asarray(ids.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
                known = (flat >= 0) & (flat < len(tokens))
                length = np.where(known, size[np.where(known, flat, 0)], 0)
                blob = b"".join([tokens[i] if 0 <= i < len(tokens) else b"" for i in flat.tolist()])
                ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)))
                upto = np.concatenate([[0], np.cumsum(length)])
                cut = upto[np.concatenate([[0], ends])]
                text = [blob[p:q].decode("utf-8", "replace") for p, q in zip(cut[:-1].tolist(), cut[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], schema=pa.schema([*b.schema, ("decoded", pa.string())]))

    kept = encoded.select(*[c for c in encoded.columns if c != "decoded"])
    return kept.mapInArrow(task, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))


def bpe_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The contract's columns: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A text is encoded, its ids are decoded, and both are digested where they are
    made: one Python worker a task, and neither goes back to the JVM."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(tokenizer))

    def task(batches):
        encoder, tokens = Encoder(vocabulary.value), vocabulary.value["tokens"]
        ids_of = range(max(tokens) + 1)
        token, said = [tokens.get(i, b"") for i in ids_of], [b"%d" % i for i in ids_of]
        for b in slices(batches, "text", LOT):
            rows = encoder.encode_all([t.decode("utf-8", "replace") for t in as_bytes(b.column("text"))])
            n, ids_sha, decoded_sha = [], [], []
            for row in rows:
                ids = np.frombuffer(row, np.int32).tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(b",".join([said[i] for i in ids])).hexdigest())
                text = b"".join([token[i] for i in ids]).decode("utf-8", "replace")
                decoded_sha.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = T.StructType([_id_field(docs, "doc_id"), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("decoded_sha256", T.StringType())])
    return docs.select("doc_id", "text").mapInArrow(task, schema)
