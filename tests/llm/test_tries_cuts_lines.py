"""Conversation trie, fill-in-middle and line dedup against plain versions, with
nulls, empty and very long rows, ties, repeated rows, empty tables and extra
columns of clashing names. Their SQL twins run in test_llm.test_sql_twin."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import brute
import numpy as np
import pytest

from rowsync.llm import fim, lines, prefix_trie
from rowsync.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


# 11 conversation trie

def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [x[2] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    members = defaultdict(list)
    for c, p in rebuilt.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(set)
    for q in members:
        if q:
            kids[q[:-1]].add(q)
    leaves, saved = defaultdict(int), defaultdict(int)
    for q, m in members.items():
        worth = (len(m) - 1) * len(q[-1][1].encode()) if q else 0
        for d in range(len(q) + 1):
            leaves[q[:d]] += not kids[q]
            saved[q[:d]] += worth
    out = []
    for q, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if rebuilt[c] == q)
        out.append((min(m), len(q), min(members[q[:-1]]) if q else None, len(m), len(kids[q]), leaves[q], saved[q], brute.sha(ends)))
    return sorted(out, key=repr)


def odd_conversations():
    rng = random.Random(7)
    rows = []
    for c in range(-7, 120):
        shape = rng.randrange(4)
        n = rng.choice([1, 2, 3, 5, 9, 14])
        for t in range(n):
            text = ["hello", "again", "é" * 3, "", None, f"own {c}"][rng.randrange(6)] if shape else "same"
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", None, ""]) if shape == 3 else "user", text))
        if shape == 2:
            rows.append(rows[-1])  # a repeated row, and a tie of turns
            rows.append((c, 0, "user", "tie"))
    rows += [(1000 + c, t, "user", "common") for c in range(60) for t in range(12)]  # equal conversations
    rows += [(2003, t, "user", "very long " + "x" * (t == 5) * 100_000) for t in range(70)]
    rows += [(None, 1, "user", "nowhere"), (3001, 0, "user", "donor is absent")]
    return rows


@pytest.mark.parametrize("block,shard,sampled", [(64, 1 << 16, 8), (64, 16, 1), (3, 24, 2), (2, 1 << 16, 8)])
def test_trie(spark, monkeypatch, block, shard, sampled):
    for name, value in (("BLOCK", block), ("SHARD_ROWS", shard), ("PER_SHARD", sampled)):
        monkeypatch.setattr(prefix_trie, name, value)
    rows = odd_conversations()
    random.Random(1).shuffle(rows)
    data = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, d int, path string, size int")
    got = sorted((tuple(r) for r in prefix_trie.conversation_trie(data).collect()), key=repr)
    assert got == brute_trie(rows)


def test_trie_empty(spark):
    data = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.conversation_trie(data).count() == 0
    only = spark.createDataFrame([(3, 0, "user", "x")], data.schema)  # rebuilt without a turn or with one
    assert [tuple(r) for r in prefix_trie.conversation_trie(only).orderBy("depth").collect()] == sorted(brute_trie([(3, 0, "user", "x")]), key=lambda r: r[1])


def test_skeleton():
    key = [bytes([i]) * 16 for i in range(4)]
    trie = prefix_trie.skeleton([(0, 0, 0, key[0] + key[1], 1), (0, 0, 0, key[0] + key[2], 1), (1, 5, 5, key[0], 1)])
    assert trie["nodes"] == [[0, 1, 2], [0, 1, 3], [4, 5]] and trie["up"].tolist() == [-1, 0, 1, 1, -1, 4]


# 12 fill in the middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(i, t):
    t = t or ""
    unit = UNIT.findall(t)
    x = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(unit) + 1), h2 % (len(unit) + 1)))
    p, m, s = "".join(unit[:a]), "".join(unit[a:z]), "".join(unit[z:])
    if not t or any(w in t for w in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(unit), "plain", None, None, t
    if h4 % 100 < 80:
        return len(unit), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(unit), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "😀", "<", "<S", "\x1c", " ", "\x0b"]
    texts = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(400)]
    texts += [(400, None), (401, ""), (402, " \t\n"), (403, "a <M> b"), (404, "é " * 200_000), (None, "no id at all"), (405, "x" * 50_000)]
    return texts + texts[:5]


def test_fim(spark):
    texts = fim_texts()
    data = spark.createDataFrame([(i, t, 1, "f", 0) for i, t in texts], "doc_id long, text string, n int, form string, output int")
    want = sorted(((i, *brute_fim(i, t)) for i, t in texts), key=repr)
    got = sorted((tuple(r) for r in fim.fill_in_middle(data).collect()), key=repr)
    assert got == want and {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = sorted((tuple(r) for r in fim.fim_digest(data).collect()), key=repr)
    assert digests == sorted(((i, *brute_fim(i, t)[:4], brute.sha(brute_fim(i, t)[4]), brute.sha(t or "")) for i, t in texts), key=repr)
    assert fim.fim_digest(data.limit(0)).count() == 0


def test_cut_index():
    text = "aé日😀 plain ascii 😀😀é end"
    index, raw = fim.CutIndex(text.encode()), text.encode()
    chars = np.arange(len(text) + 1)
    ends = np.array([len(text[:k].encode()) for k in chars])
    assert index.to_bytes(chars).tolist() == ends.tolist() and index.to_chars(ends).tolist() == chars.tolist()
    assert len(fim.CutIndex(b"only ascii " * 1000).at) == 0 and len(index.at) == sum(ord(c) > 127 for c in text) and raw


# 13 line dedup

def brute_lines(docs, least=40, least_docs=5):
    blank = "\x20\x09\x0a\x0b\x0c\x0d"
    ident = lambda i: -(1 << 63) if i is None else i
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            key = x.strip(blank).translate(brute.LOW)
            if len(key) >= least:
                held[key].add(ident(i))
    out = []
    for i, t in docs:
        every = (t or "").split("\n")
        stay = [x for x in every if not (len(held[k := x.strip(blank).translate(brute.LOW)]) >= least_docs and max(held[k]) != ident(i))]
        out.append((i, len(every), len(every) - len(stay), brute.sha("\n".join(stay))))
    return sorted(out, key=repr)


def line_docs():
    rng = random.Random(3)
    common = ["The same line of forty characters or more %d" % k for k in range(12)] + ["é" * 39, "é" * 40, "short", "", "\x85" + "z" * 50 + " "]
    docs = []
    for i in range(90):
        picked = [rng.choice(common) for _ in range(rng.randrange(1, 9))]
        picked = [rng.choice(["", " ", "\t", "\r"]) + (x.upper() if rng.random() < 0.2 and x.isascii() else x) + rng.choice(["", "  ", "\r"]) for x in picked]
        docs.append((i, "\n".join([*picked, f"a line that only this one document holds, number {i}"])))
    docs += [(200 + i, "A line that is in every other document of these as a hot one") for i in range(80)]
    docs += [(None, docs[0][1]), (None, docs[1][1] + "\n"), (400, None), (401, ""), (402, "\n\n"), (403, (common[0] + "\n") * 20_000)]
    docs += [docs[5], (5, docs[6][1])]  # a repeated row, and its id with another text
    return docs


@pytest.mark.parametrize("batches,fanout,hot", [(4, 2, 1024), (1, 2, 1024), (5, 3, 8)])
def test_lines(spark, monkeypatch, batches, fanout, hot):
    monkeypatch.setattr(lines, "HOT", hot)
    docs = line_docs()
    data = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, id int, n int, key string").repartition(5)
    got = lines.drop_lines(data, digest=True, batches=batches, fanout=fanout)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(docs)


def test_lines_small(spark):
    data = spark.createDataFrame(line_docs(), "doc_id long, text string")
    texts = {r.doc_id: r for r in lines.drop_lines(data).collect()}
    assert "every other document" in texts[279].kept and texts[278].kept == "" and texts[278].n_dropped == 1
    assert lines.line_digest(data.limit(0)).count() == 0


def test_line_runs_levels(spark):
    """Four runs of fanout 2 end as one of level 2; a key keeps its first batch's
    keeper; stored runs are joined without an exchange."""
    runs = lines.LineRuns(spark, 2)
    for ids in ((40, 41), (30, 31), (20,), (10,)):
        rows = [(b"every", i) for i in ids] + [(b"own%d" % i, i) for i in ids]
        runs.add(spark.createDataFrame(rows, "key binary, id long"))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = {bytes(r.key): (r.n, r.keeper) for r in runs.merged().collect()}
    assert got[b"every"] == (6, 41) and got[b"own10"] == (1, 10) and len(got) == 7
    batch = spark.createDataFrame([(b"every", 1, 5)], "key binary, n long, top long")
    plan = runs.judged(batch)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the batch's own
    assert [r.keeper for r in runs.judged(batch).collect()] == [None]
    runs.drop()
