"""Prefix trie of conversations by a splitter skeleton.

A conversation is its path: the digests of its turns in order. Paths are sorted
and dealt to shards by splitters (a sample only places them; it changes no
result). The trie of the splitter paths, the skeleton, is broadcast: only its
nodes can have members in two shards. Each shard sorts its rows and finishes all
other nodes by itself; for skeleton nodes it gives partial aggregates, which are
reduced, and then summed up the skeleton. Rows that share a whole path are parted
by conv_id, so a group of equal conversations is no larger task than others.

Paths are kept in blocks of ``BLOCK`` turns: block b of a conversation is a path
in the trie of those that agree in all b * BLOCK turns before (two 64-bit sums
of block digests name it). So no row grows with a conversation, and positions
are counted over range partitions: a conversation may hold any share of all
turns. What deeper blocks add to a subtree is carried by the smallest member.

The digests of a node's ends are one SHA-256 over ids in order. A node that spans
shards is digested from the shards' joined ids, streamed in order by one task
(a digest cannot be combined), in memory of one shard's ids.

Defined results: turns are ordered by turn, null first, ties by the MD5 of role
and text. A null role or text is empty. Turns without conv_id belong to no
conversation. Repeated rows are turns of their own. ids are cast to long. An
empty table has no members, so no node, not even the root. Other columns are
dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK = 64  # turns of a path that one row holds
SHARD_ROWS = 1 << 12  # rows of a shard, until there are MOST_SHARDS
MOST_SHARDS = 1 << 14  # bounds the broadcast: splitters of at most 16 * BLOCK bytes each
PER_SHARD = 8  # sampled rows for each splitter
WIDTH = 16  # bytes of a turn's digest
KEY = ["b", "h1", "h2", "path", "conv_id"]
EMPTY = hashlib.sha256(b"").hexdigest()


def donated_turns():
    """h of a conv_id."""
    return (F.crc32(F.col("conv_id").cast("string")) % 9).cast("long")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, d, key, size) of every rebuilt turn, d from 1, and (conv_id,
    length) of every rebuilt conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(key).alias("key"),
                                 F.octet_length(text).cast("long").alias("size")).filter("conv_id IS NOT NULL")
    # positions: the row's number in the sorted table less its conversation's first
    order = ["conv_id", "turn", "key"]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.select("conv_id", "key", "size", F.monotonically_increasing_id().alias("at")), "trie-turns")
    placed = placed.withColumn("piece", F.shiftright("at", 33))
    pieces = placed.groupBy("conv_id", "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    by_piece = Window.partitionBy("conv_id").orderBy("piece")
    before = F.coalesce(F.sum("n").over(by_piece.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("conv_id", "piece", (F.col("first") - before).alias("zero"), F.sum("n").over(Window.partitionBy("conv_id")).alias("own"))
    pieces = pieces.withColumn("h", donated_turns())
    ids = pieces.select("conv_id", "own", "h").distinct()
    source = ids.select(F.col("conv_id").alias("source"), F.col("own").alias("theirs")).filter("source % 5 = 0")
    of = F.col("conv_id") - F.col("conv_id") % 5
    lengths = ids.withColumn("source", of).join(source, "source", "left").withColumn("given", F.least("h", F.coalesce("theirs", F.lit(0))))
    lengths = written(lengths.select("conv_id", "source", "h", "given", (F.col("given") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-lengths")
    pieces = pieces.join(lengths.select("conv_id", "given"), "conv_id").select("conv_id", "piece", "zero", "h", "given")
    at = written(placed.join(pieces, ["conv_id", "piece"]).select("conv_id", "h", "given", "key", "size", (F.col("at") - F.col("zero") + 1).alias("pos")), "trie-placed")
    mine = at.filter("pos > h").select("conv_id", (F.col("given") + F.col("pos") - F.col("h")).alias("d"), "key", "size")
    heads = at.filter("conv_id % 5 = 0 AND pos <= 8").select(F.col("conv_id").alias("source"), F.col("pos").alias("d"), "key", "size")
    theirs = lengths.filter("given > 0").join(heads, "source").filter("d <= given").select("conv_id", "d", "key", "size")
    return mine.unionByName(theirs), lengths.select("conv_id", "length")


def path_blocks(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """Rows (b, h1, h2, path, conv_id, sizes, last, n1, n2): one for each block of
    each conversation, one of no turns for a conversation without any."""
    none = lengths.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("b"), F.lit(None).cast("long").alias("d"),
                                               F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("size"))
    rows = turns.select("conv_id", F.expr(f"(d - 1) div {BLOCK}").alias("b"), "d", "key", "size").unionByName(none)
    # at most BLOCK turns a group
    rows = rows.groupBy("conv_id", "b").agg(F.sort_array(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "key", "size")))).alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["key"])), ""))
    rows = rows.select("conv_id", "b", path.alias("path"), F.transform("t", lambda x: x["size"]).alias("sizes"))
    rows = rows.join(lengths, "conv_id").withColumn("last", F.col("length") <= (F.col("b") + 1) * BLOCK)
    zero = F.lit(0).cast("long")
    short = rows.filter(f"length <= {BLOCK}").withColumns({c: zero for c in ("h1", "h2", "n1", "n2")})
    by_block = Window.partitionBy("conv_id").orderBy("b")

    def name(seed, end):
        return F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), F.col("b"), F.col("path"))).over(by_block.rowsBetween(Window.unboundedPreceding, end)), zero)

    long = rows.filter(f"length > {BLOCK}").withColumns({"h1": name(1, -1), "h2": name(2, -1), "n1": name(1, 0), "n2": name(2, 0)})
    return short.unionByName(long).select(*KEY, "sizes", "last", "n1", "n2")


def common(a: bytes, b: bytes) -> int:
    """Turns that two paths share at their beginning."""
    n = min(len(a), len(b)) // WIDTH
    for j in range(n):
        if a[j * WIDTH:(j + 1) * WIDTH] != b[j * WIDTH:(j + 1) * WIDTH]:
            return j
    return n


def skeleton(splitters: list[tuple]) -> dict:
    """The trie of the splitter paths: ``nodes[k]`` numbers the nodes from the root
    of splitter k's trie to its end; ``up`` is each node's parent (-1: none)."""
    nodes, up = [], []
    for k, (b, h1, h2, path, _) in enumerate(splitters):
        mine = []
        if k and splitters[k - 1][:3] == (b, h1, h2):
            mine = nodes[-1][:common(splitters[k - 1][3], path) + 1]
        while len(mine) <= len(path) // WIDTH:
            up.append(mine[-1] if mine else -1)
            mine = [*mine, len(up) - 1]
        nodes.append(mine)
    return {"keys": splitters, "nodes": nodes, "up": np.array(up, np.int64)}


def find_splitters(blocks: DataFrame, n_rows: int) -> list[tuple]:
    """Sorted keys that cut the table into shards of about equal rows."""
    n = min(MOST_SHARDS, -(-n_rows // SHARD_ROWS))
    if n < 2:
        return []
    wide = 1 << 30
    share = min(wide, -(-wide * n * PER_SHARD // n_rows))
    sample = blocks.select(*KEY).filter(F.pmod(F.xxhash64("conv_id", "b"), F.lit(wide)) < share)
    # of a bounded sample, about n * PER_SHARD rows
    ranked = sample.withColumn("rank", F.row_number().over(Window.orderBy(*KEY))).filter(f"rank % {PER_SHARD} = 0")
    return sorted((r.b, r.h1, r.h2, bytes(r.path), r.conv_id) for r in ranked.select(*KEY).distinct().collect())


NODE = ("b long, j long, h1 long, h2 long, skel long, above long, conv_id long, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, size long, goes_on boolean, n1 long, n2 long, ends_sha256 string, ends string, shard long")
_NAMES = [c.split()[0] for c in NODE.split(", ")]
_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in NODE.split(", ")])


def shard_nodes(rows: pa.Table, trie: dict) -> pa.Table:
    """All nodes of one shard: finished ones (skel null) and partial aggregates of
    skeleton nodes."""
    rows = rows.sort_by([(c, "ascending") for c in KEY])
    shard, n = rows.column("shard")[0].as_py(), rows.num_rows
    col = {c: rows.column(c).to_numpy() for c in ("b", "h1", "h2", "conv_id", "n1", "n2", "carry_leaves", "carry_saved")}
    last = np.asarray(rows.column("last").to_pylist(), np.bool_)
    paths = rows.column("path").to_pylist()
    digest = np.frombuffer(b"".join(paths), np.int64).reshape(-1, 2)
    length = np.fromiter((len(p) // WIDTH for p in paths), np.int64, n)
    at = np.cumsum(length) - length
    sizes = rows.column("sizes").combine_chunks().flatten().to_numpy()
    deepest = int(length.max())

    def shared(alive: np.ndarray, most, same) -> np.ndarray:
        """Turns shared with something, -1 where the trie is another one."""
        out = np.where(alive, 0, -1)
        alive = np.flatnonzero(alive)
        for j in range(deepest):
            alive = alive[most[alive] > j]
            if len(alive):
                alive = alive[same(alive, j)]
            if not len(alive):
                break
            out[alive] = j + 1
        return out

    def in_trie(b, h1, h2):
        return (col["b"] == b) & (col["h1"] == h1) & (col["h2"] == h2)

    before = np.arange(n) - 1
    kin = np.concatenate([[False], (np.diff(col["b"]) == 0) & (np.diff(col["h1"]) == 0) & (np.diff(col["h2"]) == 0)]) if n > 1 else np.zeros(1, np.bool_)
    lcp = shared(kin, np.minimum(length, length[before]), lambda i, j: (digest[at[i] + j] == digest[at[before[i]] + j]).all(axis=1))
    # depth to which a row lies on a path of the skeleton, and that path's splitter
    depth, side = np.full(n, -1), np.zeros(n, np.int64)
    for k in (shard - 1, shard):
        if 0 <= k < len(trie["keys"]):
            b, h1, h2, path, _ = trie["keys"][k]
            other = np.frombuffer(path, np.int64).reshape(-1, 2)
            found = shared(in_trie(b, h1, h2), np.minimum(length, len(other)), lambda i, j: (digest[at[i] + j] == other[j]).all(axis=1))
            side[found > depth] = k
            depth = np.maximum(depth, found)

    def open_nodes(row, j):
        return [trie["nodes"][k][j] for k in side[row].tolist()]

    def sums(values):
        return np.concatenate([[0], np.cumsum(values)])

    leaves, saved = col["carry_leaves"].copy(), col["carry_saved"].copy()
    child = np.zeros(n, np.int64)  # finished nodes that begin at the row, one level below
    out = []
    for j in range(deepest, -1, -1):
        breaks = np.flatnonzero(lcp < j)
        ends = np.append(breaks[1:], n)
        mine = length[breaks] >= j
        s, e = breaks[mine], ends[mine]
        if not len(s):
            continue
        rep = np.minimum.reduceat(col["conv_id"], breaks)[mine]
        is_open = depth[s] >= j
        on = sums((length == j) & ~last)
        goes_on = on[e] > on[s]
        kids = sums(child)
        n_children = kids[e] - kids[s]
        size = sizes[at[s] + j - 1] if j else np.zeros(len(s), np.int64)
        done = ~is_open
        # the root of a later block is a node of the block before
        leaf = done & (n_children == 0) & ~goes_on & (np.ones(len(s), np.bool_) if j else col["b"][s] == 0)
        leaves[s] += leaf
        saved[s[done]] += ((e - s - 1) * size)[done]
        child[:] = 0
        child[s[done]] = 1
        if j:
            above = np.flatnonzero(lcp < j - 1)
            of = np.searchsorted(above, s, "right") - 1
            parent = np.minimum.reduceat(col["conv_id"], above)[of]
            up_open = depth[s] >= j - 1
        else:
            parent, up_open = np.zeros(len(s), np.int64), np.zeros(len(s), np.bool_)
        total_leaves, total_saved = sums(leaves), sums(saved)
        stops = (length == j) & last
        here, upto = np.flatnonzero(stops), sums(stops)
        ids = col["conv_id"][here].tolist()
        said, sha = [], []
        for a, z, o in zip(upto[s].tolist(), upto[e].tolist(), is_open.tolist()):
            text = ",".join(map(str, ids[a:z]))
            said.append(text if o and z > a else None)
            sha.append(None if o else EMPTY if a == z else hashlib.sha256(text.encode()).hexdigest())
        goes = np.flatnonzero((length == j) & ~last)
        follow = goes[np.minimum(np.searchsorted(goes, s), max(len(goes) - 1, 0))] if len(goes) else np.zeros(len(s), np.int64)
        at_open, at_up = np.flatnonzero(is_open), np.flatnonzero(up_open)
        skel, higher = np.full(len(s), -1), np.full(len(s), -1)
        skel[at_open] = open_nodes(s[at_open], j)
        if j:
            higher[at_up] = open_nodes(s[at_up], j - 1)
        out.append(pa.table([
            pa.array(col["b"][s]), pa.array(np.full(len(s), j)), pa.array(col["h1"][s]), pa.array(col["h2"][s]),
            pa.array(skel, mask=~is_open), pa.array(higher, mask=~up_open), pa.array(rep),
            pa.array(parent, mask=up_open | (j == 0) | ((j == 1) & (col["b"][s] > 0))),
            pa.array(e - s), pa.array(n_children), pa.array(total_leaves[e] - total_leaves[s]), pa.array(total_saved[e] - total_saved[s]),
            pa.array(size.astype(np.int64)), pa.array(goes_on), pa.array(col["n1"][follow], mask=~goes_on), pa.array(col["n2"][follow], mask=~goes_on),
            pa.array(sha, pa.string()), pa.array(said, pa.string()), pa.array(np.full(len(s), shard))], schema=_SCHEMA))
    return pa.concat_tables(out)


def stream_digests(parts: DataFrame) -> DataFrame:
    """(skel, ends_sha256) of (skel, shard, ends): the ids of a node's shards, in
    order, through one digest."""
    def task(batches):
        now, state = None, None
        for batch in batches:
            done = []
            for skel, ends in zip(batch.column("skel").to_pylist(), batch.column("ends").to_pylist()):
                if skel != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = skel, hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["skel", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([state.hexdigest()])], ["skel", "ends_sha256"])

    ordered = parts.select("skel", "shard", "ends").repartition("skel").sortWithinPartitions("skel", "shard")
    return ordered.mapInArrow(task, "skel long, ends_sha256 string")


def trie_nodes(blocks: DataFrame, carry: DataFrame | None, n_rows: int) -> DataFrame:
    """Nodes of the tries of all blocks (``NODE``'s columns but skel and ends)."""
    spark = blocks.sparkSession
    trie = spark.sparkContext.broadcast(skeleton(find_splitters(blocks, n_rows)))

    def deal(batches):
        keys = trie.value["keys"]
        for t in batches:
            mine = zip(*(t.column(c).to_pylist() for c in KEY))
            yield t.append_column("shard", pa.array([bisect_right(keys, k) for k in mine], pa.int64()))

    if carry is None:
        blocks = blocks.withColumns({"carry_leaves": F.lit(0).cast("long"), "carry_saved": F.lit(0).cast("long")})
    else:
        blocks = blocks.join(carry, ["conv_id", "b"], "left").na.fill(0, ["carry_leaves", "carry_saved"])
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema.fields)
    dealt = blocks.mapInArrow(deal, f"{fields}, shard long")
    every = written(dealt.groupBy("shard").applyInArrow(lambda t: shard_nodes(t, trie.value), NODE), "trie-nodes")
    # skeleton nodes: reduce the shards' partial aggregates, then sum them up the skeleton
    parts = every.filter("skel IS NOT NULL")
    same = ["b", "j", "h1", "h2", "above", "size"]
    summed = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    whole = parts.groupBy("skel").agg(*[F.first(c).alias(c) for c in same], F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in summed],
                                      F.max("goes_on").alias("goes_on"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))
    whole = written(whole, "trie-skeleton")
    below = whole.filter("above IS NOT NULL").groupBy(F.col("above").alias("skel")).agg(F.count(F.lit(1)).alias("more"))
    whole = whole.join(below, "skel", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = whole.select("skel", F.expr("IF(n_children = 0 AND NOT goes_on AND (j > 0 OR b = 0), 1L, 0L)").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("value"))

    def climb(batches):
        up = trie.value["up"]
        for t in batches:
            node, leaf, value = (t.column(c).to_numpy() for c in ("skel", "leaf", "value"))
            while len(node):
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(leaf), pa.array(value)], ["skel", "leaf", "value"])
                node = up[node]
                stay = node >= 0
                node, leaf, value = node[stay], leaf[stay], value[stay]

    climbed = own.mapInArrow(climb, "skel long, leaf long, value long").groupBy("skel").agg(F.sum("leaf").alias("leaf"), F.sum("value").alias("value"))
    digests = stream_digests(parts.filter("ends IS NOT NULL"))
    heads = whole.select(F.col("skel").alias("above"), F.col("conv_id").alias("head"))
    whole = whole.join(climbed, "skel").join(digests, "skel", "left").join(heads, "above", "left")
    columns = ["b", "j", "h1", "h2", "conv_id", "parent_conv_id", *summed, "goes_on", "n1", "n2", "ends_sha256"]
    top = F.expr("IF(j = 1 AND b > 0, NULL, head)").alias("parent_conv_id")
    whole = whole.select("b", "j", "h1", "h2", "conv_id", top, "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
                         (F.col("saved_tokens") + F.col("value")).alias("saved_tokens"), "goes_on", "n1", "n2", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    local = every.filter("skel IS NULL")
    under = local.filter("above IS NOT NULL").join(heads, "above").withColumn("parent_conv_id", top)
    return local.filter("above IS NULL").select(*columns).unionByName(under.select(*columns)).unionByName(whole.select(*columns))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The contract's columns, one row per node."""
    blocks = written(path_blocks(*rebuilt_turns(conversations)), "trie-blocks")
    n_rows, deepest = blocks.agg(F.count(F.lit(1)), F.max("b")).first()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    depth = (F.col("b") * BLOCK + F.col("j")).alias("depth")
    if not deepest:  # no path goes beyond its first block
        return trie_nodes(blocks, None, n_rows).withColumn("depth", depth).select(*columns)
    # what the tries of later blocks hold goes to their smallest member, and from
    # there to all its earlier blocks
    later = blocks.filter("b > 0")
    held = trie_nodes(later, None, later.count()).filter("j = 0").select("conv_id", "b", "n_leaves", "saved_tokens")
    reach = blocks.filter("b > 0 OR NOT last").select("conv_id", "b").join(held, ["conv_id", "b"], "left")
    # descending, so that the sum runs
    after = Window.partitionBy("conv_id").orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.select("conv_id", "b", F.coalesce(F.sum("n_leaves").over(after), F.lit(0)).alias("carry_leaves"),
                         F.coalesce(F.sum("saved_tokens").over(after), F.lit(0)).alias("carry_saved"))
    nodes = written(trie_nodes(blocks, carry, n_rows), "trie-all")
    tops = nodes.filter("b > 0 AND j = 0").select(F.col("b"), F.col("h1"), F.col("h2"), F.col("n_children").alias("more"))
    ends = nodes.filter("goes_on").select((F.col("b") + 1).alias("b"), F.col("n1").alias("h1"), F.col("n2").alias("h2"), F.col("conv_id").alias("head"))
    crossing = nodes.filter("goes_on").withColumns({"next": F.col("b") + 1}).join(
        tops.select(F.col("b").alias("next"), F.col("h1").alias("n1"), F.col("h2").alias("n2"), "more"), ["next", "n1", "n2"])
    crossing = crossing.withColumn("n_children", F.col("n_children") + F.col("more"))
    heads = nodes.filter("b > 0 AND j = 1 AND NOT goes_on").join(ends, ["b", "h1", "h2"]).withColumn("parent_conv_id", F.col("head"))
    rest = nodes.filter("NOT goes_on AND NOT (b > 0 AND j <= 1)")
    out = None
    for part in (crossing, heads, rest):
        part = part.withColumn("depth", depth).select(*columns)
        out = part if out is None else out.unionByName(part)
    return out
