"""Near-duplicate vectors by a robust-pruned flat graph over overlapping shards.

Rows of equal label and vector form a class; classes are compared, copies are
not. Per label, vectors are dealt to the shards of their nearest centres, and to
those of other centres almost as near (the overlap). Centres are farthest-first
points of a bounded sample; points closer together than ``TIGHT`` get no centre
of their own, so a group of near copies is not cut up. A shard that is still too
large is dealt again; one that is a single tight group, of whatever size, is
compared in pairs of blocks instead, each a unit of work of bounded size.

1. In each unit a flat graph is built: every vector's candidates are the whole unit,
   robust-pruned (an edge goes where a kept neighbour is much nearer to the target).
   Tight subgroups would keep all their edges to themselves, so heads are chosen at a
   few radii: each vector has an edge to its nearest head of a radius, and the heads of
   a radius are pruned among themselves.
2. The adjacency lists of a vector's units are united.
3. Each unit searches the united graph for each of its vectors: greedy best-first
   from the medoid and the vector's own list, then by range: every vector met within
   range, or beyond it by the widest radius of heads, is expanded until no new one
   turns up. Cosines in double precision verify what was met; they add nothing.
4. Recall is audited against brute force, a join by label: a hash sample of query
   vectors, and of those that have links, over all rows of their label. While any
   label is below ``RECALL`` the overlap is widened and the search repeated; labels
   still below it at the widest overlap are compared whole, exactly, in pairs of blocks.

A unit reports, for each vector, how many others it links to (a pair in several
shards counts in the first they share) and the smallest vector that links reach
in the unit, so a group of m near copies costs m rows, not m squared.

Bounds: about ``SAMPLE`` vectors place the centres of one pass; about ``QUERIES``
vectors in all, and ``LABEL_QUERIES`` of each label with links or of more than one
shard, are audited. Every row is indexed and searched.

Defined results: null labels, and vectors that are null, empty, zero or hold
null or non-finite components, link with nothing. Vectors of different length
never meet (they are dealt by length too). Repeated rows count once; rows that
repeat an id with another vector are one node. A null id gets null component,
no links, and is kept. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

COSINE = 0.98
SHARD, LARGEST = 400, 1000  # wanted and greatest size of a shard
SAMPLE, AT_ONCE, CENTRES = 65_536, 1024, 64  # per pass: vectors, shards, centres a shard
TIGHT = 0.95  # a point this near to a centre needs none of its own
DEGREE, ALPHA, BEAM = 24, 1.2, 24
HEADS = (1 / 2, 1 / 4, 1 / 8)  # radii of heads, of the angle of COSINE
MARGIN, STEP, WIDEST, COPIES = 0.08, 0.04, 0.2, 4  # of cosine; a vector is in so many shards at most, in more with a wider margin
QUERIES, LABEL_QUERIES, RECALL = 400, 40, 0.97
PASSES = 40


def valid(v: Column) -> Column:
    """A vector of finite components, not all zero."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(d, lambda x: x != 0), F.lit(False))


def unit(lists: pa.Array) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k centres: points of x, each the farthest from those before while
    any is not near one, then moved to the mean of their nearest points."""
    c = [0]
    near = x @ x[0]
    while len(c) < min(k, len(x)) and near.min() < TIGHT:
        c.append(int(near.argmin()))
        near = np.maximum(near, x @ x[c[-1]])
    centre = x[c]
    for _ in range(3):
        own = (x @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centre)
    return centre


def _centres(rows: DataFrame, large: list) -> dict[int, np.ndarray]:
    """Centres of each shard in ``large`` (shard, n), from about SAMPLE vectors
    in all; the driver holds that sample and the centres."""
    each = max(64, min(4096, SAMPLE // len(large)))
    share = F.create_map(*[x for r in large for x in (F.lit(r["shard"]), F.lit(min(1.0, each / r["n"])))])
    hash_ = F.pmod(F.xxhash64("cid", F.lit(1)), F.lit(1 << 20))
    picked = rows.filter(F.col("shard").isin([r["shard"] for r in large]))
    picked = picked.filter(hash_ < share[F.col("shard")] * (1 << 20)).select("shard", "cid", "v").toArrow().sort_by("cid")
    shard, out = np.asarray(picked["shard"]), {}
    vectors = picked["v"].combine_chunks()
    for r in large:
        at = np.flatnonzero(shard == r["shard"])
        if len(at):
            out[r["shard"]] = farthest_first(unit(vectors.take(pa.array(at))), max(2, min(CENTRES, -(-2 * r["n"] // SHARD))))
    return out


def deal(classes: DataFrame, margin: float, whole: DataFrame) -> DataFrame:
    """(shard, exact, cid, v, weight): each class in its shards. Each pass deals the
    shards that are too large to theirs; what one centre covers stays as it is, and
    so do the labels in ``whole``, which are marked exact."""
    copies = math.ceil(COPIES * margin / MARGIN - 1e-9) if margin > MARGIN else COPIES
    rows = classes.join(whole.select("label", F.lit(True).alias("exact")), "label", "left").withColumn("exact", F.coalesce("exact", F.lit(False)))
    rows = rows.select(F.xxhash64("label", F.size("v")).alias("shard"), F.col("exact").alias("done"), "exact", "cid", "v", "weight")
    kind = classes.schema["v"].dataType.simpleString()
    for _ in range(PASSES):
        sizes = rows.filter("NOT done").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LARGEST)
        large = sizes.orderBy(F.desc("n"), "shard").limit(AT_ONCE).collect()
        if not large:
            break
        shared = classes.sparkSession.sparkContext.broadcast(_centres(rows, large))

        def split(batches):
            known = shared.value
            for b in batches:
                shard, was = np.asarray(b.column("shard")), np.asarray(b.column("done").to_numpy(zero_copy_only=False), bool)
                take, new, done = [], [], []
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    c = known.get(s)
                    if c is None or was[at[0]]:
                        parts = [(at, np.full(len(at), s), was[at])]
                    elif len(c) == 1:
                        parts = [(at, np.full(len(at), s), np.ones(len(at), bool))]
                    else:
                        close = unit(b.column("v").take(pa.array(at))) @ c.T
                        best = np.argsort(-close, axis=1, kind="stable")[:, :copies]
                        top = np.take_along_axis(close, best, 1)
                        near = top >= top[:, :1] - margin
                        i, j = np.nonzero(near)
                        parts = [(at[i], _child(s, best[i, j]), np.zeros(len(i), bool))]
                    for x, y, z in parts:
                        take.append(x)
                        new.append(y)
                        done.append(z)
                if take:
                    at = pa.array(np.concatenate(take))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(new)), pa.array(np.concatenate(done)), *[b.column(c).take(at) for c in ("exact", "cid", "v", "weight")]],
                                                     ["shard", "done", "exact", "cid", "v", "weight"])

        rows = written(rows.mapInArrow(split, f"shard long, done boolean, exact boolean, cid long, v {kind}, weight long"), "dealt")
    return rows.drop("done")


def units(dealt: DataFrame) -> DataFrame:
    """``dealt`` with lo, hi and side: shards over LARGEST go by pairs of blocks."""
    sizes = dealt.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(LARGEST)).cast("int").alias("blocks"))
    rows = dealt.join(sizes, "shard").withColumn("side", F.pmod(F.xxhash64("cid", F.lit(3)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("shard", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "exact", "side", "cid", "v", "weight")


def _child(shard: int, k: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.uint64(shard & 0xFFFFFFFFFFFFFFFF) * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64) + np.uint64(1)
        x ^= x >> np.uint64(29)
        return (x * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def robust_prune(s: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n, degree) of the graph over points of cosine matrix ``s``;
    -1 fills. All other points are candidates. From the nearest on, an edge is kept
    and covers those that it is nearer to than the point is, by the factor alpha."""
    n = len(s)
    out = np.full((n, degree), -1, np.int64)
    gap = 1 - s.astype(np.float32)  # distances
    open_ = gap.copy()  # of the candidates that no edge covers yet
    np.fill_diagonal(open_, np.inf)
    row = np.arange(n)
    for k in range(min(degree, n - 1)):
        pick = open_.argmin(axis=1)
        live = open_[row, pick] < np.inf
        if not live.any():
            break
        out[live, k] = pick[live]
        open_[alpha * gap[pick] <= gap] = np.inf
        open_[row, pick] = np.inf
    return out


def heads(s: np.ndarray, radius: float) -> np.ndarray:
    """A net: points further than ``radius`` (an angle) from each other, such that
    every point is as near to one of them."""
    near, free, out = s >= np.cos(radius), np.ones(len(s), bool), []
    while free.any():
        out.append(int(free.argmax()))
        free &= ~near[out[-1]]
        free[out[-1]] = False
    return np.array(out, np.int64)


def flat_graph(s: np.ndarray, least: float = COSINE) -> list[np.ndarray]:
    """Adjacency lists over points of cosine matrix ``s``: robust-pruned edges, an
    edge to the nearest head of each radius, robust-pruned edges between the heads."""
    edges = [[g[g >= 0]] for g in robust_prune(s)]
    for part in HEADS:
        top = heads(s, part * np.arccos(least))
        if len(top) == len(s):  # nothing is so near
            continue
        for i, h in enumerate(top[s[:, top].argmax(axis=1)].tolist()):
            edges[i].append(np.array([h]))
        for h, g in zip(top.tolist(), robust_prune(s[np.ix_(top, top)])):
            edges[h].append(top[g[g >= 0]])
    return [np.setdiff1d(np.concatenate(e), [i]) for i, e in enumerate(edges)]


def range_search(s: np.ndarray, graph: np.ndarray, start: int, beam: int = BEAM, least: float = COSINE) -> np.ndarray:
    """For every point as the query: the points met. ``graph`` is a matrix of
    edges. Greedy best-first from ``start`` (and from the query's own list) for
    ``beam`` expansions, then every point met within range is expanded, and those
    beyond it by the widest radius of heads: a point in range has its head there."""
    n = len(s)
    near = s.astype(np.float32)
    met = np.eye(n, dtype=bool)
    met[:, start] = True
    todo = np.where(met, near, np.float32(-2))
    row, done = np.arange(n), np.zeros((n, n), bool)
    for _ in range(min(beam, n)):
        at = todo.argmax(axis=1)
        done[row, at] |= todo[row, at] > -2
        fresh = graph[at] & ~met
        met |= fresh
        np.copyto(todo, near, where=fresh)
        todo[row, at] = -2
    edges, wide = graph.astype(np.float32), s >= np.cos((1 + max(HEADS)) * np.arccos(least))
    while True:
        front = met & wide & ~done
        live = np.flatnonzero(front.any(axis=1))
        if not len(live):
            return met
        met[live] |= (front[live].astype(np.float32) @ edges) > 0
        done |= front


def _build(key, rows):
    """The adjacency lists of one unit."""
    cid = np.asarray(rows["cid"])
    x = unit(rows["v"].combine_chunks())
    return pa.table({"cid": pa.array(cid), "next": pa.array([cid[g] for g in flat_graph(x @ x.T)], pa.list_(pa.int64()))})


def _search(key, rows):
    """Found links of one unit, counted, and the components they make."""
    rows = rows.sort_by("cid")
    shard, lo, hi = (k.as_py() for k in key)
    cid, weight, side = (np.asarray(rows[c]) for c in ("cid", "weight", "side"))
    x = unit(rows["v"].combine_chunks())
    n = len(cid)
    s = x @ x.T
    graph = np.zeros((n, n), bool)
    for i, y in enumerate(rows["next"].to_pylist()):
        y = np.array(y or [], np.int64)
        at = np.minimum(np.searchsorted(cid, y), n - 1)
        at = at[cid[at] == y]
        graph[i, at] = graph[at, i] = True
    if rows["exact"][0].as_py():  # a label that the audit found wanting
        link = s >= COSINE
    else:
        found = range_search(s, graph, int(s.sum(axis=0).argmax()))  # from the medoid
        link = (found | found.T) & (s >= COSINE)
    np.fill_diagonal(link, False)
    if lo != hi:  # pairs within a block belong to its own unit
        link &= side[:, None] != side[None, :]
    low = np.arange(n)  # the smallest member reached, by rounds over the links
    while True:
        new = np.minimum(low, np.where(link, low[None, :], n).min(axis=1, initial=n))
        new = new[new]
        if (new == low).all():
            break
        low = new
    shards = [set(y) for y in rows["shards"].to_pylist()]
    counts = np.zeros(n, np.int64)
    alone = np.array([len(y) == 1 for y in shards])
    for i in np.flatnonzero(link.any(axis=1)).tolist():
        other = np.flatnonzero(link[i])
        if not alone[i]:  # a pair counts in the first shard that both are in
            other = np.array([j for j in other.tolist() if alone[j] or min(shards[i] & shards[j]) == shard], np.int64)
        counts[i] = weight[other].sum()
    return pa.table({"cid": pa.array(cid), "links": pa.array(counts), "low": pa.array(cid[low])})


def _true_links(key, rows):
    """True links of the queries among one block of their label's rows."""
    asked = np.asarray(rows["asked"].combine_chunks().to_numpy(zero_copy_only=False), bool)
    cid, weight = np.asarray(rows["cid"]), np.asarray(rows["weight"])
    if not asked.any() or asked.all():
        return pa.table({"cid": pa.array(cid[asked]), "n": pa.array(np.zeros(asked.sum(), np.int64))})
    x = unit(rows["v"].combine_chunks())
    near = (x[asked] @ x[~asked].T >= COSINE) & (cid[asked][:, None] != cid[~asked][None, :])
    return pa.table({"cid": pa.array(cid[asked]), "n": pa.array((near * weight[~asked]).sum(axis=1).astype(np.int64))})


def _audit(classes: DataFrame, found: DataFrame) -> DataFrame:
    """(label, n, m): true links of the audited vectors of each label and how many of
    them are found. Queries are a hash sample of all vectors, of each label of more
    than one shard, and of each label's vectors with links. They meet all rows of
    their label, which are cut into blocks of about LARGEST rows."""
    seen = found.groupBy("cid").agg(F.sum("links").alias("m"))
    rows = classes.withColumn("dim", F.size("v")).join(seen, "cid", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    counts = rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("m") > 0).alias("linked"))
    total = classes.count()
    share = F.greatest(F.lit(QUERIES / max(1, total)), F.when(F.col("rows") > LARGEST, F.lit(LABEL_QUERIES) / F.col("rows")),
                       F.when(F.col("m") > 0, F.lit(LABEL_QUERIES) / F.col("linked")))
    rows = rows.join(counts, ["label", "dim"]).withColumn("blocks", F.ceil(F.col("rows") / F.lit(LARGEST)).cast("int"))
    asked = written(rows.filter(F.pmod(F.xxhash64("cid", F.lit(7)), F.lit(1 << 20)) < share * (1 << 20) + 1), "asked")
    columns = ["label", "dim", "block", "cid", "v", "weight"]
    all_rows = rows.withColumn("block", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("blocks")).cast("int")).select(*columns, F.lit(False).alias("asked"))
    everywhere = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns, F.lit(True).alias("asked"))
    true = all_rows.unionByName(everywhere).groupBy("label", "dim", "block").applyInArrow(_true_links, "cid long, n long")
    true = true.groupBy("cid").agg(F.sum("n").alias("n"))
    return asked.select("label", "cid", "m").join(true, "cid").groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.least("n", "m")).alias("m"))


def near_vectors(vectors: DataFrame, margin: float = MARGIN) -> DataFrame:
    """vec_id, n_links, component_id, kept and recall (audited) of every row."""
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    usable = source.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & valid(F.col("v"))).distinct()
    usable = usable.withColumn("cid", F.xxhash64(F.col("label").cast("string"), "v"))
    classes = written(usable.groupBy("cid", "label", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vectors")
    whole = classes.select("label").limit(0)
    while True:
        dealt = written(deal(classes, margin, whole), "shards")
        work = units(dealt)
        lists = work.filter("NOT exact").groupBy("shard", "lo", "hi").applyInArrow(_build, "cid long, next array<long>")
        lists = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))
        homes = dealt.groupBy("cid").agg(F.collect_set("shard").alias("shards"))
        full = work.join(homes, "cid").join(lists, "cid", "left")
        found = written(full.groupBy("shard", "lo", "hi").applyInArrow(_search, "cid long, links long, low long"), "found")
        audited = written(_audit(classes, found), "audit")
        low = audited.filter(F.col("m") < F.lit(RECALL) * F.col("n")).select("label").join(whole, "label", "left_anti")
        n, m, wanting = audited.agg(F.sum("n"), F.sum("m"), F.count_if(F.col("m") < F.lit(RECALL) * F.col("n"))).first()
        recall = m / n if n else 1.0
        if not wanting or not low.limit(1).count():
            break
        if margin < WIDEST - 1e-9:
            margin += STEP
        else:
            whole = written(whole.unionByName(low), "whole")

    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "rep", "weight").join(counts, "cid", "left")
    reps = classes.select("cid", "rep")
    links = found.filter("low != cid").select("cid", "low").join(reps, "cid").join(
        reps.select(F.col("cid").alias("low"), F.col("rep").alias("b")), "low").select(F.col("rep").alias("a"), "b")
    members = usable.select("vec_id", "cid").join(known, "cid")
    copies = members.filter("vec_id != rep").select(F.col("rep").alias("a"), F.col("vec_id").alias("b"))
    labels = connected_components(links.unionByName(copies))
    per = members.groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = source.select("vec_id").join(per.withColumnRenamed("vec_id", "_id"), F.col("vec_id") == F.col("_id"), "left").join(
        labels, F.col("vec_id") == F.col("node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"), F.lit(float(recall)).alias("recall"))
