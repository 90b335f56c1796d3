"""K-d tree partitioning into shards of near-equal bytes (SQL functions only).

A digest of each row (size, characters, codes of language and source, id, CRC of the
text) is written once. The dimensions are metadata; rows of equal text take the least
values of their group, so they are one point.
The tree is grown level by level over all open nodes at once: each node is cut
at the weighted quantile of its widest dimension (of its width in the whole table). The
quantile is found by distributed histograms (sum of sizes by node and bin), each pass
narrowing to the values within the bin that holds the cut, until that bin is a small part of
a shard. A bin of one value is known by its least and greatest, so it takes one pass. Where a
value itself is heavier than that (a language, or one text, may hold a third of all rows),
the cut goes on inside it by the next key: id, CRC, then a hash of the row. So copies
stay together where a shard can hold them and a group too large for one is split.

Only per-node figures (two rows a node) reach the driver: the tree has as many
leaves as shards.

Defined results: null text counts as empty; null language or source are values
like any other, a null id is placed as id 0, ids beyond 2^60 as 2^60. Repeated rows are rows of their own. An empty table gives
an empty result. Extra or clashing columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small_table, written

DIMS = ("size", "chars", "lang", "source", "id")  # the metadata dimensions, as longs
CHAIN = ("id", "crc", "fine")  # what orders rows of equal value
BINS = 4096
TOLERANCE = 1 / 1000  # of a shard's target: a bin so light, or of one row, needs no finer cut


def _digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    code = lambda c: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(1 << 20))
    near = F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
                       F.length(text).cast("long").alias("chars"), code("lang").alias("lang"), code("source").alias("source"), near.alias("id"),
                       F.monotonically_increasing_id().alias("row"))
    fine = F.xxhash64("doc_id", "row").bitwiseAND(F.lit((1 << 62) - 1))
    rows = written(rows.withColumn("fine", fine), "kd-rows")
    group = rows.groupBy("crc", "size", "chars").agg(*[F.min(c).alias(c) for c in ("lang", "source", "id")], F.count(F.lit(1)).alias("n"))
    group = group.filter("n > 1").select(*[F.col(c).alias(f"g_{c}") for c in ("crc", "size", "chars", "lang", "source", "id")])
    same = [F.col(c) == F.col(f"g_{c}") for c in ("crc", "size", "chars")]
    least = [F.coalesce(f"g_{c}", c).alias(c) for c in ("lang", "source", "id")]
    return written(rows.join(group, same, "left").select("doc_id", "size", "crc", "chars", *least, "row", "fine"), "kd-digest")


FAR = 1 << 60
KEYS = (*DIMS, "crc", "fine")
DEPTH = 1 + len(CHAIN)  # keys of a cut at most
_CUT = "node bigint, " + ", ".join(f"k{i} int, v{i} bigint" for i in range(DEPTH))


def _value(index: str) -> str:
    """SQL for the value of a row's key, by its number in KEYS."""
    return f"element_at(array({', '.join(KEYS)}), {index} + 1)"


def _padded(keys: list[tuple[str, int]]) -> list:
    return [x for k, v in keys for x in (KEYS.index(k), v)] + [None] * (2 * (DEPTH - len(keys)))


def _descend(rows: DataFrame, cuts: dict) -> DataFrame:
    """Move the rows of cut nodes to their children. A cut compares up to DEPTH
    keys in order; ``cuts`` has a few rows, so it is broadcast."""
    spark = rows.sparkSession
    moves = small_table(spark, [(n, *_padded(keys), left) for n, (keys, left) in cuts.items()], f"{_CUT}, left bigint")
    less = "false"
    for i in reversed(range(DEPTH)):
        less = f"CASE WHEN k{i} IS NULL THEN false ELSE {_value(f'k{i}')} < v{i} OR ({_value(f'k{i}')} = v{i} AND {less}) END"
    placed = rows.join(F.broadcast(moves), "node", "left")
    node = F.expr(f"CASE WHEN left IS NULL THEN node WHEN {less} THEN left ELSE left + 1 END")
    return written(placed.withColumn("node", node).select(*rows.columns), "kd-level")


def kd_tree(rows: DataFrame, shards: int) -> tuple[DataFrame, dict]:
    """``rows`` with the leaf of each as ``node``, and each leaf's shard."""
    span = rows.agg(*[F.min(d) for d in DIMS], *[F.max(d) for d in DIMS], F.sum("size")).first()
    total = span[-1] or 0
    slack = total / shards * TOLERANCE
    width = {d: max(1, (span[len(DIMS) + i] or 0) - (span[i] or 0)) for i, d in enumerate(DIMS)}
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    shares = {0: (0, shards)}  # node: its first shard, how many
    todo, made = [0] if shards > 1 and total else [], 1
    while todo:
        placed = rows.filter(F.col("node").isin(todo))
        stat = placed.groupBy("node").agg(F.sum("size").alias("w"), *[F.min(d).alias(f"lo_{d}") for d in DIMS],
                                          *[F.max(d).alias(f"hi_{d}") for d in DIMS])
        seek, found = {}, {}
        for r in stat.collect():  # a row for each open node
            _, n = shares[r["node"]]
            dim = max(DIMS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / width[d], d == "size"))
            chain = [dim, *[c for c in CHAIN if c != dim]]
            seek[r["node"]] = {"chain": chain, "fixed": [], "lo": r[f"lo_{dim}"], "hi": r[f"hi_{dim}"] + 1, "want": r["w"] * (n // 2) / n}
        while seek:
            seek = _narrow(placed, seek, slack, found)
        cuts, after = {}, []
        for node in todo:
            first, n = shares.pop(node)
            shares[made], shares[made + 1] = (first, n // 2), (first + n // 2, n - n // 2)
            if node in found:  # a node without rows has no cut
                cuts[node] = (found[node], made)
                after += [x for x in (made, made + 1) if shares[x][1] > 1]
            made += 2
        rows = _descend(rows, cuts)
        todo = after
    return rows, {k: v[0] for k, v in shares.items()}


def _narrow(placed: DataFrame, seek: dict, slack: float, found: dict) -> dict:
    """One histogram pass for all nodes that still seek their cut: the bin that
    holds the cut, whose nearer end is the cut if the bin is light enough. The pass
    also gives the range of the bin's values, and of the next key within it."""
    asked = []
    for node, s in seek.items():
        s["step"] = max(1, -(-(s["hi"] - s["lo"]) // BINS))
        after = s["chain"][len(s["fixed"]) + 1:]
        asked.append((node, *_padded([*s["fixed"], (s["chain"][len(s["fixed"])], s["lo"])]), s["hi"], s["step"], float(s["want"]), len(s["fixed"]),
                      KEYS.index(after[0]) if after else None))
    ask = small_table(placed.sparkSession, asked, f"{_CUT}, hi bigint, step bigint, want double, at int, after int")
    rows = placed.join(F.broadcast(ask), "node")
    x = " ".join(["CASE at", *[f"WHEN {i} THEN {_value(f'k{i}')}" for i in range(DEPTH)], "END AS x"])
    rows = rows.selectExpr("node", "want", "size", "hi", "step", " ".join(["CASE at", *[f"WHEN {i} THEN v{i}" for i in range(DEPTH)], "END AS lo"]), x,
                           f"{_value('after')} AS y",
                           " AND ".join(f"(at < {i + 1} OR {_value(f'k{i}')} = v{i})" for i in range(DEPTH - 1)) + " AS inside")
    sums = rows.filter("inside AND x >= lo AND x < hi").groupBy("node", "want", F.expr("(x - lo) div step").alias("bin")).agg(
        F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"), F.min("x").alias("least"), F.max("x").alias("most"),
        F.min("y").alias("y_least"), F.max("y").alias("y_most"))
    upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))  # BINS rows a node at most
    cross = sums.withColumn("upto", upto).filter("upto >= want").groupBy("node").agg(
        F.min(F.struct("bin", "w", "upto", "rows", "least", "most", "y_least", "y_most")).alias("x"))
    left = {}
    for node, x in ((r["node"], r["x"]) for r in cross.collect()):
        s = seek[node]
        lo, under, key = s["lo"] + x["bin"] * s["step"], x["upto"] - x["w"], s["chain"][len(s["fixed"])]
        last, single = len(s["fixed"]) + 1 == len(s["chain"]), x["least"] == x["most"]
        if x["w"] <= slack or x["rows"] == 1 or (single and last):
            up = x["upto"] - s["want"] <= s["want"] - under  # the nearer end of the bin
            found[node] = [*s["fixed"], (key, lo + (s["step"] if up else 0))]
        elif not single:
            left[node] = s | {"lo": x["least"], "hi": x["most"] + 1, "want": s["want"] - under}
        else:  # one heavy value: go on by the next key
            left[node] = s | {"fixed": [*s["fixed"], (key, x["least"])], "lo": x["y_least"], "hi": x["y_most"] + 1, "want": s["want"] - under}
    for node, s in seek.items():  # no bin reached the mark (rounding): everything goes left
        if node not in left and node not in found:
            found[node] = [*s["fixed"], (s["chain"][len(s["fixed"])], s["hi"])]
    return left


def kd_shards(docs: DataFrame, shards: int = 40, block_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row."""
    rows = _digest(docs)
    rows, first = kd_tree(rows, shards)
    leaf = F.create_map(*[x for k, v in first.items() for x in (F.lit(k), F.lit(v))])
    n = rows.count()
    blocks = max(1, -(-n // (shards * block_rows)))  # a shard is numbered in blocks, not in one window
    placed = rows.withColumn("shard", leaf[F.col("node")].cast("int")).withColumn("block", F.pmod(F.hash("fine"), F.lit(blocks)))
    placed = written(placed.select("doc_id", "size", "crc", "fine", "row", "shard", "block"), "kd-placed")
    sizes = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("rows"))
    offset = F.coalesce(F.sum("rows").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("shard", "block", offset.alias("offset"))
    number = F.row_number().over(Window.partitionBy("shard", "block").orderBy("crc", "fine", "row"))
    numbered = placed.withColumn("number", number).join(offsets, ["shard", "block"])
    return numbered.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                           (F.col("offset") + F.col("number") - 1).cast("long").alias("slot"),
                           F.lit(None).cast("int").alias("grown_shard"))
