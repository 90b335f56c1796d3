"""Comparison of two keyed tables by a tree of digests over id ranges.

A node covers a range of ids: ``width`` of them at the leaves, ``fanout`` times
as many on each level above. Its digest is (rows, version sum, xor of the rows'
hashes), so digests of children add up to their parent's, in any order and by
partial aggregation: a side is read once, two columns wide, and shuffles one
short row per leaf. The sides are compared from the top; only children of nodes
that differ are looked at, and only rows of leaves that differ are compared by
key. What moves follows the differences, not the tables.

Ids are longs, unique within a side; negative ids have nodes of their own. A null
id is in no range and is not compared. Equal digests of different rows need equal
counts, sums and 64-bit xors at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .monitor import _versions_by_key

LEAF_WIDTH, FANOUT = 1024, 64
DIGEST = ["n", "versions", "digest"]


def node_of(key: Column, width: int) -> Column:
    """The node of an id (or of a node of the level below): floored division."""
    return F.floor((key - F.pmod(key, F.lit(width))) / F.lit(width)).cast("long")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read again: the digests of
    a side are made once, however many levels are compared."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leaf_digests(rows: DataFrame, key: str = "id", version: str = "version", width: int = LEAF_WIDTH) -> DataFrame:
    """(node, n, versions, digest) of every leaf that holds a row."""
    rows = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(version).cast("long").alias("v"))
    return rows.groupBy(node_of(F.col("k"), width).alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("versions"),
        F.bit_xor(F.xxhash64("k", "v")).alias("digest"))


def combined(digests: DataFrame, span: int) -> DataFrame:
    """Digests of the ancestors that cover ``span`` nodes each."""
    return digests.groupBy(node_of(F.col("node"), span).alias("node")).agg(
        F.sum("n").alias("n"), F.sum("versions").alias("versions"), F.bit_xor("digest").alias("digest"))


def _unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose digests differ (or that one side lacks): tagged, unioned and
    aggregated once, as a full outer join of equal keys would give them."""
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))

    def of(side):
        return F.max(F.when(F.col("side") == side, F.struct(*DIGEST)))
    return both.groupBy("node").agg(of(0).alias("a"), of(1).alias("b")).where(~F.col("a").eqNullSafe(F.col("b"))).select("node")


def unlike_leaves(a: DataFrame, b: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves that differ between two sides' stored leaf digests, found from the
    top level down."""
    far = a.unionByName(b).agg(F.max(F.abs("node"))).first()[0] or 0
    levels = 0
    while fanout ** levels <= far:
        levels += 1
    found = None
    for level in range(levels, -1, -1):
        span = fanout ** level
        sides = []
        for side in (a, b):
            if found is not None:  # children of what differs above; AQE broadcasts the list where it is short
                side = side.join(found.withColumnRenamed("node", "_up"), node_of(F.col("node"), span * fanout) == F.col("_up"), "left_semi")
            sides.append(combined(side, span) if level else side)
        found = stored(_unlike(*sides), f"digest-level-{level}")
    return found


def _rows_of(side: DataFrame, leaves: DataFrame, bounds: tuple[int, int], key: str, width: int) -> DataFrame:
    lo, hi = bounds
    rows = side.select(key, "version").where(F.col(key).between(lo * width, hi * width + width - 1))  # pushed into the scan
    return rows.join(leaves.withColumnRenamed("node", "_leaf"), node_of(F.col(key).cast("long"), width) == F.col("_leaf"), "left_semi")


def digest_differences(a: DataFrame, b: DataFrame, key: str = "id", width: int = LEAF_WIDTH, fanout: int = FANOUT) -> tuple[DataFrame, dict]:
    """(key, s_version, d_version) of every id whose versions differ or that one side
    lacks, and the digests that were compared: the leaf digests of both sides and
    the leaves that differ."""
    one, two = (stored(leaf_digests(x, key, "version", width), "digest-leaves") for x in (a, b))
    leaves = unlike_leaves(one, two, fanout)
    lo, hi = leaves.agg(F.min("node"), F.max("node")).first()
    bounds = (lo, hi) if lo is not None else (0, -1)
    left, right = (_rows_of(x, leaves, bounds, key, width) for x in (a, b))
    pairs = _versions_by_key(left, right, None, key).select(key, "s_version", "d_version")
    return pairs.where(~F.col("s_version").eqNullSafe(F.col("d_version"))), {"a": one, "b": two, "leaves": leaves, "rows": (left, right)}


def kind_of_difference() -> Column:
    s, d = F.col("s_version"), F.col("d_version")
    return (F.when(d.isNull(), "missing").when(s.isNull(), "extra").when(d < s, "stale").otherwise("ahead"))


def reconcile_by_digest(source: DataFrame, docs: DataFrame, key: str = "id", width: int = LEAF_WIDTH, fanout: int = FANOUT) -> DataFrame:
    """``reconcile``'s document figures from digests: totals come from the leaves,
    classes from the rows of the leaves that differ. Versions are not null."""
    found, at = digest_differences(source, docs, key, width, fanout)
    kinds = found.select(kind_of_difference().alias("kind"))
    out = kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("missing", "extra", "stale", "ahead")])

    def total(side, column):
        return at[side].agg(F.coalesce(F.sum(column), F.lit(0)).cast("long")).scalar()
    out = out.withColumns({"source_n": total("a", "n"), "docs_n": total("b", "n"), "source_version_sum": total("a", "versions"),
                           "docs_version_sum": total("b", "versions"),
                           "leaves": at["a"].select("node").union(at["b"].select("node")).agg(F.count_distinct("node")).scalar(),
                           "leaves_unlike": at["leaves"].agg(F.count(F.lit(1))).scalar()})
    return out.withColumn("equal", F.col("source_n") - F.col("missing") - F.col("stale") - F.col("ahead"))
