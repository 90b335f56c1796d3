"""Reconciliation by a tree of digests against the per-key result."""
import random

import pytest
from pyspark.sql import functions as F

from rowsync.operators import digest_tree as D
from rowsync.operators.monitor import reconcile


def versions(spark, rows):
    return spark.createDataFrame(rows, "id long, version long")


@pytest.mark.parametrize("width,fanout", [(1024, 64), (8, 4), (1, 2)])
def test_equals_per_key_result(spark, width, fanout):
    rng = random.Random(width)
    source = {i: rng.randrange(1, 9) for i in range(-300, 3000) if rng.random() < 0.9}
    docs = dict(source)
    for i in rng.sample(sorted(docs), 40):
        kind = rng.randrange(3)
        if kind == 0:
            del docs[i]
        else:
            docs[i] += 2 * kind - 3
    docs |= {i: 5 for i in (100_000, 5_000_001, -90_000)}
    a, b = versions(spark, list(source.items())), versions(spark, list(docs.items()))
    events = spark.createDataFrame([], "product_id long, version long")
    want = reconcile(a, b, events).first().asDict()
    got = D.reconcile_by_digest(a, b, width=width, fanout=fanout).first().asDict()
    assert {k: got[k] for k in got if k in want} == {k: want[k] for k in got if k in want}
    unlike = {i // width for i in source.keys() | docs.keys() if source.get(i) != docs.get(i)}
    assert got["leaves_unlike"] == len(unlike) and got["leaves"] == len({i // width for i in source.keys() | docs.keys()})
    found, _ = D.digest_differences(a, b, width=width, fanout=fanout)
    assert {(r.id, r.s_version, r.d_version) for r in found.collect()} == {
        (i, source.get(i), docs.get(i)) for i in source.keys() | docs.keys() if source.get(i) != docs.get(i)}


def test_rows_compared_follow_the_differences(spark):
    rows = spark.range(200_000).select("id", (F.col("id") % 7).alias("version"))
    docs = rows.where("id NOT IN (77, 150000)")
    found, at = D.digest_differences(rows, docs, width=100, fanout=10)
    assert sorted(r.id for r in found.collect()) == [77, 150_000]
    assert [side.count() for side in at["rows"]] == [200, 198]  # two leaves of 2,000
    same, at = D.digest_differences(rows, rows)
    assert same.count() == 0 and at["leaves"].count() == 0


def test_empty_and_null_ids(spark):
    none = versions(spark, [])
    some = versions(spark, [(None, 1), (3, 2)])
    assert D.digest_differences(none, none)[0].count() == 0
    assert [tuple(r) for r in D.digest_differences(some, none)[0].collect()] == [(3, 2, None)]
    got = D.reconcile_by_digest(none, some).first()
    assert (got.extra, got.equal, got.docs_n) == (1, 0, 1)
