"""Deep pages against the sorted page, and counts from sketches."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rowsync.operators import events as ev
from rowsync.operators import search
from rowsync.sinks.tables import Tables


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, updated_at timestamp_ntz, name string")


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    ids = rng.sample(range(-5000, 5000), 600)
    rows = []
    for n, i in enumerate(ids):
        if n < 200:
            at = t0  # one instant holds a third
        elif n < 260:
            at = t0 + dt.timedelta(microseconds=1)
        elif n < 290:
            at = None
        else:
            at = t0 + dt.timedelta(seconds=rng.randrange(-10**6, 10**6))
        rows.append((i, at, f"n{i}"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] - t0).total_seconds() if r[1] else 0, r[0]))]
    return docs(spark, rows).cache(), want


@pytest.mark.parametrize("most", [1 << 16, 40, 3])
def test_deep_pages(spark, pages, monkeypatch, most):
    data, want = pages
    monkeypatch.setattr(search, "BINS", 16)
    for page in (1, 11, 23, 24, 25):
        got = search.browse_deep(data, page, 25, most).collect()
        assert sorted(r.id for r in got) == sorted(want[(page - 1) * 25:page * 25]), page
        assert all(r.total == 600 for r in got)


def test_deep_pages_of_odd_tables(spark):
    none = docs(spark, [])
    assert search.browse_deep(none, 1).count() == 0
    blank = docs(spark, [(i, None, "x") for i in range(30)])
    assert [r.id for r in search.browse_deep(blank, 2, 25).collect()] == list(range(25, 30))
    assert search.browse_deep(blank, 0, 5).count() == 5 and search.browse_deep(blank, 9, 25).count() == 0


def test_page_sorts_only_its_range(spark):
    rows = spark.range(200_000).select("id", F.timestamp_micros(F.col("id") * 1_000_000).cast("timestamp_ntz").alias("updated_at"))
    page = search.browse_deep(rows, 7000, 25, most=1000)
    assert sorted(r.id for r in page.collect()) == list(range(199_999 - 7000 * 25 + 1, 199_999 - 6999 * 25 + 1))
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "updated_at" in plan and "Sort" in plan and ">=" in plan  # a bounded range is sorted


def test_sketches_merge(spark):
    def rows(lo, hi):
        return spark.range(lo, hi).select(F.concat(F.lit("e"), "id").alias("event_id"), (F.col("id") % 5000).alias("product_id"), F.lit("update").alias("op"),
                                          F.lit(1).cast("long").alias("version"), F.lit(None).cast("string").alias("payload"), F.lit(None).cast("timestamp_ntz").alias("consumed_at"))
    t = Tables.fresh(spark, "sketch", 4)
    assert t.append_events(rows(0, 20_000)) == 20_000
    assert t.append_events(rows(10_000, 30_000)) == 10_000  # half is stored already
    assert t.append_events(rows(0, 100)) == 0
    got = ev.event_counts_of_sketches(t.event_sketches())
    r = got.first()
    assert r.events == 30_000 and abs(r.event_ids - 30_000) <= 600 and abs(r.products - 5000) <= 100
    files = got.inputFiles()
    assert files and all("event_sketches" in f for f in files)  # the store itself is not read
    assert tuple(ev.event_counts_of_sketches(Tables.fresh(spark, "none", 4).event_sketches()).first()) == (0, 0, 0)
