"""Plan shape checks: scans pruned, no Python in default paths, skew-safe windows."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF01
from rowsync.operators.prefix import running_sums
from rowsync.plans.catalog import QUERIES
from rowsync.sources.fixtures import Fixtures


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_default_paths(spark):
    for name in ["change_batch_summary", "parse_event", "validate_strict", "reconcile", "search_scored",
                 "sliding_rate", "dedupe_first", "collapse_changes", "record_trace"]:
        p = plan(QUERIES[name](spark, SF01))
        assert "Python" not in p and "ArrowEval" not in p, name


def test_scan_is_pruned_and_filter_pushed(spark):
    f = Fixtures(spark, SF01)
    df = f.change_log.where(F.col("seq") > 4000).select("seq", "op")
    p = plan(df)
    assert "PushedFilters: [IsNotNull(seq), GreaterThan(seq,4000)]" in p
    assert "ReadSchema: struct<seq:bigint,op:string>" in p


def test_top_n_per_key_has_partial_group_limit(spark):
    p = plan(QUERIES["last_n_per_key"](spark, SF01))
    assert "WindowGroupLimit" in p


def test_running_sums_match_window_across_ranges(spark):
    """Narrow ranges force the cross-range offsets path; result equals a plain window."""
    f = Fixtures(spark, SF01)
    m = f.mutations.select("seq", "product_id")
    got = running_sums(m, ["product_id"], "seq", {"n": F.lit(1)}, width=64)
    w = Window.partitionBy("product_id").orderBy("seq")
    want = m.withColumn("n", F.row_number().over(w).cast("long"))
    assert got.select("seq", "n").exceptAll(want.select("seq", "n")).count() == 0
    assert got.count() == want.count()


def test_collapse_is_partial_aggregate(spark):
    p = plan(QUERIES["collapse_changes"](spark, SF01))
    assert "partial_max_by" in p or "partial_" in p


def test_mutation_state_joins_nothing(spark):
    """The op travels with the write: rows are aggregated once, without a join on seq."""
    from rowsync.operators.derive import mutation_state
    plan = mutation_state(Fixtures(spark, SF01).writes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_a_point_read_prunes_buckets(spark):
    """One document reads its own bucket folder, with the id pushed into the scans."""
    from rowsync.sinks.tables import Tables, bucket_of
    t = Tables.fresh(spark, "point", 8)
    t.seed_docs(spark.range(1, 500).select("id", F.lit(3).cast("long").alias("version")))
    one = t.doc(77)
    assert [(r["id"], r["version"]) for r in one.collect()] == [(77, 3)] and t.doc(1000).count() == 0
    plan = one._jdf.queryExecution().executedPlan().toString()
    bucket = spark.range(1).select(bucket_of(F.lit(77).cast("long"), 8)).first()[0]
    assert f"= {bucket})" in plan and "PushedFilters: [IsNotNull(id), EqualTo(id,77)]" in plan
