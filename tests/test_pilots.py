"""Expected counts of the survey's pilots at sf0.01."""
from pyspark.sql import functions as F

from conftest import SF01
from rowsync.functions.events import parse_event
from rowsync.functions.validate import validate_strict
from rowsync.operators.collapse import collapse_changes, join_changes_current
from rowsync.operators.gate import gate_outcomes
from rowsync.operators.outcomes import classify_outcomes
from rowsync.plans.catalog import backfill_outcomes
from rowsync.sources.changes import scan_changes
from rowsync.sources.fixtures import Fixtures


def counts(df, *cols):
    return {tuple(r[c] for c in cols): r["n"] for r in df.groupBy(*cols).agg(F.count("*").alias("n")).collect()}


def test_fixture_sizes(spark):
    f = Fixtures(spark, SF01)
    assert f.change_log.count() == 10000 and f.products.count() == 2000 and f.docs_old.count() == 1334
    assert counts(f.change_log, "op") == {("insert",): 150, ("delete",): 1025, ("update",): 8825}
    assert f.deliveries.count() == 11428 and f.dlq.count() == 111
    assert f.products.where(F.col("deleted_at").isNotNull()).count() == 71


def test_minimum_slice_pilot(spark):
    f = Fixtures(spark, SF01)
    as_of = f.change_log.agg(F.max("changed_at")).scalar()
    page = scan_changes(f.change_log, 4000, as_of, 86_400_000, None)
    out = gate_outcomes(validate_strict(join_changes_current(collapse_changes(page), f.products)), f.docs_old)
    assert counts(out, "outcome", "op") == {("ok", "update"): 106, ("ok", "delete"): 11,
                                            ("duplicate", "update"): 26, ("duplicate", "delete"): 5,
                                            ("dlq", "update"): 1, ("dlq", "delete"): 1}


def test_backfill_pilot(spark):
    assert counts(backfill_outcomes(Fixtures(spark, SF01)), "outcome") == {
        ("ok",): 1562, ("duplicate",): 414, ("dlq",): 24}


def test_classify_pilot(spark):
    assert counts(classify_outcomes(Fixtures(spark, SF01).bulk_items), "outcome") == {
        ("ok",): 6955, ("duplicate",): 435, ("retry",): 870, ("dlq",): 1740}


def test_parse_pilot(spark):
    p = parse_event(Fixtures(spark, SF01).deliveries)
    c = counts(p, "error")
    assert c[(None,)] == 10893
    assert c[("invalid json",)] == 118 and c[("body is not an object",)] == 127
    assert c[("missing event_id",)] == 155 and c[("missing product_id/version",)] == 135
    assert p.where(F.col("error").isNull()).select("event_id").distinct().count() == 9597
