"""Every registered query against its DuckDB twin (the driver's gate).
Pure operators at sf0.01; table/stream jobs at sf0.001 to keep the run short
(the driver runs them all at sf0.01)."""
import pytest

import __spark_entry__ as E
from conftest import SF001, SF01
from oracle import compare
from rowsync.plans.catalog import QUERIES as CATALOG

JOBS = {"run_backfill", "versioned_upsert", "resume_after_crash", "run_backfill_outcomes", "dual_sink_write",
        "progress_commit", "event_append", "run_backfill_dlq", "run_incremental", "run_both", "run_consumer",
        "consumer_dlq_append", "stream_change_log", "stream_deliveries", "stream_dedupe_bounded",
        "stateful_version_gate", "dlq_replay", "dlq_replay_state", "dlq_replay_one", "scan_docs", "doc_by_id",
        "doc_count", "status_snapshot", "quality_checks", "compact_docs", "replay_twice",
        "incremental_two_runs", "resume_after_growth", "stream_change_log_polled", "run_both_at_once", "end_to_end",
        "end_to_end_events", "consumer_job_totals", "sink_job_totals", "stream_dedupe_evicting", "stream_dedupe_state", "event_counts_approx"}

QUERIES = {k: v for k, v in E.queries().items() if k in CATALOG}
ORACLE = {k: v for k, v in E.oracle_sql().items() if k in CATALOG}


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in JOBS))
def test_operator_matches_oracle(spark, duck01, name):
    compare(QUERIES[name](spark, SF01), duck01, ORACLE[name])


@pytest.mark.parametrize("name", sorted(JOBS))
def test_job_matches_oracle(spark, duck001, name):
    compare(QUERIES[name](spark, SF001), duck001, ORACLE[name])


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert set(df.columns) == {"outcome", "op", "n"}
    assert df.count() > 0
