"""A record's trace over all stores, in one aggregate."""
from rowsync.operators.monitor import record_trace


def test_trace_of_all_sinks_without_joins(spark):
    ids = spark.createDataFrame([(1,), (2,), (9,), (2,)], "id long")
    source = spark.createDataFrame([(1, 5), (2, 1), (3, 1)], "id long, version long")
    docs = spark.createDataFrame([(1, 4), (3, 1)], "id long, version long")
    events = spark.createDataFrame([(1, v, f"1:{v}") for v in range(1, 6)] + [(3, 1, "3:1")], "product_id long, version long, event_id string")
    dlq = spark.createDataFrame([("es", 1, "open", 2), ("rabbitmq", 1, "resolved", 1), ("rabbitmq", 2, "open", 1)],
                                "sink string, record_id long, status string, attempts int")
    trace = record_trace(ids, source, docs, events, dlq, 3)
    assert sorted((tuple(r) for r in trace.collect()), key=lambda r: r[0]) == [
        (1, 5, 4, "1:5,1:4,1:3", 5, "open", 2, "es:open:2,rabbitmq:resolved:1"),
        (2, 1, None, None, 0, None, None, "rabbitmq:open:1"),
        (9, None, None, None, 0, None, None, None)]
    plan = trace._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "WindowGroupLimit" in plan
    assert record_trace(ids.limit(0), source, docs, events, dlq).count() == 0
