"""The data-bearing cases of the reference's unit tests, as Spark tables."""
from pyspark.sql import functions as F

from rowsync.functions.events import parse_event
from rowsync.operators.events import dedupe_first, insert_if_absent
from rowsync.operators.monitor import sliding_rate
from rowsync.operators.outcomes import classify_outcomes, flatten_bulk


def test_classify_each_branch(spark):
    items = spark.createDataFrame([(1, 201, None), (2, 200, None), (3, 409, None),
                                   (4, 400, "mapper_parsing_exception"), (5, 429, None), (6, 503, None),
                                   (7, 404, None)], "id long, status int, error string")
    got = {r["id"]: (r["outcome"], r["error"]) for r in classify_outcomes(items).collect()}
    assert [i for i in got if got[i][0] == "ok"] == [1, 2]
    assert [i for i in got if got[i][0] == "duplicate"] == [3]
    assert sorted(i for i in got if got[i][0] == "retry") == [5, 6]
    assert sorted(i for i in got if got[i][0] == "dlq") == [4, 7]
    assert got[4][1] == "mapper_parsing_exception" and got[7][1] == "http 404"


def test_classify_partial_failure_497_3(spark):
    items = spark.range(1, 501).select(F.col("id"), F.when(F.col("id") <= 3, 400).otherwise(201).alias("status"),
                                       F.lit(None).cast("string").alias("error"))
    c = {r["outcome"]: r["n"] for r in classify_outcomes(items).groupBy("outcome").agg(
        F.count("*").alias("n")).collect()}
    assert c == {"ok": 497, "dlq": 3}


def test_flatten_bulk(spark):
    raw = spark.createDataFrame([('[{"index":{"_id":"10","status":201}},'
                                  '{"index":{"_id":"11","status":400,"error":{"type":"mapper_parsing_exception",'
                                  '"reason":"failed","caused_by":{"type":"number_format_exception",'
                                  '"reason":"bad"}}}}]',)], "items string")
    rows = sorted(flatten_bulk(raw).collect())
    assert (rows[0]["id"], rows[0]["status"], rows[0]["error"]) == (10, 201, None)
    assert rows[1]["error"] == "mapper_parsing_exception: failed (number_format_exception: bad)"


def test_sliding_rate_cases(spark):
    s = spark.createDataFrame([("m", 1000000, 500), ("m", 1001000, 500), ("m", 1002000, 500),
                               ("k", 0, 1000), ("k", 20000, 100)], "mode string, t_ms long, n long")
    got = {(r["mode"], r["t_ms"]): r["rate"] for r in sliding_rate(s).collect()}
    assert got[("m", 1002000)] == 750
    assert got[("k", 20000)] == 100


def test_parse_event_cases(spark):
    d = spark.createDataFrame([
        (1, None, '{"event_id":"7:3","product_id":7,"op":"update","version":3,"product":{"id":7}}'),
        (2, "1:1", '{"product_id":1,"version":1}'),
        (3, None, "{oops"),
        (4, None, '{"event_id":"x"}'),
        (5, None, "{} junk"),
        (6, "9:2", '{"product":{"id":9,"version":2}}'),
        (7, None, '"text"'),
        (8, None, ""),
        (9, "5:5", '{"product_id":true,"version":5}'),
    ], "delivery_id long, message_id string, body string")
    got = {r["delivery_id"]: r for r in parse_event(d).collect()}
    assert (got[1]["event_id"], got[1]["product_id"], got[1]["version"], got[1]["op"]) == ("7:3", 7, 3, "update")
    assert got[2]["event_id"] == "1:1" and got[2]["op"] == "update"
    assert got[3]["error"].startswith("invalid json")
    assert got[4]["error"] == "missing product_id/version"
    assert got[5]["error"].startswith("invalid json")
    assert (got[6]["product_id"], got[6]["version"]) == (9, 2)
    assert got[7]["error"] == "body is not an object"
    assert got[8]["error"].startswith("invalid json")
    assert got[9]["error"] == "missing product_id/version"


def test_insert_if_absent_and_dedupe(spark):
    batch = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "delivery_id long, event_id string")
    uniq = dedupe_first(batch)
    assert sorted((r["event_id"], r["delivery_id"]) for r in uniq.collect()) == [("a", 1), ("b", 2)]
    store = spark.createDataFrame([("b",)], "event_id string")
    assert [r["event_id"] for r in insert_if_absent(batch, store).collect()] == ["a"]
