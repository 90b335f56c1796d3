"""Numbers of a message that no long can hold are an error, not a null id."""

from rowsync.functions.events import parse_event


def test_numbers_out_of_range(spark):
    bodies = ['{"event_id":"a","product_id":7,"version":2}', '{"event_id":"b","product_id":1e30,"version":2}',
              '{"event_id":"c","product_id":7,"version":-1e25}']
    rows = spark.createDataFrame([(i, f"m{i}", b) for i, b in enumerate(bodies)], "delivery_id long, message_id string, body string")
    got = {r.delivery_id: r for r in parse_event(rows).collect()}
    assert got[0].error is None and (got[0].product_id, got[0].version) == (7, 2)
    for i in (1, 2):
        assert got[i].error is not None and got[i].event_id is None and got[i].version is None
