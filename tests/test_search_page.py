"""Paged search: five fields, exact totals, pages that follow each other, no shuffle of documents."""
from datetime import datetime

import pytest

from rowsync.operators.search import search_page

SCHEMA = "id long, name string, sku string, category string, attributes string, updated_at timestamp_ntz"


@pytest.fixture(scope="module")
def docs(spark):
    day = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [
        (1, "Blue gear", "S-1", "a", '{"brand":"Acme","tags":["blue","x y"],"description":"a gear"}', day[0]),
        (2, "red wheel", "S-2", "a", '{"brand":"gear","description":"BLUE, blue wheel"}', day[1]),
        (3, "red wheel", "gear", "b", "{}", day[2]),
        (4, None, None, None, None, None),
        (5, "plain", "S-5", "b", "not json", day[4]),
        (6, "plain", "S-6", "b", '{"tags":["gear","gear"]}', day[5]),
        (7, "gear gear gear", "S-7", "b", "{}", day[6]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_all_fields_are_searched(spark, docs):
    got = search_page(spark, docs, "gear").collect()
    assert {r["id"] for r in got} == {1, 2, 3, 6, 7} and {r["total"] for r in got} == {5}
    assert set(ids(search_page(spark, docs, "x y"))) == {1}  # a tag as a whole
    assert set(ids(search_page(spark, docs, "S-5"))) == {5}  # no text has its tokens
    assert ids(search_page(spark, docs, "y")) == [] and ids(search_page(spark, docs, "?!")) == []


def test_order_is_by_best_field_then_id(spark, docs):
    got = search_page(spark, docs, "blue").collect()
    assert [r["id"] for r in got] == [1, 2] and got[0]["score"] > got[1]["score"] > 0
    all_of = search_page(spark, docs, "gear").collect()
    assert [(-r["score"], r["id"]) for r in all_of] == sorted((-r["score"], r["id"]) for r in all_of)


def test_pages_follow_each_other(spark, docs):
    whole = ids(search_page(spark, docs, "gear", size=10))
    assert [i for p in (1, 2, 3) for i in ids(search_page(spark, docs, "gear", page=p, size=2))] == whole
    assert ids(search_page(spark, docs, "gear", page=0, size=2)) == whole[:2]
    assert ids(search_page(spark, docs, "gear", page=9, size=2)) == []


def test_category_number_and_no_query(spark, docs):
    got = search_page(spark, docs, "gear", category="b").collect()
    assert {r["id"] for r in got} == {3, 6, 7} and {r["total"] for r in got} == {3}
    # frequencies are those of all documents, whatever the category
    scores = {r["id"]: r["score"] for r in search_page(spark, docs, "gear").collect()}
    assert all(scores[r["id"]] == r["score"] for r in got)
    assert [(r["id"], r["score"], r["total"]) for r in search_page(spark, docs, " 6 ").collect()] == [(6, None, 1)]
    assert ids(search_page(spark, docs, "6", category="a")) == []
    assert ids(search_page(spark, docs, "", size=3)) == [7, 6, 5] and ids(search_page(spark, docs)) == [7, 6, 5, 3, 2, 1, 4]
    assert ids(search_page(spark, docs.limit(0), "gear")) == []


def test_documents_are_not_shuffled(spark, docs):
    page = search_page(spark, docs, "blue gear", page=2, size=2)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan and "Python" not in plan
