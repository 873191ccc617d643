"""Forms that keep large tables within their limits give the rows of the plain ones."""

import random
from collections import Counter
from datetime import datetime

import pytest

from brookmart import schemas
from brookmart.operators import keywords, visits, wide, windows
from brookmart.plans import catalog
from brookmart.streaming import stateful
from tests.test_state import hot_pages
from tests.test_streaming import PAGE, as_batch, chunks, sentinel, timed


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(df):
    return Counter(tuple(row) for row in df.select(*sorted(df.columns)).collect())


def counted_rows(rows):
    return Counter((r.id, r.mid, r.ts, r.last_page_id, r.event_ts, r.outcome) for r in rows)


PHRASES = [
    *[(datetime(2024, 1, 1, 0, 0, i % 3), f"red {i} Shoes red") for i in range(6)],
    (datetime(2024, 1, 1, 0, 1, 7), "blue shoes"), (datetime(2024, 1, 1, 0, 1, 7), "blue shoes"),
    (datetime(2024, 1, 1, 0, 1, 9), None), (datetime(2024, 1, 1, 0, 2), ""), (None, "no time"),
]


@pytest.mark.parametrize("busy", [0, 2, 100])
def test_phrases_dealt_by_window(spark, busy):
    rows = spark.createDataFrame(PHRASES, "event_ts timestamp, item string").repartition(3)
    got = counted(keywords.phrase_stats(rows, busy=busy))
    assert got == counted(windows.keyword_stats(keywords.split_words(rows)))


def test_words_of_a_quiet_window_are_not_exchanged(spark):
    rows = spark.createDataFrame(PHRASES, "event_ts timestamp, item string")
    plan = plan_of(keywords.phrase_stats(rows))
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # Two branches are counted; only that of the crowded windows sends words.
    assert plan.count("Generate explode") == 2
    assert len([line for line in exchanges if "keyword" in line]) == 1


@pytest.mark.parametrize(("bucket", "mix"), [(None, True), ("45 seconds", True), ("10 minutes", False)])
def test_bounces_in_the_state_of_an_aggregate(spark, feed, drain, bucket, mix):
    rows = hot_pages(5, n=400, span=1500)
    batches = [random.Random(i).sample(c, len(c)) if mix else c for i, c in enumerate(chunks(rows, 130))]
    stream = timed(feed([*batches, sentinel(0), sentinel(1)], PAGE))
    got = drain(stateful.bounce_stream(stream, bucket=bucket, built_in=True))
    want = visits.bounce_outcomes(as_batch(spark, rows))
    assert counted_rows(r for r in got if r.id < 10_000) == counted_rows(want.collect())
    assert {r.outcome for r in got} == {"matched", "timeout"}
    # Once the last page has closed all buckets, nothing of these devices is left in the state.
    assert drain.query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3


def test_query_of_bounces_calls_no_python_per_key(spark, monkeypatch, tmp_path):
    """One call per device and bucket took most of its time."""
    monkeypatch.setattr(stateful, "Bounces", None)
    made = [(i, i % 3, datetime(2024, 1, 1 + i // 2, i % 24), ("view", "click", "view", "error")[i % 4], float(i), '{"k": 7}') for i in range(40)]
    events = spark.createDataFrame(made, "event_id long, user_id long, ts timestamp, event_type string, value double, props string")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.all_queries()["stream_bounces"](spark, str(tmp_path))
    want = catalog.all_queries()["bounce_union"](spark, str(tmp_path)).select(*got.columns)
    assert counted(got) == counted(want) and got.count() > 0


def texts(spark, columns, rows):
    """Text rows; columns that are not given hold their own name and the row's number."""
    made = [tuple(row[c] if c in row else f"{c} {i}" for c in columns) for i, row in enumerate(rows)]
    return spark.createDataFrame(made, ", ".join(f"{c} string" for c in columns))


def test_refunds_joined_before_the_other_parts(spark):
    lines = [("1", "o1", "s1"), ("1", "o1", "s1"), ("2", "o1", "s2"), ("3", "o2", "s1"), (None, "o2", "s2"), ("5", None, "s1"), ("6", "o9", "s9"), ("7", "o3", None)]
    detail = texts(spark, schemas.ORDER_DETAIL, [{"id": a, "order_id": b, "sku_id": c} for a, b, c in lines])
    info = texts(spark, schemas.ORDER_INFO, [{"id": o} for o in ("o1", "o1", "o2", "o3", None)])
    activity = texts(spark, schemas.ORDER_DETAIL_ACTIVITY, [{"order_detail_id": d} for d in ("1", "1", "3", None)])
    coupon = texts(spark, schemas.ORDER_DETAIL_COUPON, [{"order_detail_id": d} for d in ("2", "6", None)])
    refunds = [("o1", "s1"), ("o1", "s1"), ("o2", "s1"), ("o2", "s2"), ("o9", "s9"), (None, "s1"), ("o3", None), ("o7", "s1")]
    refund = texts(spark, schemas.ORDER_REFUND_INFO, [{"order_id": o, "sku_id": k} for o, k in refunds])
    want = wide.refund_wide(refund, wide.order_wide(detail, info, activity, coupon))
    got = wide.refund_order_wide(refund, detail, info, activity, coupon)
    assert got.columns == want.columns == schemas.REFUND_WIDE
    assert counted(got) == counted(want) and got.count() > 10


def test_query_of_refunds_deals_no_wide_rows_by_sku(spark):
    """Only lines and refunds are dealt by order and sku, before any other join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = texts(spark, schemas.ORDER_DETAIL, [{}])
        refund = texts(spark, schemas.ORDER_REFUND_INFO, [{}])
        rest = [texts(spark, columns, [{}]) for columns in (schemas.ORDER_INFO, schemas.ORDER_DETAIL_ACTIVITY, schemas.ORDER_DETAIL_COUPON)]
        plan = plan_of(wide.refund_order_wide(refund, part, *rest))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert len(joins) == 4 and "sku_id" in joins[-1] and not any("sku_id" in line for line in joins[:-1])
