"""Rows that are dealt with their texts packed."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from brookmart import schemas
from brookmart.functions.packing import packed, unpacked
from brookmart.operators import wide, windows
from brookmart.plans import catalog
from brookmart.sources.standins import Standins
from brookmart.streaming import sinks
from tests.test_scale import counted, plan_of, texts

ODD = [None, "", "0", "007", "-1.50", "1997-01-31 00:00:01", "12\n", "1E5", "E", "F", "\x01", "\x02", "a\x01b", "sku 7", "é", "٣", "1,5", " "]


def test_packed_texts_come_back(spark):
    rng = random.Random(4)
    rows = [(str(i), *(rng.choice(ODD) for _ in range(5))) for i in range(400)] + [("one", v, v, v, v, v) for v in ODD]
    df = spark.createDataFrame(rows, "k string, a string, b string, c string, d string, e string")
    coded = packed(df, ["a", "b", "c", "d", "e"], "_p", ["b", "d", "other"])
    assert coded.columns == ["k", "a", "b", "c", "d", "e", "_p_digits", "_p_texts"]
    assert 0 < coded.filter("_p_digits is not null").count() < len(rows) and 0 < coded.filter("_p_texts is not null").count() < len(rows)
    back = unpacked(coded, ["a", "b", "c", "d", "e"], "_p", ["b", "d", "other"])
    assert back.columns == df.columns and sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def parts_of_lines(spark):
    lines = [("1", "o1"), ("1", "o1"), ("1", "o2"), ("2", "o1"), ("3", "o2"), (None, "o2"), ("5", None), ("6", "o9"), ("7", "o3")]
    detail = texts(spark, schemas.ORDER_DETAIL, [{"id": a, "order_id": b, "create_time": "2024-01-01 00:00:00", "sku_num": None} for a, b in lines])
    info = texts(spark, schemas.ORDER_INFO, [{"id": o} for o in ("o1", "o1", "o2", "o3", None)])
    # Parts name orders of their own, which do not count.
    activity = texts(spark, schemas.ORDER_DETAIL_ACTIVITY, [{"order_detail_id": d, "order_id": "o3"} for d in ("1", "1", "3", "5", "6", "8", None)])
    coupon = texts(spark, schemas.ORDER_DETAIL_COUPON, [{"order_detail_id": d} for d in ("1", "2", "6", None)])
    return detail, info, activity, coupon


@pytest.fixture
def large(spark):
    """Plans as for large tables, with the join settings of the queries."""
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    yield
    for name, value in kept.items():
        spark.conf.set(name, value)


def test_parts_that_go_to_the_orders_of_their_lines(spark, large):
    inputs = parts_of_lines(spark)
    want = counted(wide.order_wide(*inputs, hot=True))
    assert counted(wide.order_wide(*inputs)) == counted(wide.order_wide(*inputs, by_line=True)) == want and sum(want.values()) == 15


def test_lines_are_dealt_once(spark, large):
    """Texts of lines crossed two exchanges: by line for their parts, by order for the order."""
    text = plan_of(wide.order_wide(*parts_of_lines(spark)))
    exchanges = text.count("Exchange hashpartitioning(order_id")
    assert exchanges == 1 and "hashpartitioning(id" not in text.split("_part_line")[0]
    assert text.count("hashpartitioning(order_id") + text.count("hashpartitioning(_part_order") == 2


def test_payments_meet_lines_where_they_lie(spark, large):
    payment = texts(spark, schemas.PAYMENT_INFO, [{"order_id": o} for o in ("o1", "o2", "o7", None)])
    inputs = parts_of_lines(spark)
    paid = wide.payment_wide(payment, wide.order_wide(*inputs))
    assert plan_of(paid).count("Exchange hashpartitioning(order_id") == 1
    assert counted(paid) == counted(wide.payment_wide(payment, wide.order_wide(*inputs, hot=True)))


def test_refunded_lines_are_dealt_packed(spark, large):
    detail, info, activity, coupon = parts_of_lines(spark)
    refund = texts(spark, schemas.ORDER_REFUND_INFO, [{"order_id": "o1", "sku_id": "sku_id 0"}, {"order_id": "o1", "sku_id": None}])
    made = wide.refund_order_wide(refund, detail, info, activity, coupon)
    assert "_line_texts" in plan_of(made)
    assert counted(made) == counted(wide.refund_wide(refund, wide.order_wide(detail, info, activity, coupon, hot=True))) and made.count() > 0


def test_changes_of_a_version_table_deal_the_versions_once(spark, large, tmp_path):
    rng = random.Random(7)
    table = sinks.VersionTable(str(tmp_path / "t"), ["k"], ["seq"])
    for number in range(4):
        rows = [(rng.choice([*"abcdefgh", None]), number * 10 + i, rng.choice([None, "x", "y"]), rng.random() < 0.3) for i in range(6)]
        table(spark.createDataFrame(rows, "k string, seq int, v string, gone boolean"), number)
    for since, upto in ((9, 39), (-1, 25), (19, 19), (100, 200), (39, 9)):
        got = table.changes(spark, since, upto, ["k", "v"], "gone")
        old, new = (table.as_of(spark, at, "gone").select("k", "v") for at in (since, upto))
        assert counted(got) == counted(sinks.change_feed(old, new, ["k"]))
    # Two windows and both sides of a join dealt them four times before.
    assert plan_of(table.changes(spark, 9, 39, ["k", "v"], "gone")).count("Exchange") == 1


def test_deletions_are_found_by_key(spark, large, monkeypatch):
    plans, write = [], sinks.VersionTable.__call__
    monkeypatch.setattr(sinks.VersionTable, "__call__", lambda self, batch, number: (plans.append(plan_of(batch)), write(self, batch, number))[1])
    catalog.all_queries()["order_wide_changes"](spark, "/root/testdata/sf0.001")
    assert not any("sku_name" in line for line in plans[2].splitlines() if "FileScan" in line)


def exchanged(df) -> list[str]:
    """Lines of the plan from each exchange to what it deals."""
    lines = plan_of(df).splitlines()
    return [f"{line} {lines[i + 1]}" for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]


def test_enrichment_deals_neither_names_nor_province_texts(spark, large):
    """Both came from dimensions anyway, and travelled with every row."""
    queries = catalog.all_queries()
    for name in ("snowflake_enrich", "snowflake_enrich_left"):
        df = queries[name](spark, "/root/testdata/sf0.001")
        text = plan_of(df)
        facts = [line for line in text.splitlines() if "lineitem.parquet" in line]
        assert facts and "'sku '" not in text and "sku  " not in text.replace("sku_", "")
        joins = [line for line in text.splitlines() if "SortMergeJoin" in line]
        assert "province_id" in joins[0] and "_win#" in text and "_win.end" not in text


def test_windows_of_a_batch_travel_as_their_start(spark):
    rows = spark.createDataFrame(
        [(1, "2024-01-01 00:00:09.5"), (1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10"), (2, "1969-12-31 23:59:59"), (2, None)], "k int, t string")
    made = windows.tumbling(rows.withColumn("event_ts", F.col("t").cast("timestamp")), ["k"], {"n": F.count(F.lit(1))})
    assert "window#" not in plan_of(made) and made.columns == ["k", "n", "stt", "edt"]
    assert sorted(map(tuple, made.collect())) == [
        (1, 1, "2024-01-01 00:00:10", "2024-01-01 00:00:20"), (1, 2, "2024-01-01 00:00:00", "2024-01-01 00:00:10"),
        (2, 1, "1969-12-31 23:59:50", "1970-01-01 00:00:00")]


def test_order_lines_without_sku_names_give_the_same_numbers(spark):
    rows = [("b", "1", "late", "3.00", "5", "6", "2", "4.00", "2024-01-01 00:00:03"), ("a", "1", "first", "1.00", "5", "6", "1", "2.50", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "order_detail_id string, sku_id string, sku_name string, order_price string, user_id string, province_id string,"
                                     "sku_num string, split_total_amount string, create_time string")
    want = windows.user_province_sku_stats(windows.order_measures(df)).drop("sku_name")
    got = windows.user_province_sku_stats(windows.order_measures(df.drop("sku_name")))
    assert got.columns == want.columns and counted(got) == counted(want) and got.first().sku_price == Decimal("1.00")


def test_order_lines_go_to_their_orders_packed(spark, large):
    lines = catalog._order_lines(Standins(spark, "/root/testdata/sf0.001"))
    dealt = [line for line in exchanged(lines) if "order_id" in line and "_line_digits" in line]
    assert len(dealt) == 1 and lines.filter("create_time is null or sku_num is null").count() == 0
