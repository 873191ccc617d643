"""Batch and stream forms agree; watermarks, late rows and state behave as documented."""

import time
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brookmart.operators import logs, visits, wide, windows
from brookmart.streaming import jobs, stateful
from brookmart.streaming.watermark import LateRows, keep_watermark, with_event_time
from brookmart import schemas

PAGE = ("id long, mid string, is_new string, vc string, ch string, ar string, page_id string, "
        "last_page_id string, item string, during_time long, ts long")
START = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
FAR = START + 40 * 86_400_000


def page(id, mid, second, last=None, is_new="1", item=None, page_id="home", during=1000):
    return (id, mid, is_new, "v1", "ch1", "ar1", page_id, last, item, during, START + int(second * 1000))


def sentinel(n):
    """Rows far in the future that push the watermark past everything before."""
    return [page(10_000 + n, f"end{n}", (FAR - START) / 1000 + n * 3600, last="x")]


def random_pages(seed, n=120, devices=5, span=400):
    rng = random.Random(seed)
    seconds = sorted(rng.uniform(0, span) for _ in range(n))
    return [
        page(i, f"m{rng.randrange(devices)}", s, rng.choice([None, None, "search", "home"]), rng.choice("01"),
             rng.choice([None, "red shoes", "blue 大数据 shirt"]), rng.choice(["home", "cart"]))
        for i, s in enumerate(seconds)
    ]


def chunks(rows, size):
    return [rows[i:i + size] for i in range(0, len(rows), size)]


def timed(df, delay="2 seconds"):
    return with_event_time(df, F.timestamp_millis("ts"), delay)


def as_batch(spark, rows):
    return spark.createDataFrame(rows, PAGE).withColumn("event_ts", F.timestamp_millis("ts"))


def without_sentinels(rows, column="stt", limit="2024-02"):
    return [r for r in rows if r[column] < limit]


def same(got, want):
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in want)))
    assert got


def test_page_view_stats(spark, feed, drain):
    rows = random_pages(1)
    stream = feed([*chunks(rows, 30), sentinel(0), sentinel(1)], PAGE)
    got = without_sentinels(drain(jobs.page_view_stats(timed(stream))))
    same(got, windows.page_view_stats(as_batch(spark, rows)).collect())


def test_keyword_stats_filter_keeps_watermark(spark, feed, drain):
    rows = random_pages(2)
    stream = timed(feed([*chunks(rows, 40), sentinel(0), sentinel(1)], PAGE))
    got = without_sentinels(drain(jobs.keyword_stats(stream).drop("ts")))
    search = as_batch(spark, rows).filter("last_page_id = 'search' and item is not null")
    from brookmart.operators.keywords import split_words

    same(got, windows.keyword_stats(split_words(search.select("event_ts", "item"))).drop("ts").collect())


def test_keep_watermark_stays_above_the_watermark(spark, feed, capsys):
    stream = timed(feed([[page(1, "a", 0)]], PAGE))

    def plan(df):
        capsys.readouterr()
        df.explain(mode="simple")
        return capsys.readouterr().out

    plain = plan(stream.filter(F.col("page_id") == "home").groupBy(F.window("event_ts", "10 seconds")).count())
    kept = plan(stream.filter(keep_watermark(F.col("page_id") == "home"))
                .groupBy(F.window("event_ts", "10 seconds")).count())
    assert plain.index("EventTimeWatermark") < plain.index("= home")  # printed top down: pushed below
    assert kept.index("= home") < kept.index("EventTimeWatermark")


def test_new_flag_repair(spark, feed, drain):
    rows = random_pages(3)
    shuffled = [random.Random(i).sample(c, len(c)) for i, c in enumerate(chunks(rows, 25))]
    stream = feed(shuffled, PAGE)
    got = drain(stateful.repair_new_flag_stream(stream).select("id", "mid", "is_new"))
    want = logs.repair_new_flag(spark.createDataFrame(rows, PAGE)).select("id", "mid", "is_new")
    same(got, want.collect())


def test_first_visit_and_unique_visits(spark, feed, drain):
    rows = [page(i, r[1], 86_400 * (i // 40) + r[0] * 60, r[7]) for i, r in enumerate(random_pages(4))]
    batches = [*chunks(rows, 17), sentinel(0), sentinel(1)]
    got = drain(stateful.first_visit_stream(timed(feed(batches, PAGE))).select("id", "mid"))
    same(got, visits.first_visit_per_day(as_batch(spark, rows)).select("id", "mid").collect())
    stats = without_sentinels(drain(jobs.unique_visit_stats(timed(feed(batches, PAGE)))))
    same(stats, windows.unique_visit_stats(visits.first_visit_per_day(as_batch(spark, rows))).collect())


@pytest.mark.parametrize("seed", [5, 6])
def test_bounces(spark, feed, drain, seed):
    rows = random_pages(seed, n=150, devices=4, span=900)
    # Out of order inside a batch; across batches only within the watermark delay.
    shuffled = [random.Random(i).sample(c, len(c)) for i, c in enumerate(chunks(rows, 31))]
    stream = timed(feed([*shuffled, sentinel(0), sentinel(1)], PAGE))
    got = drain(stateful.bounce_stream(stream).select("id", "mid", "outcome"))
    want = visits.bounce_outcomes(as_batch(spark, rows)).select("id", "mid", "outcome").collect()
    assert {r.outcome for r in want} == {"matched", "timeout"}
    same([r for r in got if r.id < 10_000], want)


def test_bounce_stats_from_bounce_feed(spark, feed, drain):
    rows = random_pages(7, span=900)
    bounced = visits.bounce_outcomes(as_batch(spark, rows))
    columns = PAGE
    names = [c.strip().split()[0] for c in columns.split(",")]
    emitted = [tuple(r[c] for c in names) for r in bounced.orderBy("ts").collect()]
    stream = feed([*chunks(emitted, 20), sentinel(0), sentinel(1)], PAGE).withColumn("event_ts", F.timestamp_millis("ts"))
    got = without_sentinels(drain(jobs.bounce_stats(stream)))
    same(got, windows.bounce_stats(bounced).collect())


def test_late_rows_are_dropped_and_counted(spark, feed, drain):
    # Lateness is judged by the watermark of the batch before, hence the extra batch.
    late = page(4, "a", 5)
    batches = [[page(1, "a", 0)], [page(2, "a", 100)], [page(3, "a", 101)], [late], sentinel(0), sentinel(1)]
    counter = LateRows()
    spark.streams.addListener(counter)
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        got = without_sentinels(drain(jobs.page_view_stats(timed(feed(batches, PAGE)))))
        assert sum(r.pv_ct for r in got) == 3
        for _ in range(50):  # reports come on a thread of their own
            if counter.of(drain.query) == 1:
                break
            time.sleep(0.2)
        assert counter.of(drain.query) == 1
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
        spark.streams.removeListener(counter)


# --- orders ---------------------------------------------------------------------


def at(second):
    return (datetime(2024, 1, 1) + timedelta(seconds=second)).strftime("%Y-%m-%d %H:%M:%S")


def record(columns, **values):
    return tuple(values.get(c) for c in columns)


def text_schema(columns):
    return ", ".join(f"{c} string" for c in columns)


def order_parts():
    detail, info, activity, coupon = [], [], [], []
    for i in range(12):
        t = i * 3
        detail.append(record(schemas.ORDER_DETAIL, id=f"d{i}", order_id=f"o{i // 2}", sku_id=f"{i}", order_price="2.50",
                             sku_num="2", split_total_amount="5.00", create_time=at(t), sku_name=f"s{i}"))
        if i % 2 == 0 and i != 6:
            info.append(record(schemas.ORDER_INFO, id=f"o{i // 2}", user_id="7", province_id="1", create_time=at(t + 1)))
        if i % 3 == 0:
            activity.append(record(schemas.ORDER_DETAIL_ACTIVITY, id=f"a{i}", order_detail_id=f"d{i}", activity_id="x",
                                   create_time=at(t)))
        if i == 4:
            coupon.append(record(schemas.ORDER_DETAIL_COUPON, id=f"c{i}", order_detail_id=f"d{i}", create_time=at(t + 2)))
    return detail, info, activity, coupon


def end_record(columns, n):
    return [record(columns, id=f"end{n}{columns[-2]}", order_id=f"end{n}", order_detail_id=f"none{n}",
                   create_time=at(86_400 * (20 + n)))]


def order_feeds(feed):
    out = []
    for rows, columns in zip(order_parts(), (schemas.ORDER_DETAIL, schemas.ORDER_INFO, schemas.ORDER_DETAIL_ACTIVITY,
                                             schemas.ORDER_DETAIL_COUPON)):
        batches = [rows, end_record(columns, 0), end_record(columns, 1)]
        out.append(feed(batches, text_schema(columns)))
    return out


def test_order_wide(spark, feed, drain):
    got = drain(jobs.order_wide(*order_feeds(feed)).drop("_line_ts"))
    got = [r for r in got if not r.order_id.startswith("end")]
    parts = [spark.createDataFrame(rows, text_schema(columns)) for rows, columns in zip(
        order_parts(),
        (schemas.ORDER_DETAIL, schemas.ORDER_INFO, schemas.ORDER_DETAIL_ACTIVITY, schemas.ORDER_DETAIL_COUPON))]
    want = wide.order_wide(*parts).collect()
    assert {r.order_detail_activity_id is None for r in want} == {True, False}
    same(got, want)


def wide_rows(spark):
    columns = (schemas.ORDER_DETAIL, schemas.ORDER_INFO, schemas.ORDER_DETAIL_ACTIVITY, schemas.ORDER_DETAIL_COUPON)
    parts = [spark.createDataFrame(rows, text_schema(c)) for rows, c in zip(order_parts(), columns)]
    return wide.order_wide(*parts)


def test_payment_and_refund_wide(spark, feed, drain):
    lines = wide_rows(spark)
    rows = [tuple(r) for r in lines.collect()]
    ends = [record(schemas.ORDER_WIDE, order_detail_id=f"e{n}", order_id=f"e{n}", sku_id="-", create_time=at(86_400 * (20 + n)))
            for n in range(2)]
    line_batches = [rows, [ends[0]], [ends[1]]]

    pays = [record(schemas.PAYMENT_INFO, id=f"p{i}", order_id=f"o{i}", out_trade_no=f"t{i}", create_time=at(60 + i))
            for i in range(5)] + [record(schemas.PAYMENT_INFO, id="p9", order_id="none", create_time=at(61))]
    pay_batches = [pays] + [[record(schemas.PAYMENT_INFO, id=f"pe{n}", order_id=f"x{n}", create_time=at(86_400 * (20 + n)))]
                            for n in range(2)]
    got = drain(jobs.payment_wide(feed(pay_batches, text_schema(schemas.PAYMENT_INFO)),
                                  feed(line_batches, text_schema(schemas.ORDER_WIDE))))
    want = wide.payment_wide(spark.createDataFrame(pays, text_schema(schemas.PAYMENT_INFO)), lines).collect()
    assert any(r.order_detail_id is None for r in want)
    same([r for r in got if not r.payment_id.startswith("pe")], want)

    refs = [record(schemas.ORDER_REFUND_INFO, id=f"r{i}", order_id=f"o{i // 2}", sku_id=f"{i}", user_id="9", create_time=at(90))
            for i in (0, 3, 5)] + [record(schemas.ORDER_REFUND_INFO, id="r9", order_id="o0", sku_id="5", create_time=at(90))]
    got = drain(jobs.refund_wide(feed([refs], text_schema(schemas.ORDER_REFUND_INFO)),
                                 feed([rows], text_schema(schemas.ORDER_WIDE))))
    want = wide.refund_wide(spark.createDataFrame(refs, text_schema(schemas.ORDER_REFUND_INFO)), lines).collect()
    assert len(want) == 3
    same(got, want)


def test_order_stats_absorb_repeated_versions(spark, feed, drain):
    rows = [tuple(r) for r in wide_rows(spark).collect()]
    ends = [record(schemas.ORDER_WIDE, order_detail_id=f"e{n}", user_id="0", province_id="0", sku_id="0", sku_num="0",
                   split_total_amount="0", order_price="0", create_time=at(86_400 * (20 + n))) for n in range(2)]
    stream = feed([rows, rows[:4], [ends[0]], [ends[1]]], text_schema(schemas.ORDER_WIDE))
    got = [r for r in drain(jobs.user_province_sku_stats(stream, width="1 minute")) if r.user_id == 7]
    want = windows.user_province_sku_stats(windows.order_measures(wide_rows(spark)), "1 minute").collect()
    assert sum(r.order_ct for r in want) == len(rows)
    same(got, want)
