"""Event-time tumbling window aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.functions.scalars import seconds_of, text_to_ts, ts_to_text

VISITOR_KEYS = ["vc", "ch", "ar", "is_new"]


def tumbling(
    df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], width: str = "10 seconds",
    ts: str = "event_ts",
) -> DataFrame:
    """Aggregate per window and key; window bounds as text in ``stt`` and ``edt``.

    Plain aggregates only, so partial sums are combined before the exchange and
    a hot key travels as one row per map task. Rows that carry their window already
    (``_win``, see :func:`in_windows`) keep it.
    """
    aggregates = [expr.alias(name) for name, expr in measures.items()]
    if "_win" not in df.columns and not df.isStreaming:
        # The start tells the window; the end need not travel with it.
        started = in_windows(df, width, ts).withColumn("_win", F.col("_win.start"))
        end = F.col("_win") + F.expr(f"interval {seconds_of(width)} seconds")
        grouped = started.groupBy("_win", *keys).agg(*aggregates)
        return grouped.withColumns({"stt": ts_to_text(F.col("_win")), "edt": ts_to_text(end)}).drop("_win")
    win = F.col("_win") if "_win" in df.columns else F.window(ts, width).alias("_win")
    return (
        df.groupBy(win, *keys)
        .agg(*aggregates)
        .withColumns({"stt": ts_to_text(F.col("_win.start")), "edt": ts_to_text(F.col("_win.end"))})
        .drop("_win")
    )


def in_windows(df: DataFrame, width: str = "10 seconds", ts: str = "event_ts") -> DataFrame:
    """Rows with their window in ``_win``; rows without a time have none and are left out."""
    return df.withColumn("_win", F.window(ts, width))


def first_ts(ts: str = "event_ts") -> Column:
    """Event time (ms) of the earliest row of a group."""
    return F.unix_millis(F.min(ts))


def page_measures(pages: DataFrame) -> DataFrame:
    """Per-row page measures. ``sv_ct`` counts rows that have a previous page, and
    ``session_starts`` those that have none."""
    entry = F.col("last_page_id").isNull()
    return pages.withColumns({
        "pv": F.lit(1),
        "sv": F.when(entry, 0).otherwise(1),
        "entry": F.when(entry, 1).otherwise(0),
        "dur": F.coalesce(F.col("during_time"), F.lit(0)),
    })


def page_view_stats(pages: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Page views, follow-up views and time on page, per page and visitor group."""
    measures = {
        "pv_ct": F.sum("pv"), "sv_ct": F.sum("sv"), "dur_sum": F.sum("dur"),
        "session_starts": F.sum("entry"), "ts": first_ts(),
    }
    return tumbling(page_measures(pages), ["page_id", *VISITOR_KEYS], measures, width)


def unique_visit_stats(first_visits: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Unique visits per visitor group from first-visit rows."""
    return tumbling(first_visits, VISITOR_KEYS, {"uv_ct": F.count(F.lit(1)), "ts": first_ts()}, width)


def bounce_stats(bounces: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Bounces per visitor group from bounce rows."""
    return tumbling(bounces, VISITOR_KEYS, {"uj_ct": F.count(F.lit(1)), "ts": first_ts()}, width)


def keyword_stats(word_rows: DataFrame, width: str = "10 seconds", source: str = "search") -> DataFrame:
    """Occurrences per word."""
    counted = tumbling(word_rows.withColumnRenamed("word", "keyword"), ["keyword"], {"ct": F.count(F.lit(1)), "ts": first_ts()}, width)
    return counted.withColumn("source", F.lit(source))


def order_measures(wide: DataFrame) -> DataFrame:
    """Order-line rows as typed measures with the event time taken from ``create_time``.

    A malformed number or time is null; see :func:`rejected_measures`.
    """
    return wide.select(
        "order_detail_id",
        F.col("sku_id").try_cast("bigint").alias("sku_id"), *[c for c in ("sku_name",) if c in wide.columns],
        F.col("order_price").try_cast("decimal(18,2)").alias("sku_price"),
        F.col("user_id").try_cast("bigint").alias("user_id"),
        F.col("province_id").try_cast("bigint").alias("province_id"),
        F.col("sku_num").try_cast("bigint").alias("sku_num"),
        F.col("split_total_amount").try_cast("decimal(18,2)").alias("amount"),
        text_to_ts(F.col("create_time")).alias("event_ts"),
    )


def rejected_measures(wide: DataFrame) -> DataFrame:
    """Order lines with a number or time that :func:`order_measures` cannot read (absent ones aside)."""
    def broken(column: str, kind: str) -> Column:
        return F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()

    whole = [broken(c, "bigint") for c in ("sku_id", "user_id", "province_id", "sku_num")]
    money = [broken(c, "decimal(18,2)") for c in ("order_price", "split_total_amount")]
    # A line without a time has no window either.
    return wide.filter(reduce(or_, [*whole, *money, text_to_ts(F.col("create_time")).isNull()]))


def user_province_sku_stats(measures: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Quantity, amount and line count per user, province and sku.

    ``sku_name`` and ``sku_price`` are those of the earliest line of the group. Lines without
    ``sku_name`` give none, for those who take the name from the dimension.
    """
    named = [c for c in ("sku_name",) if c in measures.columns]
    # One value to hold and to send for the earliest line and its time.
    aggregates = {
        "order_sku_num": F.sum("sku_num"), "order_amount": F.sum("amount").cast("decimal(28,2)"),
        "order_ct": F.count(F.lit(1)), "_first": F.min(F.struct("event_ts", "order_detail_id", *named, "sku_price")),
    }
    grouped = tumbling(measures, ["user_id", "province_id", "sku_id"], aggregates, width)
    columns = ["user_id", "province_id", "sku_id", "order_sku_num", "order_amount", "order_ct"]
    return grouped.select(*columns, F.unix_millis("_first.event_ts").alias("ts"), "stt", "edt", *[f"_first.{c}" for c in (*named, "sku_price")])
