"""Daily reports over the aggregate tables.

Every report takes the day as ``yyyyMMdd``; 0 or nothing means today. Aggregate
tables are stored by day (``dt``), which prunes folders. An aggregate made on the spot
has no such column and is filtered by the prefix of ``stt``; that filter stays above the
aggregate, so give the aggregate the raw rows of :func:`span_of` only.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.functions.scalars import half_up_div, padded_hour, scaled, seconds_of, short_name_or, text_to_ts

# Province shown for a name of at most one character.
DEFAULT_PROVINCE = "贵州"

# Row labels of the new-versus-returning report.
UV_LABEL = "用户数(人)"
PV_LABEL = "总访问页面(次)"
BOUNCE_RATE_LABEL = "跳出率(%)"
SECONDS_LABEL = "平均在线时长(秒)"
PAGES_LABEL = "平均访问页面数(人次)"


def day_of(date: int | None) -> str:
    """``yyyyMMdd`` to ``yyyy-MM-dd``; 0 or None is today."""
    moment = datetime.strptime(str(date), "%Y%m%d") if date else datetime.now(timezone.utc)
    return moment.strftime("%Y-%m-%d")


def span_of(date: int | None, more: str = "0 seconds") -> tuple[str, str]:
    """The day as two times, from the first up to the second, with ``more`` time after it."""
    start = datetime.strptime(day_of(date), "%Y-%m-%d")
    return f"{start:%Y-%m-%d %H:%M:%S}", f"{start + timedelta(days=1, seconds=seconds_of(more)):%Y-%m-%d %H:%M:%S}"


def on_day(stats: DataFrame, date: int | None) -> DataFrame:
    day = day_of(date)
    if "dt" in stats.columns:
        return stats.filter(F.col("dt") == F.lit(day))
    return stats.filter(F.col("stt").startswith(day))


def gmv(orders: DataFrame, date: int | None = None) -> DataFrame:
    """Sales total of a day, 0 when there were none."""
    total = F.coalesce(F.sum("order_amount"), F.lit(0)).cast("decimal(38,2)")
    return on_day(orders, date).agg(total.alias("order_amount"))


def _top(orders: DataFrame, date: int | None, keys: list[str], limit: int, **measures) -> DataFrame:
    totals = {"order_amount": F.sum("order_amount"), **measures}
    return (
        on_day(orders, date)
        .groupBy(*keys)
        .agg(*[expr.alias(name) for name, expr in totals.items()])
        .filter(F.col("order_amount") > 0)
        .orderBy(F.desc("order_amount"), *keys)
        .limit(limit)
    )


def top_spu(orders: DataFrame, date: int | None = None, limit: int = 10) -> DataFrame:
    return _top(orders, date, ["spu_id", "spu_name"], limit, order_ct=F.sum("order_ct"))


def top_category3(orders: DataFrame, date: int | None = None, limit: int = 4) -> DataFrame:
    return _top(orders, date, ["category3_id", "category3_name"], limit)


def top_trademark(orders: DataFrame, date: int | None = None, limit: int = 20) -> DataFrame:
    return _top(orders, date, ["tm_id", "tm_name"], limit)


def province_sales(orders: DataFrame, date: int | None = None) -> DataFrame:
    return (
        on_day(orders, date)
        .groupBy("province_id", "province_name")
        .agg(F.sum("order_amount").alias("order_amount"))
        .withColumn("name", short_name_or(F.col("province_name"), DEFAULT_PROVINCE))
    )


def top_keywords(keywords: DataFrame, date: int | None = None, limit: int = 20) -> DataFrame:
    return (
        on_day(keywords, date).groupBy("keyword").agg(F.sum("ct").alias("ct"))
        .orderBy(F.desc("ct"), "keyword").limit(limit)
    )


def visitors_by_flag(
    page_views: DataFrame, unique_visits: DataFrame, bounces: DataFrame, date: int | None = None
) -> DataFrame:
    """Totals per new-visitor flag; flags need both page views and unique visits."""
    pv = on_day(page_views, date).groupBy("is_new").agg(
        F.sum("pv_ct").alias("pv_ct"), F.sum("sv_ct").alias("sv_ct"), F.sum("dur_sum").alias("dur_sum")
    )
    uv = on_day(unique_visits, date).groupBy("is_new").agg(F.sum("uv_ct").alias("uv_ct"))
    uj = on_day(bounces, date).groupBy("is_new").agg(F.sum("uj_ct").alias("uj_ct"))
    return (
        pv.join(uv, "is_new").join(uj, "is_new", "left")
        .withColumn("uj_ct", F.coalesce("uj_ct", F.lit(0).cast("bigint")))
    )


def visitor_ratios(totals: DataFrame) -> DataFrame:
    """Bounce rate (%), seconds per session and pages per session, rounded half up.

    All are 0 without unique visits or without sessions.
    """
    def guarded(units):
        return F.when(F.col("uv_ct") == 0, F.lit(0).cast("bigint")).otherwise(units)

    sessions = F.col("sv_ct")
    whole_ms = half_up_div(F.col("dur_sum"), sessions, 0)
    return totals.withColumns({
        "uj_rate": scaled(guarded(half_up_div(F.col("uj_ct") * 100, sessions, 2)), 2),
        "dur_per_sv": scaled(guarded(half_up_div(whole_ms, F.lit(1000), 1)), 1),
        "pv_per_sv": scaled(guarded(half_up_div(F.col("pv_ct"), sessions, 2)), 2),
    })


def visitor_pivot(ratios: DataFrame) -> DataFrame:
    """Five rows ``type, new, old``; a missing flag shows 0."""
    metrics = {
        UV_LABEL: "uv_ct", PV_LABEL: "pv_ct", BOUNCE_RATE_LABEL: "uj_rate",
        SECONDS_LABEL: "dur_per_sv", PAGES_LABEL: "pv_per_sv",
    }
    number = "decimal(22,2)"
    new = F.col("is_new") == "1"
    sides = ratios.agg(*[
        F.coalesce(F.max(F.when(rule, F.col(c).cast(number))), F.lit(0).cast(number)).alias(f"{side}_{c}")
        for c in metrics.values() for side, rule in (("new", new), ("old", ~new))
    ])
    rows = F.array(*[
        F.struct(F.lit(label).alias("type"), F.col(f"new_{c}").alias("new"), F.col(f"old_{c}").alias("old"))
        for label, c in metrics.items()
    ])
    return sides.select(F.inline(rows))


def visitors_by_hour(
    page_views: DataFrame, unique_visits: DataFrame, bounces: DataFrame, date: int | None = None,
    keep_pv: bool = False,
) -> DataFrame:
    """Totals per hour. Hours without unique visits are left out unless ``keep_pv``."""
    hour = F.hour(text_to_ts(F.col("stt"))).alias("hr")
    new_uv = F.sum(F.when(F.col("is_new") == "1", F.col("uv_ct")).otherwise(0)).alias("new_uv")
    pv = on_day(page_views, date).groupBy(hour).agg(F.sum("pv_ct").alias("pv_ct"))
    uv = on_day(unique_visits, date).groupBy(hour).agg(F.sum("uv_ct").alias("uv_ct"), new_uv)
    uj = on_day(bounces, date).groupBy(hour).agg(F.sum("uj_ct").alias("uj_ct"))
    joined = pv.join(uv, "hr", "full" if keep_pv else "inner").join(uj, "hr", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "hr", *[F.coalesce(c, zero).alias(c) for c in ("new_uv", "uj_ct", "uv_ct", "pv_ct")]
    )


def fill_hours(by_hour: DataFrame) -> DataFrame:
    """Hours 00 to 23, zero where the report has no row."""
    zero = F.lit(0).cast("bigint")
    hours = by_hour.sparkSession.range(24).select(F.col("id").cast("int").alias("hr"))
    return hours.join(by_hour, "hr", "left").select(
        padded_hour(F.col("hr")).alias("hr"),
        *[F.coalesce(c, zero).alias(c) for c in ("uv_ct", "pv_ct", "new_uv")],
    )


def page_view_row_count(page_views: DataFrame, date: int | None = None) -> DataFrame:
    """Number of aggregate rows of a day (not of page views)."""
    return on_day(page_views, date).agg(F.count("pv_ct").alias("pv_ct"))


def unique_visit_row_count(unique_visits: DataFrame, date: int | None = None) -> DataFrame:
    """Number of aggregate rows of a day (not of unique visits)."""
    return on_day(unique_visits, date).agg(F.count("uv_ct").alias("uv_ct"))
