"""Named queries: every operator applied to inputs derived from the test tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmart import schemas
from brookmart.functions import scalars
from brookmart.functions.packing import packed, unpacked
from brookmart.functions.tokens import words
from brookmart.operators import (
    changelog, enrich, joins, keywords, latest, logs, partials, routing, segment, visits, wide, windows,
)
from brookmart.plans import reports
from brookmart.session import pin_session
from brookmart.sources.readers import renamed_dimension
from brookmart.sources.standins import DATABASE, WIDE_STATES, Days, Standins
from brookmart.streaming import jobs, replay, sinks, stateful
from brookmart.streaming.enrichment import EnrichedSink
from brookmart.streaming.watermark import with_event_time

VISIT_DAY = 20240115
KEYWORD_DAY = 20240101
ORDER_DAY = 19970131
AS_OF = "2024-01-01"
BOUNCE_WITHIN = "12 hours"
JOIN_RANGE = "5 minutes"
#: Keys of the busy order aggregate, and how many of each there are.
BUSY_KEYS = {"user_id": 7, "province_id": 5, "sku_id": 11}
#: Of lines with the same id the first counts.
LINE_ORDER = ["create_time", "sku_num", "split_total_amount"]
#: Deliveries in which tables reach the streams.
PARTS = 3

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(build: Callable[[Standins], DataFrame]) -> Callable[[Standins], DataFrame]:
    """Register ``build`` under its own name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return doubles(build(Standins(pin_session(spark), sf_dir)))

    _QUERIES[build.__name__] = run
    return build


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def doubles(df: DataFrame) -> DataFrame:
    """Exact decimals as doubles, the form results are compared in."""
    return df.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ])


# --- application log ----------------------------------------------------------


@query
def log_parse_clean(s: Standins) -> DataFrame:
    return logs.parse_log(s.raw_log()).select(
        "id", "common.*", "page.*",
        F.size("displays").alias("n_displays"), F.size("actions").alias("n_actions"),
        logs.is_error().alias("has_err"), logs.is_start().alias("has_start"), "ts",
    )


@query
def log_parse_dirty(s: Standins) -> DataFrame:
    return logs.dirty_log(s.raw_log())


@query
def new_visitor_repair(s: Standins) -> DataFrame:
    return logs.repair_new_flag(s.page_log(), order=("event_ts", "id")).select("id", "mid", "is_new")


def _repaired(s: Standins) -> DataFrame:
    return logs.repair_log(logs.parse_log(s.raw_log()))


@query
def log_page(s: Standins) -> DataFrame:
    pages = logs.flat_pages(logs.page_rows(_repaired(s)))
    return pages.drop("event_ts")


@query
def log_start(s: Standins) -> DataFrame:
    return logs.start_rows(_repaired(s)).select(
        "id", "common.mid", "common.is_new", "ts",
        F.try_variant_get("start", "$.loading_time", "bigint").alias("loading_time"),
    )


@query
def log_error(s: Standins) -> DataFrame:
    return logs.error_rows(_repaired(s)).select(
        "id", "common.mid", "common.is_new", "ts", logs.is_start().alias("is_start"),
        F.try_variant_get("err", "$.error_code", "bigint").alias("error_code"),
    )


@query
def log_split_exclusive(s: Standins) -> DataFrame:
    return logs.tag_exclusive(_repaired(s)).select("id", "common.mid", "common.is_new", "stream")


def _member(path: str, kind: str = "string"):
    return F.get_json_object("value", path).cast(kind)


@query
def log_display(s: Standins) -> DataFrame:
    return logs.display_rows(logs.page_rows(_repaired(s)), keep=("id",)).select(
        "id", _member("$.display_type").alias("display_type"), _member("$.item").alias("item"),
        _member("$.order", "bigint").alias("item_order"), _member("$.ts", "bigint").alias("ts"),
        _member("$.page_id").alias("page_id"),
    )


@query
def log_action(s: Standins) -> DataFrame:
    common = F.get_json_object("value", "$.common")
    return logs.action_rows(logs.page_rows(_repaired(s)), keep=("id",)).select(
        "id", _member("$.action_id").alias("action_id"), _member("$.item").alias("item"),
        _member("$.ts", "bigint").alias("ts"), _member("$.page_id").alias("page_id"),
        F.get_json_object(common, "$.mid").alias("mid"), F.get_json_object(common, "$.is_new").alias("is_new"),
    )


@query
def log_fan_out(s: Standins) -> DataFrame:
    return logs.fan_out(_repaired(s)).groupBy("id", "topic").agg(F.count("value").alias("n"))


def _message_values(messages: DataFrame) -> DataFrame:
    """What every message carries, dirty ones too: members as text, long numbers and trailing zeros included."""
    common = F.when(F.col("topic") != logs.DIRTY_TOPIC, F.get_json_object("value", "$.common"))

    def number(name: str) -> Column:
        return F.regexp_extract("value", rf'{name}\\?":([0-9.]+)', 1).alias(name)

    whole = F.when(F.col("topic") == logs.DIRTY_TOPIC, F.col("value"))
    return messages.select(
        "id", "topic", number("trace"), number("weight"), number("price"), F.get_json_object(common, "$.mid").alias("mid"),
        F.get_json_object(common, "$.is_new").alias("is_new"), F.coalesce(_member("$.item"), _member("$.page.item")).alias("item"),
        _member("$.ts", "bigint").alias("ts"), F.coalesce(_member("$.page_id"), _member("$.page.page_id")).alias("page_id"), whole.alias("dirty"),
    )


@query
def log_fan_out_values(s: Standins) -> DataFrame:
    return _message_values(logs.fan_out(logs.repair_log(logs.parse_records(s.exact_log()))))


@query
def epoch_to_ts(s: Standins) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = s.table("events").select("event_id", ms.alias("ts"))
    return rows.select(
        "event_id", scalars.ts_to_text(scalars.epoch_ms_to_second_ts(F.col("ts"))).alias("rt"),
        F.date_format(scalars.epoch_ms_to_ts(F.col("ts")), "yyyy-MM-dd HH:mm:ss.SSS").alias("rt_ms"),
        scalars.day_number(scalars.epoch_ms_to_ts(F.col("ts"))).alias("day"),
    )


# --- change log and dimensions ------------------------------------------------


@query
def tombstone_filter(s: Standins) -> DataFrame:
    return changelog.drop_tombstones(s.order_wide_topic())


@query
def ods_json_scan(s: Standins) -> DataFrame:
    data = F.col("data")
    return changelog.parse_changes(s.ods_json()).select(
        "id", "database", "table", "type", "ts", data["id"].alias("order_id"),
        data["order_status"].alias("order_status"), data["total_amount"].alias("total_amount"),
        data["payment_way"].alias("payment_way"), F.size(data).cast("bigint").alias("n_columns"),
    )


@query
def ods_parse_clean(s: Standins) -> DataFrame:
    return changelog.parse_changes(s.ods_json()).select("id", "type")


@query
def ods_parse_dirty(s: Standins) -> DataFrame:
    return changelog.dirty_changes(s.ods_json())


def _ods(s: Standins, table: str, columns: list[str]) -> DataFrame:
    return changelog.ods_table(s.ods, table, columns, DATABASE)


@query
def ods_order_detail(s: Standins) -> DataFrame:
    return _ods(s, "order_detail", schemas.ORDER_DETAIL)


@query
def ods_order_info(s: Standins) -> DataFrame:
    return _ods(s, "order_info", schemas.ORDER_INFO)


@query
def ods_order_activity(s: Standins) -> DataFrame:
    return _ods(s, "order_detail_activity", schemas.ORDER_DETAIL_ACTIVITY)


@query
def ods_order_coupon(s: Standins) -> DataFrame:
    return _ods(s, "order_detail_coupon", schemas.ORDER_DETAIL_COUPON)


@query
def ods_payment_info(s: Standins) -> DataFrame:
    return _ods(s, "payment_info", schemas.PAYMENT_INFO)


@query
def ods_refund_info(s: Standins) -> DataFrame:
    return _ods(s, "order_refund_info", schemas.ORDER_REFUND_INFO)


@query
def cdc_envelope(s: Standins) -> DataFrame:
    return changelog.envelope_json(changelog.flatten_envelope(s.user_cdc()))


@query
def cdc_current_state(s: Standins) -> DataFrame:
    after = F.col("after")
    return changelog.current_state(s.user_cdc(), ["id"], ["seq"]).select(
        "id", after["name"].alias("name"), after["phone_num"].alias("phone_num")
    )


@query
def config_current(s: Standins) -> DataFrame:
    return routing.current_config(s.config_log(), ["change_ts", "seq"])


def _routed(s: Standins) -> DataFrame:
    return routing.route(s.ods, routing.current_config(s.config_log(), ["change_ts", "seq"]))


@query
def dim_route(s: Standins) -> DataFrame:
    slim = s.ods.select("table", "type", F.col("data")["id"].alias("id"))
    return routing.route(slim, routing.current_config(s.config_log(), ["change_ts", "seq"])).select(
        "table", "type", "sink_table", "sink_pk", "id")


@query
def dim_route_as_of(s: Standins) -> DataFrame:
    """Routes in force when each change happened; they change, vanish and come back inside the feed."""
    routed = routing.route_as_of(s.ods_times(), s.config_log(), "change_at", bucket="6 hours")
    return routed.select("table", "type", "id", "sink_table", "sink_columns", "sink_pk")


@query
def dim_prune_columns(s: Standins) -> DataFrame:
    pruned = routing.prune_columns(_routed(s).withColumn("id", F.col("data")["id"]))
    return routing.explode_data(pruned).select("table", "type", "id", "column", "content")


@query
def dim_upsert_state(s: Standins) -> DataFrame:
    routed = s.user_changes().withColumn("sink_table", F.concat(F.lit("dim_"), F.col("table")))
    data = F.col("data")
    return changelog.dim_upsert_state(routed, ["seq"]).select(
        "sink_table", "pk", "seq", data["name"].alias("name"), data["phone_num"].alias("phone_num"),
        data["segment"].alias("segment"),
    )


@query
def dim_scan_renamed(s: Standins) -> DataFrame:
    return renamed_dimension(s.dim("user"))


@query
def upsert_latest_by_key(s: Standins) -> DataFrame:
    orders = s.business("order_info").select("id", "order_status", "total_amount")
    existing = orders.withColumn("version", F.lit(1))
    changes = orders.filter("order_status = 'P'").withColumns(
        {"order_status": F.lit("DONE"), "version": F.lit(2)}
    )
    return latest.upsert_latest(existing, changes, ["id"], ["version"])


# --- wide tables --------------------------------------------------------------


# The change log is split into columnar tables once (the ods_* queries); the joins
# read those tables, where unused columns are never read.


def _detail(s: Standins) -> DataFrame:
    return s.business("order_detail")


def _info(s: Standins) -> DataFrame:
    return s.business("order_info")


def _wide(s: Standins) -> DataFrame:
    return wide.order_wide(
        _detail(s), _info(s), s.business("order_detail_activity"), s.business("order_detail_coupon")
    )


@query
def order_detail_join_info(s: Standins) -> DataFrame:
    return wide.detail_with_order(_detail(s), _info(s))


@query
def order_wide(s: Standins) -> DataFrame:
    return _wide(s)


def _wide_state(s: Standins, arrived: dict[str, str]) -> DataFrame:
    lines = latest.first_per_key(s.business("order_detail", arrived["order_detail"]), ["id"], LINE_ORDER)
    return wide.order_wide(
        lines, _info(s),
        latest.first_per_key(s.business("order_detail_activity", arrived["order_detail_activity"]), ["order_detail_id"], ["create_time"]),
        latest.first_per_key(s.business("order_detail_coupon", arrived["order_detail_coupon"]), ["order_detail_id"], ["create_time"]),
        by_line=True,  # made unique by id, so dealt by it
    )


def wide_versions(s: Standins) -> sinks.VersionTable:
    """Order wide as a table of versions: first what had arrived early, then everything, less cancelled lines."""
    table = sinks.VersionTable(replay.new_folder(s.spark, "order_wide"), ["order_detail_id"], ["_batch"])
    first, second = (_wide_state(s, arrived) for arrived in WIDE_STATES)
    table(first.withColumns({"_batch": F.lit(0), "_deleted": F.lit(False)}), 0)
    table(second.withColumns({"_batch": F.lit(1), "_deleted": F.lit(False)}), 1)
    # The second state is stored by now; it is read, not joined again. A deletion is a key.
    stored = table.versions(s.spark)
    held = stored.filter("_batch = 1").select("order_detail_id")
    gone = table.as_of(s.spark, 0).select("order_detail_id").join(held, "order_detail_id", "left_anti")
    told = {"order_detail_id": F.col("order_detail_id"), "_batch": F.lit(1), "_deleted": F.lit(True)}
    table(gone.select(*[told.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in stored.schema.fields]), 1)
    return table


@query
def order_wide_changes(s: Standins) -> DataFrame:
    """What a reader of the first state has to retract and to add."""
    return wide_versions(s).changes(s.spark, 0, 1, schemas.ORDER_WIDE, "_deleted")


@query
def payment_wide(s: Standins) -> DataFrame:
    return wide.payment_wide(s.business("payment_info"), _wide(s))


@query
def refund_wide(s: Standins) -> DataFrame:
    return wide.refund_order_wide(
        s.business("order_refund_info"), _detail(s), _info(s), s.business("order_detail_activity"), s.business("order_detail_coupon")
    )


@query
def id_join(s: Standins) -> DataFrame:
    names = s.table("customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    orders = s.table("orders").select(
        F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
    )
    return joins.id_join(names, orders)


@query
def interval_join(s: Standins) -> DataFrame:
    pages = s.page_log()
    left = pages.select("mid", F.col("id").alias("left_id"), F.col("event_ts").alias("left_ts"))
    right = pages.select("mid", F.col("id").alias("right_id"), F.col("event_ts").alias("right_ts"))
    pairs = joins.interval_join(left, right, "mid", "left_ts", "right_ts", JOIN_RANGE, JOIN_RANGE)
    return pairs.select("mid", "left_id", "right_id")


# --- orders: dedupe, aggregate, enrich ----------------------------------------


@query
def first_per_order_detail(s: Standins) -> DataFrame:
    rows = s.order_detail_dup().select("id", "line_key", "sku_id", "create_time")
    return latest.first_per_key(rows, ["id"], ["create_time", "line_key"])


#: Texts of order lines that are digits, except the key of the order.
_PACKED = ["id", *LINE_ORDER]


def _order_lines(s: Standins, days: Days | None = None) -> DataFrame:
    # The aggregate uses neither activity nor coupon columns, so it reads the
    # inner join and skips the two outer ones.
    # Numbers travel as numbers; the columns that order lines of the same id stay texts.
    detail = (s.lines_of(days) if days else _detail(s)).withColumns({
        "sku_id": F.col("sku_id").try_cast("bigint"), "order_price": F.col("order_price").try_cast("decimal(18,2)")})
    info = _info(s).withColumns({c: F.col(c).try_cast("bigint") for c in ("user_id", "province_id")})
    # The texts of a line travel to its order packed.
    held = ["id", "order_id", "sku_id", "sku_name", "order_price", *LINE_ORDER]
    lines = wide.detail_with_order(packed(detail.select(*held), _PACKED, "_line", _PACKED), info)
    lines = unpacked(lines, _PACKED, "_line", _PACKED).withColumnRenamed("id", "order_detail_id")
    return lines.select(
        "order_detail_id", "sku_id", "sku_name", "order_price", "user_id", "province_id", "sku_num",
        "split_total_amount", "create_time",
    )


def _measures(s: Standins, days: Days | None = None) -> DataFrame:
    return windows.order_measures(_order_lines_once(s, days))


def _order_lines_once(s: Standins, days: Days | None = None) -> DataFrame:
    return latest.first_per_key(_order_lines(s, days), ["order_detail_id"], LINE_ORDER)


def _order_stats(s: Standins, width: str = "10 seconds", days: Days | None = None) -> DataFrame:
    return windows.user_province_sku_stats(_measures(s, days), width)


@query
def user_province_sku_stats(s: Standins) -> DataFrame:
    return _order_stats(s)


@query
def user_province_sku_daily(s: Standins) -> DataFrame:
    return _order_stats(s, "1 day")


@query
def user_province_sku_busy(s: Standins) -> DataFrame:
    """Few keys and long windows: groups of many lines."""
    few = {c: F.pmod(c, F.lit(n)) for c, n in BUSY_KEYS.items()}
    return windows.user_province_sku_stats(_measures(s).withColumns(few), "365 days")


def _user_lookup(s: Standins, how: str) -> DataFrame:
    orders = s.business("order_info").select("id", "user_id")
    columns = {"gender": "GENDER", "birthday": "BIRTHDAY"}
    return joins.dim_lookup(orders, s.dim("user"), F.col("user_id"), columns, how)


@query
def dim_lookup_inner(s: Standins) -> DataFrame:
    return _user_lookup(s, "inner")


@query
def dim_lookup_left(s: Standins) -> DataFrame:
    return _user_lookup(s, "left")


def _enriched(s: Standins, how: str = "inner", days: Days | None = None) -> DataFrame:
    # The name of a sku comes from its dimension.
    stats = windows.user_province_sku_stats(_measures(s, days).drop("sku_name"))
    return enrich.snowflake_enrich(stats, s.dims(), F.lit(AS_OF).cast("timestamp"), how)


@query
def snowflake_enrich(s: Standins) -> DataFrame:
    return _enriched(s)


@query
def snowflake_enrich_left(s: Standins) -> DataFrame:
    return _enriched(s, "left")


@query
def age_years(s: Standins) -> DataFrame:
    age = scalars.age_years(F.to_date("BIRTHDAY"), F.lit(AS_OF).cast("timestamp"))
    return s.dim("user").select("ID", "BIRTHDAY", age.alias("age"))


# --- visits and keywords ------------------------------------------------------


@query
def page_view_stats(s: Standins) -> DataFrame:
    return windows.page_view_stats(s.page_log())


@query
def page_view_stats_hourly(s: Standins) -> DataFrame:
    return windows.page_view_stats(s.page_log(), "1 hour")


@query
def page_view_stats_monthly(s: Standins) -> DataFrame:
    return windows.page_view_stats(s.page_log(), "30 days")


@query
def first_visit_per_day(s: Standins) -> DataFrame:
    return visits.first_visit_per_day(s.page_log()).select(
        "id", "mid", scalars.day_text(F.col("event_ts")).alias("day")
    )


def _unique_visits(s: Standins, width: str = "10 seconds", days: Days | None = None) -> DataFrame:
    return windows.unique_visit_stats(visits.first_visit_per_day(s.page_log(days)), width)


@query
def unique_visit_stats(s: Standins) -> DataFrame:
    return _unique_visits(s)


@query
def unique_visit_stats_hourly(s: Standins) -> DataFrame:
    return _unique_visits(s, "1 hour")


@query
def bounce_matched(s: Standins) -> DataFrame:
    return visits.bounce_matched(s.page_log(), BOUNCE_WITHIN).select("id", "mid", "outcome")


@query
def bounce_timeout(s: Standins) -> DataFrame:
    return visits.bounce_timeout(s.page_log(), BOUNCE_WITHIN).select("id", "mid", "outcome")


@query
def bounce_union(s: Standins) -> DataFrame:
    return visits.bounce_outcomes(s.page_log(), BOUNCE_WITHIN).select("id", "mid", "outcome")


def _bounces(s: Standins, width: str = "10 seconds", days: Days | None = None) -> DataFrame:
    return windows.bounce_stats(visits.bounce_outcomes(s.page_log(days), BOUNCE_WITHIN), width)


@query
def bounce_stats(s: Standins) -> DataFrame:
    return _bounces(s, "1 hour")


@query
def bounce_stats_10s(s: Standins) -> DataFrame:
    """Production parameters: 10 s pattern, 10 s windows."""
    return windows.bounce_stats(visits.bounce_outcomes(s.page_log()))


@query
def keyword_filter(s: Standins) -> DataFrame:
    return keywords.search_rows(s.keyword_log()).select("id", "mid", "item")


@query
def keyword_split(s: Standins) -> DataFrame:
    return s.table("documents").select("doc_id", F.explode(words(F.col("text"))).alias("word"))


@query
def keyword_split_dictionary(s: Standins) -> DataFrame:
    """Texts in CJK letters, cut by a dictionary of the short words that are frequent in them."""
    cut = segment.split_words_by_dictionary(s.cjk_texts(), s.cjk_dictionary(), "text")
    return cut.groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def _keyword_counts(s: Standins, days: Days | None = None) -> DataFrame:
    rows = keywords.search_rows(s.keyword_log(days)).select("event_ts", "item")
    return keywords.phrase_stats(rows)


@query
def keyword_stats(s: Standins) -> DataFrame:
    return _keyword_counts(s)


# --- reports ------------------------------------------------------------------


@query
def report_gmv(s: Standins) -> DataFrame:
    return reports.gmv(_enriched(s, days=reports.span_of(ORDER_DAY)), ORDER_DAY)


@query
def report_spu(s: Standins) -> DataFrame:
    return reports.top_spu(_enriched(s, days=reports.span_of(ORDER_DAY)), ORDER_DAY)


@query
def report_category3(s: Standins) -> DataFrame:
    return reports.top_category3(_enriched(s, days=reports.span_of(ORDER_DAY)), ORDER_DAY)


@query
def report_trademark(s: Standins) -> DataFrame:
    return reports.top_trademark(_enriched(s, days=reports.span_of(ORDER_DAY)), ORDER_DAY)


@query
def report_province(s: Standins) -> DataFrame:
    return reports.province_sales(_enriched(s, days=reports.span_of(ORDER_DAY)), ORDER_DAY)


def _visit_tables(s: Standins) -> tuple[DataFrame, DataFrame, DataFrame]:
    # A visit is decided by its own day, a bounce by the next page of the device as well.
    day, longer = reports.span_of(VISIT_DAY), reports.span_of(VISIT_DAY, BOUNCE_WITHIN)
    return windows.page_view_stats(s.page_log(day)), _unique_visits(s, days=day), _bounces(s, days=longer)


@query
def report_visitor_new_flag(s: Standins) -> DataFrame:
    return reports.visitors_by_flag(*_visit_tables(s), VISIT_DAY)


@query
def report_visitor_ratios(s: Standins) -> DataFrame:
    return reports.visitor_ratios(reports.visitors_by_flag(*_visit_tables(s), VISIT_DAY))


@query
def report_visitor_pivot(s: Standins) -> DataFrame:
    totals = reports.visitors_by_flag(*_visit_tables(s), VISIT_DAY)
    return reports.visitor_pivot(reports.visitor_ratios(totals))


@query
def report_visitor_hour(s: Standins) -> DataFrame:
    return reports.visitors_by_hour(*_visit_tables(s), VISIT_DAY)


@query
def report_visitor_hour_filled(s: Standins) -> DataFrame:
    return reports.fill_hours(reports.visitors_by_hour(*_visit_tables(s), VISIT_DAY, keep_pv=True))


@query
def report_pv_rows(s: Standins) -> DataFrame:
    return reports.page_view_row_count(windows.page_view_stats(s.page_log(reports.span_of(VISIT_DAY))), VISIT_DAY)


@query
def report_uv_rows(s: Standins) -> DataFrame:
    return reports.unique_visit_row_count(_unique_visits(s, days=reports.span_of(VISIT_DAY)), VISIT_DAY)


@query
def report_keyword(s: Standins) -> DataFrame:
    return reports.top_keywords(_keyword_counts(s, reports.span_of(KEYWORD_DAY)), KEYWORD_DAY)


# --- reports over stored aggregates --------------------------------------------------
#
# The aggregates are stored by day in several batches, as partial results: a group whose
# rows arrive in different batches has a partial row in each.


def stored_orders(s: Standins) -> DataFrame:
    """Partial results of the order aggregate, stored batch by batch."""
    path, lines = replay.new_folder(s.spark, "order_partials"), _measures(s)
    # By time; of the last day of a month every second line comes a batch late.
    month_end = F.to_date("event_ts") == F.last_day("event_ts")
    year, late = F.year("event_ts"), month_end & (F.pmod(F.xxhash64("order_detail_id"), F.lit(2)) == 0)
    batch_of = F.when(year < 1997, 0).when(year < 1999, 1).otherwise(2) + F.when(late, 1).otherwise(0)
    table = sinks.BatchTable(path, "orders", [*partials.WINDOW, *partials.ORDER_KEYS, "order_sku_num", "order_amount", "order_ct", "ts", "first"])
    # Joined and made unique once, not once per batch.
    lines = replay.staged(lines.withColumn("_batch", batch_of), f"{path}/lines", ["_batch"])
    for batch in range(4):
        table(partials.order_partials(lines.filter(F.col("_batch") == batch).drop("_batch")), batch)
    return sinks.BatchTable.read(s.spark, path)


def stored_visits(s: Standins) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Page views, unique visits and bounces, stored batch by batch."""
    first, bounced = visits.first_visit_per_day(s.page_log()), visits.bounce_outcomes(s.page_log(), BOUNCE_WITHIN)
    kinds = [
        ("page_views", s.page_log(), windows.page_view_stats, schemas.PAGE_VIEW_STATS, partials.merged_page_views),
        ("unique_visits", first, windows.unique_visit_stats, schemas.UNIQUE_VISIT_STATS, partials.merged_unique_visits),
        ("bounces", bounced, windows.bounce_stats, schemas.BOUNCE_STATS, partials.merged_bounces),
    ]
    out = []
    for name, rows, stats, columns, merged in kinds:
        path = replay.new_folder(s.spark, name)
        for batch in range(PARTS):
            sinks.BatchTable(path, name, columns)(stats(rows.filter(F.pmod("id", F.lit(PARTS)) == batch)), batch)
        out.append(merged(reports.on_day(sinks.BatchTable.read(s.spark, path), VISIT_DAY)))
    return tuple(out)


def _stored_day(s: Standins) -> DataFrame:
    day = partials.merged_orders(reports.on_day(stored_orders(s), ORDER_DAY))
    return enrich.snowflake_enrich(day, s.dims(), F.lit(AS_OF).cast("timestamp"))


@query
def stored_user_province_sku(s: Standins) -> DataFrame:
    return partials.merged_orders(stored_orders(s)).drop("dt")


@query
def stored_report_spu(s: Standins) -> DataFrame:
    return reports.top_spu(_stored_day(s), ORDER_DAY)


@query
def stored_report_visitor_pivot(s: Standins) -> DataFrame:
    return reports.visitor_pivot(reports.visitor_ratios(reports.visitors_by_flag(*stored_visits(s), VISIT_DAY)))


@query
def stored_report_visitor_hour(s: Standins) -> DataFrame:
    return reports.visitors_by_hour(*stored_visits(s), VISIT_DAY)


# --- streaming forms, run to the end of the feed ---------------------------------
#
# The tables arrive in several deliveries; between them the queries restart from their checkpoints.


def _delivered(s: Standins, rows: DataFrame, by: str, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Final rows of ``build(stream)`` after all deliveries of ``rows``."""
    folder = replay.new_folder(s.spark, name)
    return replay.in_parts(rows, by, folder, lambda stream, _: replay.append_to_end(build(stream), folder), PARTS)


def _timed_pages(s: Standins) -> DataFrame:
    return s.page_log().withColumn("ts", F.unix_millis("event_ts"))


@query
def stream_page_view_stats(s: Standins) -> DataFrame:
    keys = ["stt", "page_id", *windows.VISITOR_KEYS]
    folder = replay.new_folder(s.spark, "page_view_stats")

    def run(stream: DataFrame, number: int) -> DataFrame:
        return replay.update_to_end(windows.page_view_stats(with_event_time(stream, F.col("event_ts"))), keys, folder)

    return replay.in_parts(_timed_pages(s), "event_ts", folder, run, PARTS)


@query
def stream_new_visitor_repair(s: Standins) -> DataFrame:
    pages = _timed_pages(s).select("id", "mid", "is_new", "event_ts", F.unix_micros("event_ts").alias("ts"))
    return _delivered(
        s, pages, "event_ts", "new_visitor_repair",
        lambda stream: stateful.repair_new_flag_stream(stream.drop("event_ts")).select("id", "mid", "is_new"),
    )


@query
def stream_log_fan_out_values(s: Standins) -> DataFrame:
    """The log job."""
    return _message_values(_delivered(
        s, s.exact_log_at(), "at", "log_topics", lambda stream: logs.fan_out(jobs.repaired_log(stream.drop("at")))))


@query
def stream_first_visit_per_day(s: Standins) -> DataFrame:
    pages = _timed_pages(s).select("id", "mid", "ts", "last_page_id", "event_ts")
    rows = _delivered(
        s, pages, "event_ts", "first_visit",
        lambda stream: stateful.first_visit_stream(with_event_time(stream, F.col("event_ts"))),
    )
    return rows.select("id", "mid", scalars.day_text(F.col("event_ts")).alias("day"))


def _closed(pages: DataFrame) -> DataFrame:
    """Pages with one more far ahead, which closes everything before it."""
    far = F.lit("2100-01-01 00:00:00").cast("timestamp")
    end = {"event_ts": far, "ts": F.unix_millis(far), "last_page_id": F.lit("end"), "id": F.lit(-1), "mid": F.lit("end")}
    nothing = F.lit(None)
    last = pages.sparkSession.range(1).select(*[end.get(f.name, nothing).cast(f.dataType).alias(f.name) for f in pages.schema.fields])
    return pages.unionByName(last)


@query
def stream_unique_visit_stats(s: Standins) -> DataFrame:
    """First visits and their window counts in one query."""
    return _delivered(
        s, _closed(_timed_pages(s)), "event_ts", "unique_visits",
        lambda stream: jobs.unique_visit_stats(with_event_time(stream, F.col("event_ts"))),
    )


@query
def stream_bounces(s: Standins) -> DataFrame:
    pages = _timed_pages(s).select("id", "mid", "ts", "last_page_id", "event_ts")
    return _delivered(
        s, _closed(pages), "event_ts", "bounces",
        lambda stream: stateful.bounce_stream(with_event_time(stream, F.col("event_ts")), BOUNCE_WITHIN, built_in=True).select("id", "mid", "outcome"),
    )


@query
def stream_cdc_current_state(s: Standins) -> DataFrame:
    """A snapshot, taken at another position for every second key, and the changes around and after it."""
    folder = replay.new_folder(s.spark, "cdc_state")
    changes = s.user_cdc().select("id", "op", "seq", "after")
    taken = F.when(F.col("id").cast("bigint") % 2 == 0, 3).otherwise(1)
    latest.latest_per_key(changes.filter(F.col("seq") <= taken), ["id"], ["seq"]).write.parquet(f"{folder}/snapshot")
    snapshot = s.spark.read.parquet(f"{folder}/snapshot")

    def run(stream: DataFrame, number: int) -> DataFrame:
        return replay.append_to_end(stateful.current_state_stream(stream, snapshot, ["id"]), folder)

    news = replay.in_parts(changes.filter("seq > 1"), "seq", folder, run, PARTS)
    after = F.col("after")
    return changelog.current_state(snapshot.unionByName(news), ["id"], ["seq"]).select(
        "id", after["name"].alias("name"), after["phone_num"].alias("phone_num"))


@query
def stream_snowflake_enrich(s: Standins) -> DataFrame:
    """Order aggregate and enrichment, while users and products still arrive."""
    folder, whole, step = replay.new_folder(s.spark, "enriched"), s.dims(), 0

    def dims() -> enrich.Dimensions:
        known = "cast(ID as bigint) % 2 = 0"
        if step == 0:
            return replace(whole, user=whole.user.filter(known), sku=whole.sku.filter(known))
        return replace(whole, category3=whole.category3.filter(known)) if step == 1 else whole

    sink = EnrichedSink(dims, f"{folder}/rows", F.lit(AS_OF).cast("timestamp"))

    def run(stream: DataFrame, number: int) -> None:
        nonlocal step
        step = number
        replay.batches_to_end(jobs.user_province_sku_stats(stream.drop("_at")), sink, folder)

    # Joined and made unique once: the deliveries and their cuts read the lines many times.
    once = replay.staged(_order_lines_once(s).drop("sku_name").withColumn("_at", scalars.text_to_ts(F.col("create_time"))), f"{folder}/lines")
    lines = once.unionByName(once)  # every line is sent again, as an upsert feed does
    last = lines.limit(0).unionByName(s.spark.range(1).select(
        F.lit("end").alias("order_detail_id"), F.lit("2100-01-01 00:00:00").alias("create_time"),
        F.lit("2100-01-01 00:00:00").cast("timestamp").alias("_at")), allowMissingColumns=True)
    replay.in_parts(lines.unionByName(last), "_at", folder, run, PARTS)
    return sink.rows(s.spark)


@query
def stream_interval_join(s: Standins) -> DataFrame:
    def side(name: str) -> DataFrame:
        rows = s.page_stream().select("mid", F.col("id").alias(f"{name}_id"), F.col("event_ts").alias(f"{name}_ts"))
        return rows.withWatermark(f"{name}_ts", "2 seconds")

    pairs = joins.interval_join(side("left"), side("right"), "mid", "left_ts", "right_ts", JOIN_RANGE, JOIN_RANGE)
    rows = replay.append_to_end(
        pairs.select("mid", "left_id", "right_id"), replay.new_folder(s.spark, "interval_join")
    )
    return rows
