"""Shape of the physical plans, with broadcasts off where the large-table plan is meant."""

import re

import pytest

from brookmart.plans.catalog import all_queries as queries
from brookmart.operators import changelog, latest, logs, wide
from brookmart import schemas
from brookmart.sources.standins import Standins

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in queries() if not n.startswith(("stream_", "stored_")) and n != "order_wide_changes"))
def test_no_query_leaves_the_engine_or_crosses_tables(spark, no_broadcast, name):
    text = plan(queries()[name](spark, SF_DIR))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas",
                 "FlatMapGroupsInPandas"):
        assert word not in text


def test_first_per_key_prunes_before_the_exchange(spark):
    df = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    text = plan(latest.first_per_key(df, ["l_orderkey"], ["l_shipdate", "l_linenumber"]))
    final, partial = text.index("Final"), text.index("Partial")
    assert final < text.index("Exchange") < partial


def test_window_aggregate_is_one_exchange_with_partial_sums(spark):
    text = plan(queries()["page_view_stats"](spark, SF_DIR))
    assert text.count("Exchange") == 1 and text.count("HashAggregate") == 2 and "SortAggregate" not in text


def test_scans_read_only_used_columns(spark):
    text = plan(queries()["report_gmv"](spark, SF_DIR))
    lineitem = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_returnflag" not in lineitem and "l_tax" not in lineitem
    assert "o_totalprice" not in text


def test_building_the_wide_tables_runs_no_look_ahead(spark):
    s = Standins(spark, SF_DIR)
    tables = [s.business(n) for n in ("order_detail", "order_info", "order_detail_activity", "order_detail_coupon", "payment_info")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "wide tables")
    wide.payment_wide(tables[4], wide.order_wide(*tables[:4]))
    jobs = tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs


def test_wide_joins_can_be_split(spark, no_broadcast):
    s = Standins(spark, SF_DIR)
    lines = wide.order_wide(*[s.business(n) for n in (
        "order_detail", "order_info", "order_detail_activity", "order_detail_coupon")], hot=True)
    text = plan(wide.payment_wide(s.business("payment_info"), lines, hot=True))
    # Inner and anti joins only: adaptive execution can split either side of the inner ones.
    joined = [line for line in text.splitlines() if "SortMergeJoin" in line]
    assert joined and not any("LeftOuter" in line and "_key" in line for line in joined)


def test_top_n_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(queries()["report_keyword"](spark, SF_DIR))


def test_change_log_stored_by_table_prunes_folders(spark, tmp_path):
    Standins(spark, SF_DIR).ods.write.partitionBy("table").parquet(str(tmp_path / "ods"))
    ods = spark.read.parquet(str(tmp_path / "ods"))
    rows = changelog.ods_table(ods, "payment_info", schemas.PAYMENT_INFO, "shop")
    assert re.search(r"PartitionFilters: \[isnotnull\(table#\d+\), \(table#\d+ = payment_info\)\]", plan(rows))
    assert rows.count() == Standins(spark, SF_DIR).business("payment_info").count()


def executed_scans(df) -> int:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan|Scan parquet", final))


@pytest.mark.parametrize(("name", "most"), [("order_wide", 6), ("payment_wide", 8), ("refund_wide", 8)])
def test_wide_tables_read_every_input_once(spark, no_broadcast, name, most):
    assert executed_scans(queries()[name](spark, SF_DIR)) <= most


@pytest.mark.parametrize("name", sorted(n for n in queries() if n.startswith("report_")))
def test_reports_read_their_day_only(spark, name):
    """The span of the report reaches the files of the raw rows it starts from."""
    text = plan(queries()[name](spark, SF_DIR))
    scans = [line for line in text.splitlines() if "FileScan" in line and ("events.parquet" in line or "lineitem.parquet" in line)]
    column = "l_shipdate" if any("lineitem" in line for line in scans) else "ts"
    assert scans and all(f"GreaterThanOrEqual({column}," in line and f"LessThan({column}," in line for line in scans)


def test_reports_over_stored_aggregates_prune_days(spark, tmp_path):
    from brookmart.plans import reports
    from brookmart.streaming.sinks import BatchTable

    rows = spark.createDataFrame([(f"2024-01-{d:02d} 00:00:00", "v", d) for d in range(1, 30)], "stt string, vc string, pv_ct long")
    BatchTable(str(tmp_path), "q", ["stt", "vc", "pv_ct"])(rows, 0)
    day = reports.on_day(BatchTable.read(spark, str(tmp_path)), 20240115)
    text = plan(day)
    assert re.search(r"PartitionFilters: \[[^\]]*dt#\d+[^\]]*2024-01-15", text) and [r.pv_ct for r in day.collect()] == [15]


def test_point_in_time_join_sorts_buckets_not_tables(spark, no_broadcast):
    text = plan(queries()["dim_route_as_of"](spark, SF_DIR))
    windows = [line for line in text.splitlines() if "Window [last(" in line]
    assert len(windows) == 2 and "_bucket" in windows[0].split("], [")[-2]


def test_routes_are_sent_to_the_changes(spark, no_broadcast):
    """Changes are not dealt by table name, however large the log of the routes is."""
    text = plan(queries()["dim_prune_columns"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "hashpartitioning(table" not in text


def test_column_list_is_cut_once_per_row(spark):
    from brookmart.operators import routing

    rows = spark.createDataFrame([("a, c", {"a": "1", "b": "2", "c": "3"})], "sink_columns string, data map<string,string>")
    pruned = routing.prune_columns(rows.filter("rand() < 2"))
    assert pruned.first().data == {"a": "1", "c": "3"}
    # The split stands outside the function of the entries.
    optimised = pruned._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in optimised[optimised.index("map_filter"):]


class Enough(Exception):
    pass


def test_stored_orders_join_the_lines_once(spark, monkeypatch):
    from brookmart.streaming import sinks

    batches, write = [], sinks.BatchTable.__call__
    monkeypatch.setattr(sinks.BatchTable, "__call__", lambda self, batch, number: (batches.append(plan(batch)), write(self, batch, number))[1])
    queries()["stored_user_province_sku"](spark, SF_DIR)
    assert len(batches) == 4 and not any("orders.parquet" in text or "Join" in text for text in batches)


def test_streamed_order_lines_are_made_once(spark, monkeypatch):
    from brookmart.streaming import replay

    fed = []

    def stop(rows, *_):
        fed.append(plan(rows))
        raise Enough

    monkeypatch.setattr(replay, "in_parts", stop)
    with pytest.raises(Enough):
        queries()["stream_snowflake_enrich"](spark, SF_DIR)
    assert "orders.parquet" not in fed[0] and "Join" not in fed[0]


def test_cancelled_lines_come_from_the_stored_states(spark, monkeypatch):
    from brookmart.streaming import sinks

    plans, write = [], sinks.VersionTable.__call__
    monkeypatch.setattr(sinks.VersionTable, "__call__", lambda self, batch, number: (plans.append(plan(batch)), write(self, batch, number))[1])
    queries()["order_wide_changes"](spark, SF_DIR)
    assert len(plans) == 3 and "lineitem.parquet" not in plans[2]


def test_places_are_not_dealt_by_first_character(spark, no_broadcast):
    assert "hashpartitioning(first" not in plan(queries()["keyword_split_dictionary"](spark, SF_DIR))


def test_order_aggregate_holds_the_earliest_line_once(spark):
    text = plan(queries()["user_province_sku_stats"](spark, SF_DIR))
    assert "min_by" not in text and text.count("partial_min(") == 1


def test_log_fan_out_cuts_each_part_once(spark):
    """A pattern over a whole record stands once in the plan for displays, actions, common and the flag."""
    raw = spark.createDataFrame([(1, '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"displays":[{"a":1}],"actions":[{"b":2}],"ts":1}')], "id long, value string")
    made = logs.fan_out(logs.repair_log(logs.parse_records(raw)))
    text = made._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract(") == 3
    assert text.count("regexp_replace(") == 1
    assert {r.value for r in made.where("topic = 'dwd_display_log'").collect()} == {'{"a":1,"ts":1,"page_id":"p"}'}
