"""Readers and writers, on files."""

import json

import pytest
from pyspark.sql import functions as F

from brookmart import schemas
from brookmart.operators import logs, routing
from brookmart.plans import reports
from brookmart.sources import readers
from brookmart.streaming import jobs, sinks
from brookmart.session import checkpoint_root


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive


def test_topics_round_trip(spark, tmp_path):
    spark.createDataFrame([("a",), ("",), (None,)], "value string").write.parquet(str(tmp_path / "in"))
    stream = readers.topic_text_or_empty(spark, str(tmp_path / "in"), "parquet")
    finish(sinks.topic_writer(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "parquet"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["", "", "a"]


def test_log_job_feeds_the_page_job_and_the_report(spark, tmp_path):
    """Raw text files -> topics -> page aggregate by day -> report, by public functions only."""
    (tmp_path / "raw").mkdir()
    ms = 1704067200000
    lines = ['{"common":{"mid":"m%d","is_new":"1","vc":"v"},"page":{"page_id":"home","during_time":5},"ts":%d}' % (i % 3, ms + i * 1000) for i in range(30)]
    (tmp_path / "raw" / "1.txt").write_text("\n".join([*lines[:20], "broken"]))
    (tmp_path / "raw" / "2.txt").write_text("\n".join([*lines[20:], lines[0].replace(str(ms), str(ms + 10**8))]))
    raw = readers.topic_text(spark, str(tmp_path / "raw"), "text", maxFilesPerTrigger="1")
    assert {"id", "seq", "partition", "offset", "topic", "timestamp"} <= set(raw.columns)
    finish(sinks.topic_writer(jobs.log_topics(raw), str(tmp_path / "topics"), str(tmp_path / "cp1"), "parquet"))
    pages = jobs.page_stream(readers.topic_text(spark, str(tmp_path / "topics" / "topic=dwd_page_log"), "parquet"))
    finish(sinks.aggregate_writer(jobs.page_view_stats(pages), schemas.PAGE_VIEW_STATS, str(tmp_path / "dws"), str(tmp_path / "cp2")))
    table = readers.aggregate_table(spark, str(tmp_path / "dws"))
    assert reports.page_view_row_count(table, 20240101).first().pv_ct > 0
    assert table.filter("dt = '2024-01-01'").agg(F.sum("pv_ct")).first()[0] == 30
    assert table.filter("is_new = '1' and dt = '2024-01-01'").agg(F.sum("pv_ct")).first()[0] == 3


def test_kafka_reader_is_declared(spark):
    with pytest.raises(Exception, match="[Kk]afka"):
        readers.topic_text(spark, "topic_log", **{"kafka.bootstrap.servers": "nowhere:1"})


def test_json_table_and_view(spark, tmp_path):
    text = '{"database":"shop","table":"t","type":"insert","ts":5,"data":{"id":1,"n":null},"old":null}'
    spark.createDataFrame([(text,)], "value string").write.parquet(str(tmp_path / "in"))
    stream = readers.ods_table_stream(spark, str(tmp_path / "in"), "parquet")
    assert stream.isStreaming and stream.columns[:3] == ["database", "table", "type"]
    readers.json_table(spark.read.parquet(str(tmp_path / "in")), schemas.ODS_TYPE, view="ods_db")
    row = spark.sql("select data['id'] id, data['n'] n, data['missing'] m from ods_db").first()
    assert tuple(row) == ("1", None, None)


def test_cdc_stream(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "a.json").write_text('{"topic":"s.shop.u","op":"r","seq":1,"after":{"id":"1"}}\n')
    stream = readers.cdc_stream(spark, str(tmp_path / "feed"))
    finish(stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
           .option("checkpointLocation", str(tmp_path / "cp")))
    assert spark.read.parquet(str(tmp_path / "out")).first().after == {"id": "1"}


RECORDS = [
    '{"common":{"mid":"m","is_new":"1"},"start":{"x":1},"ts":1}',
    '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"displays":[{"a":1},{"a":2}],"actions":[{"b":1}],"ts":2}',
    '{"common":{"mid":"m","is_new":"1"},"page":{"page_id":"p"},"err":{"c":1},"ts":3}',
    '{"broken',
]


def test_log_job_writes_five_topics_and_dirty_text(spark, tmp_path):
    spark.createDataFrame(list(enumerate(RECORDS)), "id long, value string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, value string").parquet(str(tmp_path / "in"))
    finish(sinks.topic_writer(jobs.log_topics(stream), str(tmp_path / "out"), str(tmp_path / "cp"), "parquet"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["topic"]: r["count"] for r in out.groupBy("topic").count().collect()} == {
        "dwd_start_log": 1, "dwd_page_log": 2, "dwd_error_log": 1, "dwd_display_log": 2, "dwd_action_log": 1, "dirty_log": 1}
    assert out.filter("topic = 'dirty_log'").first().value == RECORDS[3]
    batch = logs.fan_out(logs.repair_log(logs.parse_records(spark.read.parquet(str(tmp_path / "in")))))
    assert sorted((r.topic, r.value) for r in out.collect()) == sorted((r.topic, r.value) for r in batch.collect())


def test_aggregate_writer_column_order_and_days(spark, tmp_path):
    stats = spark.createDataFrame(
        [("2024-01-01 00:00:00", "e", "p", "v", "c", "a", "1", 3, 1, 9, 7, 5), ("2024-01-02 00:00:00", "e", "p", "v", "c", "a", "0", 1, 1, 1, 1, 5)],
        "stt string, edt string, page_id string, vc string, ch string, ar string, is_new string, pv_ct long, sv_ct long,"
        "dur_sum long, session_starts long, ts long")
    sinks.write_aggregate(stats, schemas.PAGE_VIEW_STATS, str(tmp_path / "batch"))
    stats.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stats.schema).parquet(str(tmp_path / "in"))
    finish(sinks.aggregate_writer(stream, schemas.PAGE_VIEW_STATS, str(tmp_path / "dws"), str(tmp_path / "cp")))
    for path in ("batch", "dws"):
        table = readers.aggregate_table(spark, str(tmp_path / path))
        assert table.columns == schemas.PAGE_VIEW_STATS + ["dt"]
        assert reports.page_view_row_count(table, 20240101).first().pv_ct == 1
    assert "PartitionFilters: [isnotnull(dt" in reports.on_day(table, 20240101)._jdf.queryExecution().toString()


@pytest.mark.parametrize("mode", ["dynamic", "static"])
def test_version_table_upserts_replay_and_restart(spark, tmp_path, mode):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        table = sinks.VersionTable(str(tmp_path / "table"), ["id"], ["seq"], ["kind"])

        def batch(*rows):
            return spark.createDataFrame([(*r, "k") for r in rows], "id string, seq int, v string, kind string")

        def held(t=table):
            return {tuple(r) for r in t.read(spark).select("id", "seq", "v").collect()}

        table(batch(("1", 1, "a"), ("2", 1, "b"), ("1", 2, "a2")), 0)
        table(batch(("2", 3, "b3"), ("3", 3, "c")), 1)
        want = {("1", 2, "a2"), ("2", 3, "b3"), ("3", 3, "c")}
        assert held() == want
        table(batch(("2", 3, "b3"), ("3", 3, "c")), 1)  # replayed
        table(batch(("2", 2, "stale")), 2)
        table(batch(), 3)
        assert held() == want
        # Another query with a new checkpoint counts its batches from 0 again.
        again = sinks.VersionTable(str(tmp_path / "table"), ["id"], ["seq"], ["kind"])
        again(batch(("9", 9, "z")), 0)
        assert held() == want | {("9", 9, "z")}
        small = table.compacted(spark, str(tmp_path / "small"))
        assert held(small) == held() and small.versions(spark).count() == 4
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def test_dimension_job(spark, tmp_path):
    config_log = spark.createDataFrame(
        [(1, "user_info", "c", {"sink_table": "dim_user_info", "sink_columns": "id, name", "sink_pk": "code"})],
        "seq int, source_table string, op string, after map<string,string>")
    rows = [
        ("user_info", "bootstrap-start", 0, {}),
        ("user_info", "bootstrap-insert", 1, {"id": "1", "code": "c1", "name": "a"}),
        ("user_info", "insert", 2, {"id": "2", "code": "c2", "name": None}),
        ("user_info", "update", 3, {"id": "1", "code": "c1", "name": "b"}),
        ("user_info", "delete", 4, {"id": "2"}),
        ("user_info", "insert", 6, {"id": "7"}), ("user_info", "insert", 7, {"id": "8"}),
        ("other", "insert", 5, {"id": "9"}),
    ]
    spark.createDataFrame(rows, "table string, type string, seq int, data map<string,string>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("table string, type string, seq int, data map<string,string>").parquet(str(tmp_path / "in"))
    store = sinks.VersionTable(str(tmp_path / "dims"), ["pk"], ["seq"], partition_by=["sink_table"])
    write = jobs.dim_sync(lambda: routing.current_config(config_log, ["seq"]), store, str(tmp_path / "tables"))
    finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")))
    dim = jobs.dimension_columns(store.read(spark), "dim_user_info", "id, name")
    assert dim.columns == ["ID", "NAME"]
    assert {tuple(r) for r in dim.collect()} == {("1", "b"), ("2", None)}
    # The target table is there before its first rows, as configured.
    target = readers.dimension(spark, str(tmp_path / "tables" / "dim_user_info"))
    assert target.dtypes == [("id", "string"), ("name", "string")] and target.count() == 0


def test_keyed_json(spark):
    row = sinks.keyed_json(spark.createDataFrame([("1", None)], "id string, v string"), ["id"]).first()
    assert json.loads(row.key) == {"id": "1"} and json.loads(row.value) == {"id": "1", "v": None}
    assert json.loads(sinks.value_json(spark.createDataFrame([("1", None)], "id string, v string")).first().value) == {"id": "1"}


def test_create_table(spark, tmp_path):
    for _ in range(2):
        sinks.create_table(spark, str(tmp_path / "t"), "id, name", "compression=gzip, parquet.page.size=65536")
    assert readers.dimension(spark, str(tmp_path / "t")).columns == ["id", "name"]


class NamedFolder:
    """A session whose cluster names the checkpoint folder."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://shared/cp/" if key == "spark.checkpoint.dir" else default


def test_checkpoint_root(spark):
    assert checkpoint_root(NamedFolder()) == "hdfs://shared/cp"
    assert checkpoint_root(spark) == checkpoint_root(spark)
