"""Configuration-driven routing of change rows to dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmart.operators.asof import as_of
from brookmart.operators.changelog import current_state

CONFIG_COLUMNS = ["source_table", "sink_table", "sink_columns", "sink_pk", "sink_extend"]


def current_config(config_log: DataFrame, order: list[str]) -> DataFrame:
    """Routes in force after a log of ``(source_table, after map, op, …)`` changes.

    A deleted route disappears. An empty key falls back to ``id`` and an absent
    suffix to the empty text.
    """
    live = current_state(config_log, ["source_table"], order)
    return live.select("source_table", *_sink(F.col("after")))


def _sink(after: Column) -> list[Column]:
    return [
        after["sink_table"].alias("sink_table"),
        after["sink_columns"].alias("sink_columns"),
        F.coalesce(F.nullif(after["sink_pk"], F.lit("")), F.lit("id")).alias("sink_pk"),
        F.coalesce(after["sink_extend"], F.lit("")).alias("sink_extend"),
    ]


def route(ods: DataFrame, config: DataFrame) -> DataFrame:
    """Attach the sink of each change; rows of unknown tables and deletes are dropped.

    There is one route per table name, so there are as many as the database has tables, however
    long their log is. They are sent to the changes: the planner only knows the size of the
    log, and dealing changes by table name would give each task a whole table.
    """
    routes = F.broadcast(config.select("source_table", "sink_table", "sink_columns", "sink_pk"))
    return (
        ods.filter(F.col("type") != "delete")
        .join(routes, F.col("table") == F.col("source_table"))
        .drop("source_table")
    )


def route_as_of(ods: DataFrame, config_log: DataFrame, at: str, config_at: str = "change_ts", order: str = "seq", bucket: str = "1 hour") -> DataFrame:
    """Attach the sink that was configured when each change happened.

    ``at`` is the time of a change and ``config_at`` that of a configuration row. Changes
    before the first route of their table, after its deletion and without a time are dropped,
    deletes too. The history of a table is cut into time buckets, see :func:`asof.as_of`.
    """
    changes = ods.filter(F.col("type") != "delete")
    routes = config_log.select(F.col("source_table").alias("table"), config_at, order, "op", *_sink(F.col("after")))
    routed = as_of(changes, routes, ["table"], at, config_at, order, bucket, "_route")
    sink = [F.col("_route")[c].alias(c) for c in ("sink_table", "sink_columns", "sink_pk")]
    return routed.filter(F.col("_route").isNotNull() & (F.col("_route")["op"] != "d")).select(*ods.columns, *sink)


def column_list(text: str) -> list[str]:
    """Names of a comma list; blanks around them and empty entries do not count."""
    return [name for part in text.split(",") if (name := part.strip(" \t\r\n"))]


def prune_columns(routed: DataFrame) -> DataFrame:
    """Keep only the ``data`` entries listed in ``sink_columns``, read as by :func:`column_list`."""
    listed = F.transform(F.split("sink_columns", ","), lambda c: F.btrim(c, F.lit(" \t\r\n")))
    # An argument of ``transform`` is read once per row, not once per entry.
    kept = F.transform(F.array(listed), lambda names: F.map_filter("data", lambda key, _: F.array_contains(names, key)))
    return routed.withColumn("data", F.element_at(kept, 1))


def sink_schema(sink_columns: str) -> T.StructType:
    """Schema of a dimension table: every configured column is text."""
    return T.StructType([T.StructField(c, T.StringType()) for c in column_list(sink_columns)])


def explode_data(routed: DataFrame) -> DataFrame:
    """Long form of the row images: one row per remaining column."""
    keep = [c for c in routed.columns if c != "data"]
    return routed.select(*keep, F.explode("data").alias("column", "content"))
