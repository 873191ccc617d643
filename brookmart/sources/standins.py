"""Mart inputs derived from the TPC-H-like test tables.

Each stand-in is a list of ``(column, SQL expression)`` over one or two test
tables. The expressions use the SQL both Spark and the checking database know,
so one definition feeds the Spark jobs and the oracle queries. ``{ms}`` is the
one spot where the two differ: epoch milliseconds of ``ts``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmart.operators.enrich import Dimensions
from brookmart.streaming.replay import table_stream

DATABASE = "shop"

Pairs = list[tuple[str, str]]
#: Two times as text: from the first up to the second.
Days = tuple[str, str]

SPARK_MS = "unix_millis(CAST(ts AS TIMESTAMP))"
ORACLE_MS = "epoch_us(ts) // 1000"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def money(expr: str) -> str:
    return f"CAST(CAST({expr} AS DECIMAL(18,2)) AS STRING)"


def json_object(pairs: Pairs) -> str:
    """SQL expression for a JSON object of text members; nulls become JSON null."""
    members = [
        f"'\"{name}\":' || COALESCE('\"' || {expr} || '\"', 'null')"
        for name, expr in pairs
    ]
    return "'{' || " + " || ',' || ".join(members) + " || '}'"


# --- page log and raw application log (events) -------------------------------

K = "CAST(substr(props, 7, length(props) - 7) AS INT)"
IS_NEW = "CASE WHEN event_type = 'signup' OR event_id % 2 = 0 THEN '1' ELSE '0' END"
LAST_PAGE = "CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' THEN 'search' ELSE event_type END"
VC = "'v' || CAST(user_id % 3 AS STRING)"
CH = "'ch' || CAST(user_id % 4 AS STRING)"
AR = "'ar' || CAST(user_id % 5 AS STRING)"

PAGE_LOG: Pairs = [
    ("id", "event_id"),
    ("mid", text("user_id")),
    ("event_ts", "CAST(ts AS TIMESTAMP)"),
    ("vc", VC),
    ("ch", CH),
    ("ar", AR),
    ("is_new", IS_NEW),
    ("page_id", "event_type"),
    ("last_page_id", LAST_PAGE),
    ("during_time", "CAST(floor(value * 1000) AS BIGINT)"),
]

# A record is a start log (no page) for sign-ups and a page log otherwise. Errors
# sit on page and on start logs. Item arrays are absent, empty, or hold 1-2 items.
_ITEM = "'{\"display_type\":\"promotion\",\"item\":\"' || CAST(user_id AS STRING) || '\",\"order\":' || CAST({n} AS STRING) || '}'"
_RAW_RECORD = (
    "'{\"common\":{\"mid\":\"' || CAST(user_id AS STRING) || '\",\"is_new\":\"' || " + IS_NEW
    + " || '\",\"vc\":\"' || " + VC + " || '\",\"ch\":\"' || " + CH + " || '\",\"ar\":\"' || " + AR + " || '\"},'"
    + " || CASE WHEN event_type = 'signup'"
    + " THEN '\"start\":{\"entry\":\"icon\",\"loading_time\":' || CAST(" + K + " AS STRING) || '},'"
    + " ELSE '\"page\":{\"page_id\":\"' || event_type || '\"'"
    + " || CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 2 = 0 THEN '' ELSE ',\"last_page_id\":null' END"
    + " WHEN event_type = 'click' THEN ',\"last_page_id\":\"search\",\"item\":\"item ' || CAST(" + K + " AS STRING) || '\"'"
    + " ELSE ',\"last_page_id\":\"' || event_type || '\"' END"
    + " || CASE WHEN event_type = 'error' THEN '' ELSE ',\"during_time\":' || CAST(CAST(floor(value * 1000) AS BIGINT) AS STRING) END"
    + " || '},' END"
    + " || CASE WHEN event_type = 'error' OR (event_type = 'signup' AND value < 20)"
    + " THEN '\"err\":{\"error_code\":' || CAST(" + K + " AS STRING) || '},' ELSE '' END"
    + " || CASE " + K + " % 4 WHEN 0 THEN '' WHEN 1 THEN '\"displays\":[],'"
    + " WHEN 2 THEN '\"displays\":[' || " + _ITEM.replace("{n}", "1") + " || '],'"
    + " ELSE '\"displays\":[' || " + _ITEM.replace("{n}", "1") + " || ',' || " + _ITEM.replace("{n}", "2") + " || '],' END"
    + " || CASE WHEN value > 60 THEN '\"actions\":[{\"action_id\":\"fav_add\",\"item\":\"' || CAST(" + K
    + " AS STRING) || '\",\"ts\":' || CAST(({ms}) AS STRING) || '}],' ELSE '' END"
    + " || '\"ts\":' || CAST(({ms}) AS STRING) || '}'"
)
_RECORD_COLUMNS: Pairs = [("id", "event_id"), ("k", K), ("record", _RAW_RECORD)]
# Broken input: cut-off records, empty messages, a bare scalar.
RAW_LOG: Pairs = [
    ("id", "id"),
    ("value",
     "CASE k WHEN 50 THEN '50' ELSE '' END"
     " || CASE k WHEN 13 THEN substr(record, 1, 90) WHEN 77 THEN '' WHEN 50 THEN '' ELSE record END"),
]

# The same with members that no job lists, among them a number of 45 digits and trailing zeros.
TRACE = "123456789012345678901234567890123456789012345"
EXACT_LOG: Pairs = [
    ("id", "id"),
    ("value",
     "replace(replace(replace(value, '\"common\":{', '\"trace\":" + TRACE + ",\"common\":{\"weight\":1.10,\"os\":[1, {\"a\":2}],'),"
     " '\"order\":', '\"price\":2.50,\"order\":'), '\"action_id\":', '\"price\" : 3.00,\"action_id\":')"),
]

# --- business tables (orders, lineitem, customer) ----------------------------

LINE_ID = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
LINE_KEY = LINE_ID + " || '-' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING)"
LINE_TIME = text("l_shipdate + (l_orderkey % 86400) * INTERVAL '1' SECOND")
ORDER_TIME = text("o_orderdate + (o_orderkey % 86400) * INTERVAL '1' SECOND")
NET = ("CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"
       " AS DECIMAL(18,2)) AS STRING)")

ORDER_DETAIL: Pairs = [
    ("id", LINE_KEY),
    ("order_id", text("l_orderkey")),
    ("sku_id", text("l_partkey")),
    ("sku_name", "'sku ' || CAST(l_partkey AS STRING)"),
    ("img_url", "'img/' || CAST(l_partkey AS STRING)"),
    ("order_price", money("l_extendedprice")),
    ("sku_num", text("CAST(l_quantity AS BIGINT)")),
    ("create_time", LINE_TIME),
    ("source_type", "l_linestatus"),
    ("source_id", text("l_suppkey")),
    ("split_total_amount", NET),
    ("split_activity_amount", text("CAST(l_discount AS DECIMAL(4,2))")),
    ("split_coupon_amount", text("CAST(l_tax AS DECIMAL(4,2))")),
]
# The same lines under an id that several lines share.
ORDER_DETAIL_DUP: Pairs = [("id", LINE_ID), ("line_key", LINE_KEY)] + ORDER_DETAIL[1:]
ORDER_INFO: Pairs = [
    ("id", text("o_orderkey")),
    ("consignee", "c_name"),
    ("consignee_tel", "'139' || CAST(o_custkey AS STRING)"),
    ("total_amount", money("o_totalprice")),
    ("order_status", "o_orderstatus"),
    ("user_id", text("o_custkey")),
    ("payment_way", "CAST(NULL AS STRING)"),
    ("delivery_address", "'nation ' || CAST(c_nationkey AS STRING)"),
    ("order_comment", "o_orderpriority"),
    ("out_trade_no", "'T' || CAST(o_orderkey AS STRING)"),
    ("trade_body", "CAST(NULL AS STRING)"),
    ("create_time", ORDER_TIME),
    ("operate_time", ORDER_TIME),
    ("expire_time", "CAST(NULL AS STRING)"),
    ("process_status", "CAST(NULL AS STRING)"),
    ("tracking_no", "CAST(NULL AS STRING)"),
    ("parent_order_id", "CAST(NULL AS STRING)"),
    ("img_url", "CAST(NULL AS STRING)"),
    ("province_id", text("c_nationkey")),
    ("activity_reduce_amount", "'0.00'"),
    ("coupon_reduce_amount", "'0.00'"),
    ("original_total_amount", money("o_totalprice")),
    ("feight_fee", "'0.00'"),
    ("feight_fee_reduce", "CAST(NULL AS STRING)"),
    ("refundable_time", "CAST(NULL AS STRING)"),
]
ACTIVITY: Pairs = [
    ("id", "'A' || " + LINE_KEY),
    ("order_id", text("l_orderkey")),
    ("order_detail_id", LINE_KEY),
    ("activity_id", text("l_suppkey")),
    ("activity_rule_id", text("CAST(l_discount AS DECIMAL(4,2))")),
    ("sku_id", text("l_partkey")),
    ("create_time", LINE_TIME),
]
COUPON: Pairs = [
    ("id", "'C' || " + LINE_KEY),
    ("order_id", text("l_orderkey")),
    ("order_detail_id", LINE_KEY),
    ("coupon_id", text("l_suppkey")),
    ("coupon_use_id", "'U' || " + LINE_KEY),
    ("sku_id", text("l_partkey")),
    ("create_time", LINE_TIME),
]
PAYMENT: Pairs = [
    ("id", "'P' || CAST(o_orderkey AS STRING)"),
    ("out_trade_no", "'T' || CAST(o_orderkey AS STRING)"),
    ("order_id", text("o_orderkey")),
    ("user_id", text("o_custkey")),
    ("payment_type", "o_orderpriority"),
    ("trade_no", "CAST(NULL AS STRING)"),
    ("total_amount", money("o_totalprice")),
    ("subject", "'order ' || CAST(o_orderkey AS STRING)"),
    ("payment_status", "o_orderstatus"),
    ("create_time", ORDER_TIME),
    ("callback_time", ORDER_TIME),
    ("callback_content", "CAST(NULL AS STRING)"),
]
REFUND: Pairs = [
    ("id", "'R' || " + LINE_KEY),
    ("user_id", text("l_suppkey")),
    ("order_id", text("l_orderkey")),
    ("sku_id", text("l_partkey")),
    ("refund_type", "l_linestatus"),
    ("refund_num", text("CAST(l_quantity AS BIGINT)")),
    ("refund_amount", NET),
    ("refund_reason_type", "l_returnflag"),
    ("refund_reason_txt", "CAST(NULL AS STRING)"),
    ("refund_status", "'done'"),
    ("create_time", LINE_TIME),
]

ORDER_SOURCE = "orders LEFT JOIN customer ON o_custkey = c_custkey"
# Business tables by name: columns, source, row condition.
BUSINESS: dict[str, tuple[Pairs, str, str]] = {
    "order_detail": (ORDER_DETAIL, "lineitem", "TRUE"),
    "order_info": (ORDER_INFO, ORDER_SOURCE, "TRUE"),
    "order_detail_activity": (ACTIVITY, "lineitem", "l_discount >= 0.05"),
    "order_detail_coupon": (COUPON, "lineitem", "l_tax = 0"),
    "payment_info": (PAYMENT, "orders", "o_orderstatus <> 'P'"),
    "order_refund_info": (REFUND, "lineitem", "l_returnflag = 'R'"),
}

# Change feed of the user table: snapshot, then updates, then deletions.
USER_ROW: Pairs = [
    ("id", text("c_custkey")), ("name", "c_name"), ("phone_num", "'139' || CAST(c_custkey AS STRING)"),
    ("segment", "c_mktsegment"),
]
USER_ROW_NEW: Pairs = [
    ("id", text("c_custkey")), ("name", "c_name || '*'"), ("phone_num", "CAST(NULL AS STRING)"),
    ("segment", "c_mktsegment"),
]
# (operation of a log tool, operation code of a CDC tool, seq, row condition, row before, row after)
USER_FEED = [
    ("bootstrap-start", "r", 0, "c_custkey = 0", None, None),
    ("bootstrap-insert", "r", 1, "TRUE", None, USER_ROW),
    ("bootstrap-complete", "r", 2, "c_custkey = 0", None, None),
    ("update", "u", 3, "c_acctbal < 3000", USER_ROW, USER_ROW_NEW),
    ("delete", "d", 4, "c_mktsegment = 'BUILDING' AND c_acctbal < 6000", USER_ROW, None),
]

# Route configuration log: every event changes the route of one table.
CONFIG_TABLE = (
    "CASE user_id % 8 WHEN 0 THEN 'user_info' WHEN 1 THEN 'order_info' WHEN 2 THEN 'order_detail'"
    " WHEN 3 THEN 'payment_info' WHEN 4 THEN 'order_refund_info' WHEN 5 THEN 'base_province'"
    " WHEN 6 THEN 'sku_info' ELSE 'unused_table' END"
)
CONFIG_OP = "CASE event_type WHEN 'error' THEN 'd' WHEN 'signup' THEN 'c' ELSE 'u' END"
CONFIG_SINK_COLUMNS = (
    "CASE event_type WHEN 'click' THEN 'id,name' WHEN 'view' THEN 'id,order_id,user_id,total_amount'"
    " ELSE 'id,name,phone_num,create_time' END"
)
CONFIG_LOG: Pairs = [
    ("seq", "event_id"),
    ("change_ts", "CAST(ts AS TIMESTAMP)"),
    ("source_table", CONFIG_TABLE),
    ("op", CONFIG_OP),
    ("sink_table", "CASE WHEN event_type = 'error' THEN NULL ELSE 'dim_' || " + CONFIG_TABLE + " END"),
    ("sink_columns", "CASE WHEN event_type = 'error' THEN NULL ELSE " + CONFIG_SINK_COLUMNS + " END"),
    ("sink_pk", "CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN '' ELSE 'id' END"),
    ("sink_extend", "CAST(NULL AS STRING)"),
]

# Changes happen in the 30 days of the configuration log: seconds since then are the creation time modulo 30 days.
ODS_START, ODS_SPAN = 1704067200, 2592000

# What has arrived of an order wide when it is first looked at, and the second time: conditions by input.
WIDE_STATES = (
    {"order_detail": "l_linenumber < 6", "order_detail_activity": "l_suppkey % 2 = 0", "order_detail_coupon": "FALSE"},
    {"order_detail": "l_quantity > 2", "order_detail_activity": "TRUE", "order_detail_coupon": "TRUE"},
)

# Document texts with Han characters for the letters; other letters and digits stay.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "的一是了我不人在他有这个上们来到时大地为子中你说生国"
CJK_TEXT: Pairs = [("doc_id", "doc_id"), ("text", f"translate(lower(text), '{LATIN}', '{HAN}')")]
# Dictionary: words of up to so many characters that occur so often.
DICTIONARY_LETTERS, DICTIONARY_COUNT = 4, 5

# --- dimensions (customer, nation, part, region) ------------------------------

DIM_USER: Pairs = [
    ("ID", text("c_custkey")),
    ("GENDER", "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END"),
    ("BIRTHDAY", text("DATE '1950-01-01' + CAST(c_custkey * 37 % 18000 AS INT)")),
    ("USER_LEVEL", "c_mktsegment"),
]
DIM_PROVINCE: Pairs = [
    ("ID", text("n_nationkey")),
    ("NAME", "CASE WHEN n_nationkey = 7 THEN 'X' ELSE n_name END"),
    ("AREA_CODE", text("100000 + n_nationkey")),
    ("ISO_CODE", "'CN-' || CAST(n_nationkey AS STRING)"),
    ("ISO_3166_2", "'CN-' || CAST(n_regionkey AS STRING) || '-' || CAST(n_nationkey AS STRING)"),
]
SPU_KEY = "CAST(floor(p_partkey / 10) AS BIGINT)"
CATEGORY2_KEY = "CAST(floor(p_size / 5) AS BIGINT)"
DIM_SKU: Pairs = [
    ("ID", text("p_partkey")),
    ("SKU_NAME", "p_name || ' ' || CAST(p_partkey AS STRING)"),
    ("CATEGORY3_ID", text("p_size")),
    ("SPU_ID", text(SPU_KEY)),
    ("TM_ID", "substr(p_brand, 7)"),
]
DIM_SPU: Pairs = [("ID", text(SPU_KEY)), ("SPU_NAME", "'spu ' || " + text(SPU_KEY))]
DIM_CATEGORY3: Pairs = [
    ("ID", text("p_size")), ("NAME", "'category ' || " + text("p_size")), ("CATEGORY2_ID", text(CATEGORY2_KEY)),
]
DIM_CATEGORY2: Pairs = [
    ("ID", text(CATEGORY2_KEY)), ("NAME", "'group ' || " + text(CATEGORY2_KEY)),
    ("CATEGORY1_ID", text(CATEGORY2_KEY + " % 5")),
]
DIM_CATEGORY1: Pairs = [("ID", text("r_regionkey")), ("NAME", "r_name")]
DIM_TRADEMARK: Pairs = [("ID", "substr(p_brand, 7)"), ("TM_NAME", "p_brand")]

# Dimensions by name: columns, source, row condition (which leaves keys missing), duplicates removed.
DIMENSIONS: dict[str, tuple[Pairs, str, str, bool]] = {
    "user": (DIM_USER, "customer", "c_acctbal > -900", False),
    "province": (DIM_PROVINCE, "nation", "TRUE", False),
    "sku": (DIM_SKU, "part", "p_retailprice > 905", False),
    "spu": (DIM_SPU, "part", "TRUE", True),
    "category3": (DIM_CATEGORY3, "part", "p_size < 50", True),
    "category2": (DIM_CATEGORY2, "part", "TRUE", True),
    "category1": (DIM_CATEGORY1, "region", "TRUE", False),
    "trademark": (DIM_TRADEMARK, "part", "TRUE", True),
}


# --- Spark side ---------------------------------------------------------------


def _exprs(pairs: Pairs, ms: str = SPARK_MS) -> list[str]:
    return [f"{expr.replace('{ms}', ms)} AS {name}" for name, expr in pairs]


class Standins:
    """Lazy DataFrames over one directory of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _events(self, days: Days | None) -> DataFrame:
        events = self.table("events")
        if days is None:
            return events
        # Compared in the stored type, so that the range reaches the files.
        kind = dict(events.dtypes)["ts"]
        return events.filter((F.col("ts") >= F.lit(days[0]).cast(kind)) & (F.col("ts") < F.lit(days[1]).cast(kind)))

    def page_log(self, days: Days | None = None) -> DataFrame:
        """The page log, or its part from the first of two times up to the second."""
        return self._events(days).selectExpr(*_exprs(PAGE_LOG))

    def page_stream(self) -> DataFrame:
        """The page log as a stream of the event files, with ``ts`` in milliseconds."""
        events = table_stream(self.spark, f"{self.sf_dir}/events.parquet")
        return events.selectExpr(*_exprs([*PAGE_LOG, ("ts", SPARK_MS)]))

    def raw_log(self) -> DataFrame:
        return self.table("events").selectExpr(*_exprs(_RECORD_COLUMNS)).selectExpr(*_exprs(RAW_LOG))

    def exact_log_at(self) -> DataFrame:
        """:meth:`exact_log` with the time of each record in ``at``."""
        events = self.table("events").selectExpr(*_exprs([*_RECORD_COLUMNS, ("at", "CAST(ts AS TIMESTAMP)")]))
        return events.selectExpr(*_exprs(RAW_LOG), "at").selectExpr(*_exprs(EXACT_LOG), "at")

    def cjk_texts(self) -> DataFrame:
        return self.table("documents").selectExpr(*_exprs(CJK_TEXT))

    def cjk_dictionary(self) -> DataFrame:
        runs = F.regexp_extract_all("text", F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0))
        words = self.cjk_texts().select(F.explode(runs).alias("word")).filter(F.length("word") <= DICTIONARY_LETTERS)
        return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= DICTIONARY_COUNT)

    def exact_log(self) -> DataFrame:
        return self.raw_log().selectExpr(*_exprs(EXACT_LOG))

    def keyword_log(self, days: Days | None = None) -> DataFrame:
        """Page log whose phrases are the document texts, whole; documents are dealt to events in turn."""
        docs = self.table("documents")
        turn = F.pmod("id", docs.agg(F.greatest(F.count("*"), F.lit(1))).scalar())
        texts = docs.select("doc_id", F.col("text").alias("item"))
        return self.page_log(days).withColumn("_doc", turn).join(texts, F.col("_doc") == F.col("doc_id")).drop("doc_id", "_doc")

    def lines_of(self, days: Days) -> DataFrame:
        """Order lines created from the first of two days up to the second; the day is a stored column."""
        kind = dict(self.table("lineitem").dtypes)["l_shipdate"]
        held = (F.col("l_shipdate") >= F.lit(days[0]).cast(kind)) & (F.col("l_shipdate") < F.lit(days[1]).cast(kind))
        return self.table("lineitem").filter(held).selectExpr(*_exprs(ORDER_DETAIL))

    def ods_times(self) -> DataFrame:
        """The change log without row images, with the time of each change within the month of the configuration."""
        made = F.unix_timestamp(F.to_timestamp(F.col("data")["create_time"]))
        at = F.timestamp_seconds(F.lit(ODS_START) + made % ODS_SPAN)
        return self.ods.select("table", "type", F.col("data")["id"].alias("id"), at.alias("change_at"))

    def business(self, name: str, also: str = "TRUE") -> DataFrame:
        """A business table, or the rows of it for which ``also`` holds of their source."""
        pairs, source, condition = BUSINESS[name]
        if source == ORDER_SOURCE:
            base = self.table("orders").join(
                self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
            )
        else:
            base = self.table(source)
        return base.filter(condition).filter(also).selectExpr(*_exprs(pairs))

    def order_detail_dup(self) -> DataFrame:
        return self.table("lineitem").selectExpr(*_exprs(ORDER_DETAIL_DUP))

    @cached_property
    def ods(self) -> DataFrame:
        """Business change log: every row inserted; pending orders updated once more."""
        parts = []
        for name in BUSINESS:
            rows = self.business(name)
            image = F.create_map(*[item for c in rows.columns for item in (F.lit(c), F.col(c))])
            parts.append(rows.select(*_ods_head(name, "insert", 1), image.alias("data")))
            if name == "order_info":
                pending = rows.filter("order_status = 'P'")
                parts.append(pending.select(*_ods_head(name, "update", 2), image.alias("data")))
        feed = parts[0]
        for part in parts[1:]:
            feed = feed.unionByName(part)
        return feed

    def ods_json(self) -> DataFrame:
        """Order changes as JSON text; expensive orders arrive cut off."""
        rows = self.table("orders").join(
            self.table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left"
        )
        return rows.selectExpr(*_exprs(ODS_JSON))

    def user_cdc(self) -> DataFrame:
        """CDC records of the user table: ``topic, op, seq, before, after``."""
        customers = self.table("customer")
        parts = []
        for _, op, seq, condition, before, after in USER_FEED:
            if before is None and after is None:
                continue
            parts.append(customers.filter(condition).select(
                F.lit(f"binlog.{DATABASE}.user_info").alias("topic"), F.lit(op).alias("op"),
                F.lit(seq).alias("seq"), F.col("c_custkey").cast("string").alias("id"),
                _image(before).alias("before"), _image(after).alias("after"),
            ))
        feed = parts[0]
        for part in parts[1:]:
            feed = feed.unionByName(part)
        return feed

    def user_changes(self) -> DataFrame:
        """Log-tool changes of the user table: ``database, table, type, seq, data``."""
        customers = self.table("customer")
        parts = []
        for kind, _, seq, condition, before, after in USER_FEED:
            image = _image(after or before)
            parts.append(customers.filter(condition).select(
                F.lit(DATABASE).alias("database"), F.lit("user_info").alias("table"),
                F.lit(kind).alias("type"), F.lit(seq).alias("seq"), image.alias("data"),
            ))
        feed = parts[0]
        for part in parts[1:]:
            feed = feed.unionByName(part)
        return feed

    def config_log(self) -> DataFrame:
        rows = self.table("events").selectExpr(*_exprs(CONFIG_LOG))
        images = ["sink_table", "sink_columns", "sink_pk", "sink_extend"]
        after = F.create_map(*[item for c in images for item in (F.lit(c), F.col(c))])
        return rows.select("seq", "change_ts", "source_table", "op", after.alias("after"))

    def order_wide_topic(self) -> DataFrame:
        """Upsert topic of order lines: returned lines are tombstones, some messages are broken."""
        return self.table("lineitem").selectExpr(*_exprs(WIDE_TOPIC))

    def dim(self, name: str) -> DataFrame:
        pairs, source, condition, dedupe = DIMENSIONS[name]
        rows = self.table(source).filter(condition).selectExpr(*_exprs(pairs))
        return rows.distinct() if dedupe else rows

    def dims(self) -> Dimensions:
        return Dimensions(**{name: self.dim(name) for name in DIMENSIONS})


def _ods_head(table: str, kind: str, seq: int):
    return [
        F.lit(DATABASE).alias("database"), F.lit(table).alias("table"), F.lit(kind).alias("type"),
        F.lit(seq).alias("seq"),
    ]


def _image(pairs: Pairs | None):
    if pairs is None:
        return F.lit(None).cast("map<string,string>")
    return F.create_map(*[item for name, expr in pairs for item in (F.lit(name), F.expr(expr))])


_ODS_RECORD = (
    f"'{{\"database\":\"{DATABASE}\",\"table\":\"order_info\",\"type\":\"'"
    " || CASE WHEN o_orderstatus = 'P' THEN 'update' ELSE 'insert' END"
    " || '\",\"ts\":' || CAST(o_orderkey AS STRING) || ',\"data\":' || " + json_object(ORDER_INFO) + " || ',\"old\":null}'"
)
ODS_JSON: Pairs = [
    ("id", "o_orderkey"),
    ("value",
     f"CASE WHEN o_totalprice > 450000 THEN substr({_ODS_RECORD}, 1, 60) ELSE {_ODS_RECORD} END"),
]
WIDE_TOPIC: Pairs = [
    ("id", LINE_KEY),
    ("value",
     "CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_quantity = 50 THEN '' WHEN l_quantity = 49 THEN substr("
     + json_object(ORDER_DETAIL) + ", 1, 6) ELSE " + json_object(ORDER_DETAIL) + " END"),
]


# --- oracle side ---------------------------------------------------------------


def select_sql(pairs: Pairs, source: str, condition: str = "TRUE", distinct: bool = False) -> str:
    columns = ", ".join(_exprs(pairs, ORACLE_MS))
    return f"SELECT {'DISTINCT ' if distinct else ''}{columns} FROM {source} WHERE {condition}"


def business_sql(name: str, also: str = "TRUE") -> str:
    pairs, source, condition = BUSINESS[name]
    return select_sql(pairs, source, f"({condition}) AND ({also})")


def dim_sql(name: str) -> str:
    return select_sql(*DIMENSIONS[name])


def page_log_sql() -> str:
    return select_sql(PAGE_LOG, "events")


def raw_log_sql() -> str:
    return select_sql(RAW_LOG, f"({select_sql(_RECORD_COLUMNS, 'events')}) AS record_rows")


def cjk_texts_sql() -> str:
    return select_sql(CJK_TEXT, "documents")


def exact_log_sql() -> str:
    return select_sql(EXACT_LOG, f"({raw_log_sql()}) AS raw_rows")


def config_log_sql() -> str:
    return select_sql(CONFIG_LOG, "events")
