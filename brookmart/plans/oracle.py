"""SQL for the same results as :mod:`brookmart.plans.catalog`, for an independent engine."""

from __future__ import annotations

from brookmart import schemas
from brookmart.operators import segment
from brookmart.plans import reports
from brookmart.plans.catalog import AS_OF, BUSY_KEYS, KEYWORD_DAY, ORDER_DAY, VISIT_DAY
from brookmart.sources import standins as st

WITHIN = "INTERVAL '12 hours'"
RANGE = "INTERVAL '5 minutes'"


def with_(select: str, **ctes: str) -> str:
    parts = ", ".join(f"{name} AS ({body})" for name, body in ctes.items())
    return f"WITH {parts} {select}"


def _stt(bucket: str, interval: str) -> str:
    return (
        f"strftime({bucket}, '%Y-%m-%d %H:%M:%S') AS stt, "
        f"strftime({bucket} + {interval}, '%Y-%m-%d %H:%M:%S') AS edt"
    )


# --- log ------------------------------------------------------------------------

_OBJECT = (
    "CASE WHEN value IS NULL THEN false WHEN NOT json_valid(value) THEN false"
    " ELSE json_type(value) = 'OBJECT' END"
)
_PARSED = f"""
SELECT id, value, value->>'$.common.mid' AS mid, value->>'$.common.is_new' AS flag,
       value->>'$.common.vc' AS vc, value->>'$.common.ch' AS ch, value->>'$.common.ar' AS ar,
       value->>'$.page.page_id' AS page_id, value->>'$.page.last_page_id' AS last_page_id,
       value->>'$.page.item' AS item, CAST(value->>'$.page.during_time' AS BIGINT) AS during_time,
       (value->>'$.err') IS NOT NULL AS has_err, (value->>'$.start') IS NOT NULL AS has_start,
       CAST(value->>'$.ts' AS BIGINT) AS ts
FROM (SELECT * FROM raw_log WHERE {_OBJECT}) AS well_formed
"""
_REPAIRED = """
SELECT *, CASE WHEN flag = '1' AND row_number() OVER (PARTITION BY mid ORDER BY ts, id) > 1
               THEN '0' ELSE flag END AS is_new
FROM parsed
"""
_LOG = {"raw_log": st.raw_log_sql(), "parsed": _PARSED, "repaired": _REPAIRED}

LOG_SQL = {
    "log_parse_clean": with_(
        """SELECT id, mid, flag AS is_new, vc, ch, ar, page_id, last_page_id, item, during_time,
                  CAST(json_array_length(value, '$.displays') AS INTEGER) AS n_displays,
                  CAST(json_array_length(value, '$.actions') AS INTEGER) AS n_actions,
                  has_err, has_start, ts FROM parsed""",
        **_LOG,
    ),
    "log_parse_dirty": with_(f"SELECT id, value FROM raw_log WHERE NOT ({_OBJECT})", **_LOG),
    "new_visitor_repair": with_(
        """SELECT id, mid, CASE WHEN is_new = '1' AND rn > 1 THEN '0' ELSE is_new END AS is_new
           FROM (SELECT *, row_number() OVER (PARTITION BY mid ORDER BY event_ts, id) AS rn FROM page_log)""",
        page_log=st.page_log_sql(),
    ),
    "log_page": with_(
        """SELECT id, mid, is_new, vc, ch, ar, page_id, last_page_id, item, during_time, ts
           FROM repaired WHERE NOT has_start""",
        **_LOG,
    ),
    "log_start": with_(
        """SELECT id, mid, is_new, ts, CAST(value->>'$.start.loading_time' AS BIGINT) AS loading_time
           FROM repaired WHERE has_start""",
        **_LOG,
    ),
    "log_error": with_(
        """SELECT id, mid, is_new, ts, has_start AS is_start,
                  CAST(value->>'$.err.error_code' AS BIGINT) AS error_code
           FROM repaired WHERE has_err""",
        **_LOG,
    ),
    "log_split_exclusive": with_(
        """SELECT id, mid, is_new,
                  CASE WHEN has_err THEN 'error' WHEN has_start THEN 'start' ELSE 'page' END AS stream
           FROM repaired""",
        **_LOG,
    ),
    "log_display": with_(
        """SELECT id, d->>'$.display_type' AS display_type, d->>'$.item' AS item,
                  CAST(d->>'$.order' AS BIGINT) AS item_order, ts, page_id
           FROM (SELECT id, ts, page_id, unnest(json_extract(value, '$.displays[*]')) AS d
                 FROM repaired WHERE NOT has_start)""",
        **_LOG,
    ),
    "log_action": with_(
        """SELECT id, a->>'$.action_id' AS action_id, a->>'$.item' AS item,
                  CAST(a->>'$.ts' AS BIGINT) AS ts, page_id, mid, is_new
           FROM (SELECT id, page_id, mid, is_new, unnest(json_extract(value, '$.actions[*]')) AS a
                 FROM repaired WHERE NOT has_start)""",
        **_LOG,
    ),
    "log_fan_out": with_(
        """SELECT id, 'dwd_error_log' AS topic, CAST(1 AS BIGINT) AS n FROM repaired WHERE has_err
           UNION ALL SELECT id, 'dwd_start_log', 1 FROM repaired WHERE has_start
           UNION ALL SELECT id, 'dwd_page_log', 1 FROM repaired WHERE NOT has_start
           UNION ALL SELECT id, 'dwd_display_log', json_array_length(value, '$.displays') FROM repaired
                     WHERE NOT has_start AND json_array_length(value, '$.displays') > 0
           UNION ALL SELECT id, 'dwd_action_log', json_array_length(value, '$.actions') FROM repaired
                     WHERE NOT has_start AND json_array_length(value, '$.actions') > 0""",
        **_LOG,
    ),
    "log_fan_out_values": with_(
        f"""SELECT id, topic, trace, weight, price, mid, is_new, item, ts, page_id, dirty FROM (
              SELECT id, 'dirty_log' AS topic, regexp_extract(value, 'trace":([0-9.]+)', 1) AS trace, regexp_extract(value, 'weight":([0-9.]+)', 1) AS weight,
                     regexp_extract(value, 'price":([0-9.]+)', 1) AS price, NULL AS mid, NULL AS is_new, NULL AS item, NULL AS ts, NULL AS page_id, value AS dirty
              FROM raw_log WHERE NOT ({_OBJECT})
              UNION ALL
              SELECT id, topic, '{st.TRACE}', '1.10', CASE WHEN json_array_length(value, '$.displays') > 0 THEN '2.50' ELSE '' END, mid, is_new, item, ts, page_id, NULL
              FROM repaired, unnest(CASE WHEN has_start AND has_err THEN ['dwd_start_log', 'dwd_error_log'] WHEN has_start THEN ['dwd_start_log']
                                         WHEN has_err THEN ['dwd_page_log', 'dwd_error_log'] ELSE ['dwd_page_log'] END) AS t(topic)
              UNION ALL
              SELECT id, 'dwd_display_log', '', '', '2.50', NULL, NULL, d->>'$.item', ts, page_id, NULL
              FROM (SELECT id, ts, page_id, unnest(json_extract(value, '$.displays[*]')) AS d FROM repaired WHERE NOT has_start)
              UNION ALL
              SELECT id, 'dwd_action_log', '', '1.10', '', mid, is_new, a->>'$.item', CAST(a->>'$.ts' AS BIGINT), page_id, NULL
              FROM (SELECT id, mid, is_new, page_id, unnest(json_extract(value, '$.actions[*]')) AS a FROM repaired WHERE NOT has_start))""",
        **{**_LOG, "raw_log": st.exact_log_sql()},
    ),
    "epoch_to_ts": """
        SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS rt,
               strftime(date_trunc('millisecond', ts), '%Y-%m-%d %H:%M:%S.%g') AS rt_ms,
               CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day
        FROM events""",
}

# --- change log and dimensions ---------------------------------------------------


def _image(pairs: st.Pairs | None) -> str:
    return st.json_object(pairs) if pairs else "NULL"


def _user_feed_sql(cdc: bool) -> str:
    rows = []
    for kind, op, seq, condition, before, after in st.USER_FEED:
        if cdc and before is None and after is None:
            continue
        row = dict(after or before or [])
        picked = ", ".join(f"{row.get(c, 'NULL')} AS {c}" for c in ("name", "phone_num", "segment"))
        pk = st.text("c_custkey") if cdc or row else "NULL"
        rows.append(
            f"SELECT '{kind}' AS type, '{op}' AS op, {seq} AS seq, {pk} AS id, {picked}, "
            f"{_image(before)} AS before, {_image(after)} AS after FROM customer WHERE {condition}"
        )
    return " UNION ALL ".join(rows)


def _columns(pairs: st.Pairs) -> str:
    return ", ".join(name for name, _ in pairs)


_CONFIG = {
    "config_log": st.config_log_sql(),
    "config": """
        SELECT source_table, sink_table, sink_columns,
               CASE WHEN sink_pk IS NULL OR sink_pk = '' THEN 'id' ELSE sink_pk END AS sink_pk,
               COALESCE(sink_extend, '') AS sink_extend
        FROM (SELECT *, row_number() OVER (PARTITION BY source_table ORDER BY change_ts DESC, seq DESC) AS rn
              FROM config_log)
        WHERE rn = 1 AND op <> 'd'""",
}


def _feed_sql() -> str:
    """Change feed in long form: one row per (change, column)."""
    parts = []
    for name, (pairs, source, condition) in st.BUSINESS.items():
        versions = [("insert", "TRUE")]
        if name == "order_info":
            versions.append(("update", "o_orderstatus = 'P'"))
        for kind, extra in versions:
            items = ", ".join(f"{{'col': '{c}', 'content': {expr}}}" for c, expr in pairs)
            parts.append(
                f"SELECT '{name}' AS tbl, '{kind}' AS type, {pairs[0][1]} AS id, [{items}] AS items "
                f"FROM {source} WHERE ({condition}) AND ({extra})"
            )
    return " UNION ALL ".join(parts)


CHANGE_SQL = {
    "tombstone_filter": with_(
        f"SELECT id, value FROM topic WHERE {_OBJECT}", topic=st.select_sql(st.WIDE_TOPIC, "lineitem")
    ),
    "ods_json_scan": with_(
        f"""SELECT id, value->>'$.database' AS database, value->>'$.table' AS "table",
                   value->>'$.type' AS type, CAST(value->>'$.ts' AS BIGINT) AS ts,
                   value->>'$.data.id' AS order_id, value->>'$.data.order_status' AS order_status,
                   value->>'$.data.total_amount' AS total_amount, value->>'$.data.payment_way' AS payment_way,
                   CAST(len(json_keys(value, '$.data')) AS BIGINT) AS n_columns
            FROM (SELECT * FROM feed WHERE {_OBJECT}) AS well_formed""",
        feed=st.select_sql(st.ODS_JSON, st.ORDER_SOURCE),
    ),
    "ods_parse_clean": with_(
        f"SELECT id, value->>'$.type' AS type FROM (SELECT * FROM feed WHERE {_OBJECT}) AS well_formed",
        feed=st.select_sql(st.ODS_JSON, st.ORDER_SOURCE),
    ),
    "ods_parse_dirty": with_(
        f"SELECT id, value FROM feed WHERE NOT ({_OBJECT})", feed=st.select_sql(st.ODS_JSON, st.ORDER_SOURCE)
    ),
    "ods_order_detail": st.business_sql("order_detail"),
    "ods_order_info": st.business_sql("order_info"),
    "ods_order_activity": st.business_sql("order_detail_activity"),
    "ods_order_coupon": st.business_sql("order_detail_coupon"),
    "ods_payment_info": st.business_sql("payment_info"),
    "ods_refund_info": st.business_sql("order_refund_info"),
    "cdc_envelope": with_(
        f"""SELECT id, seq, '{{"database":"{st.DATABASE}","tableName":"user_info","after":' || COALESCE(after, '{{}}')
                   || ',"before":' || COALESCE(before, '{{}}') || ',"type":"' || op || '"}}' AS value
            FROM feed""",
        feed=_user_feed_sql(cdc=True),
    ),
    "cdc_current_state": with_(
        """SELECT id, name, phone_num
           FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM feed)
           WHERE rn = 1 AND op <> 'd'""",
        feed=_user_feed_sql(cdc=True),
    ),
    "config_current": with_("SELECT * FROM config", **_CONFIG),
    "dim_route": with_(
        """SELECT tbl AS "table", type, sink_table, sink_pk, id FROM feed JOIN config ON tbl = source_table""",
        **_CONFIG, feed=_feed_sql(),
    ),
    "dim_prune_columns": with_(
        """SELECT tbl AS "table", type, id, item.col AS "column", item.content AS content
           FROM (SELECT tbl, type, id, unnest(items) AS item FROM feed) JOIN config ON tbl = source_table
           WHERE ',' || sink_columns || ',' LIKE '%,' || item.col || ',%'""",
        **_CONFIG, feed=_feed_sql(),
    ),
    "dim_upsert_state": with_(
        """SELECT 'dim_user_info' AS sink_table, id AS pk, seq, name, phone_num, segment
           FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM feed
                 WHERE type NOT IN ('bootstrap-start', 'bootstrap-complete', 'delete'))
           WHERE rn = 1""",
        feed=_user_feed_sql(cdc=False),
    ),
    "dim_scan_renamed": with_(
        "SELECT ID AS id, GENDER AS gender, BIRTHDAY AS birthday, USER_LEVEL AS \"userLevel\" FROM dim_user",
        dim_user=st.dim_sql("user"),
    ),
    "upsert_latest_by_key": with_(
        """SELECT id, CASE WHEN order_status = 'P' THEN 'DONE' ELSE order_status END AS order_status,
                  total_amount, CASE WHEN order_status = 'P' THEN 2 ELSE 1 END AS version
           FROM order_info""",
        order_info=st.business_sql("order_info"),
    ),
}

# --- wide tables ------------------------------------------------------------------

_TABLES = {name: st.business_sql(name) for name in st.BUSINESS}

# What a line gains from each other input: how, input, the key there and on the line, columns (renamed ones in pairs).
_GAINS = [
    ("INNER", "order_info", ("id", "order_id"), schemas.WIDE_FROM_ORDER),
    *[("LEFT", f"order_detail_{kind}", ("order_detail_id", "id"), [(c.removeprefix(f"order_detail_{kind}_"), c) if c.startswith("order_detail_") else c for c in names])
      for kind, names in (("activity", schemas.WIDE_FROM_ACTIVITY), ("coupon", schemas.WIDE_FROM_COUPON))],
]


def _renamed(columns: list) -> str:
    return ", ".join(c if isinstance(c, str) else f"{c[0]} AS {c[1]}" for c in columns)


def _gathered(lines: str, gains: list, **inputs: str) -> str:
    joins = " ".join(
        f"{how} JOIN (SELECT {_renamed([key, *columns])} FROM {inputs.get(table, table)}) USING ({key[1]})" for how, table, key, columns in gains
    )
    return f"(FROM {lines} {joins})"


def _order_wide(**inputs: str) -> str:
    columns = _renamed([("id", "order_detail_id"), *schemas.ORDER_WIDE[1:]])
    return f"SELECT {columns} FROM {_gathered(inputs.get('order_detail', 'order_detail'), _GAINS, **inputs)}"


_WIDE = {**_TABLES, "wide": _order_wide()}


def _with_lines(own: list, table: str, columns: list[str], keys: list[str], how: str) -> str:
    """Rows of a table with the order lines of the same ``keys``; line columns that the table has itself are its own."""
    names = [c if isinstance(c, str) else c[1] for c in own]
    other = [c for c in columns if c not in names]
    renamed = {k: k if k in names else f"{k}_of_row" for k in keys}
    mine = _renamed([*own, *[(k, r) for k, r in renamed.items() if k != r]])
    theirs = _renamed([*[c for c in other if c not in keys], *[(k, r) for k, r in renamed.items()], *[k for k in keys if k in other]])
    return f"SELECT {', '.join(columns)} FROM (SELECT {mine} FROM {table}) {how} JOIN (SELECT {theirs} FROM wide) USING ({', '.join(renamed.values())})"


def _states_sql() -> str:
    """Both states of the order wide, each row as one value, met by key."""
    def first(name: str, also: str) -> str:
        key, order = ("id", "create_time, sku_num, split_total_amount") if name == "order_detail" else ("order_detail_id", "create_time")
        return f"(SELECT * FROM ({st.business_sql(name, also)}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"

    states = [_order_wide(**{name: first(name, also) for name, also in arrived.items()}) for arrived in st.WIDE_STATES]
    row = "{" + ", ".join(f"'{c}': {c}" for c in schemas.ORDER_WIDE) + "}"
    old, new = (f"(SELECT order_detail_id, {row} AS {name} FROM ({body}))" for name, body in zip(("old", "new"), states, strict=True))
    return f"SELECT old, new FROM {old} FULL JOIN {new} USING (order_detail_id) WHERE old IS DISTINCT FROM new"


WIDE_SQL = {
    "order_detail_join_info": with_(f"SELECT * FROM {_gathered('order_detail', _GAINS[:1])}", **_TABLES),
    "order_wide": with_("SELECT * FROM wide", **_WIDE),
    "order_wide_changes": with_(
        """SELECT CASE WHEN old IS NULL THEN 'insert' ELSE 'update_after' END AS change, unnest(new) FROM changed WHERE new IS NOT NULL
           UNION ALL SELECT CASE WHEN new IS NULL THEN 'delete' ELSE 'update_before' END, unnest(old) FROM changed WHERE old IS NOT NULL""",
        **_TABLES, changed=_states_sql(),
    ),
    "payment_wide": with_(
        _with_lines(
            [("id", "payment_id"), "out_trade_no", "subject", "payment_status", ("create_time", "payment_create_time"), "callback_time", "callback_content"],
            "payment_info", schemas.PAYMENT_WIDE, ["order_id"], "LEFT"),
        **_WIDE,
    ),
    "refund_wide": with_(
        _with_lines(
            [("id", "order_refund_id"), *schemas.REFUND_WIDE[1:10], ("create_time", "order_refund_create_time")],
            "order_refund_info", schemas.REFUND_WIDE, ["order_id", "sku_id"], "INNER"),
        **_WIDE,
    ),
    "id_join": """
        SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, o_orderkey AS order_key, o_orderstatus AS status
        FROM customer JOIN orders ON c_custkey = o_custkey""",
    "interval_join": with_(
        f"""SELECT l.mid, l.id AS left_id, r.id AS right_id FROM page_log l JOIN page_log r ON l.mid = r.mid
            AND r.event_ts BETWEEN l.event_ts - {RANGE} AND l.event_ts + {RANGE}""",
        page_log=st.page_log_sql(),
    ),
}

# --- orders -----------------------------------------------------------------------


def _order_stats(interval: str, few: dict[str, int] | None = None) -> str:
    bucket = f"time_bucket({interval}, rt, TIMESTAMP '1970-01-01')"
    key = {c: f"CAST({c} AS BIGINT)" + (f" % {few[c]}" if few else "") for c in ("user_id", "province_id", "sku_id")}
    return f"""
        SELECT {_stt('bucket', interval)}, user_id, province_id, sku_id,
               CAST(sum(num) AS BIGINT) AS order_sku_num, CAST(sum(amount) AS DOUBLE) AS order_amount,
               count(*) AS order_ct, epoch_us(min(rt)) // 1000 AS ts,
               arg_min(sku_name, [CAST(rt AS VARCHAR), id]) AS sku_name,
               CAST(arg_min(price, [CAST(rt AS VARCHAR), id]) AS DOUBLE) AS sku_price
        FROM (
            SELECT *, {bucket} AS bucket FROM (
                SELECT id, {key['user_id']} AS user_id, {key['province_id']} AS province_id,
                       {key['sku_id']} AS sku_id, sku_name, CAST(order_price AS DECIMAL(18,2)) AS price,
                       CAST(sku_num AS BIGINT) AS num, CAST(split_total_amount AS DECIMAL(18,2)) AS amount,
                       CAST(create_time AS TIMESTAMP) AS rt
                FROM (SELECT od.*, oi.user_id, oi.province_id,
                             row_number() OVER (PARTITION BY od.id ORDER BY od.create_time, od.sku_num,
                                                od.split_total_amount) AS rn
                      FROM order_detail od JOIN order_info oi ON od.order_id = oi.id)
                WHERE rn = 1))
        GROUP BY bucket, user_id, province_id, sku_id"""


_DIMS = {f"dim_{name}": st.dim_sql(name) for name in st.DIMENSIONS}


def _enriched(join: str) -> str:
    age = (f"CAST(floor((epoch_ms(TIMESTAMP '{AS_OF} 00:00:00') - epoch_ms(CAST(u.BIRTHDAY AS TIMESTAMP)))"
           " / (365 * 86400000.0)) AS BIGINT)")
    return f"""
        SELECT t.stt, t.edt, t.sku_id, k.SKU_NAME AS sku_name, t.sku_price,
               CAST(k.SPU_ID AS BIGINT) AS spu_id, p.SPU_NAME AS spu_name,
               CAST(k.TM_ID AS BIGINT) AS tm_id, m.TM_NAME AS tm_name,
               CAST(k.CATEGORY3_ID AS BIGINT) AS category3_id, c3.NAME AS category3_name,
               CAST(c3.CATEGORY2_ID AS BIGINT) AS category2_id, c2.NAME AS category2_name,
               CAST(c2.CATEGORY1_ID AS BIGINT) AS category1_id, c1.NAME AS category1_name,
               t.user_id, {age} AS user_age, u.GENDER AS user_gender,
               t.province_id, v.NAME AS province_name, v.AREA_CODE AS province_area_code,
               v.ISO_CODE AS province_iso_code, v.ISO_3166_2 AS province_iso_3166_2,
               t.order_sku_num, t.order_amount, t.order_ct, t.ts
        FROM stats t
        {join} JOIN dim_user u ON CAST(t.user_id AS VARCHAR) = u.ID
        {join} JOIN dim_province v ON CAST(t.province_id AS VARCHAR) = v.ID
        {join} JOIN dim_sku k ON CAST(t.sku_id AS VARCHAR) = k.ID
        {join} JOIN dim_spu p ON k.SPU_ID = p.ID
        {join} JOIN dim_category3 c3 ON k.CATEGORY3_ID = c3.ID
        {join} JOIN dim_category2 c2 ON c3.CATEGORY2_ID = c2.ID
        {join} JOIN dim_category1 c1 ON c2.CATEGORY1_ID = c1.ID
        {join} JOIN dim_trademark m ON k.TM_ID = m.ID"""


_STATS = {**_TABLES, "stats": _order_stats("INTERVAL '10 seconds'")}
_ENRICHED = {**_STATS, **_DIMS, "enriched": _enriched("INNER")}

ORDER_SQL = {
    "first_per_order_detail": with_(
        """SELECT id, line_key, sku_id, create_time
           FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY create_time, line_key) AS rn FROM dup)
           WHERE rn = 1""",
        dup=st.select_sql(st.ORDER_DETAIL_DUP, "lineitem"),
    ),
    "user_province_sku_stats": with_("SELECT * FROM stats", **_STATS),
    "user_province_sku_daily": with_(
        "SELECT * FROM stats", **{**_TABLES, "stats": _order_stats("INTERVAL '1 day'")}
    ),
    "user_province_sku_busy": with_(
        "SELECT * FROM stats", **{**_TABLES, "stats": _order_stats("INTERVAL '365 days'", BUSY_KEYS)}
    ),
    "dim_lookup_inner": with_(
        """SELECT o.id, o.user_id, u.GENDER AS gender, u.BIRTHDAY AS birthday
           FROM order_info o JOIN dim_user u ON o.user_id = u.ID""",
        **_TABLES, **_DIMS,
    ),
    "dim_lookup_left": with_(
        """SELECT o.id, o.user_id, u.GENDER AS gender, u.BIRTHDAY AS birthday
           FROM order_info o LEFT JOIN dim_user u ON o.user_id = u.ID""",
        **_TABLES, **_DIMS,
    ),
    "snowflake_enrich": with_("SELECT * FROM enriched", **_ENRICHED),
    # A sku missing from the sku dimension has no product keys either, and a
    # broken level of the chain leaves the levels above it empty.
    "snowflake_enrich_left": with_(
        "SELECT * FROM enriched", **{**_ENRICHED, "enriched": _enriched("LEFT")}
    ),
    "age_years": with_(
        f"""SELECT ID, BIRTHDAY, CAST(floor((epoch_ms(TIMESTAMP '{AS_OF} 00:00:00')
                   - epoch_ms(CAST(BIRTHDAY AS TIMESTAMP))) / (365 * 86400000.0)) AS BIGINT) AS age
            FROM dim_user""",
        **_DIMS,
    ),
}

# --- visits and keywords ----------------------------------------------------------

_ENTRY_DAYS = """
    SELECT *, strftime(event_ts, '%Y-%m-%d') AS day,
           row_number() OVER (PARTITION BY mid, CAST(event_ts AS DATE) ORDER BY event_ts, id) AS rn
    FROM page_log WHERE last_page_id IS NULL"""


def _bounce_rows(within: str) -> str:
    return f"""
        SELECT *, CASE WHEN next_ts IS NULL OR next_ts - event_ts >= {within} THEN 'timeout'
                       WHEN next_last IS NULL THEN 'matched' END AS outcome
        FROM (SELECT *, lead(event_ts) OVER w AS next_ts, lead(last_page_id) OVER w AS next_last
              FROM page_log WINDOW w AS (PARTITION BY mid ORDER BY event_ts, id))
        WHERE last_page_id IS NULL
          AND (next_ts IS NULL OR next_ts - event_ts >= {within} OR next_last IS NULL)"""


def _page_views(interval: str) -> str:
    return f"""
        SELECT {_stt('bucket', interval)}, page_id, vc, ch, ar, is_new, count(*) AS pv_ct,
               count(last_page_id) AS sv_ct, CAST(sum(COALESCE(during_time, 0)) AS BIGINT) AS dur_sum,
               count(*) - count(last_page_id) AS session_starts, epoch_us(min(event_ts)) // 1000 AS ts
        FROM (SELECT *, time_bucket({interval}, event_ts, TIMESTAMP '1970-01-01') AS bucket FROM page_log)
        GROUP BY bucket, page_id, vc, ch, ar, is_new"""


def _visitor_counts(rows: str, name: str, interval: str) -> str:
    return f"""
        SELECT {_stt('bucket', interval)}, vc, ch, ar, is_new, count(*) AS {name}, epoch_us(min(event_ts)) // 1000 AS ts
        FROM (SELECT *, time_bucket({interval}, event_ts) AS bucket FROM {rows})
        GROUP BY bucket, vc, ch, ar, is_new"""


_TEN = "INTERVAL '10 seconds'"
_HOUR = "INTERVAL '1 hour'"
_VISIT = {
    "page_log": st.page_log_sql(),
    "entry_days": _ENTRY_DAYS,
    "first_visits": "SELECT * FROM entry_days WHERE rn = 1",
    "bounces": _bounce_rows(WITHIN),
}
_KEYWORD = {
    "keyword_log": f"SELECT p.*, d.text AS item FROM ({st.page_log_sql()}) p JOIN documents d ON p.id % (SELECT greatest(count(*), 1) FROM documents) = d.doc_id",
    "search_rows": "SELECT * FROM keyword_log WHERE last_page_id = 'search' AND item IS NOT NULL",
    "keyword_stats": f"""
        SELECT keyword, count(*) AS ct, 'search' AS source, {_stt('bucket', _TEN)}, epoch_us(min(event_ts)) // 1000 AS ts
        FROM (SELECT time_bucket({_TEN}, event_ts) AS bucket, event_ts,
                     unnest(regexp_extract_all(lower(item), '[\\p{{L}}\\p{{N}}]+', 0)) AS keyword FROM search_rows)
        GROUP BY bucket, keyword""",
}

VISIT_SQL = {
    "page_view_stats": with_(_page_views(_TEN), **_VISIT),
    "page_view_stats_hourly": with_(_page_views(_HOUR), **_VISIT),
    "page_view_stats_monthly": with_(_page_views("INTERVAL '30 days'"), **_VISIT),
    "first_visit_per_day": with_("SELECT id, mid, day FROM first_visits", **_VISIT),
    "unique_visit_stats": with_(_visitor_counts("first_visits", "uv_ct", _TEN), **_VISIT),
    "unique_visit_stats_hourly": with_(_visitor_counts("first_visits", "uv_ct", _HOUR), **_VISIT),
    "bounce_matched": with_("SELECT id, mid, outcome FROM bounces WHERE outcome = 'matched'", **_VISIT),
    "bounce_timeout": with_("SELECT id, mid, outcome FROM bounces WHERE outcome = 'timeout'", **_VISIT),
    "bounce_union": with_("SELECT id, mid, outcome FROM bounces", **_VISIT),
    "bounce_stats": with_(_visitor_counts("bounces", "uj_ct", _HOUR), **_VISIT),
    "bounce_stats_10s": with_(
        _visitor_counts("bounces", "uj_ct", _TEN), **{**_VISIT, "bounces": _bounce_rows(_TEN)}
    ),
    "keyword_filter": with_("SELECT id, mid, item FROM search_rows", **_KEYWORD),
    "keyword_split": r"""
        SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+', 0)) AS word FROM documents""",
    "keyword_stats": with_("SELECT * FROM keyword_stats", **_KEYWORD),
}


def _dictionary_sql() -> str:
    return f"""
WITH RECURSIVE pieces AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(text, '[\\p{{Han}}]+|(?:[\\p{{N}}]|[^\\P{{L}}\\p{{Han}}])+')) AS run FROM ({st.cjk_texts_sql()})
), runs AS MATERIALIZED (SELECT DISTINCT run FROM pieces WHERE regexp_matches(run, '^\\p{{Han}}')),
counted AS MATERIALIZED (
  SELECT run AS word, count(*) AS n FROM pieces WHERE regexp_matches(run, '^\\p{{Han}}') AND length(run) <= {st.DICTIONARY_LETTERS}
  GROUP BY run HAVING count(*) >= {st.DICTIONARY_COUNT}
), dict AS MATERIALIZED (SELECT word, CAST(round({segment.UNITS} * ln(sum(n) OVER () / n)) AS BIGINT) AS cost FROM counted),
edges AS MATERIALIZED (
  SELECT run, start, start + size AS stop, coalesce(cost, (SELECT coalesce(max(cost), 0) FROM dict) + {segment.UNKNOWN}) AS cost
  FROM (SELECT run, start, unnest(range(1, least({st.DICTIONARY_LETTERS}, length(run) - start) + 1)) AS size
        FROM (SELECT run, unnest(range(length(run))) AS start FROM runs)) p
  LEFT JOIN dict ON dict.word = substr(run, start + 1, size) WHERE size = 1 OR cost IS NOT NULL
), best AS (
  SELECT run, 0 AS i, [CAST(0 AS BIGINT)] AS costs, [CAST(0 AS BIGINT)] AS starts FROM runs
  UNION ALL
  SELECT b.run, b.i + 1, list_append(any_value(b.costs), min(b.costs[e.start + 1] + e.cost)),
         list_append(any_value(b.starts), arg_min(e.start, [b.costs[e.start + 1] + e.cost, e.start]))
  FROM best b JOIN edges e ON e.run = b.run AND e.stop = b.i + 1 GROUP BY b.run, b.i
), walk AS (
  SELECT run, starts, CAST(i AS BIGINT) AS stop FROM best WHERE i = length(run)
  UNION ALL SELECT run, starts, starts[stop + 1] FROM walk WHERE stop > 0
), cut AS (SELECT run, substr(run, starts[stop + 1] + 1, stop - starts[stop + 1]) AS word FROM walk WHERE stop > 0)
SELECT doc_id, word, count(*) AS n FROM (
  SELECT doc_id, word FROM pieces JOIN cut USING (run)
  UNION ALL SELECT doc_id, run FROM pieces WHERE NOT regexp_matches(run, '^\\p{{Han}}'))
GROUP BY doc_id, word"""


VISIT_SQL["keyword_split_dictionary"] = _dictionary_sql()

# --- reports ----------------------------------------------------------------------


def _on(day: int) -> str:
    return f"substr(stt, 1, 10) = '{reports.day_of(day)}'"


def _half_up(num: str, den: str, digits: int) -> str:
    scale = 2 * 10**digits
    return f"CASE WHEN uv_ct = 0 OR {den} = 0 THEN 0 ELSE ({num} * {scale} + {den}) // ({den} * 2) END"


def _top(keys: str, limit: int, extra: str = "") -> str:
    return with_(
        f"""SELECT {keys}, sum(order_amount) AS order_amount{extra}
            FROM (SELECT *, CAST(order_amount AS DECIMAL(18,2)) AS exact FROM enriched WHERE {_on(ORDER_DAY)})
            GROUP BY {keys} HAVING sum(exact) > 0 ORDER BY sum(exact) DESC, {keys} LIMIT {limit}"""
        .replace("sum(order_amount) AS", "CAST(sum(exact) AS DOUBLE) AS"),
        **_ENRICHED,
    )


def _pivoted(key: str, names: list[str], needed: list[str], more: list[str] = ()) -> str:
    """One row per key with the sums of the named measures; keys without the needed ones are left out."""
    sums = [f"coalesce(sum(amount) FILTER (name = '{n}'), 0)::BIGINT AS {n}" for n in names]
    present = " AND ".join(f"bool_or(name = '{n}')" for n in needed)
    return f"SELECT {key}, {', '.join([*sums, *more])} FROM measured GROUP BY {key} HAVING {present}"


_VISIT_TABLES = {
    **_VISIT,
    "pvs": _page_views(_TEN),
    "uvs": _visitor_counts("first_visits", "uv_ct", _TEN),
    "ujs": _visitor_counts("bounces", "uj_ct", _TEN),
    # Every measure of the day as a row of its own: hour, flag, name, value.
    "measured": " UNION ALL ".join(
        f"SELECT hour(CAST(stt AS TIMESTAMP)) AS hr, is_new, '{name}' AS name, {name} AS amount FROM {table} WHERE {_on(VISIT_DAY)}"
        for table, names in (("pvs", ("pv_ct", "sv_ct", "dur_sum")), ("uvs", ("uv_ct",)), ("ujs", ("uj_ct",))) for name in names),
    "flags": _pivoted("is_new", ["pv_ct", "sv_ct", "dur_sum", "uv_ct", "uj_ct"], ["pv_ct", "uv_ct"]),
    "ratios": f"""
        SELECT *, ({_half_up('uj_ct * 100', 'sv_ct', 2)}) / 100.0 AS uj_rate,
               ((({_half_up('dur_sum', 'sv_ct', 0)}) * 20 + 1000) // 2000) / 10.0 AS dur_per_sv,
               ({_half_up('pv_ct', 'sv_ct', 2)}) / 100.0 AS pv_per_sv
        FROM flags""",
    "hours": _pivoted("hr", ["pv_ct", "uv_ct", "uj_ct"], ["pv_ct"], ["coalesce(sum(amount) FILTER (name = 'uv_ct' AND is_new = '1'), 0)::BIGINT AS new_uv", "bool_or(name = 'uv_ct') AS has_uv"]),
}


def _pivot_sql() -> str:
    metrics = [
        (reports.UV_LABEL, "uv_ct"), (reports.PV_LABEL, "pv_ct"), (reports.BOUNCE_RATE_LABEL, "uj_rate"),
        (reports.SECONDS_LABEL, "dur_per_sv"), (reports.PAGES_LABEL, "pv_per_sv"),
    ]
    return " UNION ALL ".join(
        f"""SELECT '{label}' AS type,
                   CAST(COALESCE(max(CASE WHEN is_new = '1' THEN {c} END), 0) AS DOUBLE) AS new,
                   CAST(COALESCE(max(CASE WHEN is_new <> '1' THEN {c} END), 0) AS DOUBLE) AS old FROM ratios"""
        for label, c in metrics
    )


REPORT_SQL = {
    "report_gmv": with_(
        f"""SELECT CAST(COALESCE(sum(CAST(order_amount AS DECIMAL(18,2))), 0) AS DOUBLE) AS order_amount
            FROM enriched WHERE {_on(ORDER_DAY)}""",
        **_ENRICHED,
    ),
    "report_spu": _top("spu_id, spu_name", 10, ", CAST(sum(order_ct) AS BIGINT) AS order_ct"),
    "report_category3": _top("category3_id, category3_name", 4),
    "report_trademark": _top("tm_id, tm_name", 20),
    "report_province": with_(
        f"""SELECT province_id, province_name,
                   CAST(sum(CAST(order_amount AS DECIMAL(18,2))) AS DOUBLE) AS order_amount,
                   CASE WHEN length(province_name) > 1 THEN province_name
                        ELSE '{reports.DEFAULT_PROVINCE}' END AS name
            FROM enriched WHERE {_on(ORDER_DAY)} GROUP BY province_id, province_name""",
        **_ENRICHED,
    ),
    "report_visitor_new_flag": with_("SELECT * FROM flags", **_VISIT_TABLES),
    "report_visitor_ratios": with_("SELECT * FROM ratios", **_VISIT_TABLES),
    "report_visitor_pivot": with_(_pivot_sql(), **_VISIT_TABLES),
    "report_visitor_hour": with_(
        "SELECT CAST(hr AS INTEGER) AS hr, new_uv, uj_ct, uv_ct, pv_ct FROM hours WHERE has_uv", **_VISIT_TABLES
    ),
    "report_visitor_hour_filled": with_(
        """SELECT lpad(CAST(r.h AS VARCHAR), 2, '0') AS hr, COALESCE(uv_ct, 0) AS uv_ct,
                  COALESCE(pv_ct, 0) AS pv_ct, COALESCE(new_uv, 0) AS new_uv
           FROM range(24) AS r(h) LEFT JOIN hours ON hours.hr = r.h""",
        **_VISIT_TABLES,
    ),
    "report_pv_rows": with_(f"SELECT count(pv_ct) AS pv_ct FROM pvs WHERE {_on(VISIT_DAY)}", **_VISIT_TABLES),
    "report_uv_rows": with_(f"SELECT count(uv_ct) AS uv_ct FROM uvs WHERE {_on(VISIT_DAY)}", **_VISIT_TABLES),
    "report_keyword": with_(
        f"""SELECT keyword, CAST(sum(ct) AS BIGINT) AS ct FROM keyword_stats WHERE {_on(KEYWORD_DAY)}
            GROUP BY keyword ORDER BY 2 DESC, 1 LIMIT 20""",
        **_KEYWORD,
    ),
}


def _times_sql() -> str:
    """The change log with the time of each change."""
    at = f"TIMESTAMP '1970-01-01' + to_seconds({st.ODS_START} + CAST(epoch(CAST({{}} AS TIMESTAMP)) AS BIGINT) % {st.ODS_SPAN})"
    parts = []
    for name, (pairs, source, condition) in st.BUSINESS.items():
        made = at.format(dict(pairs)["create_time"])
        for kind, also in [("insert", "TRUE"), *([("update", "o_orderstatus = 'P'")] if name == "order_info" else [])]:
            parts.append(f"SELECT '{name}' AS source_table, '{kind}' AS type, {pairs[0][1]} AS id, {made} AS change_ts FROM {source} WHERE ({condition}) AND ({also})")
    return " UNION ALL ".join(parts)


AS_OF_SQL = {
    "dim_route_as_of": with_(
        """SELECT source_table AS "table", type, id, sink_table, sink_columns, coalesce(nullif(sink_pk, ''), 'id') AS sink_pk
           FROM feed ASOF JOIN (SELECT * FROM config_log QUALIFY row_number() OVER (PARTITION BY source_table, change_ts ORDER BY seq DESC) = 1) AS told
             USING (source_table, change_ts)
           WHERE op <> 'd'""",
        config_log=st.config_log_sql(), feed=_times_sql(),
    ),
}

# The streaming forms give the rows of the batch forms, reports over stored aggregates those of the reports.
STREAM_SQL = {
    "stream_page_view_stats": VISIT_SQL["page_view_stats"],
    "stream_new_visitor_repair": LOG_SQL["new_visitor_repair"],
    "stream_log_fan_out_values": LOG_SQL["log_fan_out_values"],
    "stream_unique_visit_stats": VISIT_SQL["unique_visit_stats"],
    "stream_first_visit_per_day": VISIT_SQL["first_visit_per_day"],
    "stream_bounces": VISIT_SQL["bounce_union"],
    "stream_interval_join": WIDE_SQL["interval_join"],
    "stream_cdc_current_state": CHANGE_SQL["cdc_current_state"],
    "stream_snowflake_enrich": ORDER_SQL["snowflake_enrich"],
    "stored_user_province_sku": ORDER_SQL["user_province_sku_stats"],
    "stored_report_spu": REPORT_SQL["report_spu"],
    "stored_report_visitor_pivot": REPORT_SQL["report_visitor_pivot"],
    "stored_report_visitor_hour": REPORT_SQL["report_visitor_hour"],
}


def all_sql() -> dict[str, str]:
    return {**LOG_SQL, **CHANGE_SQL, **WIDE_SQL, **ORDER_SQL, **VISIT_SQL, **REPORT_SQL, **AS_OF_SQL, **STREAM_SQL}
