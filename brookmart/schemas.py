"""Column lists and JSON shapes of the feeds, detail tables and aggregates."""

from __future__ import annotations

# JSON shape of one application log record. Members with an open
# key set stay VARIANT so that re-serialising keeps their own types.
LOG_TYPE = (
    "struct<"
    "common struct<mid string, is_new string, vc string, ch string, ar string>,"
    "page struct<page_id string, last_page_id string, item string, during_time bigint>,"
    "actions array<variant>,"
    "displays array<variant>,"
    "start variant,"
    "err variant,"
    "ts bigint>"
)

# One row of the business change log.
ODS_TYPE = (
    "struct<"
    "database string, `table` string, type string, ts bigint, xid bigint, xoffset bigint,"
    "data map<string, string>, old map<string, string>>"
)

# Keys read from the `data` map of each business table.
ORDER_DETAIL = [
    "id", "order_id", "sku_id", "sku_name", "img_url", "order_price", "sku_num", "create_time",
    "source_type", "source_id", "split_total_amount", "split_activity_amount", "split_coupon_amount",
]
ORDER_INFO = [
    "id", "consignee", "consignee_tel", "total_amount", "order_status", "user_id", "payment_way",
    "delivery_address", "order_comment", "out_trade_no", "trade_body", "create_time", "operate_time",
    "expire_time", "process_status", "tracking_no", "parent_order_id", "img_url", "province_id",
    "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee",
    "feight_fee_reduce", "refundable_time",
]
ORDER_DETAIL_ACTIVITY = [
    "id", "order_id", "order_detail_id", "activity_id", "activity_rule_id", "sku_id", "create_time",
]
ORDER_DETAIL_COUPON = [
    "id", "order_id", "order_detail_id", "coupon_id", "coupon_use_id", "sku_id", "create_time",
]
PAYMENT_INFO = [
    "id", "out_trade_no", "order_id", "user_id", "payment_type", "trade_no", "total_amount", "subject",
    "payment_status", "create_time", "callback_time", "callback_content",
]
ORDER_REFUND_INFO = [
    "id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount",
    "refund_reason_type", "refund_reason_txt", "refund_status", "create_time",
]

# Columns of the wide tables, by the input that supplies them.
WIDE_FROM_DETAIL = ORDER_DETAIL[1:]
WIDE_FROM_ORDER = [
    "consignee", "consignee_tel", "total_amount", "order_status", "user_id", "payment_way",
    "delivery_address", "order_comment", "out_trade_no", "trade_body", "operate_time", "expire_time",
    "process_status", "tracking_no", "parent_order_id", "province_id", "activity_reduce_amount",
    "coupon_reduce_amount", "original_total_amount", "feight_fee", "feight_fee_reduce",
    "refundable_time",
]
WIDE_FROM_ACTIVITY = [
    "order_detail_activity_id", "activity_id", "activity_rule_id", "order_detail_activity_create_time",
]
WIDE_FROM_COUPON = [
    "order_detail_coupon_id", "coupon_id", "coupon_use_id", "order_detail_coupon_create_time",
]
ORDER_WIDE = (
    ["order_detail_id"] + WIDE_FROM_DETAIL + WIDE_FROM_ORDER + WIDE_FROM_ACTIVITY + WIDE_FROM_COUPON
)
# Payment wide drops img_url and out_trade_no of the order side: the payment has its own.
PAYMENT_WIDE = [
    "payment_id", "out_trade_no", "subject", "payment_status", "payment_create_time", "callback_time",
    "callback_content",
] + [c for c in ORDER_WIDE if c not in ("img_url", "out_trade_no")]
# Refund wide takes order, sku and user from the refund.
REFUND_WIDE = [
    "order_refund_id", "user_id", "order_id", "sku_id", "refund_type", "refund_num", "refund_amount",
    "refund_reason_type", "refund_reason_txt", "refund_status", "order_refund_create_time",
] + [c for c in ORDER_WIDE if c not in ("order_id", "sku_id", "user_id")]

# Sink column order of the aggregates.
PAGE_VIEW_STATS = [
    "stt", "edt", "page_id", "vc", "ch", "ar", "is_new", "pv_ct", "sv_ct", "dur_sum", "ts",
]
UNIQUE_VISIT_STATS = ["stt", "edt", "vc", "ch", "ar", "is_new", "uv_ct", "ts"]
BOUNCE_STATS = ["stt", "edt", "vc", "ch", "ar", "is_new", "uj_ct", "ts"]
KEYWORD_STATS = ["keyword", "ct", "source", "stt", "edt", "ts"]
USER_PROVINCE_SKU = [
    "stt", "edt",
    "sku_id", "sku_name", "sku_price",
    "spu_id", "spu_name", "tm_id", "tm_name",
    "category3_id", "category3_name", "category2_id", "category2_name", "category1_id", "category1_name",
    "user_id", "user_age", "user_gender",
    "province_id", "province_name", "province_area_code", "province_iso_code", "province_iso_3166_2",
    "order_sku_num", "order_amount", "order_ct", "ts",
]
