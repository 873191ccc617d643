"""Order, payment and refund wide tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart import schemas
from brookmart.functions.packing import packed, unpacked
from brookmart.operators.joins import left_join_split


#: Texts of a line that are numbers, amounts and times, see :func:`packed`.
_DIGITS = [
    "sku_id", "order_price", "sku_num", "create_time", "source_id", "split_total_amount", "split_activity_amount", "split_coupon_amount",
]


def detail_with_order(detail: DataFrame, info: DataFrame) -> DataFrame:
    """Order lines that have an order, with the order's columns (inner)."""
    order = info.select(F.col("id").alias("_order_id"), *schemas.WIDE_FROM_ORDER)
    return detail.join(order, F.col("order_id") == F.col("_order_id")).drop("_order_id")


def _left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: bool) -> DataFrame:
    return left_join_split(left, right, left_key, right_key) if hot else left.join(right, F.col(left_key) == F.col(right_key), "left")


def _texts(df: DataFrame, *without: str) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string" and name not in without]


def order_wide(
    detail: DataFrame, info: DataFrame, activity: DataFrame, coupon: DataFrame, hot: bool = False, keep: Sequence[str] = (),
    by_line: bool = False,
) -> DataFrame:
    """Order line with order, activity and coupon columns; the last two are optional.

    Lines are dealt once, by order, with their texts packed (:func:`packed`). An activity or coupon belongs to a
    line whatever order it names, so the orders of the lines' ids go to the parts first, and the parts go
    to those orders. The result is partitioned by ``order_id``, the key of the payment join.
    ``by_line`` is for lines that are dealt by ``id`` already or are costly to make twice: the parts
    meet them there, and lines and parts are dealt by order together. An activity or coupon belongs to a
    line, so a line has few of them and adaptive splitting of the lines is enough; where one
    line may own a large share of them, ``hot`` splits that side too and reads inputs again.
    The columns ``keep`` of the lines stay besides.
    """
    act = activity.select(
        F.col("order_detail_id").alias("_act_key"),
        F.col("id").alias("order_detail_activity_id"), "activity_id", "activity_rule_id",
        F.col("create_time").alias("order_detail_activity_create_time"),
    )
    cou = coupon.select(
        F.col("order_detail_id").alias("_cou_key"),
        F.col("id").alias("order_detail_coupon_id"), "coupon_id", "coupon_use_id",
        F.col("create_time").alias("order_detail_coupon_create_time"),
    )
    if hot:
        lines = _left_join(detail, act, "id", "_act_key", hot)
        lines = _left_join(lines, cou, "id", "_cou_key", hot).withColumnRenamed("id", "order_detail_id")
        return detail_with_order(lines, info).select(*schemas.ORDER_WIDE, *keep)
    order = info.select(F.col("id").alias("_order_id"), *schemas.WIDE_FROM_ORDER)
    texts = _texts(detail, "id", "order_id")
    lines = packed(detail, texts, "_line", _DIGITS)
    if by_line:
        parted = _left_join(_left_join(lines, act, "id", "_act_key", hot), cou, "id", "_cou_key", hot)
        rows = parted.join(order, F.col("order_id") == F.col("_order_id"))
    else:
        # Dealt by line only, which serves both the distinct pairs and the joins.
        orders = detail.select(F.col("id").alias("_part_line"), F.col("order_id").alias("_part_order")).dropna().repartition("_part_line").distinct()
        parts = _left_join(_left_join(orders, act, "_part_line", "_act_key", hot), cou, "_part_line", "_cou_key", hot)
        parts = parts.filter(F.col("_act_key").isNotNull() | F.col("_cou_key").isNotNull()).drop("_act_key", "_cou_key")
        rows = lines.join(order, F.col("order_id") == F.col("_order_id"))
        rows = rows.join(parts, (F.col("order_id") == F.col("_part_order")) & (F.col("id") == F.col("_part_line")), "left")
    return unpacked(rows, texts, "_line", _DIGITS).withColumnRenamed("id", "order_detail_id").select(*schemas.ORDER_WIDE, *keep)


def payment_wide(payment: DataFrame, wide: DataFrame, hot: bool = False) -> DataFrame:
    """Every payment with all lines of its order; a payment without lines stays, null-padded.

    ``hot`` is for orders that own a large share of all lines, see :func:`order_wide`.
    """
    pay = payment.select(
        F.col("id").alias("payment_id"), F.col("order_id").alias("_pay_order"),
        F.col("out_trade_no").alias("_pay_trade_no"), "subject", "payment_status",
        F.col("create_time").alias("payment_create_time"), "callback_time", "callback_content",
    )
    lines = wide.drop("out_trade_no", "img_url")
    joined = _left_join(pay, lines, "_pay_order", "order_id", hot)
    return joined.withColumnRenamed("_pay_trade_no", "out_trade_no").select(*schemas.PAYMENT_WIDE)


#: Columns of a refund beside its order and sku.
_OF_REFUND = [c for c in schemas.ORDER_REFUND_INFO if c not in ("order_id", "sku_id")]


def _with_refunds(refund: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines with each of their refunds, in columns of their own, matched on order and sku (inner)."""
    ref = refund.select("order_id", "sku_id", *[F.col(c).alias(f"_ref_{c}") for c in _OF_REFUND])
    return lines.join(ref, ["order_id", "sku_id"])


def _refund_columns(rows: DataFrame) -> DataFrame:
    names = {"id": "order_refund_id", "create_time": "order_refund_create_time"}
    return rows.drop("user_id").withColumnsRenamed({f"_ref_{c}": names.get(c, c) for c in _OF_REFUND}).select(*schemas.REFUND_WIDE)


def refund_wide(refund: DataFrame, wide: DataFrame) -> DataFrame:
    """Refunds with the order line they refund, matched on order and sku (inner)."""
    return _refund_columns(_with_refunds(refund, wide))


def refund_order_wide(refund: DataFrame, detail: DataFrame, info: DataFrame, activity: DataFrame, coupon: DataFrame) -> DataFrame:
    """:func:`refund_wide` of the :func:`order_wide` of these inputs, with the refunds joined first.

    Order and sku are columns of the line, so both orders give the same rows. Lines without a refund
    take no part in the other joins, and the wide rows are not dealt once more by order and sku.
    """
    texts = _texts(detail, "order_id", "sku_id")
    refunded = unpacked(_with_refunds(refund, packed(detail, texts, "_line", _DIGITS)), texts, "_line", _DIGITS)
    return _refund_columns(order_wide(refunded, info, activity, coupon, keep=[f"_ref_{c}" for c in _OF_REFUND], by_line=True))
