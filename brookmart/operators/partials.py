"""Partial results that merge: sums, counts and first positions per window and key.

A partial result of some rows and one of others give, merged, the result of both. So an
aggregate can be stored piece by piece, by day, as rows arrive, and a report merges the
pieces of the days it reads instead of starting from raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.operators.windows import VISITOR_KEYS, first_ts, tumbling

WINDOW = ["stt", "edt"]
ORDER_KEYS = ["user_id", "province_id", "sku_id"]


def merged(partials: DataFrame, keys: Sequence[str], sums: Sequence[str], firsts: Sequence[str] = ("ts",)) -> DataFrame:
    """One row per window and key: ``sums`` added up, of ``firsts`` the smallest; ``dt`` stays if there is one."""
    day = [c for c in ("dt",) if c in partials.columns]
    kinds = dict(partials.dtypes)
    totals = [F.sum(c).cast(kinds[c]).alias(c) for c in sums] + [F.min(c).alias(c) for c in firsts]
    return partials.groupBy(*WINDOW, *keys, *day).agg(*totals)


def order_partials(measures: DataFrame, width: str = "10 seconds") -> DataFrame:
    """Partial form of the order aggregate; ``first`` is the earliest line with its sku columns."""
    first = F.min(F.struct("event_ts", "order_detail_id", "sku_name", "sku_price"))
    totals = {
        "order_sku_num": F.sum("sku_num"), "order_amount": F.sum("amount").cast("decimal(28,2)"),
        "order_ct": F.count(F.lit(1)), "ts": first_ts(), "first": first,
    }
    return tumbling(measures, ORDER_KEYS, totals, width)


def merged_orders(partials: DataFrame) -> DataFrame:
    """The order aggregate out of its partial results."""
    whole = merged(partials, ORDER_KEYS, ["order_sku_num", "order_amount", "order_ct"], ["ts", "first"])
    return whole.select("*", "first.sku_name", "first.sku_price").drop("first")


def merged_page_views(partials: DataFrame) -> DataFrame:
    return merged(partials, ["page_id", *VISITOR_KEYS], ["pv_ct", "sv_ct", "dur_sum"])


def merged_unique_visits(partials: DataFrame) -> DataFrame:
    return merged(partials, VISITOR_KEYS, ["uv_ct"])


def merged_bounces(partials: DataFrame) -> DataFrame:
    return merged(partials, VISITOR_KEYS, ["uj_ct"])
