"""Snowflake enrichment of the order aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart import schemas
from brookmart.functions.scalars import age_years
from brookmart.operators.joins import dim_lookup


@dataclass(frozen=True)
class Dimensions:
    """Dimension tables: all-text columns in upper case, key ``ID``."""

    user: DataFrame
    province: DataFrame
    sku: DataFrame
    spu: DataFrame
    category3: DataFrame
    category2: DataFrame
    category1: DataFrame
    trademark: DataFrame


def flat_sku(dims: Dimensions, how: str = "inner") -> DataFrame:
    """Sku with its spu, trademark and three category levels on one row.

    The six product lookups hang off the sku, so they are joined once per sku
    instead of once per fact; facts then make three lookups instead of eight.
    """
    sku = dims.sku.select(
        "ID", "SKU_NAME",
        F.col("CATEGORY3_ID").cast("bigint").alias("category3_id"),
        F.col("SPU_ID").cast("bigint").alias("spu_id"),
        F.col("TM_ID").cast("bigint").alias("tm_id"),
    )
    sku = dim_lookup(sku, dims.spu, F.col("spu_id"), {"spu_name": "SPU_NAME"}, how)
    sku = dim_lookup(
        sku, dims.category3, F.col("category3_id"),
        {"category3_name": "NAME", "category2_id": F.col("CATEGORY2_ID").cast("bigint")}, how,
    )
    sku = dim_lookup(
        sku, dims.category2, F.col("category2_id"),
        {"category2_name": "NAME", "category1_id": F.col("CATEGORY1_ID").cast("bigint")}, how,
    )
    sku = dim_lookup(sku, dims.category1, F.col("category1_id"), {"category1_name": "NAME"}, how)
    return dim_lookup(sku, dims.trademark, F.col("tm_id"), {"tm_name": "TM_NAME"}, how)


def snowflake_enrich(stats: DataFrame, dims: Dimensions, as_of: Column, how: str = "inner") -> DataFrame:
    """Aggregated orders with user, province and product attributes, in sink order.

    Run it after the aggregation, on reduced rows. With ``inner`` a row whose
    chain of keys is broken anywhere is dropped.
    """
    age = age_years(F.to_date("BIRTHDAY"), as_of)
    rows = dim_lookup(stats, dims.user, F.col("user_id"), {"user_gender": "GENDER", "user_age": age}, how)
    product = ["spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name",
               "category2_id", "category2_name", "category1_id", "category1_name"]
    rows = dim_lookup(
        rows, flat_sku(dims, how), F.col("sku_id"), {"sku_name": "SKU_NAME", **{c: c for c in product}}, how
    )
    # Last: provinces are few, so their lookup deals nothing, and their texts need not travel to the skus.
    rows = dim_lookup(
        rows, dims.province, F.col("province_id"),
        {
            "province_name": "NAME", "province_area_code": "AREA_CODE",
            "province_iso_code": "ISO_CODE", "province_iso_3166_2": "ISO_3166_2",
        }, how,
    )
    return rows.select(*schemas.USER_PROVINCE_SKU)


#: Columns of the order aggregate that enrichment starts from; the others come from dimensions.
STATS = ["stt", "edt", "sku_id", "sku_price", "user_id", "province_id", "order_sku_num", "order_amount", "order_ct", "ts"]


def enrich_or_wait(stats: DataFrame, dims: Dimensions, as_of: Column) -> DataFrame:
    """:func:`snowflake_enrich` without loss: rows with a broken chain of keys stay, marked ``waits``.

    A product counts as known once its whole chain is. Waiting rows carry the columns of
    :data:`STATS`, so they can be handed in again.
    """
    known = F.lit(True)
    age = age_years(F.to_date("BIRTHDAY"), as_of)
    rows = dim_lookup(stats, dims.user, F.col("user_id"), {"user_gender": "GENDER", "user_age": age, "_user": known}, "left")
    product = ["spu_id", "spu_name", "tm_id", "tm_name", "category3_id", "category3_name",
               "category2_id", "category2_name", "category1_id", "category1_name"]
    rows = dim_lookup(
        rows, flat_sku(dims), F.col("sku_id"), {"sku_name": "SKU_NAME", **{c: c for c in product}, "_sku": known}, "left"
    )
    rows = dim_lookup(
        rows, dims.province, F.col("province_id"),
        {
            "province_name": "NAME", "province_area_code": "AREA_CODE", "province_iso_code": "ISO_CODE",
            "province_iso_3166_2": "ISO_3166_2", "_province": known,
        }, "left",
    )
    waits = F.col("_user").isNull() | F.col("_province").isNull() | F.col("_sku").isNull()
    return rows.select(*schemas.USER_PROVINCE_SKU, waits.alias("waits"))
