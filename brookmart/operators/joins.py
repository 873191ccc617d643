"""Dimension lookups, keyed joins and interval joins."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.functions.scalars import seconds_of


def dim_lookup(
    fact: DataFrame, dim: DataFrame, key: Column, columns: Mapping[str, str | Column], how: str = "inner",
    dim_key: str = "ID",
) -> DataFrame:
    """Add dimension columns (``output name -> dimension column``) to fact rows.

    ``inner`` drops facts whose key is missing, ``left`` keeps them with nulls.
    No broadcast hint: a dimension below the size threshold is broadcast by the
    planner, a larger one is sort-merge joined with adaptive skew splitting.
    """
    picked = dim.select(
        F.col(dim_key).alias("_dim_key"),
        *[(F.col(src) if isinstance(src, str) else src).alias(f"_dim_{out}") for out, src in columns.items()],
    )
    joined = fact.join(picked, key.cast("string") == F.col("_dim_key"), how)
    kept = [c for c in fact.columns if c not in columns]
    return joined.select(*kept, *[F.col(f"_dim_{out}").alias(out) for out in columns])


def left_join_split(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Left outer equi-join that stays parallel when one key fills the right side.

    Adaptive execution splits both sides of an inner join but only the left side of an
    outer one. So the matches come from an inner join, and the rows without a match
    from an anti-join with the distinct right keys, one row per key and map task. Both
    read the same exchange of the left side.
    """
    matched = left.join(right, F.col(left_key) == F.col(right_key))
    keys = right.select(F.col(right_key).alias("_key")).distinct()
    alone = left.join(keys, F.col(left_key) == F.col("_key"), "left_anti")
    padded = alone.select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields])
    return matched.unionByName(padded)


def id_join(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner equi-join on one key; streams must use :func:`interval_join`, which bounds state."""
    if left.isStreaming and right.isStreaming:
        raise ValueError("an unbounded stream-stream join keeps all state; use interval_join")
    return left.join(right, key)


def interval_join(
    left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str,
    before: str = "5 seconds", after: str = "5 seconds", how: str = "inner",
) -> DataFrame:
    """Pairs of equal key with ``left - before <= right <= left + after``, both ends included.

    Time columns need distinct names. On tables the join key is (key, time
    bucket): a right row is copied to the one or two buckets it can meet, so a
    hot key is spread over its time range instead of being compared with itself
    as a whole. On streams the same condition bounds the join state.
    """
    lower, upper = seconds_of(before), seconds_of(after)
    in_range = F.expr(
        f"{right_ts} >= {left_ts} - interval {lower} seconds and {right_ts} <= {left_ts} + interval {upper} seconds"
    )
    right_key = f"_right_{key}"
    renamed = right.withColumnRenamed(key, right_key)
    same_key = F.col(key) == F.col(right_key)
    if left.isStreaming or right.isStreaming:
        return left.join(renamed, same_key & in_range, how).drop(right_key)
    if how not in ("inner", "left", "leftouter", "left_outer"):
        raise ValueError("interval_join supports inner and left")

    width = max(lower + upper, 1) * 1_000_000

    def bucket(ts: str, shift: int) -> Column:
        return F.floor((F.unix_micros(F.col(ts)) + F.lit(shift * 1_000_000)) / F.lit(width)).cast("bigint")

    lhs = left.withColumn("_bucket", bucket(left_ts, 0))
    rhs = renamed.withColumn(
        "_right_bucket", F.explode(F.sequence(bucket(right_ts, -upper), bucket(right_ts, lower)))
    )
    pairs = same_key & (F.col("_bucket") == F.col("_right_bucket")) & in_range
    return lhs.join(rhs, pairs, how).drop(right_key, "_bucket", "_right_bucket")
