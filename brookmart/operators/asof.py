"""Point-in-time lookup: the version of a key that was in force at a row's time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmart.functions.scalars import seconds_of


def as_of(
    rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: str, version_at: str, version_order: str,
    bucket: str = "1 hour", name: str = "version",
) -> DataFrame:
    """``rows`` with the newest version of their keys that is no later than ``at``, as struct ``name``.

    Versions and rows share the columns ``keys``; of versions at the same ``version_at`` the
    one with the largest ``version_order`` counts. The struct holds the other columns of
    ``versions``; it is null where no version was in force yet, or without a time.

    Rows and versions are united by position and the last version is carried forward. A key
    is not sorted as a whole: its history is cut into time buckets, and each bucket with rows
    is lent the version that was in force when it began. That one comes from the last version
    per key and bucket, summed up before the exchange, so the only thing gathered per key is
    one row for each bucket. A key with a third of all rows is as many groups as it has buckets.
    """
    width = seconds_of(bucket)
    columns = rows.columns
    payload = [c for c in versions.columns if c not in keys]

    def bucket_of(ts: str) -> Column:
        return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(width)).cast("bigint")

    known = versions.filter(F.col(version_at).isNotNull()).select(
        *keys, bucket_of(version_at).alias("_bucket"), F.col(version_at).cast("timestamp").alias("_at"),
        F.col(version_order).alias("_order"), F.struct(*payload).alias("_version"),
    )
    marked = rows.select("*", bucket_of(at).alias("_bucket"))

    # The version with which each bucket begins.
    ends = known.groupBy(*keys, "_bucket").agg(F.max_by("_version", F.struct("_at", "_order")).alias("_version"))
    asked = marked.select(*keys, "_bucket").distinct()
    steps = asked.withColumn("_asks", F.lit(True)).unionByName(ends.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    # A bucket's own last version comes after the question of the bucket.
    earlier = Window.partitionBy(*keys).orderBy("_bucket", F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, -1)
    begun = steps.withColumn("_version", F.last("_version", ignorenulls=True).over(earlier)).filter(F.col("_asks") & F.col("_version").isNotNull())

    events = (
        marked.select(*keys, "_bucket", F.col(at).cast("timestamp").alias("_at"), F.lit(2).alias("_kind"), F.struct(*columns).alias("_row"))
        .unionByName(known.select(*keys, "_bucket", "_at", "_order", F.lit(1).alias("_kind"), "_version"), allowMissingColumns=True)
        .unionByName(begun.select(*keys, "_bucket", F.lit(0).alias("_kind"), "_version"), allowMissingColumns=True)
    )
    # What is lent has no time and comes first; a version counts for rows of its own instant.
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(F.col("_at").asc_nulls_first(), "_kind", "_order").rowsBetween(Window.unboundedPreceding, 0)
    carried = events.withColumn("_version", F.last("_version", ignorenulls=True).over(so_far)).filter(F.col("_kind") == 2)
    version = F.when(F.col("_row")[at].isNotNull(), F.col("_version"))
    return carried.select("_row.*", version.alias(name))
