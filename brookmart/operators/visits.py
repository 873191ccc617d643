"""First daily visits and bounces from the page log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brookmart.functions.scalars import day_text, seconds_of
from brookmart.operators.latest import first_per_key


def first_visit_per_day(pages: DataFrame) -> DataFrame:
    """First entry page (no previous page) of every device on every day."""
    entries = pages.filter(F.col("last_page_id").isNull()).withColumn("_day", day_text(F.col("event_ts")))
    return first_per_key(entries, ["mid", "_day"], ["event_ts", "id"]).drop("_day")


def bounce_outcomes(pages: DataFrame, within: str = "10 seconds", bucket: str = "10 minutes") -> DataFrame:
    """Bounced entry pages with ``outcome`` ``matched`` or ``timeout``.

    An entry page bounces when the device's next page is another entry page less
    than ``within`` later (matched), or when no page follows within that span
    (timeout).

    A device is not sorted as a whole. Its history is cut into buckets at least
    ``within`` long, and the first page of a bucket is lent to the bucket before
    it: a later page is too far away to matter. A device with a third of all
    rows is therefore spread over as many groups as it has buckets.
    """
    span = seconds_of(within)
    width = max(seconds_of(bucket), span)
    rows = pages.withColumns({
        "_bucket": F.floor(F.unix_seconds("event_ts") / F.lit(width)).cast("bigint"),
        "_lent": F.lit(0),
    })
    heads = (
        rows.groupBy("mid", "_bucket")
        .agg(F.min(F.struct("event_ts", "id", "last_page_id")).alias("_head"))
        .select("mid", (F.col("_bucket") - 1).alias("_bucket"), "_head.*", F.lit(1).alias("_lent"))
    )
    order = Window.partitionBy("mid", "_bucket").orderBy("_lent", "event_ts", "id")
    followed = rows.unionByName(heads, allowMissingColumns=True).withColumns({
        "_next_ts": F.lead("event_ts").over(order),
        "_next_last": F.lead("last_page_id").over(order),
    })
    gap = F.unix_micros("_next_ts") - F.unix_micros("event_ts")
    outcome = (
        F.when(F.col("_next_ts").isNull() | (gap >= span * 1_000_000), "timeout")
        .when(F.col("_next_last").isNull(), "matched")
    )
    return (
        followed.filter((F.col("_lent") == 0) & F.col("last_page_id").isNull())
        .withColumn("outcome", outcome)
        .filter(F.col("outcome").isNotNull())
        .drop("_bucket", "_lent", "_next_ts", "_next_last")
    )


def bounce_matched(pages: DataFrame, within: str = "10 seconds", bucket: str = "10 minutes") -> DataFrame:
    return bounce_outcomes(pages, within, bucket).filter(F.col("outcome") == "matched")


def bounce_timeout(pages: DataFrame, within: str = "10 seconds", bucket: str = "10 minutes") -> DataFrame:
    return bounce_outcomes(pages, within, bucket).filter(F.col("outcome") == "timeout")


def bounce_union(matched: DataFrame, timeout: DataFrame) -> DataFrame:
    """Both kinds of bounce in one relation, duplicates kept.

    Callers that do not need the parts apart take :func:`bounce_outcomes`, which
    is the same rows from one pass.
    """
    return matched.unionByName(timeout)
