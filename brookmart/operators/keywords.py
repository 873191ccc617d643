"""Search words from the page log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.functions.tokens import words
from brookmart.operators import windows

#: Phrases of a window above which its words are counted where they are made.
BUSY_WINDOW = 10_000
#: Parts in which windows are dealt, for each of the session's shuffle partitions: words take more room than phrases.
PARTS = 4


def search_rows(pages: DataFrame) -> DataFrame:
    """Pages reached from the search page that carry a search phrase."""
    return pages.filter((F.col("last_page_id") == "search") & F.col("item").isNotNull())


def split_words(df: DataFrame, text: str = "item") -> DataFrame:
    """One row per word of ``text``, which is dropped."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.explode(words(F.col(text))).alias("word"))


def phrase_stats(phrases: DataFrame, width: str = "10 seconds", busy: int = BUSY_WINDOW) -> DataFrame:
    """:func:`windows.keyword_stats` of the words of ``phrases`` (``event_ts``, ``item``).

    Few phrases share a window, so counting their words before the exchange saves little, and
    a word with its window takes many times the room it takes in the phrase. So whole phrases are
    dealt by window and cut there. A window of more than ``busy`` phrases would be a task of its
    own; its words, which repeat, are counted in tasks first. There is one such window in ``busy``
    phrases at most, so they are sent to all tasks. The number of parts is given, because adaptive
    execution would join parts by the size of the phrases.
    """
    parts = PARTS * int(phrases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = windows.in_windows(phrases, width)
    crowded = placed.groupBy(F.col("_win").alias("_crowded")).count().filter(F.col("count") > busy).select("_crowded")
    told = placed.join(F.broadcast(crowded), F.col("_win") == F.col("_crowded"), "left")
    quiet = told.filter(F.col("_crowded").isNull()).drop("_crowded").repartition(parts, "_win")
    rest = told.filter(F.col("_crowded").isNotNull()).drop("_crowded")
    counted = [windows.keyword_stats(split_words(part), width) for part in (quiet, rest)]
    return counted[0].unionByName(counted[1])
