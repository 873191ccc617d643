"""Search-phrase tokeniser as a native expression, and as a SQL table function."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# A run of Han/kana/Hangul characters, or a run of other letters and digits.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
TOKEN_PATTERN = rf"[{CJK}]+|[\p{{L}}\p{{N}}&&[^{CJK}]]+"
PLAIN_PATTERN = r"[\p{L}\p{N}]+"
# All CJK characters lie above this code point; script tests are slow and skipped below it.
MAYBE_CJK = r"[\x{1100}-\x{10FFFF}]"


def words(text: Column) -> Column:
    """Array of words of a text: lower-cased letter/digit runs, CJK runs as bigrams."""
    def runs(pattern: str) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))

    def split_run(run: Column) -> Column:
        bigrams = F.transform(
            F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
        )
        return F.when(run.rlike(f"^[{CJK}]{{2,}}$"), bigrams).otherwise(F.array(run))

    with_cjk = F.flatten(F.transform(runs(TOKEN_PATTERN), split_run))
    return F.when(text.rlike(MAYBE_CJK), with_cjk).otherwise(runs(PLAIN_PATTERN))


def register_split_words(spark: SparkSession, name: str = "split_words") -> None:
    """Register ``name(text) -> (word)`` for ``LATERAL`` use in SQL, over the expressions of :func:`words`."""
    def literal(pattern: str) -> str:
        return "'" + pattern.replace("\\", "\\\\") + "'"

    def runs(pattern: str) -> str:
        return f"regexp_extract_all(lower(text), {literal(pattern)}, 0)"

    split_run = (
        f"run -> CASE WHEN run RLIKE {literal(f'^[{CJK}]{{2,}}$')} "
        "THEN transform(sequence(1, length(run) - 1), i -> substring(run, i, 2)) ELSE array(run) END"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE (word STRING) RETURN "
        f"SELECT explode(CASE WHEN text RLIKE {literal(MAYBE_CJK)} "
        f"THEN flatten(transform({runs(TOKEN_PATTERN)}, {split_run})) ELSE {runs(PLAIN_PATTERN)} END) AS word"
    )
