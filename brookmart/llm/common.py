"""Helpers that several operators share: whitespace words, Arrow batches, shared folders."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmart.session import checkpoint_root

#: What separates words everywhere in this package, as a character class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same characters for ``translate``.
SPACES = " \t\n\x0b\x0c\r"

#: Text handled at once inside a task; batches are cut into slices of about this many bytes.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    The optimiser may copy an expression into a lambda and so evaluate it once per
    element; an argument of ``transform`` is a variable and is not copied.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/llm-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored in the shared folder and read back: cuts lineage and is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_buckets(spark: SparkSession, per_partition: int = 1) -> int:
    """Buckets for keys that are dealt by hand; follows the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * per_partition


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive slices of a string column with about ``limit`` bytes each, with their first row."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield first, column.slice(first, row - first)
            first, held = row, 0
        held += size
    if first < len(column):
        yield first, column.slice(first)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows of a batch, one at a time: rows may be large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]
