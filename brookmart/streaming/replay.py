"""Run a stream over stored tables to its end and hand the result back as a table."""

from __future__ import annotations

import uuid

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmart.session import ROCKSDB, checkpoint_root
from brookmart.streaming.sinks import VersionTable


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, on the storage shared by all executors."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """``rows`` stored at ``path``, a new folder, and read back, for rows that are dear to make and read several times."""
    rows.write.partitionBy(*partition_by).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stored table, a file or a folder, as a stream of its files.

    A file source takes a lone file only by pattern, hence the one-letter class.
    """
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def end_of_feed(stream: DataFrame, folder: str, **values) -> DataFrame:
    """The stream with one more row, whose event time closes everything before it.

    The row travels as a second file stream; columns not named are null.
    """
    spark = stream.sparkSession
    row = spark.range(1).select(*[
        F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in stream.schema.fields
    ])
    row.write.parquet(f"{folder}/end")
    return stream.unionByName(spark.readStream.schema(row.schema).parquet(f"{folder}/end"))


def append_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """Final rows of an append-mode stream, through the exactly-once file sink."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def update_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Latest value per key of an update-mode stream, kept in a table of versions."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    table = VersionTable(f"{folder}/table", keys, ["_batch"])

    def write(batch: DataFrame, batch_id: int) -> None:
        table(batch.withColumn("_batch", F.lit(batch_id)), batch_id)

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return table.read(spark).drop("_batch")


def time_parts(rows: DataFrame, by: str, parts: int) -> Iterator[DataFrame]:
    """``rows`` cut into ``parts`` consecutive ranges of the number or time ``by``; nulls are in the first."""
    place = F.unix_micros(by) if dict(rows.dtypes)[by] == "timestamp" else F.col(by)
    cuts = rows.select(place.cast("double").alias("place")).approxQuantile("place", [i / parts for i in range(1, parts)], 0.01)
    inner = [None, *cuts, None]
    for low, high in zip(inner, inner[1:], strict=False):
        above = F.lit(True) if low is None else place > low
        below = F.lit(True) if high is None else place <= high
        yield rows.filter((place.isNull() if low is None else F.lit(False)) | (above & below))


def in_parts(
    rows: DataFrame, by: str, folder: str, run: Callable[[DataFrame, int], DataFrame | None], parts: int = 3
) -> DataFrame | None:
    """Feed a table to a stream in ``parts`` time-ordered deliveries.

    After each delivery ``run(stream, number)`` takes the query on to the end of what is
    there. The query goes on from its checkpoint each time, so every delivery is a restart
    and at least one micro-batch of its own. Returns what the last run returned.
    """
    spark, feed, got = rows.sparkSession, f"{folder}/feed", None
    for number, part in enumerate(time_parts(rows, by, parts)):
        part.write.mode("append").parquet(feed)
        got = run(spark.readStream.schema(rows.schema).parquet(feed), number)
    return got


def batches_to_end(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    """Hand the micro-batches of a stream to ``write`` until its input is used up."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
