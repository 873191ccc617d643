"""Readers: topics as text, JSON tables, change feeds, dimensions, aggregate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brookmart.functions.scalars import lower_camel
from brookmart.schemas import ODS_TYPE


def topic_text(spark: SparkSession, source: str, fmt: str = "kafka", **options: str) -> DataFrame:
    """Unbounded topic as text in ``value``, from the latest offset.

    Beside the text come ``key``, ``topic``, ``partition``, ``offset`` and ``timestamp``,
    and from partition and offset ``id`` (unique in a topic) and ``seq`` (ascending within
    a partition), which the jobs ask for. ``kafka`` takes a topic name and the options of
    the connector. Any file format takes a directory of text records: columns of these
    names are used if the files have them, else a file is a partition and the row of a
    record (Parquet), or the hash of its text, stands for the offset.
    """
    if fmt == "kafka":
        reader = spark.readStream.format("kafka").option("subscribe", source)
        raw = reader.options(**{"startingOffsets": "latest", **options}).load()
        raw = raw.withColumns({"key": F.col("key").cast("string"), "value": F.col("value").cast("string")})
        return _placed(raw.select("key", "value", "topic", "partition", "offset", "timestamp"))
    schema = "key string, value string, partition int, offset bigint"
    stream = spark.readStream.format(fmt).schema("value string" if fmt == "text" else schema).options(**options).load(source)
    name = F.col("_metadata.file_name")
    own = {"key": F.lit(None).cast("string"), "partition": F.lit(None).cast("int"), "offset": F.lit(None).cast("bigint")}
    stream = stream.withColumns({n: c for n, c in own.items() if n not in stream.columns})
    # Only Parquet knows a record's row; elsewhere its hash tells records of a file apart.
    place = F.col("_metadata.row_index") if fmt == "parquet" else F.xxhash64("value")
    return _placed(stream.select(
        "key", "value", F.lit(source).alias("topic"), F.coalesce("partition", F.hash(name)).alias("partition"),
        F.coalesce("offset", place).alias("offset"), F.col("_metadata.file_modification_time").alias("timestamp")))


def _placed(records: DataFrame) -> DataFrame:
    return records.withColumns({"seq": F.col("offset"), "id": F.xxhash64("topic", "partition", "offset")})


def topic_text_or_empty(spark: SparkSession, source: str, fmt: str = "kafka", **options: str) -> DataFrame:
    """Upsert topic as text, tombstones as the empty text."""
    return topic_text(spark, source, fmt, **options).withColumn("value", F.coalesce("value", F.lit("")))


def json_table(text: DataFrame, schema: str, view: str | None = None) -> DataFrame:
    """JSON text in ``value`` as columns of ``schema`` (a struct type), optionally as a view.

    ``id`` and ``seq`` of the records are kept if there are any.
    """
    places = [c for c in ("id", "seq") if c in text.columns]
    rows = text.select(*places, F.from_json("value", schema).alias("_row")).select("_row.*", *places)
    if view:
        rows.createOrReplaceTempView(view)
    return rows


def ods_table_stream(spark: SparkSession, source: str, fmt: str = "kafka", **options: str) -> DataFrame:
    """The business change topic as a table."""
    return json_table(topic_text(spark, source, fmt, **options), ODS_TYPE)


def cdc_stream(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Snapshot rows and change rows of a table in one feed of envelope files."""
    schema = "topic string, op string, seq bigint, before map<string,string>, after map<string,string>"
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def dimension(spark: SparkSession, path: str | None = None, jdbc: dict[str, str] | None = None) -> DataFrame:
    """A whole dimension table, from files or over JDBC (split by the caller's partition options)."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.parquet(path)


def renamed_dimension(dim: DataFrame) -> DataFrame:
    """``UPPER_SNAKE`` columns as ``lowerCamel``."""
    return dim.toDF(*[lower_camel(c) for c in dim.columns])


def aggregate_table(spark: SparkSession, path: str) -> DataFrame:
    """An aggregate table written by the day-partitioned sink; ``dt`` prunes folders."""
    return spark.read.parquet(path).withColumn("dt", F.col("dt").cast("string"))
