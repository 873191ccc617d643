"""Business change log: parsing, table extraction, state folding, CDC envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmart.operators.latest import latest_per_key
from brookmart.schemas import ODS_TYPE

# Markers that frame an initial load and carry no row.
BOOTSTRAP_MARKERS = ("bootstrap-start", "bootstrap-complete")


def parsed_object(value: Column) -> Column:
    """Text of one well-formed JSON object as a variant, null for anything else.

    Only text framed by braces reaches the parser, so scalars and arrays are out. The
    parser itself stops behind the first value; as the one element of an array, a
    second value or other trailing text is an error or a second element. Of members
    with the same name the last counts (a session setting).
    """
    bare = F.btrim(value, F.lit(" \t\r\n"))
    framed = F.when(bare.startswith("{") & bare.endswith("}"), F.concat(F.lit("["), value, F.lit("]")))
    listed = F.transform(F.array(F.try_parse_json(framed)), lambda v: F.when(
        F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))
    return F.element_at(listed, 1)


def is_json_object(value: Column) -> Column:
    return parsed_object(value).isNotNull()


def well_formed(df: DataFrame, value: str = "value", name: str = "_json") -> DataFrame:
    """Rows whose text is one JSON object, with ``value`` replaced by the parsed variant.

    The parse sits in a one-element array that is exploded: the test for null
    then stays above it, so a record is parsed once and not once more for the
    filter.
    """
    return parsed(df, value, name).filter(F.col(name).isNotNull())


def parsed(df: DataFrame, value: str = "value", name: str = "_json") -> DataFrame:
    """All rows, with ``value`` replaced by its variant, or by null where it is not one JSON object."""
    keep = [c for c in df.columns if c != value]
    return df.select(*keep, F.explode(F.array(parsed_object(F.col(value)))).alias(name))


def drop_tombstones(df: DataFrame, value: str = "value") -> DataFrame:
    """Drop null, empty and malformed messages of an upsert topic."""
    return df.filter(is_json_object(F.col(value)))


def parse_changes(df: DataFrame, value: str = "value") -> DataFrame:
    """Well-formed change rows with their fields as columns; other columns are kept."""
    keep = [c for c in df.columns if c != value]
    return well_formed(df, value).select(*keep, *members("_json", ODS_TYPE))


def members(variant: str, struct_type: str) -> list[Column]:
    """One column per member of a struct type; members nobody selects are not extracted."""
    fields = T._parse_datatype_string(struct_type).fields
    return [
        F.try_variant_get(variant, f"$.{field.name}", field.dataType.simpleString()).alias(field.name)
        for field in fields
    ]


def dirty_changes(df: DataFrame, value: str = "value") -> DataFrame:
    """The rows :func:`parse_changes` leaves out."""
    return df.filter(~is_json_object(F.col(value)))


def ods_table(
    ods: DataFrame, table: str, columns: Sequence[str], database: str, types: Sequence[str] = ("insert",)
) -> DataFrame:
    """Rows of one business table as plain columns.

    Store the change log partitioned by ``table`` and the filter prunes folders.
    """
    data = F.col("data")
    return ods.filter(
        (F.col("database") == database) & (F.col("table") == table) & F.col("type").isin(*types)
    ).select(*[data[c].alias(c) for c in columns])


def flatten_envelope(df: DataFrame) -> DataFrame:
    """CDC records ``(topic, op, before, after)`` to the flat envelope.

    ``topic`` is ``source.database.table``; absent row images become ``{}``.
    """
    parts = F.split("topic", r"\.")
    empty = F.create_map().cast("map<string,string>")
    return df.select(
        *[c for c in df.columns if c not in ("topic", "op", "before", "after")],
        F.try_element_at(parts, F.lit(2)).alias("database"),
        F.try_element_at(parts, F.lit(3)).alias("tableName"),
        F.coalesce("after", empty).alias("after"),
        F.coalesce("before", empty).alias("before"),
        F.col("op").alias("type"),
    )


def envelope_json(df: DataFrame) -> DataFrame:
    """The flat envelope as JSON text in ``value``."""
    fields = ["database", "tableName", "after", "before", "type"]
    rest = [c for c in df.columns if c not in fields]
    return df.select(*rest, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def current_state(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], op: str = "op", deletes: Sequence[str] = ("d", "delete")
) -> DataFrame:
    """Current rows of a table from its snapshot and change feed."""
    return latest_per_key(changes, keys, order).filter(~F.col(op).isin(*deletes))


def dim_upserts(routed: DataFrame) -> DataFrame:
    """Routed changes a dimension store accepts: no markers, no deletes."""
    return routed.filter(~F.col("type").isin(*BOOTSTRAP_MARKERS, "delete"))


def keyed_upserts(routed: DataFrame) -> DataFrame:
    """Accepted changes with their key in ``pk``, read from the column that the route names.

    Take it before columns are pruned: the key need not be one of the stored columns.
    Changes without a key are left out; see :func:`unkeyed_upserts`.
    """
    return _with_key(routed).filter(F.col("pk").isNotNull())


def unkeyed_upserts(routed: DataFrame) -> DataFrame:
    """Accepted changes whose key is null: they name no row and must not replace one another."""
    return _with_key(routed).filter(F.col("pk").isNull())


def _with_key(routed: DataFrame) -> DataFrame:
    named = F.col("sink_pk") if "sink_pk" in routed.columns else F.lit("id")
    return dim_upserts(routed).withColumn("pk", F.try_element_at("data", F.coalesce(F.nullif(named, F.lit("")), F.lit("id"))))


def dim_upsert_state(routed: DataFrame, order: Sequence[str]) -> DataFrame:
    """Dimension contents after all upserts, one row per (sink table, key)."""
    return latest_per_key(keyed_upserts(routed), ["sink_table", "pk"], order)
