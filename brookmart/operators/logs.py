"""Application log: parse, repair the new-visitor flag, split into detail streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.functions import jsontext
from brookmart.operators.changelog import is_json_object, members, parsed
from brookmart.schemas import LOG_TYPE


def parse_records(df: DataFrame, value: str = "value") -> DataFrame:
    """All records, with the listed members of the log as columns; ``dirty`` marks what is not a JSON object.

    ``record`` is the text as received and ``common_all`` the whole of ``common``:
    messages made from a record carry every member, listed or not.
    """
    keep = [c for c in df.columns if c != value]
    rows = parsed(df.withColumn("record", F.col(value)), value)
    whole = F.try_variant_get("_json", "$.common", "variant").alias("common_all")
    return rows.select(*keep, *members("_json", LOG_TYPE), whole, "record", F.col("_json").isNull().alias("dirty"))


def parse_log(df: DataFrame, value: str = "value") -> DataFrame:
    """The well-formed records of :func:`parse_records`."""
    return parse_records(df, value).filter(~F.col("dirty")).drop("dirty")


def dirty_log(df: DataFrame, value: str = "value") -> DataFrame:
    """Records :func:`parse_log` leaves out, as received."""
    return df.filter(~is_json_object(F.col(value)))


def repair_new_flag(
    df: DataFrame, mid: str = "mid", is_new: str = "is_new", order: tuple[str, ...] = ("ts", "id")
) -> DataFrame:
    """Set ``is_new`` to ``'0'`` on every row of a device but its first.

    The first position per device is a map-side combined aggregate; joining it
    back lets the adaptive planner broadcast it or split a hot device, which a
    window over the whole device history could not.
    """
    position = F.struct(*order)
    first = df.groupBy(F.col(mid).alias("_mid")).agg(F.min(position).alias("_first"))
    seen_before = (F.col(is_new) == "1") & (position > F.col("_first"))
    return (
        df.join(first, F.col(mid) == F.col("_mid"), "left")
        .withColumn(is_new, F.when(seen_before, F.lit("0")).otherwise(F.col(is_new)))
        .drop("_mid", "_first")
    )


def repair_log(log: DataFrame, order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """:func:`repair_new_flag` on parsed records, where the flag sits in ``common``."""
    columns = log.columns
    lifted = log.withColumn("_dev", F.col("common.mid")).withColumn("_new", F.col("common.is_new"))
    fixed = repair_new_flag(lifted, "_dev", "_new", order)
    return with_new_flag(fixed, F.col("_new")).select(*columns)


def with_new_flag(log: DataFrame, is_new: Column) -> DataFrame:
    """Put the repaired flag into ``common`` and, where it differs, into the text of the record.

    Records whose flag stands are forwarded as received; in the others one digit is
    changed, and every other letter stays. Only where the place of the flag is not plain (names
    with escapes or repeated, very deep nesting) is the record written anew from its values.
    """
    changed = ~is_new.eqNullSafe(F.col("common.is_new"))
    record = F.col("record")
    # A column of its own, so that the pattern runs once.
    log = log.withColumn("_spliced", F.when(changed & (is_new == "0"), jsontext.with_inner_member(record, "common", "is_new", "0", "1")))
    spliced = F.col("_spliced")
    plain = (is_new == "0") & (spliced != record) & ~jsontext.repeated(record, "common") & ~jsontext.repeated(record, "is_new")
    anew = _with_entries(F.parse_json("record"), ("common",), {"common": F.parse_json(
        _with_entries(F.col("common_all"), ("is_new",), {"is_new": _as_variant(is_new)}))})
    log = log.withColumn("record", F.when(changed, F.when(plain, spliced).otherwise(anew)).otherwise(record)).drop("_spliced")
    return log.withColumn("common", F.col("common").withField("is_new", is_new))


def _present(member: str) -> Column:
    return F.col(member).isNotNull() & ~F.is_variant_null(F.col(member))


def is_error() -> Column:
    return _present("err")


def is_start() -> Column:
    return _present("start")


def error_rows(log: DataFrame) -> DataFrame:
    return log.filter(is_error())


def start_rows(log: DataFrame, exclusive: bool = False) -> DataFrame:
    """Start records; with ``exclusive`` those carrying an error are left to the error stream."""
    rule = is_start() & ~is_error() if exclusive else is_start()
    return log.filter(rule)


def page_rows(log: DataFrame, exclusive: bool = False) -> DataFrame:
    """Everything that is not a start record (nor, with ``exclusive``, an error)."""
    rule = ~is_start() & ~is_error() if exclusive else ~is_start()
    return log.filter(rule)


def tag_exclusive(log: DataFrame) -> DataFrame:
    """One label per record: error wins over start, start over page."""
    label = F.when(is_error(), "error").when(is_start(), "start").otherwise("page")
    return log.withColumn("stream", label)


def _with_entries(item: Column, names: tuple[str, ...], entries: dict[str, Column]) -> Column:
    """JSON text of an item with ``entries`` set, replacing members of the same name."""
    members = F.try_variant_get(item, "$", "map<string,variant>")
    own = F.map_filter(members, lambda key, _: ~key.isin(*names))
    # A null entry is left out, like a null member of any serialised record.
    added = F.map_filter(
        F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), v)]),
        lambda _, v: v.isNotNull(),
    )
    return F.to_json(F.map_concat(own, added))


def _as_variant(value: Column) -> Column:
    return value.cast("variant")


def _item_texts(name: str, texts: Column) -> Column:
    """Texts of the items of an array member as received; empty where they are not found for certain.

    The parsed array tells how many there are.
    """
    return F.when((F.size(texts) == F.size(name)) & ~jsontext.repeated(F.col("record"), name), texts).otherwise(F.array().cast("array<string>"))


def _item_message(item: Column, text: Column, entries: dict[str, Column]) -> Column:
    """The item with ``entries`` (JSON texts) added, letter by letter as received where its text is at hand.

    Members of these names are replaced; then, and without a text, the parsed item is written.
    """
    names = tuple(entries)
    plain = text.startswith("{") & ~jsontext.holds(text, names)
    anew = _with_entries(item, names, {n: F.try_parse_json(v) for n, v in entries.items()})
    return F.when(plain, jsontext.with_members(text, entries)).otherwise(anew)


def _common_text(found: Column) -> Column:
    """The object ``common`` as received, with the repaired flag; ``found`` is what was cut out of the record, or null."""
    return F.coalesce(found, F.to_json(F.try_variant_get(F.try_parse_json("record"), "$.common", "variant")))


def _display_entries() -> dict[str, Column]:
    return {"ts": F.col("ts").cast("string"), "page_id": F.col("_page_id")}


def _action_entries() -> dict[str, Column]:
    return {"common": F.col("_common"), "page_id": F.col("_page_id")}


def _with_items(log: DataFrame, name: str, common_as_text: bool = True) -> DataFrame:
    """What the messages of a record's items refer to, made once per record.

    What a step uses more than once is a column of the step before: within one expression
    the patterns would run again for each use.
    """
    record, some, actions = F.col("record"), F.size(name) > 0, name == "actions"
    cut = {"_cut": F.when(some, jsontext.member_or_empty(record, name))}
    if actions:
        cut["_cut_common"] = F.when(some & ~jsontext.repeated(record, "common"), jsontext.member_or_empty(record, "common"))
    texts = {"_texts": jsontext.items(F.col("_cut"))}
    if actions:
        texts["_common"] = F.when(some, _common_text(F.when(F.col("_cut_common") != "", F.col("_cut_common"))))
    made = {f"_{name}": F.when(some, _item_texts(name, F.col("_texts"))), "_page_id": jsontext.quoted(F.col("page.page_id"))}
    if actions and common_as_text:
        made["_common"] = jsontext.quoted(F.col("_common"))
    return log.withColumns(cut).withColumns(texts).withColumns(made).drop("_cut", "_cut_common", "_texts")


def display_rows(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per displayed item of page records: item + ``ts`` + ``page_id``."""
    items = _with_items(pages.withColumn("_page", F.col("page.page_id")), "displays").select(
        *keep, "ts", "_page_id", "_page", "_displays", F.posexplode("displays").alias("_at", "_item"))
    value = _item_message(F.col("_item"), F.get("_displays", F.col("_at")), _display_entries())
    return items.select(*keep, "ts", F.col("_page").alias("page_id"), value.alias("value"))


def action_rows(
    pages: DataFrame, keep: tuple[str, ...] = (), common_as_text: bool = True
) -> DataFrame:
    """One row per action of page records: item + ``common`` + ``page_id``.

    ``common`` is embedded as JSON text, or as an object on request.
    """
    items = _with_items(pages.withColumn("_page", F.col("page.page_id")), "actions", common_as_text).select(
        *keep, "_common", "_page_id", "_page", "_actions", F.posexplode("actions").alias("_at", "_item"))
    value = _item_message(F.col("_item"), F.get("_actions", F.col("_at")), _action_entries())
    return items.select(*keep, F.col("_page").alias("page_id"), value.alias("value"))


# Detail topics of the log job.
TOPICS = {
    "page": "dwd_page_log",
    "error": "dwd_error_log",
    "display": "dwd_display_log",
    "action": "dwd_action_log",
    "start": "dwd_start_log",
}
DIRTY_TOPIC = "dirty_log"


def fan_out(log: DataFrame) -> DataFrame:
    """All five detail streams of repaired records as ``(id, topic, value)`` in one pass.

    A sink that takes a topic per row, or folders by topic, writes them without
    reading or caching the input five times. Rows of :func:`parse_records` marked ``dirty``
    go to :data:`DIRTY_TOPIC` as received, from the same parse.
    """
    dirty = F.col("dirty") if "dirty" in log.columns else F.lit(False)
    # Made once per record; the messages below only refer to the texts.
    texts = _with_items(_with_items(log.withColumns({"_is_start": is_start(), "_is_error": is_error(), "_dirty": dirty}), "displays"), "actions")
    nothing = F.array().cast("array<struct<topic:string,value:string>>")

    def message(topic: str | Column, value: Column) -> Column:
        return F.struct((F.lit(topic) if isinstance(topic, str) else topic).alias("topic"), value.alias("value"))

    def when_page(items: Column) -> Column:
        return F.coalesce(F.when(~F.col("_is_start"), items), nothing)

    def of_items(name: str, topic: str, entries: dict[str, Column]) -> Column:
        return F.transform(name, lambda item, i: message(topic, _item_message(item, F.get(f"_{name}", i), entries)))

    main_topic = F.when(F.col("_dirty"), DIRTY_TOPIC).when(F.col("_is_start"), TOPICS["start"]).otherwise(TOPICS["page"])
    messages = F.concat(
        F.array(message(main_topic, F.col("record"))),
        F.when(F.col("_is_error"), F.array(message(TOPICS["error"], F.col("record")))).otherwise(nothing),
        when_page(of_items("displays", TOPICS["display"], _display_entries())),
        when_page(of_items("actions", TOPICS["action"], _action_entries())),
    )
    return texts.select("id", F.explode(messages).alias("_m")).select("id", "_m.*")


def flat_pages(pages: DataFrame) -> DataFrame:
    """Page records as flat columns, the input of the visit and window operators."""
    rest = [c for c in ("id",) if c in pages.columns]
    return pages.select(
        *rest,
        "common.mid", "common.is_new", "common.vc", "common.ch", "common.ar",
        "page.page_id", "page.last_page_id", "page.item", "page.during_time",
        "ts", F.timestamp_millis("ts").alias("event_ts"),
    )
