"""Keyed state for the operators that built-in stream operators cannot express.

A device may send a third of all rows, so rows are reduced before they are dealt by key:
each task of a micro-batch keeps one row per device (or device and day, or device and time
bucket) for the state, as Arrow tables sorted at once. What a task can decide by itself never
meets the state of the device: it goes round it in lanes, or is left out. The state of a
device then sees at most a row per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from brookmart.functions.scalars import day_text, seconds_of
from brookmart.streaming.watermark import keep_watermark


#: Rows that a task holds, one per key, before it sends them on.
HELD_ROWS = 100_000


def _position(row: Row) -> tuple:
    """(ts, id) with nulls first, the order of tables."""
    ts, place = row["ts"], row["id"]
    return (ts is not None, ts or 0, place is not None, place or 0)


def _by_key(rows: pa.Table, keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    """Rows sorted by key and position, and whether each is the first of its key."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in (*keys, "ts", "id")], null_placement="at_start")
    rows = rows.take(order)
    first = np.zeros(rows.num_rows, bool)
    first[:1] = True
    for key in keys:
        codes = rows.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first[1:] |= codes[1:] != codes[:-1]
    return rows, first


def _split_firsts(
    df: DataFrame, keys: list[str], added: list[T.StructField],
    firsts: Callable[[pa.Table], pa.Table], rest: Callable[[pa.Table], pa.Table | None],
) -> DataFrame:
    """Tell the first row per key, of each task and micro-batch, from the others.

    ``firsts`` and ``rest`` give the output rows of either kind, with the ``added``
    columns; ``rest`` may give none. A task holds one row per key, and sends them
    on when there are many: a key can then have several first rows.
    """
    # Attributes keep their metadata, and with it the watermark.
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows, first = _by_key(pa.concat_tables([held, rows]) if held is not None else rows, keys)
            others = rest(rows.filter(pa.array(~first)))
            if others is not None:
                yield from others.to_batches()
            held = rows.filter(pa.array(first))
            if held.num_rows > HELD_ROWS:
                yield from firsts(held).to_batches()
                held = None
        if held is not None:
            yield from firsts(held).to_batches()

    return df.mapInArrow(run, schema)


class NewFlagRepair(StatefulProcessor):
    """Remembers for ever which devices were seen; rows in a lane pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[1]:
            yield from rows
            return
        known = self._seen.exists()
        first = None
        for row in rows:
            if known:
                yield self._old(row)
            elif first is None:
                first = row
            elif _position(row) < _position(first):
                yield self._old(first)
                first = row
            else:
                yield self._old(row)
        if first is not None:
            yield first
        if not known:
            self._seen.update((True,))

    @staticmethod
    def _old(row: Row) -> Row:
        if row["is_new"] != "1":
            return row
        values = row.asDict()
        values["is_new"] = "0"
        return Row(**values)

    def close(self) -> None:
        pass


class DailyFirst(StatefulProcessor):
    """First row per device and day; a day is forgotten once the watermark has left it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        day = T.StructType([T.StructField("day", T.StringType())])
        self._days = handle.getMapState("days", day, T.StructType([T.StructField("end_ms", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        earliest: dict[str, Row] = {}
        for row in rows:
            best = earliest.get(row["day"])
            if best is None or _position(row) < _position(best):
                earliest[row["day"]] = row
        for day, row in earliest.items():
            if not self._days.containsKey((day,)):
                self._days.updateValue((day,), (row["day_end_ms"],))
                self._handle.registerTimer(row["day_end_ms"])
                yield row

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        gone = [tuple(day) for day, end in self._days.iterator() if end[0] <= now]
        for day in gone:
            self._days.removeKey(day)
        return iter(())

    def close(self) -> None:
        pass


class Bounces(StatefulProcessor):
    """Entry pages of one device and time bucket that bounce.

    Pages wait in state until the watermark has passed the bucket and the pattern's
    length; then all its entries are decided at once and the state is gone. A state
    list holds the pages of one bucket and the first page of the next one, at most
    once per task and micro-batch.
    """

    def __init__(self, row_type: T.StructType, within_ms: int, bucket_ms: int):
        self._row_type = row_type
        self._within = within_ms
        self._bucket = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", self._row_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if not self._open.exists():
            self._handle.registerTimer((key[1] + 1) * self._bucket + self._within)
        self._open.appendList([tuple(row) for row in rows])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        names = self._row_type.names
        ts, last, lent, place = (names.index(n) for n in ("ts", "last_page_id", "_lent", "id"))
        waiting = sorted((tuple(r) for r in self._open.get()), key=lambda r: (r[lent], r[ts], r[place]))
        self._open.clear()
        for row, following in zip(waiting, [*waiting[1:], None], strict=True):
            if row[lent] or row[last] is not None:
                continue
            if following is None or following[ts] - row[ts] >= self._within:
                yield Row(*names, "outcome")(*row, "timeout")
            elif following[last] is None:
                yield Row(*names, "outcome")(*row, "matched")

    def close(self) -> None:
        pass


class FirstSince(StatefulProcessor):
    """First row of a key, and again after the key was idle for a time.

    A key is forgotten ``ttl_ms`` of event time after its last write, or after its
    last row with ``on_read``. A timer drops the state once the watermark is there;
    a row behind the expiry counts as new even if the timer has not run yet.
    """

    def __init__(self, ttl_ms: int, on_read: bool):
        self._ttl = ttl_ms
        self._on_read = on_read

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._ends = handle.getValueState("ends", T.StructType([T.StructField("ends", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ends = self._ends.get()[0] if self._ends.exists() else None
        before = ends
        for row in sorted(rows, key=_position):
            fresh = ends is None or row["ts"] >= ends
            if fresh:
                yield row
            if fresh or self._on_read:
                ends = max(ends or 0, row["ts"] + self._ttl)
        if ends != before:
            self._ends.update((ends,))
            self._handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # Timers of earlier ends find a later one and leave the state alone.
        if self._ends.exists() and self._ends.get()[0] <= timerValues.getCurrentWatermarkInMs():
            self._ends.clear()
        return iter(())

    def close(self) -> None:
        pass


class CurrentRow(StatefulProcessor):
    """Newest change per key, starting from a snapshot; older changes are refused.

    The state holds the position (``seq``) of what is known of a key. A change at or
    before it, so every change that the snapshot already holds, gives no row.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._seq = handle.getValueState("seq", T.StructType([T.StructField("seq", T.LongType())]))

    def handleInitialState(self, key, initialState, timerValues) -> None:
        rows = [initialState] if isinstance(initialState, Row) else list(initialState)
        self._keep(max(r["seq"] for r in rows))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(rows, key=lambda r: r["seq"])
        if not self._seq.exists() or newest["seq"] > self._seq.get()[0]:
            self._keep(newest["seq"])
            yield newest

    def _keep(self, seq: int) -> None:
        if not self._seq.exists() or seq > self._seq.get()[0]:
            self._seq.update((seq,))

    def close(self) -> None:
        pass


def repair_new_flag_stream(df: DataFrame, lanes: int | None = None) -> DataFrame:
    """Streaming form of the new-visitor repair; needs ``mid, is_new, ts, id``.

    Rows that are not their task's first of a device cannot be its first at all: their
    flag is settled, and they pass the state in ``lanes`` instead of under their device.
    """
    lanes = lanes or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    added = [T.StructField("_device", T.StringType()), T.StructField("_lane", T.IntegerType())]

    def firsts(rows: pa.Table) -> pa.Table:
        zero = pa.array(np.zeros(rows.num_rows, np.int32))
        return rows.append_column("_device", rows.column("mid").cast(pa.string())).append_column("_lane", zero)

    def rest(rows: pa.Table) -> pa.Table:
        lane = pa.array((1 + np.arange(rows.num_rows) % lanes).astype(np.int32))
        return rows.append_column("_device", pa.nulls(rows.num_rows, pa.string())).append_column("_lane", lane)

    dealt = _split_firsts(df, ["mid"], added, firsts, rest)
    settled = F.when((F.col("_lane") > 0) & (F.col("is_new") == "1"), "0").otherwise(F.col("is_new"))
    dealt = dealt.withColumn("is_new", settled)
    return dealt.groupBy("_device", "_lane").transformWithState(
        statefulProcessor=NewFlagRepair(), outputStructType=dealt.schema, outputMode="append", timeMode="none"
    ).select(*df.columns)


def first_visit_stream(pages: DataFrame, event_ts: str = "event_ts") -> DataFrame:
    """First entry page per device and day, as soon as it arrives.

    ``pages`` carries a watermark on ``event_ts``, which the result keeps, so a
    window aggregate can follow in the same query. Of a device's entry pages of a
    day each task sends one.
    """
    columns = pages.columns
    end = F.unix_millis(F.date_trunc("day", event_ts)) + F.lit(86_400_000)
    entries = pages.filter(keep_watermark(F.col("last_page_id").isNull(), event_ts)).withColumns(
        {"day": day_text(F.col(event_ts)), "day_end_ms": end}
    )
    entries = _split_firsts(entries, ["mid", "day"], [], lambda rows: rows, lambda rows: None)
    schema = T.StructType([f for f in entries.schema.fields])
    return entries.groupBy("mid").transformWithState(
        statefulProcessor=DailyFirst(), outputStructType=schema, outputMode="append",
        timeMode="eventTime", eventTimeColumnName=event_ts,
    ).select(*columns)


def _bounces_of_windows(pages: DataFrame, span: int, width: int) -> DataFrame:
    """:func:`bounce_stream` by an aggregate: windows of a bucket and ``within`` more, one for each bucket."""
    window = F.window("event_ts", f"{width + span} milliseconds", f"{width} milliseconds")
    rest = [c for c in pages.columns if c not in ("ts", "id", "last_page_id")]
    own = F.unix_millis("_win.start") + width > F.col("ts")
    head = F.struct("ts", "id", "last_page_id")
    held = pages.withColumn("_win", window).groupBy("mid", "_win").agg(
        F.collect_list(F.when(own, F.struct("ts", "id", "last_page_id", *rest))).alias("_pages"),
        F.min(F.when(~own, head)).alias("_next"),
    )

    def decided(row: Column, i: Column) -> Column:
        following = F.get("_sorted", i + 1)
        inside = i + 1 < F.size("_sorted")
        gap = F.coalesce(following["ts"], F.col("_next.ts")) - row["ts"]
        next_last = F.when(inside, following["last_page_id"]).otherwise(F.col("_next.last_page_id"))
        outcome = F.when(row["last_page_id"].isNull(), F.when(gap.isNull() | (gap >= span), "timeout").when(next_last.isNull(), "matched"))
        return F.struct(row.alias("row"), outcome.alias("outcome"))

    told = held.select("_next", F.sort_array("_pages").alias("_sorted")).select(
        F.explode(F.filter(F.transform("_sorted", decided), lambda d: d["outcome"].isNotNull())).alias("_told"))
    return told.select(*[F.col(f"_told.row.{c}") for c in pages.columns], "_told.outcome")


def bounce_stream(pages: DataFrame, within: str = "10 seconds", bucket: str | None = None, built_in: bool = False) -> DataFrame:
    """Bounces of a page stream that carries a watermark.

    The history of a device is cut into buckets at least ``within`` long, as on tables; each
    task lends the first page of a bucket to the bucket before. A bounce is emitted when the
    watermark has left its bucket by ``within``. Aggregate it in a second query whose
    watermark delay covers bucket and ``within``.

    Every call for a key and its state goes from Python to the store and back. Where most buckets
    hold few pages, ``built_in`` keeps them in the state of an aggregate instead, which takes a late
    page as long as its bucket is open. Other columns must have an order.
    """
    span = seconds_of(within) * 1000
    width = max(seconds_of(bucket) * 1000 if bucket else span, span)
    if built_in:
        return _bounces_of_windows(pages, span, width)
    own = pages.withColumn("_bucket", F.floor(F.col("ts") / F.lit(width)).cast("bigint"))
    lent = T.StructField("_lent", T.IntegerType())

    def marked(rows: pa.Table, value: int) -> pa.Table:
        return rows.append_column("_lent", pa.array(np.full(rows.num_rows, value, np.int32)))

    def heads(rows: pa.Table) -> pa.Table:
        at = rows.schema.get_field_index("_bucket")
        before = rows.set_column(at, "_bucket", pc.subtract(rows.column("_bucket"), 1))
        return pa.concat_tables([marked(rows, 0), marked(before, 1)])

    dealt = _split_firsts(own, ["mid", "_bucket"], [lent], heads, lambda rows: marked(rows, 0))
    row_type = T.StructType([T.StructField(f.name, f.dataType, True) for f in dealt.schema.fields])
    out = T.StructType([*row_type.fields, T.StructField("outcome", T.StringType())])
    return dealt.groupBy("mid", "_bucket").transformWithState(
        statefulProcessor=Bounces(row_type, span, width), outputStructType=out,
        outputMode="append", timeMode="eventTime",
    ).drop("_bucket", "_lent")


def first_since_stream(df: DataFrame, keys: list[str], ttl: str, on_read: bool = True) -> DataFrame:
    """First row per key of a stream with a watermark; a key idle for ``ttl`` of event time starts anew.

    Needs ``ts`` (milliseconds) and ``id``. With ``on_read`` every row of a key keeps it alive,
    without it only those that are emitted.
    """
    return df.groupBy(*keys).transformWithState(
        statefulProcessor=FirstSince(seconds_of(ttl) * 1000, on_read), outputStructType=df.schema,
        outputMode="append", timeMode="eventTime",
    )


def current_state_stream(changes: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Changes of a stream that are news to a snapshot of the same table, newest per key and micro-batch.

    ``snapshot`` (a table with the keys and ``seq``, the position up to which it holds each
    key) seeds the state before the first change; changes up to that position are refused, so
    no row comes twice at the seam. Snapshot rows themselves are not emitted.
    """
    known = snapshot.groupBy(*keys).agg(F.max("seq").cast("bigint").alias("seq"))
    changes = changes.withColumn("seq", F.col("seq").cast("bigint"))
    return changes.groupBy(*keys).transformWithState(
        statefulProcessor=CurrentRow(), outputStructType=changes.schema, outputMode="append",
        timeMode="none", initialState=known.groupBy(*keys),
    )
