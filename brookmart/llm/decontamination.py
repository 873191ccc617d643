"""Benchmark decontamination by pigeonhole edit matching.

A test item of m letters may differ from a passage of a document by k = floor(m * error
rate) edits. Cut into k + 1 pieces, at least one piece must occur in such a passage
unchanged. So the pieces of all items are looked up exactly (one automaton), and only
around the hits the item is compared, by Myers' bit-parallel distance, with the text:
the item matches where its smallest distance to any substring is at most k.

Items and texts are compared in lower case with every run of white space as one space.

The items are a query set: they are dealt out in blocks of a bounded size, and each block
is held by every task that reads documents. The number of scans of the documents grows
with the items, not with the documents.

Null and empty texts match nothing; null and empty items are skipped. Items of fewer than
``min_letters`` letters are compared as they are (k may be 0). Equal items all match.
A repeated row gives its matches each time. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


ERROR_RATE = 0.08
#: Letters of items in a block (proven bound of what a task is sent).
BLOCK_LETTERS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(letters: int, rate: float) -> int:
    return int(letters * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length with their places; empty pieces are left out."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Pattern:
    """Myers' automaton of one item."""

    def __init__(self, item: str):
        self.m = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, letter in enumerate(item):
            self.masks[letter] |= 1 << i
        self.full, self.high = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str, k: int) -> tuple[int, int] | None:
        """Smallest distance of the item to a substring of ``text`` and where it first ends, if at most k."""
        masks, full, high = self.masks.get, self.full, self.high
        plus, minus, score, found = full, 0, self.m, None
        for end, letter in enumerate(text, 1):
            eq = masks(letter, 0)
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(xh | plus))
            down = plus & xh
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = (up << 1) & full
            down = (down << 1) & full
            plus = down | (full & ~(xv | up))
            minus = up & xv
            if score <= k and (found is None or score < found[0]):
                found = (score, end)
        return found


class Matcher:
    """Items of a block, their pieces in one automaton."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, text, k) in enumerate(self.items):
            for at, piece in pieces(text, k):
                places[piece].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.patterns: dict[int, Pattern] = {}

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normal form) of the best place of every item that matches."""
        if not text or not len(self.automaton):
            return []
        letters = normal(text)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, where) in self.automaton.iter(letters):
            begin = end - size + 1
            for n, at in where:
                _, item, k = self.items[n]
                spans[n].append((max(0, begin - at - k), begin - at + len(item) + k))
        out = []
        for n, found in spans.items():
            key, item, k = self.items[n]
            best: tuple[int, int] | None = None
            for low, high in joined(found):
                if n not in self.patterns:
                    self.patterns[n] = Pattern(item)
                got = self.patterns[n].best(letters[low:high], k)
                if got and (best is None or (got[0], low + got[1]) < best):
                    best = (got[0], low + got[1])
            if best:
                out.append((key, *best))
        return sorted(out)


def joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Overlapping spans as one."""
    low = high = None
    for a, b in sorted(set(spans)):
        if high is not None and a <= high:
            high = max(high, b)
        else:
            if high is not None:
                yield low, high
            low, high = a, b
    if high is not None:
        yield low, high


def item_blocks(items: DataFrame, item_key: str, text: str, letters: int = BLOCK_LETTERS) -> Iterator[list[tuple[int, str]]]:
    """The items in normal form, in blocks of at most ``letters`` letters (one item at least)."""
    rows = items.select(F.col(item_key).cast("long"), F.col(text)).where(F.col(text).isNotNull() & F.col(item_key).isNotNull())
    block, held = [], 0
    for key, value in rows.toLocalIterator():
        value = normal(value)
        if not value:
            continue
        if block and held + len(value) > letters:
            yield block
            block, held = [], 0
        block.append((key, value))
        held += len(value)
    if block:
        yield block


def matches(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
    item_key: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE,
) -> DataFrame:
    """``docs`` (all columns) with ``leaks``: array of (item_id, distance, end) in ascending order."""
    blocks = list(item_blocks(items, item_key, item_text))
    leak = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int64())]))

    def scanned(df: DataFrame, block: list[tuple[int, str]], name: str) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                at = batch.schema.names.index(text)
                found = [[dict(zip(("item_id", "distance", "end"), m, strict=True)) for m in matcher.matches(v.as_py())] for v in batch.column(at)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, name])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, leak)]))

    df = docs.drop("leaks")
    if not blocks:
        return df.withColumn("leaks", F.lit(None).cast(leak)).withColumn("leaks", F.coalesce("leaks", F.array().cast(leak)))
    names = [f"__leaks_{i}" for i in range(len(blocks))]
    for block, name in zip(blocks, names, strict=True):
        df = scanned(df, block, name)
    return df.withColumn("leaks", F.array_sort(reduce(lambda a, b: F.concat(a, b), [F.col(n) for n in names]))).drop(*names)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; columns unchanged."""
    return matches(docs, items, **options).where(F.size("leaks") == 0).select(*docs.columns)
