"""Lines that many documents share, removed through keep bitmaps.

Every line gives a row (hash of its key, document, position). The rows are range-partitioned
by all three and sorted, so a line of any number of documents is cut across partitions, and a
task streams its partition: the first row of a document within a run of equal hashes counts
that document. A run inside a partition is decided on the spot, holding no more rows than the
first documents short of the limit; the runs at the two ends of a partition may go on next
door, so their documents are counted once more over all partitions (two hashes a partition).
Back to the documents go no texts but one bitmap each, compressed, with a bit for each line
up to the last dropped one (1 keeps); lines after it are kept, and without a bitmap all are.

A line's key is the line without ASCII white space at both ends and with A-Z lower-cased;
lines are what ``\\n`` separates. Keys are compared by 128-bit hashes. A key of fewer than
``min_letters`` code points is never dropped; one found in at least ``min_docs`` documents
loses all its lines.

A null or empty text is one empty line. Rows with the same key column and text are one
document however often they repeat, and each gets its result; equal key columns with other
texts (null keys as well) are documents of their own. An empty table gives an empty result.
Only the key and text columns are read; other columns cannot clash. A very long text is one
row of its task, as everywhere.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.llm.common import SPACES, text_slices, written

MIN_DOCS = 10
MIN_LETTERS = 1

_STRIP = SPACES.encode()
_ROW = ("h1", "h2", "d1", "d2", "at")


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``text`` and the 128-bit hash of both, ``d1`` and ``d2``."""
    k, t = F.col(key), F.col(text)
    return docs.select(k.alias("key"), t.alias("text"), F.xxhash64(k, t).alias("d1"), F.xxhash64(F.lit("again"), k, t).alias("d2"))


def line_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS) -> DataFrame:
    """``h1``, ``h2`` (hash of the key), ``d1``, ``d2`` (document) and ``at`` (position) of every line that may go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column(0)):
                digests, at, sizes = [], [], []
                for value in part.cast(pa.large_binary()):
                    before = len(at)
                    for i, line in enumerate((value.as_py() or b"").split(b"\n")):
                        line = line.strip(_STRIP).lower()
                        if len(line) >= min_letters and (len(line) >= 4 * min_letters or len(line.decode()) >= min_letters):
                            digests.append(hashlib.blake2b(line, digest_size=16).digest())
                            at.append(i)
                    sizes.append(len(at) - before)
                hashes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                d1, d2 = (np.repeat(batch.column(c).slice(first, len(part)).to_numpy(), sizes) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (hashes[:, 0], hashes[:, 1], d1, d2, np.array(at, np.int64))], names=_ROW)

    return _identified(docs, key, text).select("text", "d1", "d2").mapInArrow(run, ", ".join(f"{c} long" for c in _ROW))


def _streamed(min_docs: int):
    """Map over sorted partitions: the rows of runs with ``min_docs`` documents, and those of open runs.

    ``open`` rows belong to the first or last run of the partition. A last run that has enough
    documents already leaves a row with ``at`` = -1 for what goes on next door.
    """

    def changes(*columns: np.ndarray) -> np.ndarray:
        """True where a row differs from the one before; the first row does."""
        out = np.ones(len(columns[0]), bool)
        if len(out):
            out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None  # hash of the partition's first run
        last = None  # hash of the run at the end of what was read
        enough = False  # it has the documents, and its rows went on
        held = np.zeros((5, 0), np.int64)  # its rows, while it has not

        def out(rows: np.ndarray, is_open: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(is_open)], names=[*_ROW, "open"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in range(5)])], axis=1)
            if not rows.shape[1]:
                continue
            h1, h2, d1, d2, _ = rows
            starts = np.flatnonzero(changes(h1, h2))
            ids = np.cumsum(changes(h1, h2)) - 1
            docs = np.add.reduceat(changes(h1, h2, d1, d2).astype(np.int64), starts)
            ends = [*starts[1:].tolist(), rows.shape[1]]
            passed = docs >= min_docs
            if first is None:
                first = (h1[0], h2[0])
            if enough and last == (h1[0], h2[0]):
                passed[0] = True
            in_first = np.zeros(len(starts), bool)
            in_first[0] = first == (h1[0], h2[0])
            last = (h1[-1], h2[-1])
            waits = not passed[-1] and not in_first[-1]
            enough = bool(passed[-1])
            held = rows[:, starts[-1]:ends[-1]] if waits else held[:, :0]
            take = (passed | in_first)[ids]
            if take.any():
                yield out(rows[:, take], in_first[ids][take])
        if last is not None and last != first:
            if enough:
                yield out(np.array([[last[0]], [last[1]], [0], [0], [-1]], np.int64), np.ones(1, bool))
            else:
                yield out(held, np.ones(held.shape[1], bool))

    return run


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``lines`` whose hash ``min_docs`` documents have: ``d1``, ``d2``, ``at``."""
    # Stored first: the range partitioning samples its input.
    ranged = written(lines, "lines").repartitionByRange(*_ROW).sortWithinPartitions(*_ROW)
    runs = written(ranged.mapInArrow(_streamed(min_docs), ", ".join(f"{c} long" for c in _ROW) + ", open boolean"), "line-runs")
    at_ends = runs.where("open")
    documents = F.count_distinct(F.when(F.col("at") >= 0, F.struct("d1", "d2")))
    counted = at_ends.groupBy("h1", "h2").agg(documents.alias("n"), F.min("at").alias("least"))
    # At most two hashes for each partition.
    enough = F.broadcast(counted.where((F.col("n") >= min_docs) | (F.col("least") < 0)).select("h1", "h2"))
    closed = runs.where("not open")
    return closed.union(at_ends.where("at >= 0").join(enough, ["h1", "h2"], "left_semi").select(closed.columns)).select("d1", "d2", "at")


def pack_keep(dropped: np.ndarray) -> bytes:
    """Compressed keep bitmap with the sorted positions ``dropped`` cleared."""
    keep = np.ones((int(dropped[-1]) + 8) // 8 * 8 if len(dropped) else 0, np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 6)


def unpack_keep(bitmap: bytes | None, n: int) -> np.ndarray:
    """Whether each of ``n`` lines is kept."""
    keep = np.ones(n, bool)
    if bitmap:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[:n]
        keep[:len(bits)] = bits > 0
    return keep


def keep_bitmaps(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``d1``, ``d2`` (document), ``n_dropped`` and ``keep`` of every document that loses a line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [(len(x), pack_keep(np.asarray(x.values.to_numpy()))) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in maps], pa.int64()), pa.array([m for _, m in maps], pa.binary())],
                names=["d1", "d2", "n_dropped", "keep"],
            )

    dropped = shared_lines(line_rows(docs, key, text, min_letters), min_docs)
    listed = dropped.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("at")).alias("at"))
    return listed.mapInArrow(run, "d1 long, d2 long, n_dropped long, keep binary")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_letters: int = MIN_LETTERS) -> DataFrame:
    """Per document: ``key``, ``n_lines`` (before dropping), ``n_dropped`` and ``kept``, the text that is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in text_slices(batch.column(1)):
                lines, kept = [], []
                for value, bitmap in zip(part.cast(pa.large_binary()), batch.column(2).slice(first, len(part)), strict=True):
                    whole = value.as_py() or b""
                    lines.append(whole.count(b"\n") + 1)
                    if bitmap.is_valid:
                        keep = unpack_keep(bitmap.as_py(), lines[-1])
                        whole = b"\n".join([x for x, k in zip(whole.split(b"\n"), keep.tolist(), strict=True) if k])
                    kept.append(whole)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(lines, pa.int64()), batch.column(3).slice(first, len(part)), pa.array(kept, pa.binary()).cast(pa.string())],
                    names=["key", "n_lines", "n_dropped", "kept"],
                )

    maps = keep_bitmaps(docs, key, text, min_docs, min_letters)
    joined = _identified(docs, key, text).join(maps, ["d1", "d2"], "left")
    kind = docs.schema[key].dataType.simpleString()
    told = joined.select("key", "text", "keep", F.coalesce("n_dropped", F.lit(0).cast("long")))
    return told.mapInArrow(run, f"key {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("key", key)
