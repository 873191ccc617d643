"""Token ids as files of fixed-width bit-packed blocks.

A block holds whole documents. Every id takes the same number of bits, the least that the
vocabulary needs, so the id at place p of a block starts at bit p * width and numpy unpacks
any range of a block without reading the rest. Beside the packed bits a block stores the
documents' keys and where each begins, the place of its first id in the whole output
(``start``), and how many ids it has. Blocks are rows of Parquet files written by Spark, so
any store that Spark reaches will do, and column statistics of ``start`` and ``first_key``
lead a reader to the blocks it needs.

Files lie in folders ``part=0, 1, ...`` in ascending order of the key. The ranges of the
folders come from quantiles of the key column alone. Places run through all folders:
each folder's total is added up once, one number per folder.

Null texts are written as empty ones; a null key sorts first. Rows of the same key stay
together, in the order of their ids; repeated rows are written each time. Only the key and
text columns are read.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmart.llm.common import SLICE_BYTES, n_buckets, rows_of, text_slices
from brookmart.llm.wordhash import Memo, Words, laid_out

#: Ids in a block before a new one begins; a longer document has a block of its own.
BLOCK_IDS = 1 << 18

#: Widths whose packed form is an array of integers.
_WHOLE_BYTES = {8: "<u1", 16: "<u2", 32: "<u4"}

BLOCKS = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("first_key", T.LongType()),
    T.StructField("start", T.LongType()),  # within the folder; readers add the folder's own start
    T.StructField("n_ids", T.LongType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
    T.StructField("offsets", T.ArrayType(T.LongType())),
    T.StructField("packed", T.BinaryType()),
])


def width_of(vocabulary: int) -> int:
    """Bits that ids below ``vocabulary`` need, at least one."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits per id, the lowest first, without gaps."""
    if width in _WHOLE_BYTES:
        return ids.astype(_WHOLE_BYTES[width]).tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of eight ids ends on a byte
        bits = np.unpackbits(ids[at:at + (1 << 16)].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes())
    return b"".join(out)


def packed_rows(ids: np.ndarray, bounds: np.ndarray, width: int) -> list[bytes]:
    """Stretches of ``ids`` between ``bounds``, packed one by one."""
    pairs = zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
    if width in _WHOLE_BYTES:
        data, size = pack(ids, width), width // 8
        return [data[a * size:b * size] for a, b in pairs]
    return [pack(ids[a:b], width) for a, b in pairs]


def unpack(packed: bytes, width: int, first: int, n: int) -> np.ndarray:
    """The ids at places ``first`` to ``first + n``; reads only their bytes."""
    if width in _WHOLE_BYTES:
        return np.frombuffer(packed, _WHOLE_BYTES[width], n, first * width // 8).astype(np.uint32)
    out = np.zeros(n, np.uint32)
    data = np.frombuffer(packed, np.uint8)
    for done in range(0, n, 1 << 16):
        m = min(1 << 16, n - done)
        low = (first + done) * width
        bits = np.unpackbits(data[low // 8:(low + m * width + 7) // 8], bitorder="little")[low % 8:low % 8 + m * width]
        full = np.zeros((m, 32), np.uint8)
        full[:, :width] = bits.reshape(m, width)
        out[done:done + m] = np.packbits(full.ravel(), bitorder="little").view("<u4")
    return out


WORDS_AT_ONCE = 512
#: Words kept per worker; beyond it the store starts anew.
CACHE_WORDS = 1_000_000
#: Letters whose ids are kept beside those of whole words.
CACHE_LETTERS = 200_000
#: Letters A-Z and U+00C0 to U+00DE, each one character in both cases and in normal form; as words of a text, and in UTF-8.
LETTERS = [chr(c) for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7]
_LATIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,;:!?]?)").fullmatch
_LOWER = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def split_at(ids: np.ndarray, mark: np.ndarray) -> list[np.ndarray]:
    """The stretches between marked places."""
    at = np.flatnonzero(mark).tolist()
    return [ids[a + 1:b] for a, b in zip([-1, *at], [*at, len(ids)], strict=True)]


_encoders: dict[str, Memo] = {}


def word_encoder(path: str) -> Memo:
    """Ids of words by the tokenizers library.

    The vocabulary's normaliser and splitter drop white space and never join what it
    separates, so the ids of a text are those of its words in a row.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()

        # Text between added tokens is encoded by itself, so many words go through one call.
        between = next((t for _, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special and not (t.lstrip or t.rstrip or t.single_word)), None)
        mark = tokenizer.token_to_id(between.content) if between else None

        def ids_of(text: str) -> bytes:
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

        # Where the vocabulary cuts marks from letters and lowers letters, a word of letters with a
        # mark behind it has the ids of its lower-case letters and those of the mark.
        marks = {m.encode(): ids_of(m) for m in ".,;:!?"}
        parted = all(ids_of(a + m.decode()) == ids_of(a) + v for m, v in marks.items() for a in ("abc", "Stone", "Über", "cité"))
        lowered = all(ids_of(a) == ids_of(a.lower()) for a in ("ABC", "Stone", "rivER", *LETTERS))
        # Where it makes one piece of lower-case letters, they go past its normaliser and splitter.
        plain = Tokenizer(tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

        def plain_ids(texts: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(texts), WORDS_AT_ONCE):
                out += [array("I", e.ids).tobytes() for e in plain.encode_batch_fast(texts[i:i + WORDS_AT_ONCE], add_special_tokens=False)]
            return out

        probes = [x.lower() for a in LETTERS for x in (a, "e" + a, a + "n", "st" + a + "nes")]
        whole = plain_ids(probes) == [ids_of(x) for x in probes]
        letters: dict[bytes, bytes] = {}

        def values(words: list[bytes]) -> list[bytes]:
            ends = [b""] * len(words)
            if len(letters) > CACHE_LETTERS:
                letters.clear()
            for i, word in enumerate(words):
                if (match := _LATIN(word)) is None:
                    continue
                own, mark = match.groups()
                if mark and not parted:
                    continue
                words[i] = own if not lowered else own.lower() if own.isascii() else own.decode().lower().encode()
                ends[i] = marks[mark] if mark else b""
            new = [w for w in dict.fromkeys(words) if w not in letters]
            found = dict(zip(new, computed(new), strict=True))
            letters.update(found)
            return [letters[w] + end for w, end in zip(words, ends, strict=True)]

        def computed(words: list[bytes]) -> list[bytes]:
            easy = [whole and _LOWER(w) is not None for w in words]
            texts = [w.decode() for w in words]
            first = iter(plain_ids([t for t, e in zip(texts, easy, strict=True) if e]))
            rest = iter(in_full([t for t, e in zip(texts, easy, strict=True) if not e]))
            return [next(first if e else rest) for e in easy]

        def in_full(words: list[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(words), WORDS_AT_ONCE):
                texts = words[i:i + WORDS_AT_ONCE]
                if between and not any(between.content in t for t in texts):
                    ids = np.array(tokenizer.encode_batch_fast([between.content.join(texts)], add_special_tokens=False)[0].ids, "<u4")
                    out += [x.tobytes() for x in split_at(ids, ids == mark)]
                else:
                    out += [ids_of(t) for t in texts]
            return out

        _encoders[path] = Memo(values, CACHE_WORDS)
    return _encoders[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(docs: DataFrame, path: str, width: int, end_id: int | None, key: str, text: str) -> DataFrame:
    """``key``, number of ids and packed ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_encoder(path)
        for batch in batches:
            for first, part in text_slices(batch.column(1), 2 * SLICE_BYTES):
                words = Words(part)
                values, inverse = memo.of(words, words.hashes)
                ids, places = laid_out(values, inverse)
                bounds = places[words.offsets]
                if end_id is not None:
                    ids, bounds = np.insert(ids, bounds[1:], end_id), bounds + np.arange(len(bounds))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(packed_rows(ids, bounds, width), pa.binary())],
                    names=["key", "n", "packed"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "key long, n long, packed binary")


def _blocks(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start, keys, rows = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, keys, rows
            ids = np.concatenate(rows)
            offsets = np.cumsum([0, *map(len, rows)])
            row = {"block": block, "first_key": keys[0], "start": start, "n_ids": len(ids), "width": width, "keys": keys, "offsets": offsets.tolist(), "packed": pack(ids, width), "part": part}
            block, start, keys, rows = block + 1, start + len(ids), [], []
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("block", pa.int64()), ("first_key", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32()), ("keys", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("packed", pa.binary()), ("part", pa.int32())])
        held = 0
        for batch in batches:
            for x in rows_of(batch):
                if rows and (x["part"] != part or held + x["n"] > BLOCK_IDS):
                    yield flush()
                    held = 0
                if x["part"] != part:
                    part, block, start = x["part"], 0, 0
                keys.append(x["key"])
                rows.append(unpack(x["packed"], width, 0, x["n"]))
                held += x["n"]
        if rows:
            yield flush()

    return run


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` with the vocabulary file ``path`` and write them below ``folder``."""
    spark = docs.sparkSession
    width = width_of(vocabulary_size(path))
    parts = n_buckets(spark)
    cuts = docs.select(F.col(key).cast("long").alias("key")).approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    bounds = F.array(*[F.lit(int(c)) for c in sorted(set(cuts))]).cast("array<bigint>")
    # The number of cuts below the key; a null key is below all.
    part = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("key"))), F.lit(0))
    rows = encoded(docs, path, width, end_id, key, text).withColumn("part", F.when(F.col("key").isNull(), 0).otherwise(part).cast("int"))
    dealt = rows.repartition(parts, "part").sortWithinPartitions("part", F.col("key").asc_nulls_first(), "packed")
    blocks = dealt.mapInArrow(_blocks(width), T.StructType([*BLOCKS.fields, T.StructField("part", T.IntegerType())]))
    blocks.write.partitionBy("part").option("compression", "none").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of the files, with ``start`` counted through all folders."""
    blocks = spark.read.schema(T.StructType([*BLOCKS.fields, T.StructField("part", T.IntegerType())])).parquet(folder)
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per folder
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # One row per folder, and folders are as many as the writer's shuffle partitions.
    return blocks.join(F.broadcast(before), "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_documents(spark: SparkSession, folder: str, value: Callable[[np.ndarray], int], kind: pa.DataType, name: str) -> DataFrame:
    """One row per document: its key, ``start``, ``n_tokens`` and ``value`` of its ids, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in rows_of(batch):
                ends = x["offsets"]
                rows = [unpack(x["packed"], x["width"], a, b - a) for a, b in zip(ends, ends[1:])]  # noqa: B905
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x["keys"], pa.int64()), pa.array([x["start"] + e for e in ends[:-1]], pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([value(r) for r in rows], kind)],
                    names=["doc_id", "start", "n_tokens", name],
                )

    blocks = read_blocks(spark, folder).select("start", "width", "keys", "offsets", "packed")
    ddl = {pa.int64(): "long", pa.binary(): "binary"}[kind]
    return blocks.mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {ddl}")


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Per document the CRC-32 of its ids as little-endian unsigned 32-bit integers."""
    return read_documents(spark, folder, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32")
