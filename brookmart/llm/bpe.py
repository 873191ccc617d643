"""Byte-pair encoding and decoding with a contiguous rank array per short word.

A word of up to ``SHORT`` bytes keeps its parts, the boundaries between them (for each part
where the next and the one before begin) and, beside them, the rank of every adjacent pair.
The smallest rank is looked for by a scan, the leftmost of equal ones; its boundary is
deleted, and the two neighbouring ranks are looked up again. New words of a slice are rows of
one array, so each step scans, deletes and refreshes for all of them that still have a
pair. Longer words keep linked parts and a heap of ranks instead, so a run of letters of any
length takes n log n steps. Each task keeps the ids of words it has met.

Null and empty texts have no ids. Repeated rows are encoded as often as they occur.
Only the named columns are read; other columns are carried along, but a column that has
the name of a new column is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmart.llm.common import text_slices
from brookmart.llm.wordhash import Memo, Words, laid_out

#: Words, and pre-tokens of them, kept per worker; beyond it the store starts anew, so memory is bounded.
CACHE_WORDS = 500_000
CACHE_PIECES = 100_000
#: Bytes of a word up to which its ranks are scanned; texts of words that are kept are no longer.
SHORT = 64
#: New words that are rows of one array.
ROWS_AT_ONCE = 4096
#: Pre-token pattern of byte-level vocabularies (fixed value); white space by its Unicode property.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_NONE = 1 << 60


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankArrayBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], _byte_letters()
        self.byte_ids = [0] * 256
        for letter, byte in letters.items():
            self.byte_ids[byte] = vocab[letter]
        self.merges: dict[int, int] = {}  # pair of ids -> rank, and the merged id in the low 20 bits
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[vocab[a] << 20 | vocab[b]] = rank << 20 | vocab[a + b]
        # The same as sorted arrays, with a last key that nothing equals.
        pairs = sorted(self.merges)
        self.pair_keys = np.array([*pairs, _NONE], np.int64)
        self.pair_ranks = np.array([*(self.merges[k] for k in pairs), _NONE], np.int64)
        self.first_ids = np.array(self.byte_ids, np.int64)
        added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.flat_bytes = table_of(self.bytes_of)
        self.added = {token: np.array([i], "<i4").tobytes() for token, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.pieces = regex.compile(PATTERN).findall
        self.cache: dict[str, bytes] = {}
        self.memo = Memo(self._word_values, CACHE_WORDS)
        self.line_end = self._encode_pieces("\n")

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of pairs of ids, with the merged id below it."""
        asked = left << 20 | right
        at = np.searchsorted(self.pair_keys, asked)
        return np.where(self.pair_keys[at] == asked, self.pair_ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens, as little-endian 32-bit integers each."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        low = 0
        for high in (8, 16, 32, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for first in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[first:first + ROWS_AT_ONCE]
                for i, ids in zip(some.tolist(), self._encode_rows([words[i] for i in some.tolist()], sizes[some], high), strict=True):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = array("i", self.encode_long(words[i])).tobytes()
        return out

    def _encode_rows(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        n = len(words)
        letters = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(n, width)
        place = np.arange(width)
        parts = self.first_ids[letters]
        alive = place < sizes[:, None]
        ranks = np.full((n, width), _NONE, np.int64)  # of the pair around the boundary behind a part
        pair = place[:-1] < sizes[:, None] - 1
        ranks[:, :-1][pair] = self._ranks(parts[:, :-1][pair], parts[:, 1:][pair])
        after = np.tile(place + 1, (n, 1))  # where the next part begins
        before = np.tile(place - 1, (n, 1))
        rows = np.arange(n)
        while len(rows):
            scanned = ranks[rows]
            i = scanned.argmin(axis=1)
            best = scanned[np.arange(len(rows)), i]
            open_rows = best != _NONE
            rows, i, best = rows[open_rows], i[open_rows], best[open_rows]
            if not len(rows):
                break
            gone = after[rows, i]
            following = after[rows, gone]
            merged = best & 0xFFFFF
            parts[rows, i] = merged
            alive[rows, gone] = False
            ranks[rows, gone] = _NONE
            after[rows, i] = following
            inside = following < sizes[rows]
            ranks[rows, i] = _NONE
            r, p, f = rows[inside], i[inside], following[inside]
            before[r, f] = p
            ranks[r, p] = self._ranks(merged[inside], parts[r, f])
            head = i > 0
            r, p = rows[head], before[rows[head], i[head]]
            ranks[r, p] = self._ranks(parts[r, p], merged[head])
        ids = parts[alive].astype("<u4").tobytes()
        ends = (np.cumsum(alive.sum(axis=1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode_long(self, word: bytes) -> list[int]:
        """Ids of one pre-token of any length: linked parts, and a heap of (rank, place) with stale entries."""
        parts: list[int | None] = [self.byte_ids[b] for b in word]
        n, rank = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i, left, right = heapq.heappop(heap)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue  # one of the parts has changed since
            parts[i], parts[j] = best & 0xFFFFF, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            p = before[i]
            if p >= 0 and (r := rank(parts[p] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, p, parts[p], parts[i]))
        return [x for x in parts if x is not None]

    def _fill(self, pieces: list[str]) -> list[bytes]:
        """Ids of each pre-token; new ones are computed together and kept."""
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        new = [p for p in dict.fromkeys(pieces) if p not in cache]
        found = dict(zip(new, self.encode_words([p.encode() for p in new]), strict=True))
        got = [cache.get(p) or found[p] for p in pieces]
        cache.update((p, v) for p, v in found.items() if len(p) <= SHORT)
        return got

    def _encode_pieces(self, text: str) -> bytes:
        return b"".join(self._fill(self.pieces(text)))

    def _encode_added(self, text: str) -> bytes:
        """Ids of any text as little-endian 32-bit integers."""
        if self.split_added is None or not any(a in text for a in self.added):
            return self._encode_pieces(text)
        return b"".join(self.added.get(p) or self._encode_pieces(p) for p in self.split_added.split(text) if p)

    encode = _encode_added

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts in a row, and where each text's ids begin.

        A pre-token has white space at its start only. So where single spaces and line
        ends are the only white space, and stand between words, a text's ids are those of
        its words, each with the space or line end before it; these are computed once per
        distinct word. Other texts, and texts with the string of an added token, are
        encoded one by one.
        """
        words = Words(texts)
        starts, ends, offsets = words.starts, words.ends, words.offsets
        n = len(starts)
        lead = np.zeros(n, np.uint8)  # 0: first of the text, else the byte before the word
        inner = np.ones(n, bool)
        inner[offsets[:-1][offsets[:-1] < n]] = False
        lead[inner] = words.data[starts[inner] - 1]
        uneven = np.zeros(len(texts), bool)
        row = np.repeat(np.arange(len(texts)), np.diff(offsets))
        begins = words.text_begins
        tight = np.empty(n, bool)
        tight[1:] = starts[1:] == ends[:-1] + 1
        tight[:1] = False
        at_start = starts == begins[row]
        uneven[row[np.where(inner, ~tight | ((lead != 0x20) & (lead != 0x0A)), ~at_start)]] = True
        full = np.diff(offsets) > 0
        uneven[full] |= ends[offsets[1:][full] - 1] != begins[1:][full]
        uneven |= ~full & (np.diff(begins) > 0)
        keys = words.hashes ^ (lead.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        values, inverse = self.memo.of(words, keys, lead)
        uneven[row[(values.sizes < 0)[inverse]]] = True
        ids, places = laid_out(values, inverse)
        bounds = places[offsets]
        if not uneven.any():
            return ids, bounds
        out = [ids[bounds[i]:bounds[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(uneven).tolist():
            out[i] = np.frombuffer(self._encode_added(texts[i].as_py()), "<u4")
        return np.concatenate(out), np.concatenate([[0], np.cumsum([len(x) for x in out])])

    def _word_values(self, words: list[tuple[bytes, int]]) -> list[bytes | None]:
        """Ids of words with their leading space or line end; None where a text can't be cut there."""
        pieces: list[str] = []
        ends: list[int | None] = []
        for word, lead in words:
            # Letters only, or with one mark behind them: cut without the pattern.
            text, mark = word.decode(), ""
            space = " " if lead == 0x20 else ""
            if text[-1] in ".,;:!?":
                text, mark = text[:-1], text[-1]
            if text.isascii() and text.isalpha():
                pieces += [space + text, mark] if mark else [space + text]
            else:
                text += mark
                if text[0].isspace() or text[-1].isspace() or any(a in text for a in self.added):
                    ends.append(None)
                    continue
                pieces += self.pieces(space + text if lead in (0, 0x20, 0x0A) else chr(lead) + text)
            ends.append(len(pieces))
        ids, out, last = self._fill(pieces), [], 0
        for (_, lead), end in zip(words, ends, strict=True):
            if end is None:
                out.append(None)
                continue
            own = b"".join(ids[last:end])
            out.append(self.line_end + own if lead == 0x0A else own)
            last = end
        return out

    def decode_slice(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the decoded texts in a row, and where each begins; bytes that are no UTF-8 become the replacement character."""
        data, at = gathered(self.flat_bytes, ids, bounds)
        whole = data.tobytes()
        try:
            whole.decode()
            cut = at[1:-1][at[1:-1] < len(data)]
            clean = not ((data[cut] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            clean = False
        if clean:
            return data, at
        rows = [whole[a:b].decode("utf-8", "replace").encode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)])

    def decode(self, ids: list[int]) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids]).decode("utf-8", "replace")


def table_of(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings in a row, and where each begins."""
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


def gathered(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of the ids in a row, and where the rows of ids given by ``bounds`` begin in it."""
    flat, begins = table
    sizes = np.diff(begins)[ids]
    places = np.concatenate([[0], np.cumsum(sizes)])
    kind = np.int32 if max(places[-1], len(flat)) < 1 << 31 else np.int64
    at = np.repeat((begins[:-1][ids] - places[:-1]).astype(kind), sizes)
    at += np.arange(places[-1], dtype=kind)
    return flat[at], places[bounds]


_loaded: dict[str, RankArrayBpe] = {}


def model(path: str) -> RankArrayBpe:
    """The vocabulary of ``path``, loaded once per worker."""
    if path not in _loaded:
        _loaded[path] = RankArrayBpe(path)
    return _loaded[path]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _appended(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), column], names=[*(batch.schema.names[i] for i in keep), name])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: array of token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            at = batch.schema.names.index(text)
            for first, part in text_slices(batch.column(at)):
                found, bounds = bpe.encode_slice(part)
                column = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(found.astype(np.int32)))
                yield _appended(batch.slice(first, len(part)), ids, column)

    return docs.mapInArrow(run, _with(docs, ids, T.ArrayType(T.IntegerType())))


def decode(docs: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text``: what the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            at = batch.schema.names.index(ids)
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sizes = pa.compute.fill_null(pa.compute.list_value_length(part.column(at)), 0).to_numpy(zero_copy_only=False)
                own = part.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, places = bpe.decode_slice(own, np.concatenate([[0], np.cumsum(sizes)]))
                texts = pa.LargeStringArray.from_buffers(part.num_rows, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data.tobytes()))
                yield _appended(part, text, texts.cast(pa.string()))

    return docs.mapInArrow(run, _with(docs, text, T.StringType()))


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and SHA-256 of ids and decoded text, one row per document.

    The texts are encoded and decoded slice by slice in one pass, so ids do not leave the task.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sha(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
        view = memoryview(data)
        return pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        decimal = table_of([b"%d," % i for i in range(len(bpe.bytes_of))])
        for batch in batches:
            for first, part in text_slices(batch.column(1)):
                ids, bounds = bpe.encode_slice(part)
                ids, bounds = ids.astype(np.int64), np.asarray(bounds)
                listed, at = gathered(decimal, ids, bounds)
                listed_sha = sha(listed, at[:-1], np.maximum(at[1:] - 1, at[:-1]))  # without the last comma
                decoded, at = bpe.decode_slice(ids, bounds)
                text_sha = sha(decoded, at[:-1], at[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(np.diff(bounds).astype(np.int64)), listed_sha, text_sha],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    out = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(key, text).mapInArrow(run, out).withColumnRenamed("key", key)
