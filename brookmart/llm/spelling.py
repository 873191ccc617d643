"""Spelling variants: words one edit apart, grouped under their common form.

Letters are hashed to a few symbols. If two words differ by one edit, so do their reduced
words, or they are equal; so every word sends the full one-edit neighbourhood of its reduced
word (itself, deletions, replacements, insertions) to be joined with the reduced vocabulary,
and what meets is verified on the original words. A reduced alphabet of s symbols makes
about 2 * s keys a letter instead of twice the letters of all scripts. The alphabet grows with
the vocabulary, so that the words of a reduced word stay few. Keys that no reduced word has
are left out by a bit map before the shuffle; the join is exact on 64-bit hashes of reduced
words, and the verification on the words themselves.

A pair of words meets once from either side, since a word's keys are distinct and the other
word has one reduced word. Pairs are summed up per word as they come; no group of words is
gathered in one place. A word's ``form`` is its near word of largest count (ties: smallest in
code-point order) if that count is ``FORM_RATIO`` times its own or more; forms are followed to
the last by doubling the way in each round, and counts rise along it, so it ends.

Words are counted over all documents, in tasks first. The query's words are runs of letters
with one letter taken out of a fixed share of them, see :func:`noisy_counts`.

A null or empty text has no words. Repeated rows count each time. A null key gives runs the
prefix ``:``. An empty table gives an empty result. Only the key and text columns are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.llm.common import text_slices, written
from brookmart.llm.membership import bitmap, maybe_in
from brookmart.llm.wordhash import mix

MIN_LETTERS = 6
MIN_COUNT = 5
FORM_RATIO = 5
#: Of the hashes of runs, one in so many loses a letter.
NOISE = 199
#: Distinct words that a task adds up before it sends them on.
HELD_WORDS = 200_000
#: Least number of symbols of the reduced alphabet.
SYMBOLS = 8

#: Runs of at least six letters A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8.
_RUN = rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}"
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def noisy_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """``word`` and ``n`` of the words of at least ``min_letters`` letters that occur ``min_count`` times.

    A run is a longest row of letters, A-Z lower-cased. Where :data:`NOISE` divides the CRC-32
    h of ``<key>:<run>``, the run loses its letter number h modulo its length.
    """
    pattern = re.compile(_RUN % min_letters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for first, part in text_slices(batch.column(1)):
                for name, value in zip(batch.column(0).slice(first, len(part)).to_pylist(), part.cast(pa.large_binary()), strict=True):
                    start = zlib.crc32(f"{name or ''}:".encode())
                    for word, n in Counter(pattern.findall((value.as_py() or b"").lower())).items():
                        h = zlib.crc32(word, start)
                        if h % NOISE == 0:
                            letters = word.decode()
                            at = h % len(letters)
                            word = (letters[:at] + letters[at + 1:]).encode()
                            if len(letters) - 1 < min_letters:
                                continue
                        held[word] += n
                    if len(held) > HELD_WORDS:
                        yield flush()
        if held:
            yield flush()

    counted = docs.select(F.col(key).cast("string"), text).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def n_symbols(n_words: int) -> int:
    """Symbols with which reduced words of the shortest length are four times the words at least."""
    return max(SYMBOLS, int(np.ceil((4 * n_words) ** (1 / MIN_LETTERS))))


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """Symbols (1 to ``symbols``) of the letters of words of one length, a row each; equal letters have equal symbols."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1).astype(np.uint64)
    return np.uint64(1) + (letters * np.uint64(0x9E3779B1) >> np.uint64(7) & np.uint64(0xFFFFFF)) % np.uint64(symbols)


def _finished(h: np.ndarray, length: int) -> np.ndarray:
    return mix(h + np.uint64(length * 0xD6E8FEB86659FD93 & _MASK))


def reduced_hashes(code: np.ndarray) -> np.ndarray:
    """A hash of each row of symbols."""
    h = np.zeros(len(code), np.uint64)
    for c in code.T:
        h = h * np.uint64(_BASE) + c
    return _finished(h, code.shape[1])


def neighbourhood(code: np.ndarray, symbols: int) -> Iterator[np.ndarray]:
    """Hashes of all symbol rows at most one edit from each row of ``code``, as columns, some of them repeated.

    A row is its head before the edit, the edit and its tail, so each hash takes one step.
    """
    n, base = code.shape[1], np.uint64(_BASE)
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    power = np.ones(n + 1, np.uint64)  # weight of what that many letters follow
    np.multiply.accumulate(np.full(n, base), out=power[1:])
    tails = np.zeros((n + 1, len(code)), np.uint64)
    for i in range(n - 1, -1, -1):
        tails[i] = tails[i + 1] + code[:, i] * power[n - 1 - i]
    yield _finished(tails[0], n)[:, None]
    head = np.zeros(len(code), np.uint64)
    for i in range(n + 1):
        raised = head * base
        new = raised[:, None] + every
        yield _finished(new * power[n - i] + tails[i][:, None], n + 1)
        if i < n:
            yield _finished(new * power[n - 1 - i] + tails[i + 1][:, None], n)
            yield _finished(head * power[n - 1 - i] + tails[i + 1], n - 1)[:, None]
            head = raised + code[:, i]


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Words of one length together, with their rows."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        yield rows, [words[i] for i in rows.tolist()]


def reduced_vocabulary(words: DataFrame, symbols: int) -> DataFrame:
    """``words`` with ``code``, the hash of the reduced word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.uint64)
            for rows, some in _by_length(batch.column(0).to_pylist()):
                codes[rows] = reduced_hashes(reduced(some, symbols))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.view(np.int64))], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def _asked(words: DataFrame, symbols: int, present: np.ndarray) -> DataFrame:
    """``word``, ``n`` and one ``code`` per neighbour of the reduced word that may be in the vocabulary."""
    known = words.sparkSession.sparkContext.broadcast(present)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                part = batch.slice(first, 2000)
                found = []
                for rows, some in _by_length(part.column(0).to_pylist()):
                    for keys in neighbourhood(reduced(some, symbols), symbols):
                        keys = keys.view(np.int64)
                        row, column = np.nonzero(maybe_in(known.value, keys))
                        found.append(np.stack([rows[row], keys[row, column]]))
                # A word asks for a key once.
                row, keys = np.unique(np.concatenate(found, axis=1), axis=1)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column(0).take(row), part.column(1).take(row), pa.array(keys)], names=["word", "n", "code"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, code long")


def near_words(words: DataFrame) -> DataFrame:
    """Pairs one edit apart, from either side: ``word``, ``n``, ``near``, ``near_n``."""
    symbols = n_symbols(words.count())
    vocabulary = written(reduced_vocabulary(words, symbols), "reduced-words")
    asked = _asked(words, symbols, bitmap(vocabulary, "code"))
    met = asked.join(vocabulary.select("code", F.col("word").alias("near"), F.col("n").alias("near_n")), "code")
    # Lengths first: they cost nothing. The distance stops beyond one.
    close = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.levenshtein("word", "near", 1) == 1)
    return met.where(close).drop("code")


def _followed(links: DataFrame) -> DataFrame:
    """``word`` and ``root`` for ``word`` -> ``form`` links without circles; the way doubles each round."""
    ways = written(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        ways = moved.select("word", "root")
        if not moved.where("moved").head(1):
            return ways


def group_variants(words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``form``, ``root``, ``n_near`` and ``form_n`` of every row of ``words`` (``word``, ``n``)."""
    words = written(words, "words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    summed = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    taken = -F.col("best.minus") >= FORM_RATIO * F.col("n")
    told = written(words.join(summed, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
    ), "forms-told")
    roots = _followed(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """Variants of the documents' words."""
    return group_variants(noisy_counts(docs, key, text, min_letters, min_count))
