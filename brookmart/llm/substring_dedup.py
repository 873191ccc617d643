"""Removal of word sequences that occur more than once, by repeated-phrase automata.

A window is ``SIZE`` consecutive words of one document. Every word covered by a window that
also starts anywhere else is removed; windows are judged on the input.

1. Every window has an anchor, the smallest hash of the 8-word phrases in it. Equal windows
   have equal anchors, and a document has few anchors. Anchors that occur once are out.
2. Only documents with a recurring anchor go on (a bit map of a fixed size, then a join).
   A task compares the windows it holds by 128-bit hashes: those that occur twice within
   it are confirmed at once, and only one copy of each window is sent on, in segments of
   adjacent windows. So a passage that very many documents share is sent once per task.
3. Segments are dealt into shards by anchor, if it has at most ``HOT_SEGMENTS`` of them.
   Anchors with more (a passage in very many documents, whose windows over its edges differ
   in each) are dealt window by window, by the hash of the window: windows are counted,
   partly before the shuffle, and those that occur once are left out. A shard confirms recurring passages among its
   segments, compiles them into one Aho-Corasick automaton and streams its segments
   through it to locate every occurrence. A shard's memory follows its segments, of which
   the number of shards (a multiple of the shuffle partitions) is the measure.
4. Located ranges are gathered per text and the other words are kept.

A null text has no words; texts shorter than a window are kept whole. Documents with equal
texts, repeated rows and equal ids are separate documents, so texts of at least ``SIZE``
words that occur twice lose all words. Only the key and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmart.llm.common import n_buckets, text_slices, written
from brookmart.llm.membership import bitmap, maybe_in
from brookmart.llm.wordhash import Words, windows

SIZE, PHRASE = 35, 8
SPAN = SIZE - PHRASE + 1
#: Text a task compares at once, and texts it remembers to skip copies.
CHUNK_BYTES, SEEN_TEXTS = 16 << 20, 1_000_000
SHARDS_PER_PARTITION = 16
#: Segments of an anchor beyond which its windows are dealt one by one.
HOT_SEGMENTS = 64


def _window_anchors(phrases: np.ndarray) -> np.ndarray:
    """Smallest of every ``SPAN`` consecutive phrase hashes."""
    low, width = phrases, 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:len(phrases) - SPAN + 1], low[SPAN - width:])


class Anchors:
    """Windows of a slice of texts: their ``anchor``, text (``owner``) and first word (``at``)."""

    def __init__(self, texts: pa.Array):
        self.words = words = Words(texts)
        n = len(words.hashes)
        owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))
        if n < SIZE:
            self.phrases = np.zeros(0, np.uint64)
            self.anchor, self.owner, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        self.phrases = windows(words.hashes, PHRASE, 3)
        inside = owner[:n - SIZE + 1] == owner[SIZE - 1:]
        self.anchor = _window_anchors(self.phrases)[inside]
        self.owner = owner[:n - SIZE + 1][inside]
        self.at = np.flatnonzero(inside)

    def runs(self) -> np.ndarray:
        """Places of windows whose anchor or text differs from the window before."""
        first = np.ones(len(self.anchor), bool)
        first[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])
        return np.flatnonzero(first)

    def near(self) -> np.ndarray:
        """Phrase hashes that occur twice within one window's length: these recur for sure."""
        p = self.phrases
        twice = [p[:-d][p[d:] == p[:-d]] for d in range(1, min(SIZE, len(p)))]
        return np.unique(np.concatenate(twice)) if twice else p[:0]


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("ka"), F.xxhash64(F.lit(1), body).alias("kb"))


def anchor_counts(keyed: DataFrame) -> DataFrame:
    """``anchor`` of those that occur more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                found = Anchors(part)
                anchor, n = np.unique(found.anchor[found.runs()], return_counts=True)
                n = n + np.isin(anchor, found.near())
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(n.astype(np.int64))], names=["anchor", "n"])

    counted = keyed.select("text").mapInArrow(run, "anchor long, n long")
    return counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def text_anchors(keyed: DataFrame) -> DataFrame:
    """``anchor`` and ``ka`` of every text's anchors, copies of a text mostly left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, part in text_slices(batch.column(0)):
                found = Anchors(part)
                ka = batch.column(1).slice(first, len(part)).to_numpy()
                if len(seen) > SEEN_TEXTS:
                    seen.clear()
                fresh = np.array([not (k in seen or seen.add(k)) for k in ka.tolist()], bool)
                at = found.runs()
                at = at[fresh[found.owner[at]]]
                yield pa.RecordBatch.from_arrays([pa.array(found.anchor[at].view(np.int64)), pa.array(ka[found.owner[at]])], names=["anchor", "ka"])

    return keyed.select("text", "ka").mapInArrow(run, "anchor long, ka long")


def marked(keyed: DataFrame, bits: np.ndarray) -> DataFrame:
    """``keyed`` with ``maybe``: whether ``ka`` passes the bit map."""
    sent = keyed.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka = batch.column(batch.schema.names.index("ka")).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(maybe_in(sent.value, ka))], names=[*batch.schema.names, "maybe"])

    return keyed.mapInArrow(run, "doc_id long, text string, ka long, kb long, maybe boolean")


_PIECES = "ka long, kb long, start long, stop long, anchor long, known boolean, segment string"


def _pieces_schema() -> pa.Schema:
    return pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("anchor", pa.int64()), ("known", pa.bool_()), ("segment", pa.string())])


def _chunk_pieces(texts: list[tuple[int, int, pa.Array, np.ndarray]]) -> Iterator[dict]:
    """Ranges confirmed within a chunk (``segment`` null), and segments to compare with others."""
    h1, h2, anchors, owners, places, words_of = [], [], [], [], [], []
    for i, (_, _, text, recurring) in enumerate(texts):
        found = Anchors(text)
        use = np.isin(found.anchor, recurring)
        h = found.words.hashes
        h1.append(windows(h, SIZE, 11)[found.at[use]])
        h2.append(windows(h, SIZE, 12)[found.at[use]])
        anchors.append(found.anchor[use])
        places.append(found.at[use].astype(np.int32))
        owners.append(np.full(len(places[-1]), i, np.int32))
        words_of.append(found.words.places())
    if not h1:
        return
    h1, h2, anchor, owner, at = map(np.concatenate, (h1, h2, anchors, owners, places))
    del anchors, owners, places
    if not len(h1):
        return
    order = np.lexsort((h2, h1)).astype(np.int32)  # equal windows stay in the order of texts and places
    head = np.ones(len(order), bool)
    head[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    del h1, h2
    # A window has an equal one if it is not the head of its group or the next one is not a head.
    twice = ~head
    twice[:-1] |= ~head[1:]
    known = np.zeros(len(order), bool)
    known[order] = twice
    sent = np.zeros(len(order), bool)
    sent[order[head]] = True  # one copy of each window
    del order, head, twice

    def runs(use: np.ndarray, *same: np.ndarray) -> Iterator[tuple[int, int]]:
        at_use = np.flatnonzero(use)
        if not len(at_use):
            return
        cut = (owner[at_use[1:]] != owner[at_use[:-1]]) | (at[at_use[1:]] != at[at_use[:-1]] + 1)
        for s in same:
            cut |= s[at_use[1:]] != s[at_use[:-1]]
        begins = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(at_use)]])
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            yield int(at_use[a]), int(at_use[b - 1])

    for a, b in runs(known):
        ka, kb = texts[owner[a]][:2]
        yield {"ka": ka, "kb": kb, "start": int(at[a]), "stop": int(at[b]) + SIZE, "anchor": None, "known": True, "segment": None}
    for a, b in runs(sent, anchor, known):
        ka, kb = texts[owner[a]][:2]
        data, begins, ends = words_of[owner[a]]
        stop = int(at[b]) + SIZE
        places = slice(int(at[a]), stop)
        text = b" ".join([bytes(data[x:y]) for x, y in zip(begins[places].tolist(), ends[places].tolist(), strict=True)]).decode()
        yield {"ka": ka, "kb": kb, "start": int(at[a]), "stop": stop, "anchor": int(anchor[a].view(np.int64)), "known": bool(known[a]), "segment": text}


def pieces(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """Confirmed ranges and segments of all texts with recurring anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
            some = []
            for row in rows:
                some.append(row)
                if len(some) == 4096:
                    yield pa.RecordBatch.from_pylist(some, _pieces_schema())
                    some = []
            if some:
                yield pa.RecordBatch.from_pylist(some, _pieces_schema())

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(2).slice(i, 1)
                held.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), text, np.array(batch.column(3)[i].as_py(), np.int64).view(np.uint64)))
                size += len(text[0].as_buffer())
                if size > CHUNK_BYTES:
                    yield from out(_chunk_pieces(held))
                    held, size = [], 0
        yield from out(_chunk_pieces(held))

    joined = keyed.where("maybe").select("ka", "kb", "text").join(hits, "ka")
    return joined.select("ka", "kb", "text", "anchors").mapInArrow(run, _PIECES)


def _segment_windows(segments: pa.Array) -> Iterator[tuple[int, Words, int, np.ndarray, np.ndarray]]:
    """Row, words, first word and both window hashes of each of the segments."""
    for first, part in text_slices(segments):
        words = Words(part)
        for k in range(len(part)):
            a, b = words.offsets[k], words.offsets[k + 1]
            yield first + k, words, int(a), windows(words.hashes[a:b], SIZE, 11), windows(words.hashes[a:b], SIZE, 12)


def hot_windows(segments: DataFrame, hot: np.ndarray) -> DataFrame:
    """``wa`` of the windows of hot anchors that were sent more than once."""
    sent = segments.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chosen = batch.column(1).filter(pa.array(maybe_in(sent.value, batch.column(0).to_numpy())))
            for a in range(0, len(chosen), 1024):
                pairs = [(h1, h2) for *_, h1, h2 in _segment_windows(chosen.slice(a, 1024))]
                h1, h2 = (np.concatenate(h).view(np.int64) for h in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2)], names=["wa", "wb"])

    each = segments.select("anchor", "segment").mapInArrow(run, "wa long, wb long")
    return each.groupBy("wa", "wb").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("wa")


def dealt(segments: DataFrame, hot: np.ndarray, recurring: np.ndarray, shards: int) -> DataFrame:
    """Segments with their ``shard``: by anchor, or hot anchors' recurring windows by window hash."""
    context = segments.sparkSession.sparkContext
    sent_hot, sent_recurring = context.broadcast(hot), context.broadcast(recurring)
    schema = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("start", pa.int64()), ("known", pa.bool_()), ("segment", pa.string()), ("shard", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor = batch.column(5).to_numpy()
            is_hot = maybe_in(sent_hot.value, anchor)
            cold = batch.filter(pa.array(~is_hot))
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(cold.columns[:5], schema, strict=False)), pa.array(anchor[~is_hot] % shards)], schema=schema)
            warm, out = batch.filter(pa.array(is_hot)), []
            for row, words, first, h1, _ in _segment_windows(warm.column(4)):
                wa = h1.view(np.int64)
                shard = wa % shards
                use = np.flatnonzero(maybe_in(sent_recurring.value, wa))
                if not len(use):
                    continue
                cuts = np.flatnonzero((use[1:] != use[:-1] + 1) | (shard[use[1:]] != shard[use[:-1]])) + 1
                ka, kb, start, known = (warm.column(i)[row].as_py() for i in range(4))
                for run_ in np.split(use, cuts):
                    a, b = int(run_[0]), int(run_[-1]) + SIZE
                    text = b" ".join(words.word(first + i) for i in range(a, b)).decode()
                    out.append({"ka": ka, "kb": kb, "start": start + a, "known": known, "segment": text, "shard": int(shard[a])})
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)

    return segments.select("ka", "kb", "start", "known", "segment", "anchor").mapInArrow(run, "ka long, kb long, start long, known boolean, segment string, shard long")


def located(table: pa.Table) -> pa.Table:
    """Ranges of a shard's segments that recurring passages cover."""
    rows = table.select(["ka", "kb", "start", "known", "segment"]).to_pylist()
    split = [r["segment"].split(" ") for r in rows]
    hashes = []
    for i in range(0, len(rows), 2048):
        part = pa.array([r["segment"] for r in rows[i:i + 2048]])
        words = Words(part)
        for k in range(len(part)):
            h = words.hashes[words.offsets[k]:words.offsets[k + 1]]
            hashes.append((windows(h, SIZE, 11), windows(h, SIZE, 12)))
    out = {"ka": [], "kb": [], "start": [], "stop": []}
    schema = pa.schema([(n, pa.int64()) for n in out])
    if not rows:
        return pa.table(out, schema)
    owner = np.repeat(np.arange(len(rows)), [len(a) for a, _ in hashes])
    h1, h2 = (np.concatenate(x) for x in zip(*hashes, strict=True))
    order = np.lexsort((h2, h1))
    head = np.ones(len(order), bool)
    head[1:] = (h1[order[1:]] != h1[order[:-1]]) | (h2[order[1:]] != h2[order[:-1]])
    group = np.cumsum(head) - 1
    confirmed = np.zeros(len(order), bool)
    known = np.array([r["known"] for r in rows], bool)
    confirmed[order] = (np.bincount(group) > 1)[group] | (np.bincount(group, known[owner][order]) > 0)[group]
    begins = np.searchsorted(owner, np.arange(len(rows) + 1))
    # Recurring passages: the longest runs of confirmed windows, between spaces.
    automaton = ahocorasick.Automaton()
    for i, words in enumerate(split):
        flags = np.concatenate([[False], confirmed[begins[i]:begins[i + 1]], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            passage = words[a:b - 1 + SIZE]
            automaton.add_word(" " + " ".join(passage) + " ", len(passage))
    if not len(automaton):
        return pa.table(out, schema)
    automaton.make_automaton()
    for r, words in zip(rows, split, strict=True):
        ends = {}
        at = 0
        for n, w in enumerate(words, 1):
            at += len(w) + 1
            ends[at] = n
        found = sorted((ends[e] - n, ends[e]) for e, n in automaton.iter(" " + r["segment"] + " "))
        low = high = None
        for a, b in [*found, (1 << 60, 1 << 60)]:
            if high is not None and a <= high:
                high = max(high, b)
                continue
            if high is not None:
                for name, value in zip(out, (r["ka"], r["kb"], r["start"] + low, r["start"] + high), strict=True):
                    out[name].append(value)
            low, high = a, b
    return pa.table(out, schema)


def ranges(keyed: DataFrame) -> DataFrame:
    """``ka``, ``kb`` and ``ranges`` (start and stop words) of the texts that lose words."""
    recurring = anchor_counts(keyed)
    hits = written(text_anchors(keyed).join(recurring, "anchor").groupBy("ka").agg(F.collect_set("anchor").alias("anchors")), "anchors")
    found = written(pieces(marked(keyed, bitmap(hits, "ka")), hits), "pieces")
    shards = n_buckets(keyed.sparkSession, SHARDS_PER_PARTITION)
    segments = found.where("segment is not null")
    hot = bitmap(segments.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_SEGMENTS), "anchor")
    recurring = bitmap(hot_windows(segments, hot), "wa")
    across = dealt(segments, hot, recurring, shards).groupBy("shard").applyInArrow(located, "ka long, kb long, start long, stop long")
    every = found.where("segment is null").select("ka", "kb", "start", "stop").union(across)
    return every.distinct().groupBy("ka", "kb").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("ranges"))


def _kept(docs: DataFrame) -> DataFrame:
    """Results of documents with ``doc_id``, ``text`` and ``ranges``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digest = [], [], []
            for text, cut in zip(batch.column(1), batch.column(2), strict=True):
                words = bytes(text.as_buffer()).split()
                n_words.append(len(words))
                if cut.is_valid:
                    out, last = [], 0
                    for r in cut.as_py():
                        out += words[last:r["start"]]
                        last = max(last, r["stop"])
                    words = out + words[last:]
                n_removed.append(n_words[-1] - len(words))
                digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, words removed, and the digest of the kept words."""
    keyed = _keyed(docs, key, text)
    cut = written(ranges(keyed), "ranges")
    flagged = marked(keyed, bitmap(cut, "ka"))
    whole = flagged.where("not maybe").withColumn("ranges", F.lit(None).cast(cut.schema["ranges"].dataType))
    touched = flagged.where("maybe").join(cut, ["ka", "kb"], "left")
    return _kept(whole.select("doc_id", "text", "ranges").union(touched.select("doc_id", "text", "ranges")))
