"""Token counts by a trie of pre-tokens that share their forward scores.

The tokenizer is a unigram one: a word is cut into the pieces with the largest sum of log
probabilities. A task inserts the distinct words it meets into a trie; every node holds
the best forward score of the prefix it stands for and the tokens on the way there, so a
prefix that many words share is scored once. A word's count is read at its terminal node.
Documents add up the counts of their words; nothing is shuffled.

Vocabulary files give ranks. A piece of rank r has the log probability of Zipf's law,
-log(r + 1) - log(sum of 1 / (r + 1)). A character that no piece covers costs ten more
than the rarest piece and counts as its bytes.

Null and empty texts have no words and no tokens. Repeated rows are counted each time.
Only the key and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from brookmart.llm.common import text_slices
from brookmart.llm.wordhash import Memo, Words, laid_out

#: What precedes a word in pieces (fixed value of the vocabulary format).
WORD_START = "▁"
#: Words counted before the trie starts anew; counts do not depend on it.
TRIE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0


def zipf_scores(n: int) -> list[float]:
    total = math.log(sum(1 / (r + 1) for r in range(n)))
    return [-math.log(r + 1) - total for r in range(n)]


def load_pieces(path: str) -> list[str]:
    """Ordinary pieces of a piece model, most frequent first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ordinary = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    # Merged pieces carry their rank as score; single characters follow them.
    return [sp.id_to_piece(i) for i in sorted(ordinary, key=lambda i: -sp.get_score(i))]


class TrieCounter:
    """Counts of words. A trie node is [children, best score, tokens, text before it reversed].

    Pieces lie in a trie of their reversed letters, so the pieces that end at a node are
    found by walking back along the word only as far as some piece reaches.
    """

    def __init__(self, pieces: list[str]):
        self.scores = zipf_scores(len(pieces))
        self.unknown = min(self.scores) - UNKNOWN_PENALTY
        self.endings: dict = {}
        for piece, score in zip(pieces, self.scores, strict=True):
            node = self.endings
            for letter in reversed(piece):
                node = node.setdefault(letter, {})
            node[""] = score
        self._start()

    def _start(self) -> None:
        self.root: dict = {}
        self.held = 0
        self.terminals: dict[str, int] = {}

    def count(self, words: list[str]) -> list[int]:
        """Tokens of each word; new words are inserted into the trie."""
        if self.held > TRIE_WORDS:
            self._start()
        out = []
        for word in words:
            known = self.terminals.get(word)
            if known is None:
                known = self.terminals[word] = self._insert(WORD_START + word)
                self.held += 1
            out.append(known)
        return out

    def _insert(self, word: str) -> int:
        # Per depth: (best log probability, tokens) of the prefix of that length.
        path, node, depth = [(0.0, 0)], self.root, 0
        for letter in word:
            depth += 1
            step = node.get(letter)
            if step is None:
                step = node[letter] = {"": self._forward(word, depth, path)}
            path.append(step[""])
            node = step
        return path[-1][1]

    def _forward(self, word: str, end: int, path: list[tuple[float, int]]) -> tuple[float, int]:
        node, at, best, tokens, covered = self.endings, end, -math.inf, 0, False
        while at:
            at -= 1
            node = node.get(word[at])
            if node is None:
                break
            score = node.get("")
            if score is not None:
                covered |= at == end - 1
                score += path[at][0]
                if score > best:
                    best, tokens = score, path[at][1] + 1
        if not covered:
            score = path[end - 1][0] + self.unknown
            if score > best:
                best, tokens = score, path[end - 1][1] + len(word[end - 1].encode())
        return best, tokens


_loaded: dict[str, tuple[TrieCounter, Memo]] = {}


def _counter(path: str) -> tuple[TrieCounter, Memo]:
    if path not in _loaded:
        trie = TrieCounter(load_pieces(path))
        memo = Memo(lambda words: [n.to_bytes(4, "little") for n in trie.count([w.decode() for w in words])])
        _loaded[path] = (trie, memo)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_words`` and ``n_tokens`` (long) of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _counter(path)[1]
        for batch in batches:
            for first, part in text_slices(batch.column(1)):
                words = Words(part)
                values, inverse = memo.of(words, words.hashes)
                sums = np.zeros(len(inverse) + 1, np.int64)
                np.cumsum(laid_out(values, inverse)[0], out=sums[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(np.diff(words.offsets).astype(np.int64)), pa.array(np.diff(sums[words.offsets]))],
                    names=[key, "n_words", "n_tokens"],
                )

    schema = T.StructType([docs.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(key, text).mapInArrow(run, schema)
