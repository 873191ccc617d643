"""Quality rules by weak supervision, in DataFrame functions only.

Every rule looks at measures of a document and votes good (1), bad (0) or abstains (-).
Votes are noisy labels: expectation-maximisation over all documents estimates how often
each rule votes good on good and on bad documents, and the share of good documents. A
document is kept if it passes the two base conditions and its posterior probability of
being good is at least one half, instead of having to pass every rule.

There are at most 3^rules vote patterns, so documents are counted per pattern and the
estimation runs on the one row that holds all patterns, inside one expression.

Measures (words are runs without ASCII white space): ``n_words``; ``word_chars``, code
points in words; ``n_symbols``, characters of ``#*$%&|<>``; ``n_dup_lines``, lines with a
word that equal an earlier line; ``n_repeat_words``, words in 8-word windows that occur
twice or more in the text, the first included.

A null or empty text has no words and fails. Repeated rows count each time. Documents
with equal votes have equal posteriors, and one half is kept. An empty table gives an
empty result. Only the key and text columns are read; other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.llm.common import SPACES, let, words, written

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: Rule: the measure, then where it votes good and where it votes bad (lower and upper bounds).
RULES: list[tuple[str, str, str]] = [
    ("word length", "word_chars between 3 * n_words and 7 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    ("symbols", "20 * n_symbols < n_words", "5 * n_symbols > n_words"),
    ("plain words", "5 * n_plain > 4 * n_words", "2 * n_plain < n_words"),
    ("bare symbols", "50 * n_bare < n_words", "10 * n_bare > n_words"),
    ("table lines", "n_bar_lines = 0", "10 * n_bar_lines > 3 * n_lines"),
    ("repeated words", "20 * n_repeat_words < n_words", "5 * n_repeat_words > n_words"),
    ("repeated lines", "n_dup_lines = 0", "n_dup_lines > 1 and 10 * n_dup_lines > 3 * n_lines"),
    ("capitals", "5 * n_upper < word_chars", "2 * n_upper > word_chars"),
    ("exclamations", "20 * n_exclaim < n_words", "3 * n_exclaim > n_words"),
    ("sentence ends", "100 * n_stops between n_words and 30 * n_words", "n_stops = 0 and n_words >= 50"),
    ("vocabulary", "10 * n_distinct > 3 * n_words", "10 * n_distinct < n_words"),
]

ROUNDS = 25
START_SHARE, START_GOOD, START_BAD = 0.8, 0.98, 0.7
#: Weight of the starting values in every round, as a share of all documents.
PRIOR = 0.01
FLOOR = 0.001


def _repeat_words(w: Column, size: int = WINDOW) -> Column:
    """Words covered by windows of ``size`` words that occur twice or more in the array ``w``."""
    starts = F.sequence(F.lit(1), F.size(w) - (size - 1))

    def covered(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(p) - 1)
        return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.least(F.lit(size), F.get(p, i + 1) - F.get(p, i)), F.lit(size)).cast("long"))

    def repeated(s: Column) -> Column:
        # Sorted by hash: a window repeats if a neighbour has its hash (128 bits).
        def same(a: Column, b: Column) -> Column:
            return F.coalesce((F.get(s, a)["h"] == F.get(s, b)["h"]) & (F.get(s, a)["g"] == F.get(s, b)["g"]), F.lit(False))

        at = F.sequence(F.lit(0), F.size(s) - 1)
        return F.array_sort(F.transform(F.filter(at, lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(s, i)["at"]))

    def slow() -> Column:
        hashed = F.transform(starts, lambda i: F.struct(
            F.xxhash64(F.slice(w, i, size)).alias("h"), F.xxhash64(F.lit(1), F.slice(w, i, size)).alias("g"), i.alias("at")))
        return let(F.array_sort(hashed), lambda s: let(repeated(s), covered))

    quick = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))
    any_twice = let(quick, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(w) <= size, F.lit(0).cast("long")).when(any_twice, slow()).otherwise(F.lit(0).cast("long"))


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: list[Column] | None = None) -> DataFrame:
    """One row per document with its measures (long), and ``carried`` columns as ``row``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def without(letters: str) -> Column:
        return F.length(body) - F.length(F.translate(body, letters, ""))

    lines = let(
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, lambda y: y.contains("|"))).alias("bars"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")),
    )
    of_words = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).alias("n"),
        F.size(F.array_distinct(w)).alias("distinct"),
        F.size(F.filter(w, lambda x: x.rlike(r"[\p{L}\p{N}][.,;:?!]?\z"))).alias("plain"),
        F.size(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("bare"),
        F.size(F.filter(w, lambda x: x.endswith(".") | x.endswith("?"))).alias("stops"),
        _repeat_words(w).alias("repeat"),
    ))
    got = docs.select(
        F.struct(*carried).alias("row") if carried else F.lit(None).alias("row"), F.col(key).alias("doc_id"), of_words.alias("w"), lines.alias("l"),
        (F.length(body) - without(SPACES)).alias("word_chars"), without(SYMBOLS).alias("n_symbols"),
        without(UPPER).alias("n_upper"), without("!").alias("n_exclaim"),
    )
    named = {
        "n_words": "w.n", "word_chars": "word_chars", "n_symbols": "n_symbols", "n_dup_lines": "l.dup", "n_repeat_words": "w.repeat",
        "n_lines": "l.n", "n_upper": "n_upper", "n_exclaim": "n_exclaim", "n_stops": "w.stops", "n_plain": "w.plain", "n_bare": "w.bare", "n_bar_lines": "l.bars", "n_distinct": "w.distinct",
    }
    return got.select("row", "doc_id", *[F.col(c).cast("long").alias(n) for n, c in named.items()])


def with_votes(measured: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``votes``, one letter per rule: 1, 0 or -."""
    vote = [F.when(F.expr(bad), "0").when(F.expr(good), "1").otherwise("-") for _, good, bad in RULES]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("votes", F.concat(*vote))


def estimate(voted: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Posterior probability of being good per vote pattern: ``votes``, ``n`` and ``quality``."""
    n_rules = len(RULES)
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n"))

    def odds(p: Column, votes: Column) -> Column:
        """Log odds of bad against good."""
        terms = [F.log(1 - p["share"]) - F.log(p["share"])]
        for j in range(n_rules):
            letter, good, bad = F.substring(votes, j + 1, 1), F.get(p["good"], F.lit(j)), F.get(p["bad"], F.lit(j))
            terms.append(F.when(letter == "1", F.log(bad) - F.log(good)).when(letter == "0", F.log(1 - bad) - F.log(1 - good)).otherwise(F.lit(0.0)))
        return reduce(lambda a, b: a + b, terms)

    def posterior(p: Column, votes: Column) -> Column:
        return 1 / (1 + F.exp(odds(p, votes)))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + value(x))

    def held(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(FLOOR)), F.lit(1 - FLOOR))

    def step(p: Column, rows: Column) -> Column:
        def update(q: Column) -> Column:
            n = total(q, lambda x: x["n"])
            weight = n * PRIOR + 1

            def rate(j: int, start: float, good: bool) -> Column:
                mass = (lambda x: x["n"] * x["q"]) if good else (lambda x: x["n"] * (1 - x["q"]))
                letter = lambda x: F.substring(x["votes"], j + 1, 1)
                ones = total(q, lambda x: F.when(letter(x) == "1", mass(x)).otherwise(0.0))
                cast = total(q, lambda x: F.when(letter(x) != "-", mass(x)).otherwise(0.0))
                return held((ones + weight * start) / (cast + weight))

            share = (total(q, lambda x: x["n"] * x["q"]) + weight * START_SHARE) / (n + weight)
            return F.struct(
                held(share).alias("share"),
                F.array(*[rate(j, START_GOOD, True) for j in range(n_rules)]).alias("good"),
                F.array(*[rate(j, START_BAD, False) for j in range(n_rules)]).alias("bad"),
            )

        return let(F.transform(rows, lambda x: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), posterior(p, x["votes"]).alias("q"))), update)

    start = F.struct(
        F.lit(START_SHARE).alias("share"),
        F.array(*[F.lit(START_GOOD)] * n_rules).alias("good"), F.array(*[F.lit(START_BAD)] * n_rules).alias("bad"),
    )
    all_rows = F.array_sort(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))))
    fitted = patterns.agg(all_rows.alias("rows")).select(
        "rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda p, _: step(p, F.col("rows"))).alias("p"))
    return fitted.select("p", F.explode("rows").alias("x")).select("x.votes", F.col("x.n").cast("long").alias("n"), posterior(F.col("p"), F.col("x.votes")).alias("quality"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: measures, ``base_failed``, ``votes``, ``quality`` and ``kept``."""
    return _judged(measures(docs, key, text).drop("row"))


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that pass, columns unchanged."""
    fields = [F.col(f"`{c}`") for c in docs.columns]
    return _judged(measures(docs, key, text, fields)).where("kept").select("row.*")


def _judged(measured: DataFrame) -> DataFrame:
    # Stored, so that texts are parsed once: the votes are read to estimate and to judge.
    voted = written(with_votes(measured), "votes")
    # At most 3^rules rows.
    quality = F.broadcast(estimate(voted).select("votes", "quality"))
    judged = voted.join(quality, "votes")
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
