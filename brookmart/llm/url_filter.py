"""URL filter by the ratio of two character language models, in DataFrame functions only.

Rules (host suffix and path prefix) accept or reject some URLs outright; the longest rule
that fits wins. All URLs with a rule are the training set of two Markov models, one of
accepted and one of rejected URLs. Their order varies with what was seen: Witten-Bell
smoothing mixes the estimate after two symbols with that after one, without context, and
uniform. A URL without a rule gets the verdict of the log-likelihood difference of the
models, divided by its length, against a threshold. The threshold is calibrated on the
training URLs: of all edges of a histogram of their scores, the one with the smallest sum
of the shares of wrongly accepted and wrongly rejected URLs.

Symbols are folded to an alphabet of 48, so a model is an array of 48^3 numbers, whatever
the size of the table: that bound is what every task is sent.

Null URLs and those without ``://`` have empty host and path, fit no rule, and are scored
as they are (null as empty). Without training URLs of both kinds the models are equal and
all scores are 0, which accepts. Repeated rows are judged each time and count each time.
Only the key and URL columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brookmart.llm.common import let

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789/.-_:?=&%#"
#: 0 is any other character, the last symbol marks both ends.
EDGE = len(LETTERS) + 1
ALPHABET = EDGE + 1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (rule, verdict)
RULES = [
    ("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"),
    ("example.net/de/8", "block"), ("org/es/", "block"),
]
#: Histogram of training scores: edges per unit, and the largest score told apart.
EDGES_PER_UNIT, LARGEST = 256, 8


def lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host`` and ``path``."""
    pattern = "://([^/?#]*)([^?#]*)"
    body = F.coalesce(F.col(url), F.lit(""))
    return urls.withColumn("host", lower(F.regexp_extract(body, pattern, 1))).withColumn("path", F.regexp_extract(body, pattern, 2))


def with_rule(urls: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``urls`` with ``rule`` and ``ruled`` (its verdict), both null where no rule fits."""
    rule = ruled = None
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        ruled = F.when(fits, verdict) if ruled is None else ruled.when(fits, verdict)
    return urls.withColumn("rule", rule).withColumn("ruled", ruled)


def cells(url: Column) -> Column:
    """Numbers of the URL's symbol triples: every symbol after its two predecessors."""
    letters = F.filter(F.split(lower(F.coalesce(url, F.lit(""))), ""), lambda c: c != "")
    symbols = F.concat(F.array(F.lit(EDGE), F.lit(EDGE)), F.transform(letters, lambda c: F.call_function("locate", c, F.lit(LETTERS))), F.array(F.lit(EDGE)))
    return let(symbols, lambda x: F.transform(
        F.sequence(F.lit(0), F.size(x) - 3),
        lambda i: (F.get(x, i) * ALPHABET + F.get(x, i + 1)) * ALPHABET + F.get(x, i + 2)))


def fit(ruled: DataFrame, url: str = "url") -> DataFrame:
    """One row with ``model``: log p(accepted) - log p(rejected) per symbol triple."""
    spark = ruled.sparkSession
    seen = ruled.where("ruled is not null").select("ruled", F.explode(cells(F.col(url))).alias("cell"))
    counts = seen.groupBy("cell").agg(
        F.count_if(F.col("ruled") == "allow").cast("double").alias("allow"), F.count_if(F.col("ruled") == "block").cast("double").alias("block"))
    grid = spark.range(ALPHABET ** 3).withColumnRenamed("id", "cell").join(counts, "cell", "left").fillna(0.0, ["allow", "block"])
    grid = grid.select(
        "cell", "allow", "block", F.expr(f"cell div {ALPHABET}").alias("ab"),
        (F.expr(f"(cell div {ALPHABET}) % {ALPHABET}")).alias("b"), (F.col("cell") % ALPHABET).alias("c"))
    # Sums over the fixed grid: over what precedes (pairs and single symbols), and without context.
    pair = grid.groupBy("b", "c").agg(*[F.sum(k).alias(f"{k}_bc") for k in ("allow", "block")])
    one = pair.groupBy("c").agg(*[F.sum(f"{k}_bc").alias(f"{k}_c") for k in ("allow", "block")])
    every = one.withColumns({f"{k}_n": F.sum(f"{k}_c").over(Window.partitionBy()) for k in ("allow", "block")})
    after = pair.groupBy("b").agg(*[x for k in ("allow", "block") for x in (F.sum(f"{k}_bc").alias(f"{k}_b"), F.count_if(F.col(f"{k}_bc") > 0).alias(f"{k}_bt"))])
    after2 = grid.groupBy("ab").agg(*[x for k in ("allow", "block") for x in (F.sum(k).alias(f"{k}_ab"), F.count_if(F.col(k) > 0).alias(f"{k}_abt"))])
    full = grid.join(pair, ["b", "c"]).join(every, "c").join(after, "b").join(after2, "ab")

    def log_p(k: str) -> Column:
        p0 = (F.col(f"{k}_c") + 1) / (F.col(f"{k}_n") + ALPHABET)
        p1 = F.when(F.col(f"{k}_b") > 0, (F.col(f"{k}_bc") + F.col(f"{k}_bt") * p0) / (F.col(f"{k}_b") + F.col(f"{k}_bt"))).otherwise(p0)
        p2 = F.when(F.col(f"{k}_ab") > 0, (F.col(k) + F.col(f"{k}_abt") * p1) / (F.col(f"{k}_ab") + F.col(f"{k}_abt"))).otherwise(p1)
        return F.log(p2)

    ratio = F.struct("cell", (log_p("allow") - log_p("block")).alias("d"))
    return full.agg(F.transform(F.array_sort(F.collect_list(ratio)), lambda x: x["d"]).alias("model"))


def scored(urls: DataFrame, model: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``score``: log-likelihood difference per symbol, to six places."""
    total = let(F.col("__model"), lambda m: let(cells(F.col(url)), lambda c: F.aggregate(c, F.lit(0.0), lambda s, i: s + F.get(m, i)) / F.size(c)))
    return urls.withColumn("__model", model.scalar()).withColumn("score", F.round(total, 6)).drop("__model")


def threshold(judged: DataFrame) -> DataFrame:
    """One row with ``threshold``: the edge that splits the training URLs best, nearest to 0 among equals."""
    edge = F.floor(F.col("score") * EDGES_PER_UNIT)
    at = F.least(F.greatest(edge, F.lit(-LARGEST * EDGES_PER_UNIT)), F.lit(LARGEST * EDGES_PER_UNIT)).cast("long")
    bins = judged.where("ruled is not null").groupBy(at.alias("bin")).agg(
        F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block"))
    # At most 2 * LARGEST * EDGES_PER_UNIT + 1 bins.
    below, whole = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    shares = bins.select(
        "bin",
        F.coalesce(F.sum("allow").over(below), F.lit(0)).alias("allow_below"), F.sum("allow").over(whole).alias("allow_all"),
        F.coalesce(F.sum("block").over(below), F.lit(0)).alias("block_below"), F.sum("block").over(whole).alias("block_all"))
    wrong = F.round(
        F.col("allow_below") / F.greatest(F.col("allow_all"), F.lit(1)) + 1 - F.col("block_below") / F.greatest(F.col("block_all"), F.lit(1)), 9)
    best = F.min(F.when((F.col("allow_all") > 0) & (F.col("block_all") > 0), F.struct(wrong.alias("wrong"), F.abs("bin").alias("far"), F.col("bin").alias("bin"))))
    return shares.agg(F.coalesce(best["bin"] / EDGES_PER_UNIT, F.lit(0.0)).alias("threshold"))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """One row per page: ``host``, ``path``, ``rule``, ``score`` and ``verdict``."""
    ruled = with_rule(parts(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))), rules)
    judged = scored(ruled, fit(ruled))
    by_model = F.when(F.col("score") >= threshold(judged).scalar(), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", "score", F.coalesce("ruled", by_model).alias("verdict"))
