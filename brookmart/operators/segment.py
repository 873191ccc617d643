"""Words of CJK text by a dictionary: the cheapest way through a word graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmart.functions.tokens import CJK, MAYBE_CJK, PLAIN_PATTERN, TOKEN_PATTERN

#: What a character costs that is no word of the dictionary, on top of a word that occurs once.
UNKNOWN = 10_000
#: Units of cost in a natural logarithm; costs are whole numbers, so ties are ties everywhere.
UNITS = 1_000


def with_costs(dictionary: DataFrame) -> DataFrame:
    """``dictionary`` (``word``, ``n``) with ``cost``: the rarer a word, the dearer. Null and empty words are left out."""
    words = dictionary.filter((F.col("word") != "") & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(1))).scalar()
    return words.withColumn("cost", F.round(UNITS * F.log(total / F.col("n"))).cast("bigint"))


def word_graph(runs: DataFrame, costs: DataFrame) -> DataFrame:
    """Edges ``run``, ``start``, ``stop``, ``cost`` of the distinct ``runs``: dictionary words, and every character.

    The dictionary is dealt by first character: a position asks for the word lengths that
    begin with its character, and for nothing else.
    """
    places = runs.select("run", F.explode(F.sequence(F.lit(0), F.length("run") - 1)).alias("start"))
    places = places.withColumn("first", F.substring("run", F.col("start") + 1, F.lit(1)))
    lengths = costs.groupBy(F.substring("word", 1, 1).alias("first")).agg(F.collect_set(F.length("word")).alias("lengths"))
    # As many rows as there are first characters: dealt by them, a task would hold all places of a common one.
    asked = places.join(F.broadcast(lengths), "first").select("run", "start", F.explode("lengths").alias("size"))
    asked = asked.filter(F.col("start") + F.col("size") <= F.length("run"))
    found = asked.withColumn("word", F.substring("run", F.col("start") + 1, F.col("size"))).join(costs.select("word", "cost"), "word")
    edges = found.select("run", "start", (F.col("start") + F.col("size")).alias("stop"), "cost")
    rare = costs.agg(F.coalesce(F.max("cost"), F.lit(0))).scalar()
    single = places.select("run", "start", (F.col("start") + 1).alias("stop"), (rare + UNKNOWN).cast("bigint").alias("cost"))
    return edges.unionByName(single)


def segment_runs(runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``run`` and ``words``, the words on its cheapest way; of equally cheap ways the one whose last words are longest.

    Dynamic programming over the ends of words, inside one expression per run. Steps
    append to an array, so a run of n characters copies n * n / 2 numbers; runs end at
    anything that is no CJK character.
    """
    costs = with_costs(dictionary)
    into = word_graph(runs.select("run").distinct(), costs).groupBy("run", "stop").agg(F.collect_list(F.struct("start", "cost")).alias("from"))
    graph = into.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("stop", "from"))).alias("stops"))

    def cheapest(done: Column, stop: Column) -> Column:
        ways = F.transform(stop["from"], lambda e: F.struct((F.get(done, e["start"])["cost"] + e["cost"]).alias("cost"), e["start"].alias("start")))
        return F.concat(done, F.array(F.array_min(ways)))

    begin = F.array(F.struct(F.lit(0).cast("bigint").alias("cost"), F.lit(0).alias("start")))
    best = graph.select("run", F.aggregate("stops", begin, cheapest).alias("best"))

    def back(state: Column, stop: Column) -> Column:
        start = F.get(F.col("best"), stop)["start"]
        word = F.substring("run", start + 1, stop - start)
        taken = F.struct(start.alias("at"), F.concat(F.array(word), state["words"]).alias("words"))
        return F.when(stop == state["at"], taken).otherwise(state)

    ends = F.sequence(F.length("run"), F.lit(1), F.lit(-1))
    none = F.struct(F.length("run").alias("at"), F.array().cast("array<string>").alias("words"))
    return best.select("run", F.aggregate(ends, none, back)["words"].alias("words"))


def split_words_by_dictionary(df: DataFrame, dictionary: DataFrame, text: str = "item") -> DataFrame:
    """One row per word of ``text``, which is dropped; other columns are kept.

    CJK runs are cut by the dictionary (``word``, ``n``), each distinct run once; letters and digits of
    other scripts stay whole, in lower case. Null and empty texts have no words.
    """
    keep = [c for c in df.columns if c != text]
    lowered = F.lower(F.col(text))
    found = F.when(F.col(text).rlike(MAYBE_CJK), F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0))).otherwise(
        F.regexp_extract_all(lowered, F.lit(PLAIN_PATTERN), F.lit(0)))
    runs = df.select(*keep, F.explode(found).alias("run")).withColumn("_cjk", F.col("run").rlike(f"^[{CJK}]"))
    cut = segment_runs(runs.filter("_cjk"), dictionary)
    whole = runs.filter("not _cjk").select(*keep, F.col("run").alias("word"))
    return whole.unionByName(runs.filter("_cjk").join(cut, "run").select(*keep, F.explode("words").alias("word")))
