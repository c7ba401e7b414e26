"""Join-shaped operators: bags of words, nearest neighbours, votes, overrides, comparison with a baseline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bag(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, word, n: words without punctuation at their edges, in lower case."""
    bare = F.regexp_replace("word", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    words = docs.select(*keys, F.explode(F.split(F.lower(text), r"[ \t\n\r]+")).alias("word")).select(*keys, bare.alias("word")).where("word <> ''")
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def bag_scores(ours: DataFrame, theirs: DataFrame, pair: list[str]) -> DataFrame:
    """pair, common, n_ours, n_theirs, recall, f1: multiset overlap of paired texts; both bags carry the pair's keys."""
    a, b = ours.withColumnRenamed("n", "_a"), theirs.withColumnRenamed("n", "_b")
    both = a.join(b, [*pair, "word"], "full")
    sums = both.groupBy(*pair).agg(F.sum(F.least(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0)))).alias("common"), F.sum(F.coalesce("_a", F.lit(0))).alias("n_ours"), F.sum(F.coalesce("_b", F.lit(0))).alias("n_theirs"))
    share = lambda x, y: F.when(y > 0, F.round(x / F.when(y > 0, y), 4)).otherwise(0.0)
    return sums.withColumns({"recall": share(F.col("common"), F.col("n_theirs")), "f1": share(2 * F.col("common"), F.col("n_ours") + F.col("n_theirs"))})


def sharing_runs(docs: DataFrame, items: DataFrame, n: int = 5, text: str = "text") -> DataFrame:
    """doc_id, item_id: pairs that share n words in a row, or all words of a shorter item; words as in bag."""
    bare = F.filter(F.transform(F.split(F.lower(text), r"[ \t\n\r]+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")

    def runs(rows: DataFrame, k: Column) -> DataFrame:
        whole = rows.where(F.size("_w") >= k)
        starts = F.sequence(F.lit(1), F.size("_w") - k + 1)
        return whole.select(whole.columns[0], F.explode(F.transform(starts, lambda i: F.array_join(F.slice("_w", i, k), " "))).alias("run"))

    known = items.select("item_id", bare.alias("_w")).where(F.size("_w") > 0).withColumn("_k", F.least(F.lit(n), F.size("_w")))
    index = runs(known, F.col("_k")).distinct()
    found = docs.select("doc_id", bare.alias("_w"))
    sizes = [r[0] for r in known.select("_k").distinct().collect()]  # n values at most
    pairs = [runs(found, F.lit(k)).join(index, "run").select("doc_id", "item_id") for k in sizes] or [docs.select("doc_id").join(items.select("item_id")).limit(0)]
    return reduce(DataFrame.union, pairs).distinct()


def nearest(queries: DataFrame, rows: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, key, distance, rank: the k rows nearest to each query by squared distance.

    The queries are a stated set; the best k of each task are kept before they meet, so no query's candidates are
    gathered whole.
    """
    q = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("_q"))
    squares = F.zip_with("_q", vector, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    pairs = rows.select(key, vector).join(F.broadcast(q) if _few(q) else q, F.col(key) != F.col("query_id"))
    scored = pairs.select("query_id", key, F.round(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 4).alias("distance"))
    order = [F.col("distance"), F.col(key)]
    some = F.row_number().over(Window.partitionBy("query_id", "_part").orderBy(*order))
    near = scored.withColumn("_part", F.pmod(F.xxhash64(key), F.lit(64))).withColumn("_k", some).where(F.col("_k") <= k)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", key, "distance", "rank")


def _few(queries: DataFrame, most: int = 4096) -> bool:
    """Whether the queries are few enough to broadcast: counted, not assumed."""
    return queries.limit(most + 1).count() <= most


def vote(rows: DataFrame, group: str, choice: str) -> DataFrame:
    """group, choice, votes: the choice most rows of the group name; the first of equals."""
    counted = rows.groupBy(group, choice).agg(F.count("*").alias("votes"))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("votes"), choice))
    return counted.withColumn("_k", first).where("_k = 1").drop("_k")


def unambiguous(rows: DataFrame, key: str, choice: str) -> DataFrame:
    """key, choice of the keys all of whose rows name one choice."""
    return rows.groupBy(key).agg(F.min(choice).alias(choice), F.max(choice).alias("_max")).where(F.col(choice) == F.col("_max")).drop("_max")


def overridden(base: DataFrame, own: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: own where it has the key, else base."""
    mine = own.select(key, F.col(value).alias("_own"))
    return base.join(mine, key, "full").select(key, F.coalesce("_own", value).alias(value))


def differing(rows: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of the rows that base doesn't have alike."""
    other = base.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    return rows.join(other, (F.col(key) == F.col("_k")) & F.col(value).eqNullSafe(F.col("_v")), "left_anti").select(key, value)


def gate(run: DataFrame, baseline: DataFrame, key: str, score: str, tolerance: Column) -> DataFrame:
    """key, was, now, state: worse, better, same, new or lost, by a tolerance in points."""
    was = baseline.select(key, F.col(score).alias("was"))
    both = run.select(key, F.col(score).alias("now")).join(was, key, "full")
    change = F.col("now") - F.col("was")
    state = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "lost").when(change < -tolerance, "worse").when(change > tolerance, "better").otherwise("same")
    return both.select(key, "was", "now", state.alias("state"))


def close_names(rows: DataFrame, key: str, name: str, most: int = 2) -> DataFrame:
    """a, b, distance: names within an edit distance, each pair once.

    Names that close differ in length by that distance at most, so they are joined on the length; the distance is only
    computed up to the limit.
    """
    a = rows.select(F.col(key).alias("a"), F.col(name).alias("_x"), F.explode(F.sequence(F.length(name) - most, F.length(name) + most)).alias("_m"))
    b = rows.select(F.col(key).alias("b"), F.col(name).alias("_y"), F.length(name).alias("_n"))
    found = a.join(b, (F.col("_m") == F.col("_n")) & (F.col("a") < F.col("b"))).withColumn("distance", F.levenshtein("_x", "_y", most))
    return found.where("distance >= 0").select("a", "b", "distance")
