"""Operator 3: mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Documents of a source are shuffled by a seeded hash and queued REPEATS times over; a packet's virtual finish time is
the words its source has sent by then, divided by the source's target. All queues are merged by virtual finish time
(a range sort over time slots) and the merge is truncated at the total budget: that alone decides what is taken. So
that a source is off its target by 1/QUANTA of it at most, besides a word, documents longer than that go in several
packets; a source adds REPEATS * QUANTA packets at most to its documents, whatever its size. The packet at the cut is
sent in part.

Nulls: a null text has size 0, a null source is a source of its own, ranked last, a null doc_id is hashed as an empty
one. Repeated rows are documents of their own; ties in the shuffle go by doc_id, then size, so reruns agree. Empty
documents take 0 words. An empty table gives an empty result. In `mixed`, rows that share doc_id, source and size
but not what is taken of them are told apart by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafspark.llm.common import prefix_sums, stored, table, word_count, words

REPEATS = 3
#: Weights by rank of the source, repeating.
WEIGHTS = (1, 2, 3)
#: Hash and time ranges by which prefix sums are split; a range is 1/RANGES of a source or of the mix.
RANGES = 4096
#: A packet is at most 1/QUANTA of its source's target, or a word.
QUANTA = 4096
SEED = "mix"


def targets(sources: DataFrame) -> DataFrame:
    """sources (source, source_size, weight) with target: shares of the whole by weight, none above REPEATS x size.

    The shares solve sum(min(REPEATS * size, level * weight)) = whole: sources are capped in ascending order of
    size / weight. The table has a row a source, so that a window over all of it is small.
    """
    tight = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = tight.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    return (
        sources.withColumn("_whole", F.sum("source_size").over(all_rows))
        .withColumn("_level", (F.col("_whole") - REPEATS * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("_free", F.col("_level") * F.col("weight") <= REPEATS * F.col("source_size"))
        .withColumn("_level", F.min(F.when(F.col("_free"), F.struct(F.col("source_size") / F.col("weight"), F.col("_level").alias("level")))).over(all_rows)["level"])
        .withColumn("target", F.when(F.col("_level").isNull() | (F.col("_level") * F.col("weight") > REPEATS * F.col("source_size")), (REPEATS * F.col("source_size")).cast("double")).otherwise(F.col("_level") * F.col("weight")))
        .drop("_whole", "_level", "_free")
    )


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col(text)).alias("size"))


def goals(sizes: DataFrame) -> DataFrame:
    """A row a source (_source): source_size and target."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    return targets(sums.withColumn("weight", weight)).select(F.col("source").alias("_source"), "source_size", "target")


def mix(sizes: DataFrame) -> DataFrame:
    """sizes (doc_id, source, size) with source_size, target, taken: the words the mix takes of each, repeats counted."""
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = sizes.withColumn("_key", key).withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    queued = prefix_sums(keyed, "size", ["source"], "_range", ["_key", "doc_id", "size"], "_start")
    queued = queued.join(goals(sizes), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    # Before virtual time 2 every queue has sent its target or is empty, so the cut comes earlier: packets that begin
    # later are left out, but for those of the first pass, which bring every document back.
    passes = queued.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    passes = passes.withColumn("_from", F.col("_pass") * F.col("source_size") + F.col("_start"))
    passes = passes.where((F.col("_pass") == 0) | (F.col("_from") < 2 * F.greatest(F.col("target"), F.lit(1.0))))
    most = F.greatest(F.floor(F.col("target") / QUANTA), F.lit(1)).cast("long")
    parts = F.when(F.col("_from") < 2 * F.greatest(F.col("target"), F.lit(1.0)), F.greatest(F.ceil(F.col("size") / most), F.lit(1))).otherwise(F.lit(1))
    packets = passes.withColumn("_most", most).withColumn("_part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    last = F.col("_part") == parts - 1
    packets = packets.withColumn("_words", F.when(last, F.col("size") - F.col("_part") * F.col("_most")).otherwise(F.col("_most")))
    packets = packets.withColumn("_finish", F.when(F.col("target") > 0, (F.col("_from") + F.col("_part") * F.col("_most") + F.col("_words")) / F.when(F.col("target") > 0, F.col("target"))).otherwise(0.0))
    # Packets after virtual time 2 come after all time slots, spread by their hash.
    slot = F.when(F.col("_finish") < 2, F.floor(F.col("_finish") * RANGES)).otherwise(2 * RANGES + F.col("_range"))
    packets = packets.withColumn("_slot", slot.cast("int")).select("doc_id", "source", "size", "source_size", "target", "_key", "_start", "_pass", "_part", "_words", "_finish", "_slot")
    sent = prefix_sums(packets, "_words", [], "_slot", ["_finish", "_key", "source", "doc_id", "_start", "_pass", "_part"], "_sent")
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_budget"))  # one row
    cut = sent.join(F.broadcast(budget)).withColumn("_got", F.greatest(F.least(F.col("_words"), F.col("_budget") - F.col("_sent")), F.lit(0)))
    # Rows that agree in all of these are empty documents with one id: each comes back.
    first = ((F.col("_pass") == 0) & (F.col("_part") == 0)).cast("int")
    rows = cut.groupBy("doc_id", "source", "size", "source_size", "target", "_start").agg(F.sum("_got").alias("taken"), F.sum(first).alias("_copies"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_copies", "_copy", "_start")


def mixed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The mix itself: documents repeated as often as it takes them, the last pass of each source's last one cut short.

    Columns as in docs. A document's rows share its id; documents of which nothing is taken are not in it. Rows of one
    (doc_id, source, size) are one key of the join; only where they are taken of differently are they numbered.
    """
    own = docs.columns
    key = lambda *c: F.to_json(F.struct(*(F.col(x).alias(str(i)) for i, x in enumerate(c))))
    row = docs.select(F.struct(*own).alias("__sheaf_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"), word_count(F.col(text)).alias("_size"))
    row = row.select("__sheaf_row", "_size", key("_id", "_src", "_size").alias("_k"))
    plan = mix(stored(sized(docs, text))).where("size > 0").groupBy(key("doc_id", "source", "size").alias("_key"), "taken").agg(F.count("*").alias("n"))
    # Most first; the copies from first on take so many words.
    plan = plan.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("runs")).where("runs[0].taken > 0")
    joined = row.join(plan, F.col("_k") == F.col("_key"))
    several = F.size("runs") > 1
    numbered = F.row_number().over(Window.partitionBy("_k").orderBy(F.when(several, F.xxhash64(f"__sheaf_row.{text}"))))
    before = lambda i: F.aggregate(F.slice("runs", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    taken = F.when(several, F.element_at(F.filter("runs", lambda x, i: F.col("_copy") <= before(i) + x["n"]), 1)["taken"]).otherwise(F.col("runs")[0]["taken"])
    joined = joined.withColumn("_copy", numbered).withColumn("taken", taken).where("taken > 0")
    joined = joined.withColumn("_pass", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("_size")).cast("int"))))
    left = F.col("taken") - (F.col("_pass") - 1) * F.col("_size")
    body = F.col(f"__sheaf_row.{text}")
    cut = F.when(left >= F.col("_size"), body).otherwise(F.array_join(F.slice(words(body), 1, F.greatest(left, F.lit(1)).cast("int")), " "))
    out = joined.withColumn("_text", cut)
    return out.select(*(F.col("_text").alias(c) if c == text else F.length("_text").cast("long").alias(c) if c == "n_chars" else F.col(f"__sheaf_row.{c}").alias(c) for c in own))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(stored(sized(table(spark, sf_dir, "documents")))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
weighted AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
goals AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE),
    coalesce((SELECT level FROM levels WHERE level * weight <= 3 * source_size ORDER BY source_size / weight LIMIT 1), 'infinity') * weight) AS target FROM levels),
queued AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target, md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS key, greatest(CAST(floor(g.target / 4096) AS BIGINT), 1) AS most,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix' || coalesce(CAST(s.doc_id AS VARCHAR), '')), s.doc_id NULLS FIRST, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    row_number() OVER () AS rid
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
passes AS (SELECT *, p * source_size + start AS begun FROM queued, range(3) r(p)),
packets AS (SELECT *, unnest(range(CAST(greatest(ceil(size / most), 1) AS BIGINT))) AS part FROM passes),
sizedp AS (SELECT *, least(most, size - part * most) AS words FROM packets),
timed AS (SELECT *, CASE WHEN target > 0 THEN (begun + part * most + words) / target ELSE 0 END AS finish FROM sizedp),
merged AS (SELECT *, sum(words) OVER (ORDER BY finish, key, source NULLS FIRST, doc_id NULLS FIRST, start, p, part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS sent FROM timed)
SELECT doc_id, size, source_size, target, CAST(sum(greatest(least(words, (SELECT sum(size) FROM sizes) - sent), 0)) AS BIGINT) AS taken
FROM merged GROUP BY rid, doc_id, size, source_size, target
"""
