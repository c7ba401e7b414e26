"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space and \t \n \v \f \r; classes of single Latin-1 characters match fastest.
WORD = r"[^ \t\n\x0B\f\r]+"
GAP = r"[ \t\n\x0B\f\r]+"
INK = r"[^ \t\n\x0B\f\r]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder's URI below the shared folder the cluster names in spark.checkpoint.dir.

    Only where that setting is absent (tests, one machine) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sheaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sheaf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and reread: cuts lineage and survives lost executors."""
    at = scratch(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row: a lambda variable is never inlined again by the optimizer."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "^" + GAP, ""), GAP + "$", "")
    return bound(bare, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, GAP)))


def inked(text: Column) -> Column:
    """Code points in words: all but white space, each of which is one byte."""
    bare = text
    for gap in " \n\t\r\x0b\x0c":
        bare = F.replace(bare, F.lit(gap), F.lit(""))
    return F.length(bare).cast("long")


def word_count(text: Column) -> Column:
    """Number of words; null gives 0."""
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    pieces = F.split(F.coalesce(text, F.lit("")), GAP)
    return bound(pieces, lambda w: F.greatest(F.size(w) - empty(F.element_at(w, 1)) - empty(F.element_at(w, -1)), F.lit(0))).cast("long")


def prefix_sums(df: DataFrame, value: str, keys: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Column out: the sum of value over the rows of the same keys before this one by (bucket, order).

    Two levels, so that a key with a third of all rows doesn't meet in one task: sums of (keys, bucket) are
    accumulated first, then rows within their own bucket only.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in [*keys, bucket]), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, bucket]]
    return inner.join(sums, on, "left").withColumn(out, F.col("_base") + F.col("_in")).drop("_in", "_base", *(f"_{k}" for k in [*keys, bucket]))
