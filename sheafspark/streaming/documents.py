"""The engine's operators over streams of document files: stateless ones unchanged, counts as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.operators.lines import doc_lines
from sheafspark.operators.stats import letter_words

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def document_stream(spark: SparkSession, path: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def stream_lines(docs: DataFrame) -> DataFrame:
    """doc_lines has no state, so a stream's rows pass through it as a table's do."""
    return doc_lines(docs)


def stream_lexicon(docs: DataFrame) -> DataFrame:
    """lang, word, n so far; for complete or update output."""
    return letter_words(docs, ["lang"]).groupBy("lang", "word").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events a window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
