"""Scores of a text against a reference: word order by common subsequence, structure differences."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(DoubleType())
def word_order(ours: pd.Series, theirs: pd.Series) -> pd.Series:
    """Share of the reference's words that come in the same order in ours."""
    out = []
    for a, b in zip(ours, theirs):
        a, b = (a or "").split(), (b or "").split()
        out.append(round(common_subsequence(a, b) / len(b), 4) if b else 0.0)
    return pd.Series(out)


@F.pandas_udf(DoubleType())
def line_likeness(ours: pd.Series, theirs: pd.Series) -> pd.Series:
    """How much of two texts' line structure agrees."""
    return pd.Series([round(SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n"), autojunk=False).ratio(), 4) for a, b in zip(ours, theirs)])


def means(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean, n: each metric over the rows that have it."""
    parts = [scores.select(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("v is not null").groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))
