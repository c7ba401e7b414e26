"""Layout on a glyph table: lines, words, paragraphs and reading order.

A glyph row: page keys, ch, x, y (baseline, down the page), w (advance), size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAME_LINE, WORD_GAP, CUT_GAP = 0.3, 0.15, 1.1
PARAGRAPH_GAP = 1.3


def typeset(docs: DataFrame, key: str = "doc_id", text: str = "text", columns: int = 80, size: float = 10.0) -> DataFrame:
    """A text set in fixed advances, a row a drawn glyph: its lines become baselines; blanks move on and draw nothing."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("_line", "_t"))
    chars = lines.select(key, "_line", F.posexplode(F.split("_t", "")).alias("_at", "ch")).where(F.btrim("ch") != "")
    advance = size * 0.6
    return chars.select(key, "ch", (F.col("_at") * advance).alias("x"), (F.col("_line") * size * 1.2).alias("y"), F.lit(advance).alias("w"), F.lit(size).alias("size"))


def glyph_lines(glyphs: DataFrame, key: str = "doc_id") -> DataFrame:
    """glyphs with line: baselines within SAME_LINE of the size are one line. Row ids come first, then exact sorts."""
    down = Window.partitionBy(key).orderBy("y", "x")
    new = (F.col("y") - F.lag("y").over(down)) > F.col("size") * SAME_LINE
    return glyphs.withColumn("line", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))


def line_texts(lined: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, line, y, size, text, segments: a blank where the gap is a word's, a new segment where it is a cut."""
    along = Window.partitionBy(key, "line").orderBy("x")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(along)
    spaced = lined.withColumn("_lead", F.when(gap > F.col("size") * WORD_GAP, " ").otherwise("")).withColumn("_cut", F.coalesce(gap > F.col("size") * CUT_GAP, F.lit(False)).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "_lead", "ch"))), lambda g: F.concat(g["_lead"], g["ch"])), "")
    return spaced.groupBy(key, "line").agg(F.min("y").alias("y"), F.max("size").alias("size"), body.alias("text"), (F.sum("_cut") + 1).alias("segments"))


def paragraphs(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, paragraph, n_lines, text: a new one where the step is over PARAGRAPH_GAP times the median or sizes change."""
    down = Window.partitionBy(key).orderBy("line")
    step = F.col("y") - F.lag("y").over(down)
    stepped = lines.withColumn("_step", step)
    leading = stepped.groupBy(key).agg(F.percentile("_step", 0.5).alias("_leading")).withColumnRenamed(key, "_k")
    of = stepped.join(leading, F.col(key) == F.col("_k"))
    new = F.coalesce((F.col("_step") > F.col("_leading") * PARAGRAPH_GAP) | (F.col("size") != F.lag("size").over(down)), F.lit(False))
    of = of.withColumn("paragraph", F.sum(new.cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return of.groupBy(key, "paragraph").agg(F.count("*").alias("n_lines"), text.alias("text"))


def xy_cut(boxes: DataFrame, key: str = "page", least_gap: float = 8.0) -> DataFrame:
    """boxes (key, box, x0, y0, x1, y1) with place in reading order: vertical gutters first, then horizontal gaps.

    A page's boxes are few and the cut is recursive, so a page is one Python group.
    """

    def order(page: pd.DataFrame) -> pd.DataFrame:
        out: list[int] = []

        def widest(rows: pd.DataFrame, lo: str, hi: str) -> float | None:
            spans, reach, best = rows.sort_values([lo, hi])[[lo, hi]].to_numpy(), None, None
            for a, b in spans:
                if reach is not None and a - reach >= least_gap and (best is None or a - reach > best[0]):
                    best = (a - reach, (a + reach) / 2)
                reach = b if reach is None else max(reach, b)
            return best[1] if best else None

        def cut(rows: pd.DataFrame) -> None:
            for lo, hi in (("x0", "x1"), ("y0", "y1")):
                at = widest(rows, lo, hi) if len(rows) > 1 else None
                if at is not None:
                    cut(rows[rows[hi] <= at])
                    cut(rows[rows[lo] >= at])
                    return
            out.extend(rows.sort_values(["y0", "x0", "box"])["box"].tolist())

        cut(page)
        place = {b: i for i, b in enumerate(out)}
        return page.assign(place=[place[b] for b in page["box"]])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema) + ", place long"
    return boxes.groupBy(key).applyInPandas(order, schema)
