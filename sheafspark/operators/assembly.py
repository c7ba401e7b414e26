"""Putting documents together: previews, stacked sheets, list numbers, contents, headings, forms, boxes, direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions.text import LTR, RTL, is_ltr_text, strip_marks
from sheafspark.operators.lines import doc_lines, outside_fences

#: A list has levels 1 to this.
LIST_LEVELS = 9
FORM_LABEL = r"^([^:：\n]{1,40})[:：]"


def preview(rows: DataFrame, sheet: str, order: list[str], n: int = 20) -> DataFrame:
    """The first n rows of each sheet with place (from 1) and more: how many rows the sheet has beyond them.

    The limit on the rank is applied before the shuffle as well as after it; the counts are a separate aggregate.
    """
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(sheet).orderBy(*order)).cast("long")).where(F.col("place") <= n)
    sizes = rows.groupBy(F.col(sheet).alias("_sheet")).agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    return first.join(sizes, F.col(sheet).eqNullSafe(F.col("_sheet"))).drop("_sheet")


def stacked(sheets: DataFrame, name: str, n_rows: str, gap: int = 1) -> DataFrame:
    """sheets with title_row and first_row (from 0) in one sheet that holds all: a title, the rows, gap blank rows.

    The table has a row a sheet, so that a window over all of it is small.
    """
    before = F.coalesce(F.sum(F.col(n_rows) + 1 + gap).over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sheets.withColumn("title_row", before.cast("long")).withColumn("first_row", F.col("title_row") + 1)


def list_numbers(items: DataFrame, key: str, order: list[str], level: str) -> DataFrame:
    """items with number: the place among items of the same level since the last item of a shallower one."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shallower = F.array(*(F.sum((F.col(level) < k).cast("long")).over(so_far) for k in range(1, LIST_LEVELS + 1)))
    grouped = items.withColumn("_group", F.element_at(shallower, F.col(level).cast("int")))
    return grouped.withColumn("number", F.row_number().over(Window.partitionBy(key, level, "_group").orderBy(*order)).cast("long")).drop("_group")


def form_rows(lines: DataFrame, key: str, order: str, line: str, least: int = 3) -> DataFrame:
    """key, order, label, value of lines `label: value` that stand in runs of at least so many; a URL is no label."""
    w, body = Window.partitionBy(key).orderBy(order), F.col(line)
    label = F.regexp_extract(body, FORM_LABEL, 1)
    value = F.substring(body, F.length(label) + 2, F.length(body))
    found = lines.select(key, order, label.alias("label"), F.trim(value).alias("value"), ((label != "") & ~value.startswith("//")).alias("_form"))
    # Rows of one run have the same number of other lines before them.
    found = found.withColumn("_run", F.sum((~F.col("_form")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_form")
    return found.withColumn("_n", F.count("*").over(Window.partitionBy(key, "_run"))).where(F.col("_n") >= least).select(key, order, "label", "value")


def hidden_block(text: Column) -> Column:
    """The text in a fence longer than any run of backticks in it."""
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)


def in_boxes(points: DataFrame, boxes: DataFrame, page: str, band: float = 50.0) -> DataFrame:
    """points joined to the boxes of their page that hold them, upper edges excluded.

    points: page, x, y and more; boxes: page, x0, y0, x1, y1 and more. Boxes are dealt to bands of their page, so that
    points meet the boxes of one band only; a box has as many copies as it is bands high.
    """
    of = lambda y: F.floor(F.col(y) / band)
    dealt = boxes.where("x0 < x1 and y0 < y1").withColumn("_band", F.explode(F.sequence(of("y0"), of("y1"))))
    return points.withColumn("_band", of("y")).join(dealt, [page, "_band"]).where("x >= x0 and x < x1 and y >= y0 and y < y1").drop("_band")


def counted_in_boxes(points: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """boxes that hold points of their page, upper edges excluded, with points, how many; columns as in boxes.

    points: page, x, y; boxes: page, x0, y0, x1, y1 and more. No pair of a point and a box is made. Points alike and
    boxes alike are one row. A box's number is a sum over its corners of the points below and left of each, with a
    sign. Points below a height are a few runs of the page's sorted heights, of lengths that are powers of two and one
    of each at most; a point is in one run of each length, and within a run numbers are running sums by x. Work grows
    as rows times the logarithm of a page's heights; what meets in one task are a page's different heights, and a run's
    different places along x.
    """
    held = points.where("x IS NOT NULL AND y IS NOT NULL").groupBy(page, "x", "y").agg(F.count("*").alias("n"))
    edges = ["x0", "y0", "x1", "y1"]
    shapes = boxes.where("x0 < x1 AND y0 < y1").select(page, *edges).distinct()

    # rank: how many of the page's heights are below; edges come before a height equal to them.
    heights = held.select(page, F.col("y").alias("h")).distinct().withColumn("is_height", F.lit(1))
    tops = shapes.select(page, F.explode(F.array("y0", "y1")).alias("h")).distinct().withColumn("is_height", F.lit(0))
    by_page = Window.partitionBy(page)
    below = F.sum("is_height").over(by_page.orderBy("h", "is_height").rowsBetween(Window.unboundedPreceding, 0)) - F.col("is_height")
    ranks = heights.unionByName(tops).withColumns({"rank": below, "of": F.sum("is_height").over(by_page)})

    # Run j of length 2^l holds ranks from j * 2^l; ranks below r are, for each bit l set in r, run (r >> l) - 1.
    places = ranks.where("is_height = 1").select(F.col(page).alias("_p"), "h", "rank", "of")
    last = lambda v: F.floor(F.log2(v.cast("double"))).cast("int")
    levels = F.filter(F.sequence(F.lit(0), last(F.col("of"))), lambda v: F.expr("rank").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), v)) == 0)
    runs = held.join(places, (F.col(page) == F.col("_p")) & (F.col("y") == F.col("h"))).withColumn("l", F.explode(levels))
    runs = runs.groupBy(page, "l", F.call_function("shiftright", "rank", F.col("l")).alias("j"), "x").agg(F.sum("n").alias("n"))

    corner = lambda x, y, sign: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.lit(sign).alias("sign"))
    corners = shapes.withColumn("c", F.explode(F.array(corner("x1", "y1", 1), corner("x0", "y1", -1), corner("x1", "y0", -1), corner("x0", "y0", 1)))).select(page, *edges, "c.*")
    found = ranks.where("is_height = 0 AND rank > 0").select(F.col(page).alias("_p"), "h", "rank")
    asked = corners.select(page, "x", "y").distinct().join(found, (F.col(page) == F.col("_p")) & (F.col("y") == F.col("h")))
    bits = F.filter(F.sequence(F.lit(0), last(F.col("rank"))), lambda v: F.expr("rank").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), v)) != 0)
    asked = asked.withColumn("l", F.explode(bits)).select(page, "l", (F.call_function("shiftright", "rank", F.col("l")) - 1).alias("j"), "x", "y", F.lit(0).cast("long").alias("n"))
    # Questions (n = 0) come before the points at their x.
    so_far = Window.partitionBy(page, "l", "j").orderBy("x", "n").rowsBetween(Window.unboundedPreceding, 0)
    left = runs.withColumn("y", F.lit(None)).unionByName(asked).withColumn("n_left", F.sum("n").over(so_far)).where("n = 0")
    left = left.groupBy(F.col(page).alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y")).agg(F.sum("n_left").alias("_n"))
    sums = corners.join(left, (F.col(page) == F.col("_p")) & (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).groupBy(page, *edges).agg(F.sum(F.col("sign") * F.col("_n")).alias("points")).where("points > 0")
    return boxes.join(sums, [page, *edges]).select(*boxes.columns, "points")


def heading_levels(lines: DataFrame, key: str, size: str, times: float = 1.4) -> DataFrame:
    """key, size, lines, level: 1 for the largest size, and so on; null below so many times the body's size.

    The body's size is the most frequent one, the smallest of several. Lines are counted by size before any ranking.
    """
    sizes = lines.where(F.col(size).isNotNull()).groupBy(key, size).agg(F.count("*").alias("lines"))
    body = F.max(F.struct("lines", (-F.col(size)).alias("less"))).over(Window.partitionBy(key))["less"] * -1
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(size).desc()))
    return sizes.withColumn("_body", body).select(key, size, "lines", F.when(F.col(size) >= F.col("_body") * times, rank.cast("long")).alias("level"))


def contents(docs: DataFrame, key: str, text: str, deepest: int = 3) -> DataFrame:
    """key, toc: a nested list of links to the headings outside code down to a level; repeated ids get -1, -2."""
    found = outside_fences(doc_lines(docs, key, text), key).where("kind = 'heading' and not in_code")
    marks = F.length(F.regexp_extract("line", r"^ {0,3}(#+)", 1))
    title = strip_marks(F.regexp_replace("line", r"^ {0,3}#+[ \t]+|[ \t]+#*[ \t]*$", ""))
    heads = found.select(key, "line_no", marks.alias("level"), title.alias("title")).where(F.col("level") <= deepest)
    slug = F.regexp_replace(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N} _-]", ""), " +", "-")
    heads = heads.withColumn("slug", slug).withColumn("_n", F.row_number().over(Window.partitionBy(key, "slug").orderBy("line_no")) - 1)
    link = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.lit("- ["), F.col("title"), F.lit("](#"), F.col("slug"), F.when(F.col("_n") > 0, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(")"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", link.alias("link"))))
    return heads.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["link"]), "\n").alias("toc"))


def document_direction(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, direction: that of the first line with letters, prose before table rows; documents without letters have none."""
    lines = doc_lines(docs, key, text).where(F.col("line").rlike(f"{RTL}|{LTR}"))
    way = F.when(is_ltr_text(F.col("line")), "ltr").otherwise("rtl")
    return lines.groupBy(key).agg(F.min_by(way, F.struct(F.col("kind") == "table", F.col("line_no"))).alias("direction"))
