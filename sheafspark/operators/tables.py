"""Sheets: rows as Markdown or CSV text, tables found in Markdown, trimming, widths, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions.text import cell_class, coerce, csv_field, natural_key, strip_marks, table_cell, text_width
from sheafspark.operators.lines import doc_lines, outside_fences


def _ordered(lines: Column, by: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("by"), lines.alias("line")))), lambda x: x["line"]), "\n")


def to_markdown(rows: DataFrame, sheet: str, order: str, columns: list[str], level: int = 2) -> DataFrame:
    """sheet, markdown: a heading and a table a sheet. A sheet is one text, so it is put together in one task."""
    line = F.concat(F.lit("| "), F.array_join(F.array(*(table_cell(F.col(c).cast("string")) for c in columns)), " | "), F.lit(" |"))
    head = f"| {' | '.join(columns)} |\n|{' --- |' * len(columns)}\n"
    title = F.when(F.coalesce(F.col(sheet), F.lit("")) == "", "—").otherwise(F.col(sheet))
    return rows.groupBy(sheet).agg(_ordered(line, F.col(order)).alias("_body")).select(sheet, F.concat(F.lit("#" * min(max(level, 1), 6) + " "), title, F.lit("\n\n" + head), F.col("_body"), F.lit("\n")).alias("markdown"))


def to_csv_lines(rows: DataFrame, columns: list[str], sep: str = ",") -> Column:
    return F.array_join(F.array(*(csv_field(F.coalesce(F.col(c).cast("string"), F.lit("")), sep) for c in columns)), sep)


def find_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, table_no (from 1), name, row (0: header), cells: every table outside code.

    A table is a run of table lines whose second is a delimiter row. Its name is the bold line or heading nearest
    above, else Table and its number.
    """
    w = Window.partitionBy(key).orderBy("line_no")
    lines = outside_fences(doc_lines(docs, key, text), key)
    is_row = (F.col("kind") == "table") & ~F.col("in_code")
    lines = lines.withColumn("_row", is_row).withColumn("_starts", F.col("_row") & ~F.coalesce(F.lag("_row").over(w), F.lit(False)))
    bold = F.regexp_extract("line", r"^[ \t]*\*\*([^*]+)\*\*[ \t]*:?[ \t]*$", 1)
    title = F.when((F.col("kind") == "heading") & ~F.col("in_code"), F.regexp_replace("line", r"^ {0,3}#{1,6}[ \t]+", "")).when((bold != "") & ~F.col("in_code"), bold)
    lines = lines.withColumn("_name", F.last(title, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_island", F.sum(F.col("_starts").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = lines.where("_row")
    of = Window.partitionBy(key, "_island").orderBy("line_no")
    delimiter = F.col("line").rlike(r"^[ \t]*\|(?:[ \t]*:?-+:?[ \t]*\|)+[ \t]*$")
    body = body.withColumn("_at", F.row_number().over(of)).withColumn("_real", F.max(((F.col("_at") == 2) & delimiter).cast("int")).over(Window.partitionBy(key, "_island")) == 1).where("_real and _at <> 2")
    cells = F.split(F.regexp_replace("line", r"^[ \t]*\|[ \t]*|[ \t]*\|[ \t]*$", ""), r"[ \t]*(?<!\\)\|[ \t]*")
    number = F.dense_rank().over(Window.partitionBy(key).orderBy("_island"))
    out = body.withColumn("table_no", number.cast("long"))
    name = F.coalesce(strip_marks(F.col("_name")), F.concat(F.lit("Table "), F.col("table_no").cast("string")))
    return out.select(key, "table_no", name.alias("name"), F.when(F.col("_at") == 1, 0).otherwise(F.col("_at") - 2).cast("long").alias("row"), F.transform(cells, lambda c: F.replace(c, F.lit("\\|"), F.lit("|"))).alias("cells"))


def long_cells(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, c (from 0), v: a row a cell."""
    return rows.select(*keys, F.posexplode(F.array(*(F.col(c).cast("string") for c in columns))).alias("c", "v"))


def trimmed(cells: DataFrame, sheet: str) -> DataFrame:
    """cells (sheet, r, c, v) without blank rows above and below the data and without empty columns at the end."""
    full = cells.where(F.btrim(F.coalesce("v", F.lit(""))) != "").groupBy(sheet).agg(F.min("r").alias("_top"), F.max("r").alias("_end"), F.max("c").alias("_wide"))
    return cells.join(full, sheet).where("r between _top and _end and c <= _wide").select(sheet, (F.col("r") - F.col("_top")).alias("r"), "c", F.coalesce(F.btrim("v"), F.lit("")).alias("v"))


def coerced(rows: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("string")
    return rows.withColumns({"number": coerce(v), "class": cell_class(v)})


def column_widths(rows: DataFrame, columns: list[str], outlier: float = 1.25) -> DataFrame:
    """column_no, width: the widest cell, or the 95th percentile if the widest is over 1.25 times it."""
    cells = long_cells(rows, [], columns).select("c", text_width(F.coalesce("v", F.lit(""))).alias("w"))
    stats = cells.groupBy("c").agg(F.max("w").alias("most"), F.percentile("w", 0.95).alias("p95"))
    return stats.select(F.col("c").cast("long").alias("column_no"), F.round(F.when(F.col("most") > F.col("p95") * outlier, F.col("p95")).otherwise(F.col("most")), 4).alias("width"))


def unique_names(rows: DataFrame, name: str, order: str, limit: int = 31) -> DataFrame:
    """rows with unique: names made distinct without regard to case, later ones with -2, -3 within the limit."""
    n = F.row_number().over(Window.partitionBy(F.lower(name)).orderBy(order))
    suffix = F.concat(F.lit("-"), n.cast("string"))
    return rows.withColumn("unique", F.when(n == 1, F.substring(name, 1, limit)).otherwise(F.concat(F.col(name).substr(F.lit(1), F.lit(limit) - F.length(suffix)), suffix)))


def natural_places(rows: DataFrame, name: str, tie: str) -> DataFrame:
    """rows with place: from 1, in natural order of name (a2 before a10), then tie; null names first.

    Names are counted by their beginning and first number, and places begin where these counts end: only a row for each
    beginning meets in one task. Names that agree in both are ranked together.
    """
    letters, number, low = natural_key(F.col(name))
    keyed = rows.withColumns({"_letters": letters, "_number": number, "_low": low})
    counted = keyed.groupBy(F.col("_letters").alias("_l"), F.col("_number").alias("_m")).agg(F.count("*").alias("_c"))
    above = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = counted.groupBy("_l").agg(F.sum("_c").alias("_c")).select(F.col("_l").alias("_h"), F.coalesce(F.sum("_c").over(above(Window.orderBy("_l"))), F.lit(0)).alias("_base"))
    counted = counted.withColumn("_before", F.coalesce(F.sum("_c").over(above(Window.partitionBy("_l").orderBy("_m"))), F.lit(0)))
    start = counted.join(first, F.col("_l").eqNullSafe(F.col("_h"))).select("_l", "_m", (F.col("_base") + F.col("_before")).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_letters", "_number").orderBy("_low", tie))
    placed = keyed.withColumn("_in", within).join(start, F.col("_letters").eqNullSafe(F.col("_l")) & F.col("_number").eqNullSafe(F.col("_m")))
    return placed.withColumn("place", F.col("_start") + F.col("_in")).drop("_letters", "_number", "_low", "_l", "_m", "_start", "_in")


def distributed(widths: DataFrame, table: str, least: str, most: str, room: float) -> DataFrame:
    """widths with width: all columns at most if they fit, in proportion to least if not even those do, else between."""
    w = Window.partitionBy(table)
    lo, hi = F.sum(least).over(w), F.sum(most).over(w)
    between = F.col(least) + (F.lit(room) - lo) * (F.col(most) - F.col(least)) / (hi - lo)
    return widths.withColumn("width", F.when(hi <= room, F.col(most) * room / hi).when(lo >= room, F.col(least) * room / lo).otherwise(between))


def summary(sheets: DataFrame) -> DataFrame:
    """sheets (sheet, rows, cols) and a total row: rows added, the most columns."""
    return sheets.unionByName(sheets.agg(F.lit("total").alias("sheet"), F.sum("rows").alias("rows"), F.max("cols").alias("cols")))


def chart_series(rows: DataFrame, category: str, columns: list[str]) -> DataFrame:
    """category, series, value: each column that has a number is a series."""
    parts = [rows.select(category, F.lit(c).alias("series"), F.col(c).cast("double").alias("value")) for c in columns]
    return reduce(DataFrame.unionByName, parts).where("value is not null")
