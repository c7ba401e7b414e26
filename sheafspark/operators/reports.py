"""Page confidence and decisions, report order, sheet-wide rewriting, spacer columns and column alignment.

All work is by row or by aggregates of a sheet, page or report; nulls count as absent signs or empty cells, and empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions import text as T

#: Weights and full marks of the signs that lower a page's confidence, and the thresholds of decisions.
WEIGHTS = {"lost": 0.5, "glued": 0.3, "guess": 0.15, "tree": 0.15, "covered": 0.1, "ambig": 0.1, "samples": 0.05}
LOST_FULL, GLUED_FULL, AMBIG_FULL, SAMPLES_LEAST, TREE_VOTES = 0.2, 0.25, 0.5, 20, 3
OCR_GLYPHS, OCR_PICTURES, LOST_TEXT, LEAST_CONFIDENCE = 0, 0.5, 0.2, 0.45
ARABIC_UNSEEN, ARABIC_SINGLE, ARABIC_PUNCT, LATIN_SIGNS, LATIN_UNSEEN, LATIN_PAIRS, LEAST_LETTERS, ODD = 0.08, 0.08, 0.075, 0.25, 0.12, 100, 150, 0.2


def _share(a, b) -> Column:
    a, b = (x if isinstance(x, Column) else F.col(x) for x in (a, b))
    return F.when(b > 0, F.coalesce(a, F.lit(0)) / F.when(b > 0, b)).otherwise(0.0)


def _clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def confidence(pages: DataFrame) -> DataFrame:
    """pages with confidence: 1 less the weighted signs.

    Columns: glyphs, lost, words, glued, covered, guessed, tree_votes, tree_agree, ambig, gaps, samples (null: not measured).
    """
    w = WEIGHTS
    loss = (
        w["lost"] * _clamp(_share("lost", "glyphs") / LOST_FULL)
        + w["glued"] * _clamp(_share("glued", "words") / GLUED_FULL)
        + w["covered"] * _clamp(_share("covered", "glyphs"))
        + w["guess"] * _clamp(_share("guessed", "glyphs"))
        + F.when(F.col("tree_votes") >= TREE_VOTES, w["tree"] * _clamp(1 - _share("tree_agree", "tree_votes"))).otherwise(0.0)
        + w["ambig"] * _clamp(_share("ambig", "gaps") / AMBIG_FULL)
        + F.when(F.col("samples").isNotNull(), w["samples"] * _clamp(1 - F.col("samples") / SAMPLES_LEAST)).otherwise(0.0)
    )
    return pages.withColumn("confidence", F.round(_clamp(1 - loss), 3))


def decided(pages: DataFrame, mode: str = "auto") -> DataFrame:
    """pages (confidence's, with flags, picture_share and failed) with decision and why, by the first rule that holds.

    mode full never lowers a page, safe reads every page in the simplified way at least.
    """
    has = lambda f: F.array_contains("flags", f)
    rules = [
        (F.lit(mode == "full"), "full", ""),
        (F.col("failed") == "extract", "textContent", "extractFailed"),
        (F.col("failed") == "lines", "textContent", "layoutFailed"),
        (F.col("failed") == "layout", "simplified", "layoutFailed"),
        ((F.coalesce("glyphs", F.lit(0)) <= OCR_GLYPHS) & (F.coalesce("picture_share", F.lit(0.0)) >= OCR_PICTURES), "ocr", "noText"),
        ((F.col("glyphs") > 0) & (_share("lost", "glyphs") >= LOST_TEXT), "simplified", "lostGlyphs"),
        (has("suspectSpaces") & has("lostGlyphs"), "simplified", "suspectSpaces,lostGlyphs"),
        (F.col("confidence") < LEAST_CONFIDENCE, "simplified", "lowConf"),
        (F.lit(mode == "safe"), "simplified", "safeMode"),
    ]
    pick = lambda k: F.coalesce(*(F.when(c, (d, w)[k]) for c, d, w in rules), F.lit(("full", "")[k]))
    return pages.withColumns({"decision": pick(0), "why": pick(1)})


def language_verdict(measures: DataFrame) -> DataFrame:
    """measures with why (codes of what speaks against a language) and odd (advisory).

    Columns: ar_letters and the shares ar_unseen, ar_single, ar_punct; la_chars, la_letters, la_pairs and the shares
    la_signs, la_unseen, la_odd. No verdict is given on under LEAST_LETTERS letters.
    """
    arabic = F.col("ar_letters") >= LEAST_LETTERS
    latin = (F.col("la_chars") >= LEAST_LETTERS) & (F.col("la_letters") >= F.col("ar_letters"))
    codes = [
        (arabic & (F.col("ar_unseen") > ARABIC_UNSEEN), "pairs"),
        (arabic & (F.col("ar_single") > ARABIC_SINGLE), "letters"),
        (arabic & (F.col("ar_punct") > ARABIC_PUNCT), "signs"),
        (latin & (F.col("la_signs") > LATIN_SIGNS), "latin1"),
        (latin & (F.col("la_pairs") >= LATIN_PAIRS) & (F.col("la_unseen") > LATIN_UNSEEN), "latinPairs"),
    ]
    return measures.withColumns({"why": F.concat_ws(",", *(F.when(c, k) for c, k in codes)), "odd": F.coalesce(latin & (F.col("la_odd") > ODD), F.lit(False))})


def findings(rows: DataFrame, report: str, order: str, warn: str) -> DataFrame:
    """rows with place (from 1): within each report the warnings first, then the rest, each in their order."""
    w = Window.partitionBy(report).orderBy(F.desc(F.coalesce(F.col(warn), F.lit(False))), order)
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def written_out(cells: DataFrame, sheet: str, value: str, numbers: bool = True, letters: bool = True) -> DataFrame:
    """cells with value rewritten: digits in ASCII, and Persian letters if any cell of the sheet shows Persian.

    The evidence is an aggregate a sheet, joined back: no sheet is gathered.
    """
    own = F.col(value)
    seen = cells.groupBy(F.col(sheet).alias("_sheet")).agg(F.bool_or(own.rlike(T.PERSIAN_EVIDENCE)).alias("_fa"), F.bool_or(own.rlike(T.URDU_KURDISH)).alias("_ur"))
    rows = cells.join(seen, F.col(sheet).eqNullSafe(F.col("_sheet")))
    if letters:
        base = F.translate(own, "يىك", "ییک")
        own = F.when(F.col("_fa") & F.col("_ur"), base).when(F.col("_fa"), F.translate(base, "ەھ", "هه")).otherwise(own)
    return rows.withColumn(value, T.ascii_numbers(own) if numbers else own).drop("_sheet", "_fa", "_ur")


def without_spacer(cells: DataFrame, sheet: str = "sheet", column: str = "c", value: str = "value") -> DataFrame:
    """cells (long form) without a sheet's last column if that holds blanks of one space, or nothing, and some space."""
    of = cells.groupBy(F.col(sheet).alias("_s"), F.col(column).alias("_c")).agg(F.bool_and(F.coalesce(value, F.lit("")).isin("", " ")).alias("_blank"), F.bool_or(F.coalesce(value, F.lit("")) == " ").alias("_space"))
    last = of.groupBy("_s").agg(F.max(F.struct("_c", "_blank", "_space")).alias("x")).where("x._blank and x._space").select("_s", F.col("x._c").alias("_c"))
    return cells.join(last, F.col(sheet).eqNullSafe(F.col("_s")) & (F.col(column) == F.col("_c")), "left_anti")


def column_align(cells: DataFrame, keys: list[str], x0: str = "x0", x1: str = "x1", loose: bool = False) -> DataFrame:
    """keys and align of each column of left-to-right cells: right or center by the spread of their edges, else empty."""
    k = 2 if loose else 1
    spread = lambda x: F.max(x) - F.min(x)
    s = cells.groupBy(*keys).agg(F.count("*").alias("n"), spread(F.col(x0)).alias("l"), spread(F.col(x1)).alias("r"), spread((F.col(x0) + F.col(x1)) / 2).alias("m"))
    wide, even = 2.5 * k, 1.5 * k
    align = F.when(F.col("n") < 2, "").when((F.col("r") < even) & (F.col("l") > wide), "right").when((F.col("m") < even) & (F.col("l") > wide) & (F.col("r") > wide), "center").otherwise("")
    return s.select(*keys, align.alias("align"))
