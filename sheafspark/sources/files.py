"""Sources of files: encodings, delimited text, workbooks, archives; and sinks of text files."""

from __future__ import annotations

import csv
import io
import itertools
import posixpath
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.functions.values import front_matter  # noqa: F401 - of texts read here

#: A sheet's grid may have so many cells, or a hundred for each that is there.
MOST_CELLS = 5_000_000
SEPARATORS = (",", ";", "\t", "|")
#: Extensions of documents in an archive, of images, and the reason others are left out by.
DOCUMENTS, IMAGES, NAMED = {"md", "markdown", "txt", "html", "htm", "csv", "docx"}, {"png", "jpg", "jpeg", "gif", "svg", "webp", "bmp"}, {"pdf", "xlsx"}
#: A field of delimited text may be as long as its file.
csv.field_size_limit(2**31 - 1)


def sniffed(data: bytes) -> str:
    """utf-8, utf-16le, utf-16be or windows-1256."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16le"), (b"\xfe\xff", "utf-16be")):
        if data.startswith(mark):
            return name
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return "windows-1256"
    arabic = lambda t: sum("؀" <= c <= "ۿ" for c in t)
    high = [c for c in text if c > "\x7f"]
    if high and not arabic(text):
        other = [c for c in data.decode("cp1256", "replace") if c > "\x7f"]
        if other and arabic(other) >= 0.9 * len(other):
            return "windows-1256"
    return "utf-8"


def decoded(data: bytes, encoding: str) -> str:
    python = {"windows-1256": "cp1256", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}.get(encoding, encoding)
    return data.decode(python, "replace").removeprefix("﻿")


def parsed_rows(text: str, separator: str | None = None) -> tuple[str, list[list[str]]]:
    """(separator, rows without blank edges): the separator that gives the first 200 rows the most equal columns."""

    def read(sep: str) -> list[list[str]]:
        return [[c.strip() for c in r] for r in csv.reader(io.StringIO(text, newline=""), delimiter=sep)]

    def fit(sep: str) -> tuple[float, int]:
        head = csv.reader(io.StringIO(text, newline=""), delimiter=sep)
        sizes = list(itertools.islice((len(r) for r in head if any(c.strip() for c in r)), 200))
        most = max(set(sizes), key=sizes.count) if sizes else 0
        return (sizes.count(most) / len(sizes) if most > 1 else 0, most)

    sep = separator or max(SEPARATORS, key=fit)
    return sep, trim_rows(read(sep))


def trim_rows(rows: list[list[str]]) -> list[list[str]]:
    full = [i for i, r in enumerate(rows) if any(c.strip() for c in r)]
    if not full:
        return []
    rows = rows[full[0] : full[-1] + 1]
    wide = max(i + 1 for r in rows for i, c in enumerate(r) if c.strip())
    return [(r + [""] * wide)[:wide] for r in rows]


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_STRING, _TABLE = T.StringType(), T.ArrayType(T.ArrayType(T.StringType()))


@F.pandas_udf(_struct(encoding=_STRING, separator=_STRING, error=_STRING, rows=_TABLE))
def delimited(content: pd.Series) -> pd.DataFrame:
    out = []
    for data in content:
        encoding = sniffed(data)
        text = decoded(data, encoding)
        if not text.strip():
            out.append((encoding, None, "empty", []))
            continue
        separator, rows = parsed_rows(text)
        out.append((encoding, separator, None, rows))
    return pd.DataFrame(out, columns=["encoding", "separator", "error", "rows"])


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """path, encoding, separator, error, r, cells of every file below a path: encodings and separators are found."""
    files = spark.read.format("binaryFile").load(path).select("path", delimited("content").alias("f"))
    return files.select("path", "f.encoding", "f.separator", "f.error", F.posexplode_outer("f.rows").alias("r", "cells"))


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def workbook(data: bytes, merged: str = "empty") -> list[tuple[str, bool, list[list[str]]]]:
    """(name, hidden, rows) of each sheet in workbook order; merged cells: the value once, or repeated down."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            ref = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            tree = ElementTree.fromstring(z.read(posixpath.normpath(posixpath.join("xl", targets[ref])).lstrip("/")))
            cells: dict[tuple[int, int], str] = {}
            for c in (e for e in tree.iter() if local(e) == "c"):
                at = c.get("r")
                value = "".join(t.text or "" for t in c.iter() if local(t) in ("v", "t"))
                value = shared[int(value)] if c.get("t") == "s" and value else {"1": "TRUE", "0": "FALSE"}.get(value, value) if c.get("t") == "b" else value
                cells[int("".join(x for x in at if x.isdigit())) - 1, _column(at)] = value
            for m in (e for e in tree.iter() if local(e) == "mergeCell"):
                a, _, b = m.get("ref").partition(":")
                top, left = int("".join(x for x in a if x.isdigit())) - 1, _column(a)
                end = int("".join(x for x in b if x.isdigit())) - 1
                if merged == "repeat":
                    for r in range(top + 1, end + 1):
                        cells[r, left] = cells.get((top, left), "")
            high, wide = (max((k[i] for k in cells), default=-1) + 1 for i in (0, 1))
            if high * wide > MOST_CELLS and high * wide > 100 * len(cells):
                raise ValueError(f"sheet {sheet.get('name')}: {len(cells)} cells in a grid of {high} x {wide}")
            rows = [[cells.get((r, c), "") for c in range(wide)] for r in range(high)]
            out.append((sheet.get("name"), sheet.get("state") in ("hidden", "veryHidden"), rows))
    return out


def _told(read: Callable[[bytes], list[dict]], empty: dict) -> Callable[[pd.Series], pd.Series]:
    """read of each file; of one that can't be read, a single row with the reason in error."""

    def run(content: pd.Series) -> pd.Series:
        out = []
        for data in content:
            try:
                out.append([x | {"error": None} for x in read(data)])
            except (zipfile.BadZipFile, zlib.error, ElementTree.ParseError, KeyError, IndexError, ValueError, StopIteration, NotImplementedError, RuntimeError, EOFError) as why:
                out.append([empty | {"error": f"{type(why).__name__}: {why}"}])
        return pd.Series(out)

    return run


_SHEET = T.ArrayType(_struct(sheet=_STRING, hidden=T.BooleanType(), rows=_TABLE, error=_STRING))
sheets_of = F.pandas_udf(_told(lambda data: [{"sheet": n, "hidden": h, "rows": r} for n, h, r in workbook(data)], {"sheet": None, "hidden": None, "rows": None}), _SHEET)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet_no, sheet, hidden, error, r, cells of every workbook below a path; one that can't be read has an error."""
    files = spark.read.format("binaryFile").load(path).select("path", F.posexplode(sheets_of("content")).alias("sheet_no", "s"))
    return files.select("path", "sheet_no", "s.sheet", "s.hidden", "s.error", F.posexplode_outer("s.rows").alias("r", "cells"))


def member_reason(name: str, size: int, most: int | None = None) -> str:
    """document, image, hidden, or the reason a member is left out: pdf, xlsx, type, or size if a limit is given."""
    base, ext = posixpath.basename(name), posixpath.splitext(name)[1][1:].lower()
    if name.startswith("__MACOSX/") or base.startswith(".") or not base:
        return "hidden"
    if ext in IMAGES:
        return "image"
    if ext in NAMED:
        return ext
    if ext not in DOCUMENTS:
        return "type"
    return "size" if most is not None and size > most else "document"


_MEMBER = T.ArrayType(_struct(member=_STRING, reason=_STRING, size=T.LongType(), content=T.BinaryType(), error=_STRING))


def _members(data: bytes, most: int | None) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        rows = [(i, member_reason(i.filename, i.file_size, most)) for i in z.infolist()]
        return [{"member": i.filename, "reason": r, "size": i.file_size, "content": z.read(i) if r in ("document", "image") else None} for i, r in rows]


def read_archives(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """path, member, reason, size, content, error of every archive below a path; content only of documents and images.

    most: bytes beyond which a document is left out (none: no limit). An archive that can't be read has an error.
    """
    members_of = F.pandas_udf(_told(lambda data: _members(data, most), {"member": None, "reason": None, "size": None, "content": None}), _MEMBER)
    files = spark.read.format("binaryFile").load(path).select("path", F.explode(members_of("content")).alias("m"))
    return files.select("path", "m.member", "m.reason", "m.size", "m.content", "m.error")


def write_texts(rows: DataFrame, path: str, name: str, text: str) -> None:
    """A folder of text files, one a value of name."""
    rows.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").mode("overwrite").text(path)
