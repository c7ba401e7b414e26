"""Operator 2: removal of repeated passages by prefix-partitioned suffix trees.

A passage repeats if WINDOW consecutive words of one document start in another. Suffixes are split into groups by a
prefix: the PREFIX-word sequence of least hash within the suffix's first WINDOW words, so that suffixes with equal
first WINDOW words share a group and neighbouring suffixes mostly do too and travel as one span of text (a prefix at a
fixed place would send each suffix apart, with WINDOW words of its own). Prefixes that occur in one document only are
dropped first. A group beyond GROUP spans is split by longer prefixes, up to WINDOW words: at that length the group is
itself a deep node of the tree, and its least document comes from an aggregate. The other groups fit in memory: their
suffixes are sorted by doubling prefix lengths, and those that agree on WINDOW words hang below one deep internal
node; runs of such suffixes are the repeats. Whole copies, and then equal spans of a group, are collapsed to the
smallest doc_id before trees are built.

Null and empty texts have no words. A null doc_id ranks last. Repeated rows, and rows with one doc_id, are judged each
by themselves against smaller doc_ids only. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import stored, table

WINDOW = 50
PREFIX = 8
#: Most spans of a group that one task takes; a larger group is split by prefixes of full length.
GROUP = 8192
#: Words a task sorts at once: whole groups, at most this many words beyond one group.
BATCH_WORDS = 1_000_000
LAST = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_GAPS = np.zeros(256, bool)
_GAPS[[32, 9, 10, 11, 12, 13]] = True
_LETTERS = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[str, np.ndarray] = {}


def word_ids(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word: differences of one running sum over the text's bytes."""
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    if n + 1 > len(_CACHE.get("up", ())):
        size = max(1 << 16, 2 * n)
        _CACHE["up"], _CACHE["down"] = _powers(_BASE, size), _powers(_INVERSE, size)
    gap = _GAPS[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, gap, True]))
    starts, ends = edge[0::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[raw] * _CACHE["up"][:n], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * _CACHE["down"][starts] + (ends - starts).astype(np.uint64))


def _slid(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of over each run of width neighbours."""
    n, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x, k = of(x[:-k], x[k:]), 2 * k
    return of(x[:n], x[width - k : width - k + n]) if k < width else x[:n]


def prefixes(ids: np.ndarray) -> np.ndarray:
    """For each suffix of WINDOW words or more, the hash of its group's prefix."""
    n = len(ids) - PREFIX + 1
    grams = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        grams = grams * _BASE + ids[j : j + n]
    return _slid(_mixed(grams), WINDOW - PREFIX + 1, np.minimum)


def window_hashes(ids: np.ndarray) -> np.ndarray:
    """A hash of each suffix's first WINDOW words."""
    n = len(ids) - WINDOW + 1
    out = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        out = out * _INVERSE + ids[j : j + n]
    return _mixed(out)


def _outlined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sha, count, keys = [], [], []
            for text in part.column(2).to_pylist():
                ws = (text or b"").split()
                sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
                count.append(len(ws))
                keys.append(np.unique(prefixes(word_ids(text))).view(np.int64) if len(ws) >= WINDOW else [])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sha), pa.array(count, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "row", "sha", "n_words", "keys"])


_PIECES = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("same", pa.int64()), ("body", pa.binary())])


def _packed(ids: np.ndarray) -> bytes:
    """48 bits of each id: words that differ within a passage of 50 equal ones otherwise must differ there."""
    return np.ascontiguousarray(ids).view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _unpacked(body: bytes) -> np.ndarray:
    wide = np.zeros((len(body) // 6, 4), "<u2")
    wide[:, :3] = np.frombuffer(body, "<u2").reshape(-1, 3)
    return wide.view("<u8").ravel()


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text, keys): spans of text for each group that a document has suffixes in, with their hashes."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            out: list[tuple] = []
            for doc, row, text, keys in zip(*(part.column(i).to_pylist() for i in range(4))):
                ids = word_ids(text)
                of = prefixes(ids)
                held = np.isin(of, np.array(keys, np.int64).view(np.uint64))
                runs = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                for a, b in zip(runs.tolist(), [*runs[1:].tolist(), len(of)]):
                    if held[a]:
                        body = _packed(ids[a : b + WINDOW - 1])
                        same = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
                        out.append((int(of[a].view(np.int64)), doc, row, a, same, body))
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES)


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, start, body): the hash of each suffix's first WINDOW words."""
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])
    for batch in batches:
        for doc, row, start, body in zip(*(c.to_pylist() for c in batch.columns)):
            keys = window_hashes(_unpacked(body)).view(np.int64)
            n = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(np.arange(start, start + n, dtype=np.int32))], schema=schema)


def deep_nodes(spans: list[np.ndarray], groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix tree of the spans down to WINDOW words: for each suffix (span, place in it), its deep node.

    Suffixes are ranked by their first 1, 2, 4, ... words; equal ranks at WINDOW words are one node.
    """
    lengths = np.array([len(s) for s in spans])
    starts = np.cumsum(lengths) - lengths
    _, rank = np.unique(np.concatenate(spans), return_inverse=True)
    rank = rank.astype(np.int64)
    own = np.repeat(np.arange(len(spans)), lengths)

    def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        _, out = np.unique(left * (int(right.max(initial=0)) + 2) + right + 1, return_inverse=True)
        return out.astype(np.int64)

    shifted = lambda r, k: np.r_[r[k:], np.full(min(k, len(r)), -1)]
    k = 1
    while 2 * k <= WINDOW:
        rank, k = paired(rank, shifted(rank, k)), 2 * k
    if k < WINDOW:
        rank = paired(rank, shifted(rank, WINDOW - k))
    place = np.arange(len(own)) - starts[own]
    real = place <= lengths[own] - WINDOW
    return own[real], place[real], paired(groups[own[real]], rank[real])


_RANGES = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _subtrees(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, row, start, body) sorted by key: the suffixes to remove, as ranges of their first words."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        keys, docs, rows, starts, bodies = zip(*held)
        docs, starts = np.array(docs), np.array(starts)
        _, groups = np.unique(np.array(keys), return_inverse=True)
        own, place, node = deep_nodes([_unpacked(b) for b in bodies], groups.astype(np.int64))
        least = np.full(node.max() + 1, LAST)
        np.minimum.at(least, node, docs[own])
        out = np.flatnonzero(least[node] < docs[own])
        own, at = own[out], starts[own[out]] + place[out]
        first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)]) if len(out) else np.array([], int)
        last = np.r_[first[1:], len(out)] - 1 if len(out) else first
        rows = np.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(docs[own[first]], pa.int64()), pa.array(rows[own[first]], pa.int64()), pa.array(at[first].astype(np.int32)), pa.array((at[last] + 1).astype(np.int32))], schema=_RANGES)

    for batch in batches:
        for item in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if size > BATCH_WORDS and item[0] != held[-1][0]:
                yield flush()
                held, size = [], 0
            held.append(item)
            size += len(item[4]) // 6
    if held:
        yield flush()


def _kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text, starts, ends): what is left of each text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            removed, sha, left = [], [], []
            for text, starts, ends in zip(*(part.column(i).to_pylist() for i in (2, 3, 4))):
                ws = text.split()
                edges = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edges, starts, 1)
                np.add.at(edges, np.array(ends) - 1 + WINDOW, -1)
                cut = np.cumsum(edges[:-1]) > 0
                body = b" ".join([w for w, c in zip(ws, cut.tolist()) if not c])
                removed.append(int(cut.sum()))
                sha.append(hashlib.sha256(body).hexdigest())
                left.append(body)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(removed, pa.int64()), pa.array(sha), pa.array(left, pa.binary()).cast(pa.string())], ["r_doc", "r_row", "removed", "left_sha", "left_text"])


def removed(docs: DataFrame, text: str = "text", texts: bool = True) -> DataFrame:
    """A row a document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    kept_text is null where nothing was removed and the empty text where all was.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).cast("binary").alias("text"))
    outline = stored(rows.mapInArrow(_outlined, "doc long, row long, sha string, n_words long, keys array<long>"))
    first = outline.groupBy("sha").agg(F.min(F.struct("doc", "row", "keys")).alias("x"))
    whole = stored(first.select("sha", "x.doc", "x.row", "x.keys"))

    spread = whole.select("doc", "row", F.explode("keys").alias("key"))
    twice = spread.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select(F.col("key").alias("k"))
    wanted = spread.join(twice, F.col("key") == F.col("k")).groupBy("doc", "row").agg(F.collect_list("key").alias("keys"))
    wanted = wanted.select(F.col("doc").alias("w_doc"), F.col("row").alias("w_row"), "keys")
    near = rows.join(wanted, (F.col("doc") == F.col("w_doc")) & (F.col("row") == F.col("w_row")))
    near = stored(near.dropDuplicates(["doc", "row"]).select("doc", "row", "text", "keys"))

    # Equal spans first: all but those of the smallest document are repeats as a whole and go no further.
    pieces = stored(near.mapInArrow(_pieces, "key long, doc long, row long, start int, same long, body binary"))
    first = stored(pieces.groupBy("key", "same").agg(F.min("doc").alias("least"))).withColumnsRenamed({"key": "k", "same": "s"})
    own = F.when(F.col("doc") == F.col("least"), F.col("body"))
    judged = pieces.join(first, (F.col("key") == F.col("k")) & (F.col("same") == F.col("s")))
    judged = stored(judged.select("key", "doc", "row", "start", own.alias("body"), (F.col("start") + F.length("body") / 6 - (WINDOW - 1)).cast("int").alias("end")))
    found = judged.where("body is null").select("doc", "row", "start", "end")

    spans = judged.where("body is not null").select("key", "doc", "row", "start", "body")
    big = stored(spans.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(F.col("key").alias("k")))
    if not big.isEmpty():
        full = spans.join(big, F.col("key") == F.col("k"), "left_semi").select("doc", "row", "start", "body").mapInArrow(_windows, "key long, doc long, row long, start int")
        full = stored(full)
        least = full.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select(F.col("key").alias("k"), "least")
        deep = full.join(least, F.col("key") == F.col("k")).where("doc > least").select("doc", "row", "start", (F.col("start") + 1).alias("end"))
        found = found.union(deep)
        spans = spans.join(big, F.col("key") == F.col("k"), "left_anti")
    found = found.union(spans.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_subtrees, "doc long, row long, start int, end int"))
    ranges = found.groupBy("doc", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    ranges = ranges.select(F.col("doc").alias("r_doc"), F.col("row").alias("r_row"), "starts", "ends")
    cut = near.join(ranges, (F.col("doc") == F.col("r_doc")) & (F.col("row") == F.col("r_row"))).select("doc", "row", "text", "starts", "ends")
    left = cut.mapInArrow(_kept, "r_doc long, r_row long, removed long, left_sha string, left_text string")
    left = stored(left if texts else left.drop("left_text"))

    # Rows of one doc_id with the same words are judged alike, whatever white space is between the words.
    owner = whole.join(left, (F.col("doc") == F.col("r_doc")) & (F.col("row") == F.col("r_row")), "left").drop("keys", "r_doc", "r_row", "row")
    owner = owner.withColumnsRenamed({"sha": "o_sha", "doc": "owner"})
    out = outline.drop("keys").join(owner, F.col("sha") == F.col("o_sha"))
    own = F.col("doc") == F.col("owner")
    copy = (F.col("owner") < F.col("doc")) & (F.col("n_words") >= WINDOW)
    found = [
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce(F.when(own, F.col("removed")), F.lit(0))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce(F.when(own, F.col("left_sha")), "sha")).alias("kept_sha256"),
    ]
    return out.select(*found, *([F.when(copy, F.lit("")).otherwise(F.when(own, F.col("left_text"))).alias("kept_text")] if texts else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(table(spark, sf_dir, "documents"), texts=False)
