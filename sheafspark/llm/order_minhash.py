"""Operator 7: document fingerprints by Order MinHash.

The GRAM-character sequences of a text are numbered by occurrence. Each of SKETCHES hash functions selects the TUPLE
least of them; their hash in text order is one entry of the fingerprint, so an entry changes with the order of the
selected sequences as well as with their presence. Likeness is the share of equal entries.

A null text is an empty one; texts shorter than GRAM are one sequence, an empty text has none, and two texts without
sequences are alike (1). Repeated rows are fingerprinted each by themselves. In the succession of documents a null
doc_id comes last and ties go by text. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import table

GRAM = 6
TUPLE = 2
SKETCHES = 64
BLOCK = 4096
LAST = (1 << 63) - 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(11).integers(1, 1 << 31, SKETCHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TOP = np.uint32((1 << 32) - 1)
_PLACE = np.uint64((1 << 24) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(points: np.ndarray) -> np.ndarray:
    """A hash of each GRAM-character sequence."""
    if len(points) < GRAM:
        points = np.r_[points, np.zeros(GRAM - len(points), points.dtype)] if len(points) else points
        if not len(points):
            return np.zeros(0, np.uint64)
    n = len(points) - GRAM + 1
    wide = points.astype(np.uint64) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(GRAM):
        out = out * _BASE + wide[j : j + n]
    return _mixed(out)


def _grouped(of: np.ndarray) -> np.ndarray:
    """An order of places in which equal hashes stand together, each by place: one sort of hash and place in one number."""
    if len(of) <= int(_PLACE):
        order = (np.sort((of & ~_PLACE) | np.arange(len(of), dtype=np.uint64)) & _PLACE).astype(np.int64)
        x = of[order]
        if not (((x[1:] ^ x[:-1]) <= _PLACE) & (x[1:] != x[:-1])).any():
            return order
    return np.argsort(of, kind="stable")


def numbered(of: np.ndarray) -> np.ndarray:
    """Each sequence's hash with how often it has occurred before."""
    order = _grouped(of)
    new = np.r_[True, of[order][1:] != of[order][:-1]] if len(of) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    count = np.empty(len(of), np.uint64)
    count[order] = (np.arange(len(of)) - starts[np.cumsum(new) - 1]).astype(np.uint64)
    return np.where(count == 0, of, _mixed(of + count * _BASE))


def least(x: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """For each sketch, the TUPLE least hash values of x and their places, counted from first; few x leave gaps at the top.

    x is well mixed, so its upper half times an odd number is a sketch's hash; equal values go by place.
    """
    x = (x >> np.uint64(32)).astype(np.uint32)
    values, places = np.full((SKETCHES, TUPLE), _TOP), np.full((SKETCHES, TUPLE), -1)
    rows = np.arange(SKETCHES)
    for at in range(0, len(x), BLOCK):
        v = x[None, at : at + BLOCK] * _ODD[:, None]
        got_v, got_p = [], []
        for _ in range(min(TUPLE, v.shape[1])):
            i = v.argmin(axis=1)
            got_v.append(v[rows, i])
            got_p.append(i + at + first)
            v[rows, i] = _TOP
        values, places = joined((values, places), (np.column_stack(got_v), np.column_stack(got_p)))
    return values, places


def joined(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
    values, places = np.concatenate([a[0], b[0]], axis=1), np.concatenate([a[1], b[1]], axis=1)
    order = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
    return np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)


def entries(found: tuple, of: np.ndarray) -> np.ndarray:
    """The fingerprint: for each sketch, a 32-bit hash of its sequences in text order."""
    places = np.sort(found[1], axis=1)
    out = np.zeros(SKETCHES, np.uint64)
    for j in range(TUPLE):
        p = places[:, j]
        out = out * _BASE + (np.where(p >= 0, of[np.maximum(p, 0)], np.uint64(0)) if len(of) else np.uint64(0))
    return (_mixed(out) >> np.uint64(32)).astype(np.uint32)


def points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def fingerprint(text: str | None) -> np.ndarray:
    of = grams(points(text))
    return entries(least(numbered(of), 0), of)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def with_edit(own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edited text, own fingerprint, the edited text's): the last half replaced by as much of the other's beginning.

    Sequences that lie in the half kept have the same numbers in both texts, so their least are selected once.
    """
    n = len(own) // 2
    edited = np.r_[own[: len(own) - n], other[:n]]
    of, edited_of = grams(own), grams(edited)
    x, y = numbered(of), numbered(edited_of)
    kept = max(0, min(len(own) - n - GRAM + 1, len(x), len(y)))
    common = least(x[:kept], 0)
    return edited, entries(joined(common, least(x[kept:], kept)), of), entries(joined(common, least(y[kept:], kept)), edited_of)


def _beginning(text: Column) -> Column:
    """The first seven bytes of a text as a number, in the order of texts; -1 for null."""
    return F.coalesce(F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"), F.lit(-1))


def successive(docs: DataFrame, text: str, run, schema: str) -> DataFrame:
    """run over rows (bucket, halo, doc_id, text): each bucket's documents ascending, then the document after them.

    Buckets are ranges of doc_id, one a partition; the first document of each bucket is also sent, as a halo, to the
    bucket before it (that of the first bucket to the last). A doc_id (or null) that holds several quantiles is cut
    further by the beginnings of its texts; rows equal in both stay together. The driver holds one key a bucket.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "doc_id", F.col(text).alias("text"))
    quantiles = (rows.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 5 * parts)).head()[0] or []) if parts > 1 else []
    often = {i: n for i, n in Counter(quantiles).items() if n > 1}
    keyed = rows.withColumn("tie", F.when(F.col("id").isin(list(often)), _beginning(F.col("text"))).otherwise(F.lit(-1)) if often else F.lit(-1).cast("long"))
    cuts = {(i, -1) for i in quantiles}
    if often:
        at = F.percentile_approx("tie", [i / max(often.values()) for i in range(1, max(often.values()))], 100 * parts)
        cuts |= {(r.id, int(t)) for r in keyed.where(F.col("id").isin(list(often))).groupBy("id").agg(at.alias("ties")).collect() for t in r.ties}
    cut_ids, cut_ties = (np.array(x, np.int64) for x in (zip(*sorted(cuts)) if cuts else ([], [])))

    def placed(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """The number of cuts at or before each (id, tie)."""
        out = np.searchsorted(cut_ids, ids, side="right")
        for i in often:
            own = ids == i
            low, high = np.searchsorted(cut_ids, i, side="left"), np.searchsorted(cut_ids, i, side="right")
            out[own] = low + np.searchsorted(cut_ties[low:high], ties[own], side="right")
        return out

    @F.pandas_udf("int")
    def bucket(ids: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(placed(ids.to_numpy(), ties.to_numpy()).astype(np.int32))

    firsts = keyed.select(bucket("id", "tie").alias("bucket"), "id", "tie").groupBy("bucket").agg(F.min(F.struct("id", "tie")).alias("key")).collect()
    full = sorted((r.bucket, (r.key.id, r.key.tie)) for r in firsts)
    back = {key: full[i - 1][0] for i, (_, key) in enumerate(full)}

    @F.pandas_udf("array<int>")
    def sent(ids: pd.Series, ties: pd.Series) -> pd.Series:
        own = placed(ids.to_numpy(), ties.to_numpy()).tolist()
        return pd.Series([[b, -1 - back[key]] if key in back else [b] for key, b in zip(zip(ids.tolist(), ties.tolist()), own)])

    dealt = keyed.withColumn("to", F.explode(sent("id", "tie"))).select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("bucket"), (F.col("to") < 0).alias("halo"), "id", "doc_id", "text")
    return dealt.repartitionById(len(cut_ids) + 1, "bucket").sortWithinPartitions("bucket", "halo", "id", "text").select("bucket", "halo", "doc_id", "text").mapInArrow(run, schema)


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    out: list[tuple] = []
    held = None  # bucket, doc_id, points of the document that waits for the next
    ready: dict[str, np.ndarray] = {}  # its fingerprint, if it was already needed

    def pair(other: np.ndarray) -> None:
        bucket, doc, own = held
        edited, a, b = with_edit(own, other)
        of = grams(other)
        c = entries(least(numbered(of), 0), of)
        body = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        out.append((doc, len(own), hashlib.sha256(body).hexdigest(), a.astype(">u4").tobytes().hex(), b.astype(">u4").tobytes().hex(), likeness(a, b), likeness(a, c)))

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    for batch in batches:
        for bucket, halo, doc, text in zip(*(batch.column(i) for i in range(4))):
            own = points(text.as_py())
            if held and held[0] == bucket.as_py():
                pair(own)
            held = None if halo.as_py() else (bucket.as_py(), doc.as_py(), own)
            if len(out) >= 256:
                yield batch_of()
                out.clear()
    if out:
        yield batch_of()


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with fingerprint, an array of SKETCHES 32-bit numbers."""

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t).tolist() for t in texts])

    return docs.withColumn("fingerprint", of(F.col(text)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return successive(docs, "text", _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
