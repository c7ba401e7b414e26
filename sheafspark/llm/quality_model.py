"""Operator 5: a quality classifier by random Fourier features, ridge regression and isotonic calibration.

Statistics of each whole text (shares of kinds of bytes, word and line shapes, repetition) are standardized and mapped
to cosines of random projections, which approximate a Gaussian kernel. Each partition sums its normal equations, the
sums are added in two levels, and one ridge system of bounded size is solved on the driver. Raw scores of training
rows kept apart are summed in bins of fixed width and calibrated isotonically.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out and never learnt from; remainders 1 to 3 fit the ridge scores,
4 the calibration. Null and empty texts have all statistics 0 and get a score like any other. Labels with a null
doc_id or quality are ignored, several labels of one document are averaged; a null doc_id counts as an empty text in
the hash. Repeated rows are scored each by themselves. Without any usable label every score is 0.5. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import stored, table

FOLDS = 5
FEATURES = 256
RIDGE = 1e-3
THRESHOLD = 0.3
#: Width of the bins of raw scores in which calibration rows are summed.
BIN = 0.002
SEED = 5

_UPPER, _LOWER, _DIGIT = range(65, 91), range(97, 123), range(48, 58)
STATISTICS = (
    "log_bytes", "upper", "lower", "digit", "high", "white", "stop", "comma", "mark", "bar", "symbol", "other", "log_words", "word_bytes", "distinct", "adjacent", "commonest", "line_words", "line_copies", "capital_words", "marked_words",
)


def statistics(text: bytes | None) -> np.ndarray:
    """The text's statistics, in the order of STATISTICS."""
    out = np.zeros(len(STATISTICS))
    ws = (text or b"").split()
    if not ws:
        return out
    n = len(text)
    of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = lambda codes: of[list(codes)].sum() / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    ids: dict[bytes, int] = {}
    codes = np.array([ids.setdefault(w, len(ids)) for w in ws])
    counts = np.bincount(codes)
    ends = bytes(w[-1] for w in ws)
    starts = np.frombuffer(bytes(w[0] for w in ws), np.uint8)
    out[:] = (
        np.log1p(n), share(_UPPER), share(_LOWER), share(_DIGIT), of[128:].sum() / n, share(b" \t\n\r\x0b\x0c"), share(b".;:"), share(b","), share(b"!?"), share(b"|"), share(b"#*$%&<>{}~^\\"), share(b"\"'()[]-_/=+@`"),
        np.log1p(len(ws)), sum(map(len, ws)) / len(ws), len(ids) / len(ws) ** 0.8, (codes[1:] == codes[:-1]).sum() / len(ws), counts.max() / len(ws), np.log1p(len(ws) / len(lines)), 1 - len(set(lines)) / len(lines),
        ((starts >= 65) & (starts < 91)).mean(), sum(ends.count(c) for c in b"!|#*$%&") / len(ws),
    )
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fold and x, the statistics of the whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = [statistics(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "fold", "x"])

    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fold int, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(STATISTICS)) if len(column) else np.zeros((0, len(STATISTICS)))


@dataclass
class Model:
    """Standardization, ridge weights, and the calibration's knots."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        d = x.shape[1]
        at = z @ (rng.standard_normal((d, FEATURES)) / np.sqrt(d)) + rng.uniform(0, 2 * np.pi, FEATURES)
        return np.column_stack([np.cos(at) * np.sqrt(2 / FEATURES), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None or self.knots is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def _summed(rows: DataFrame, parts: int) -> DataFrame:
    """Adds up the arrays of rows (part, sums) of equal part modulo parts."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(blob)
                total, part = (x.copy() if total is None else total + x), k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    dealt = rows.select((F.col("part") % parts).alias("part"), "sums")
    return dealt.repartition(parts, "part").mapInArrow(add, "part int, sums binary")


def isotonic(raw: np.ndarray, total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins ascending in raw score: (bin scores, calibrated values)."""
    blocks: list[list[float]] = []  # sum, count, bins
    for t, c in zip(total, n):
        blocks.append([t, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, c2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + c2, blocks[-1][2] + k2]
    return raw, np.concatenate([np.full(k, t / c) for t, c, k in blocks])


def fitted(rows: DataFrame, labels: DataFrame) -> Model:
    """rows (doc_id, fold, x), labels (doc_id, quality)."""
    k = len(STATISTICS)
    got = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(k) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not got.n:
        return Model(np.zeros(k), np.ones(k))
    scale = np.array([got[f"s{i}"] for i in range(k)])
    model = Model(np.array([got[f"m{i}"] for i in range(k)]), np.where(scale > 1e-9, scale, 1.0))

    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.avg("quality").alias("y"))
    train = stored(rows.where("fold <> 0").join(known, F.col("doc_id") == F.col("l_id")).select("fold", "x", "y"))

    def equations(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        d = FEATURES + 1
        total = np.zeros((d, d + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                z = model.features(_matrix(part.column(0)))
                total[:, :d] += z.T @ z
                total[:, d] += z.T @ part.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["part", "sums"])

    sums = train.where("fold < 4").select("x", "y").mapInArrow(equations, "part int, sums binary")
    total = np.frombuffer(_summed(_summed(sums, 16), 1).first().sums).reshape(FEATURES + 1, FEATURES + 2)
    n = total[FEATURES, FEATURES]
    if not n:
        return model
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n * np.eye(FEATURES + 1) / FEATURES, total[:, -1])

    def raw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.round(model.raw(_matrix(batch.column(0))) / BIN).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column(1)], ["bin", "y"])

    bins = train.where("fold = 4").select("x", "y").mapInArrow(raw, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("t"), F.count("*").alias("c")).orderBy("bin").collect()
    if bins:
        model.knots = isotonic(*(np.array([r[i] for r in bins], float) * (BIN if i == 0 else 1) for i in range(3)))
    return model


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(_matrix(batch.column(2)))
            held = pa.array(batch.column(1).to_numpy() == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), held, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(table(spark, sf_dir, "documents")))
    return scored(rows, fitted(rows, table(spark, sf_dir, "labels").select("doc_id", "quality")))
