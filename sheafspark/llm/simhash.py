"""Operator 6: SimHash near-duplicates by a Gray-ordered hierarchical index.

Each text gets a 64-bit fingerprint: a bit is set if it is set in over half the XXH64 hashes of its word shingles.
Distinct fingerprints are sent to the groups of every choice of 2 of 5 bit blocks: two fingerprints that differ in 3
bits at most agree in 2 blocks and so meet. A group beyond GROUP members is split again by the bits that still vary
in it (four sub-blocks of which such a pair shares one), until all groups are small: no group is ever cut short.
Within a group, fingerprints are sorted by Gray rank; runs of them become nodes that hold the masked bits their
members share, upper nodes those that their children share; pairs of nodes are dropped once the shared bits of both
differ in over 3 places. A group's links are kept as stars, and stars are joined to components by alternating
large-star and small-star rounds.

Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows have one fingerprint and come
back each. A null doc_id takes part but is no component's id unless it has no other. An empty table gives an empty
result. Other columns pass through `deduplicated` untouched. near.py has the same index over longer fingerprints of
5-word shingles with an exact check, for near-duplicates by similarity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.llm.common import stored, table

SHINGLE = 3
SEED = 42
BITS = 3
#: Most members of a group that one task compares; a larger one is split further.
GROUP = 1024
FANOUT = 8
#: Edges of a graph that one task joins.
EDGES = 1 << 19


def _masks() -> list[int]:
    edges = [0, 13, 26, 39, 52, 64]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes | None, n: int = SHINGLE) -> list[int]:
    """XXH64 of each n-word shingle of the text, A-Z in lower case."""
    import xxhash

    ws = (text or b"").lower().split()
    if len(ws) <= n:
        return [xxhash.xxh64_intdigest(b" ".join(ws), SEED)] if ws else []
    joined = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(ws) - n + 1].tolist()
    h, seed = xxhash.xxh64_intdigest, SEED
    return [h(joined[a:b], seed) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]


def majority(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of sizes[i] hashes in flat, the bits set in over half of it; 0 for an empty one.

    Eight one-bit lanes of a word are summed at once over runs of 255 hashes at most, so no lane overflows.
    """
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    runs = -(-sizes // 255)
    first_run = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + (np.arange(runs.sum()) - np.repeat(first_run, runs)) * 255
    found = np.zeros(len(full), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((flat >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_run, axis=0)
        over = counts * 2 > sizes[:, None]
        for byte in range(8):
            found |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    out[full] = found
    return out


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and, if named, the column row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                hashes = [shingle_hashes(x, shingle) for x in part.column(1).to_pylist()]
                sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
                flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(majority(flat, sizes).view(np.int64)), *part.columns[2:]], ["doc_id", "fp", *["row"] * bool(row)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"), *([F.col(row).alias("row")] if row else []))
    return rows.mapInArrow(run, "doc_id long, fp long" + ", row long" * bool(row))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order: the inverse of n -> n ^ (n >> 1)."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def _wide(fps: np.ndarray) -> np.ndarray:
    return fps if fps.ndim > 1 else fps[:, None]


def gray_order(fps: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The places of fingerprints (a word or a row of words each) by group, then by Gray rank."""
    return np.lexsort((*(gray_rank(w) for w in _wide(fps).T[::-1]), group))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def near_pairs(fps: np.ndarray, group: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fps in index order, i, j): the pairs i < j of one group that differ in at most so many bits.

    group: non-negative numbers. fps: a word each, or a row of words whose differences are accumulated.
    """
    wide, order = _wide(fps), gray_order(fps, group)
    fps, wide, group = fps[order], wide[order], group[order]
    new = np.r_[True, group[1:] != group[:-1]]
    gid = np.cumsum(new) - 1
    place = np.arange(len(fps)) - np.flatnonzero(new)[gid]
    # Levels from the leaves up: each node's shared bits, which bits those are, first child, number of children, group.
    zero = np.uint64(0)
    levels = [(wide, np.full(wide.shape, ~zero), np.zeros(len(fps), np.int64), np.zeros(len(fps), np.int64))]
    while place.max(initial=0) > 0:
        parent = place // FANOUT
        starts = np.flatnonzero(np.r_[True, (parent[1:] != parent[:-1]) | (gid[1:] != gid[:-1])])
        bits_of, mask_of = levels[-1][:2]
        ones, zeros = np.bitwise_and.reduceat(bits_of & mask_of, starts, axis=0), np.bitwise_and.reduceat(~bits_of & mask_of, starts, axis=0)
        levels.append((ones, ones | zeros, starts, np.diff(np.r_[starts, len(parent)])))
        place, gid = parent[starts], gid[starts]
    a = b = np.arange(len(levels[-1][0]))
    for depth in range(len(levels) - 1, 0, -1):
        _, _, first, n = levels[depth]
        below, mask = levels[depth - 1][:2]
        left = _ranges(first[a], n[a])
        other, own = np.repeat(b, n[a]), np.repeat(a, n[a])
        # Under one node a child meets itself and those after it; under two, all of the other's.
        begin = np.where(other == own, left, first[other])
        sizes = first[other] + n[other] - begin
        a, b = np.repeat(left, sizes), _ranges(begin, sizes)
        near = sum(np.bitwise_count((below[a, w] ^ below[b, w]) & mask[a, w] & mask[b, w]).astype(np.int16) for w in range(below.shape[1])) <= bits
        a, b = a[near], b[near]
    apart = a != b
    return fps, a[apart], b[apart]


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that links (a, b) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        if (root == before).all():
            return root


def star_links(fps: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the fingerprints of each group as near_pairs does: each to the least of its component."""
    fps, a, b = near_pairs(fps, group)
    root = least_of(len(fps), a, b)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _group_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, k, fp) sorted by (g, k): links within each group. Groups are gathered to a bounded number of pairs."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray) -> pa.RecordBatch:
        new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)]
        gid = np.cumsum(new) - 1
        many = np.bincount(gid)[gid] > 1
        a, b = star_links(rows[many, 2].view(np.uint64), gid[many])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    for batch in batches:
        held.append(np.column_stack([batch.column(i).to_numpy() for i in range(3)]))
        rows = np.concatenate(held)
        if len(rows) < 8 * GROUP:
            held = [rows]
            continue
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        at = 0
        while at < starts[-1]:  # the last group may go on in the next batch
            sizes = np.diff(np.r_[starts[starts >= at]])
            n = max(1, int(np.searchsorted(np.cumsum(sizes.astype(float) ** 2), 4e6)))
            to = at + int(sizes[:n].sum())
            yield flush(np.ascontiguousarray(rows[at:to]))
            at = to
        held = [rows[at:]]
    if held and len(rows := np.concatenate(held)):
        starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        cuts = [0]
        total = 0.0
        for s, n in zip(starts.tolist(), np.diff(np.r_[starts, len(rows)]).tolist()):
            if total and total + n * n > 4e6:
                cuts.append(s)
                total = 0.0
            total += n * n
        for x, y in zip(cuts, [*cuts[1:], len(rows)]):
            yield flush(np.ascontiguousarray(rows[x:y]))


def _sub_masks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each large group (g, k, varies): its varying bits dealt to four masks."""
    for batch in batches:
        out = []
        for v in batch.column(2).to_pylist():
            on = [i for i in range(64) if v >> i & 1]
            out.append([_signed(sum(1 << i for i in on[j::4])) for j in range(4)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["bg", "bk", "masks"])


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp): links (a, b) that join all fingerprints differing in at most BITS bits, directly or by others."""
    keys = F.array(*(F.struct(F.lit(i).cast("long").alias("g"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(_masks())))
    rows = distinct.select("fp", F.explode(keys).alias("x")).select("x.g", "x.k", "fp")
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    while True:
        big = rows.groupBy("g", "k").agg(F.count("*").alias("n"), F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varies")).where(F.col("n") > GROUP)
        big = stored(big.select("g", "k", "varies").mapInArrow(_sub_masks, "bg long, bk long, masks array<long>"))
        some = not big.isEmpty()
        same = (F.col("g") == F.col("bg")) & (F.col("k") == F.col("bk"))
        small = rows.join(big, same, "left_anti") if some else rows
        found.append(small.repartition(parts, "g", "k").sortWithinPartitions("g", "k").mapInArrow(_group_links, "a long, b long"))
        if not some:
            break
        split = rows.join(big, same).select("fp", "g", "k", F.posexplode("masks").alias("j", "mask"))
        rows = stored(split.select(F.xxhash64("g", "k", "j").alias("g"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.distinct()


def _edges(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in rows.T], ["a", "b"])


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) as others, fewer than their nodes, that join the same: each node to the least of its component."""

    def joined(held: list[np.ndarray]) -> np.ndarray:
        nodes, of = np.unique(np.concatenate(held), return_inverse=True)
        of = of.reshape(-1, 2)
        root = least_of(len(nodes), of[:, 0], of[:, 1])
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return np.column_stack([nodes[linked], nodes[root[linked]]])

    held: list[np.ndarray] = []
    for batch in batches:
        held.append(np.column_stack([c.to_numpy() for c in batch.columns]))
        if sum(map(len, held)) >= 2 * EDGES:
            held = [joined(held)]
            if len(held[0]) > EDGES:
                yield _edges(held.pop())
    if held:
        yield _edges(joined(held))


def forest(edges: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """edges (a, b) as others, fewer a node, that join the same, and whether they are the result: (node, root) as components.

    Edges are dealt by range to tasks of about `most`, so that nearly all edges of a node meet, and a hub's may be in many.
    """
    tasks = max(1, -(-edges.count() // most))
    if tasks == 1:
        return stored(edges.coalesce(1).mapInArrow(_forest, "a long, b long")), True
    return stored(edges.repartitionByRange(tasks, "a", "b").mapInArrow(_forest, "a long, b long").distinct()), False


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """edges (a, b) -> (node, root): each node that has an edge but the least of its component, and that least node.

    Near copies share many buckets and come with many edges a node, each of which would be a row of every round. So
    forests of them come first; `most` edges at most are one forest and done. Above that, alternating large-star and
    small-star rounds join the forests; all work is by node in aggregates and joins, so a hub's neighbours never meet
    in one task. Each round is written to the shared folder.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges, done = forest(stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()), most)
    last = [0] if done else state(edges)
    while last[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = stored(small.select("x.a", "x.b").where("a <> b").distinct())
        now = state(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def clustered(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) with component_id, the smallest doc_id that links lead to."""
    reps = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = components(links(reps.select("fp")))
    placed = reps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    of = stored(placed.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"))
    return fps.join(of, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, of: DataFrame, text: str) -> DataFrame:
    """The rows of docs that are the first of their class; of: doc_id, row (hash of the text) and class, a row a document.

    First is the smallest doc_id, a null one after all others, then the smallest row. Rows that agree in both come back once.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row").alias("row"))
    keep = of.groupBy("class").agg(F.min(rank).alias("x")).select(F.col("x.none").alias("__k_none"), F.col("x.id").alias("__k_id"), F.col("x.row").alias("__k_row"))
    own = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__row": row_hash(text)}
    rows = docs.withColumns(own).join(keep, (F.col("__none") == F.col("__k_none")) & (F.col("__id") == F.col("__k_id")) & (F.col("__row") == F.col("__k_row")), "left_semi")
    return rows.dropDuplicates(list(own)).drop(*own)


def row_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component of the query's links; columns as in docs.

    Documents with one doc_id are told apart by their texts. A null doc_id stays only if its component has no other.
    """
    rows = docs.select("doc_id", row_hash(text).alias("__row"), text)
    of = stored(fingerprints(rows, text, row="__row"))
    reps = of.groupBy("fp").agg(F.count("*").alias("n"))
    roots = components(links(reps.select("fp")))
    placed = of.join(roots, F.col("fp") == F.col("node"), "left").select("doc_id", "row", F.coalesce("root", "fp").alias("class"))
    return one_of_each(docs, placed, text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(stored(fingerprints(table(spark, sf_dir, "documents"))))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
