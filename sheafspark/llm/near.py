"""Operator 6 by similarity: SimHash near-duplicates of 5-word Jaccard similarity 0.8 or more, the pipeline's stage.

Each text is the set of its 5-word shingles (A-Z in lower case, as 64-bit hashes); texts of one set are one node. A
node's fingerprint has BITS bits, each the majority over the set. Texts of similarity 0.8 differ in 0.15 of the bits on
average, so candidates are fingerprints that differ in RADIUS bits at most. Buckets of KEY_BITS sampled bits, TABLES of
them, bring such fingerprints together: first each member is held against its bucket's least, then, where a bucket
still has members of several components, the Gray-ordered hierarchical index of simhash.py finds the links.

Candidates make clouds. A cloud is checked exactly on whole texts: first all against its centre (the member nearest
to the majority of its fingerprints), then, where that leaves several classes, every pair not both in the centre's
class, in blocks. No pair of a group becomes a row: pairs live in the arrays of one task, and the rows of a group grow
with its blocks. A hot bucket or cloud, whose members are near its least or centre, is dealt to many tasks.

A pair of similarity 0.8 is no candidate with chance 0.03 by the buckets and 0.01 by the radius if no other text joins
the two (binomial, computed; less for closer pairs). For over 16 million distinct texts give KEY_BITS and TABLES as
`tables_for` says: 1 - (1 - 0.848 ** bits) ** tables is the chance.

Null and empty texts have the empty set and are one node. Rows that share doc_id and text come back once; a null
doc_id stays only if its class has no other. An empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.common import stored
from sheafspark.llm.simhash import components, gray_order, least_of, majority, near_pairs, one_of_each, row_hash, shingle_hashes

SHINGLE = 5
#: Least Jaccard similarity of a link, in tenths.
LEAST_TENTHS = 8
WORDS = 2
BITS = 64 * WORDS
RADIUS = 30
KEY_BITS, TABLES = 16, 48
#: Rows of a group that one task compares with one another.
GROUP, CLOUD = 512, 1024
#: Pairs in memory at once, and shingles in a block of the incidence matrix.
PAIRS, COLUMNS = 2_000_000, 4096
HUB = 64

_ODD = np.random.default_rng(42).integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def tables_for(bits: int, missed: float = 0.03) -> int:
    """Tables of keys of so many bits by which a pair of the least similarity is missed with that chance at most."""
    least = LEAST_TENTHS / 10
    agree = 1 - math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(math.log(missed) / math.log(1 - agree**bits))


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS words for each set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.column_stack([majority(_mixed(flat * a), sizes) for a in _ODD])


def node_of(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(shingles.tobytes())


def sketched(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row (hash of the text), node, n (shingles), f0 and f1 (the fingerprint)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(x) for x in part.column(2).to_pylist()]
                nodes = np.array([node_of(s) for s in sets], np.uint64).view(np.int64)
                fps = fingerprints(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps[:, 0].copy()), pa.array(fps[:, 1].copy())], ["doc_id", "row", "node", "n", "f0", "f1"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash(text).alias("row"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, node long, n long, f0 long, f1 long")


def _distance(*sides: str):
    return F.bit_count(F.col(f"{sides[0]}0").bitwiseXOR(F.col(f"{sides[1]}0"))) + F.bit_count(F.col(f"{sides[0]}1").bitwiseXOR(F.col(f"{sides[1]}1")))


def bucketed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """nodes (node, f0, f1) once a table with bucket, the table's number and its sampled bits."""
    rng = np.random.default_rng(9)
    chosen = [sorted(rng.choice(BITS, bits, replace=False).tolist()) for _ in range(tables)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                fps = [part.column(i).to_numpy().view(np.uint64) for i in (1, 2)]
                keys = np.empty((len(part), tables), np.uint64)
                for t, places in enumerate(chosen):
                    key = np.full(len(part), t, np.uint64)
                    for b in places:
                        key = (key << np.uint64(1)) | ((fps[b // 64] >> np.uint64(b % 64)) & np.uint64(1))
                    keys[:, t] = key
                of = np.repeat(np.arange(len(part)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(c.take(pa.array(of)) for c in part.columns)], ["g", "node", "f0", "f1"])

    return nodes.select("node", "f0", "f1").mapInArrow(run, "g long, node long, f0 long, f1 long")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """rows (g, main, node, ...) dealt to tasks (g, i, j): any two of a g, not both main, meet in one of them.

    A g of `most` rows at most is one task. Others go in blocks: each block of rows that aren't main meets every block.
    """
    sums = rows.groupBy(F.col("g").alias("_g")).agg(F.sum(F.col("main").cast("int")).alias("_m"), F.sum((~F.col("main")).cast("int")).alias("_o"))
    rows = rows.join(sums, F.col("g") == F.col("_g"))
    n_own, n_main = F.greatest(F.ceil(F.col("_o") / most), F.lit(1)), F.ceil(F.col("_m") / most)
    pair = lambda i, j: F.struct(F.least(i, j).cast("int").alias("i"), F.greatest(i, j).cast("int").alias("j"))
    block = F.when(F.col("main"), n_own + F.pmod(F.xxhash64("node"), F.greatest(n_main, F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), n_own))
    last = F.when(F.col("main"), n_own).otherwise(n_own + n_main) - 1
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), last.cast("long")), lambda j: pair(F.col("_block"), j))
    one = F.array(pair(F.lit(0), F.lit(0)))
    return rows.withColumn("_block", block).withColumn("_t", F.explode(F.when(F.col("_m") + F.col("_o") <= most, one).otherwise(tasks))).select("*", "_t.i", "_t.j").drop("_g", "_m", "_o", "_block", "_t")


def grouped(df: DataFrame, run: Callable, columns: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "g", "i", "j").sortWithinPartitions("g", "i", "j").select("g", "i", "j", *columns).mapInArrow(run, "a long, b long")


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], ["a", "b"])


def _index_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, i, j, node, f0, f1) sorted by task: links within each task's rows by the hierarchical index."""
    held: list[np.ndarray] = []

    def flush(rows: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[:, 4:6]).view(np.uint64)
        node = rows[gray_order(fps, group), 3]
        _, x, y = near_pairs(fps, group, RADIUS)
        root = least_of(len(node), x, y)
        linked = np.flatnonzero(root != np.arange(len(node)))
        return _pairs(node[linked], node[root[linked]])

    def cut(rows: np.ndarray, whole: bool) -> Iterator[pa.RecordBatch | np.ndarray]:
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(rows)])
        if not whole:  # the last task's rows may go on in the next batch
            starts, sizes = starts[:-1], sizes[:-1]
        at = 0
        while at < len(starts):
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:].astype(float) ** 2), PAIRS)))
            lo, hi = starts[at], starts[min(at + n, len(starts)) - 1] + sizes[min(at + n, len(starts)) - 1]
            yield flush(rows[lo:hi], np.repeat(np.arange(len(sizes[at : at + n])), sizes[at : at + n]))
            at += n
        yield rows[0:0] if whole else rows[starts[-1] + sizes[-1] if len(starts) else 0 :]

    for batch in batches:
        held.append(np.column_stack([c.to_numpy().astype(np.int64) for c in batch.columns]))
        if sum(map(len, held)) >= 16 * GROUP:
            *out, rest = cut(np.concatenate(held), False)
            yield from out
            held = [rest]
    if held and len(rows := np.concatenate(held)):
        yield from list(cut(rows, True))[:-1]


def candidates(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """nodes (node, f0, f1): links (a, b) that join fingerprints within RADIUS of each other that share a bucket."""
    rows = stored(bucketed(nodes, bits, tables))
    lead = rows.groupBy(F.col("g").alias("_g")).agg(F.min(F.struct("node", "f0", "f1")).alias("x"), F.max("node").alias("_max")).where("x.node <> _max").select("_g", F.col("x.node").alias("lead"), F.col("x.f0").alias("l0"), F.col("x.f1").alias("l1"))
    held = rows.join(lead, F.col("g") == F.col("_g")).select("g", "node", "f0", "f1", "lead", "l0", "l1")
    stars = stored(held.where((F.col("node") != F.col("lead")) & (_distance("f", "l") <= RADIUS)).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct())
    roots = components(stars).select(F.col("node").alias("_node"), "root")
    of = stored(nodes.select("node").join(roots, F.col("node") == F.col("_node"), "left").select(F.col("node").alias("_n"), F.coalesce("root", "node").alias("c")))
    lead = lead.select("_g", "lead").join(of.select(F.col("_n").alias("_l"), F.col("c").alias("lc")), F.col("lead") == F.col("_l")).select("_g", "lc")
    placed = rows.join(of, F.col("node") == F.col("_n")).join(lead, F.col("g") == F.col("_g")).select("g", "node", "f0", "f1", (F.col("c") == F.col("lc")).alias("main"))
    open_ = placed.groupBy(F.col("g").alias("_o")).agg(F.min("main").alias("all")).where("not all").select("_o")
    rest = dealt(stored(placed.join(open_, F.col("g") == F.col("_o"), "left_semi")), GROUP)
    return stars.union(grouped(rest, _index_links, ["node", "f0", "f1"]).distinct())


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of sets whose Jaccard similarity is LEAST_TENTHS or more, by products of the incidence matrix."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    ids, of, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = np.repeat(np.arange(len(sets)), sizes)
    many = counts[of] > 1
    own, of = own[many], np.unique(of[many], return_inverse=True)[1]
    order = np.argsort(of, kind="stable")
    own, of = own[order], of[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(of[-1]) + 1 if len(of) else 0, COLUMNS):
        x, y = np.searchsorted(of, (lo, lo + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[own[x:y], of[x:y] - lo] = 1
        both += part @ part.T
    i, j = np.nonzero(np.triu(10 * both >= LEAST_TENTHS * (sizes[:, None] + sizes[None, :] - both), 1))
    return i, j


def _cloud_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (g, i, j, node, text) sorted by task: links between texts alike."""
    task, nodes, sets = None, [], []

    def flush() -> pa.RecordBatch:
        root = least_of(len(sets), *alike(sets))
        linked = np.flatnonzero(root != np.arange(len(sets)))
        of = np.array(nodes, np.int64)
        return _pairs(of[linked], of[root[linked]])

    for batch in batches:
        for g, i, j, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if (g, i, j) != task:
                if len(nodes) > 1:
                    yield flush()
                task, nodes, sets = (g, i, j), [], []
            nodes.append(node)
            sets.append(shingle_set(text))
    if len(nodes) > 1:
        yield flush()


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, salt, other, node, text) sorted by (a, salt, other): the centre's row, then those to hold against it."""
    leader, own = None, None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for a, salt, other, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            words = shingle_set(text)
            if not other:
                leader, own = (a, salt), words
            elif leader == (a, salt) and len(alike([own, words])[0]):
                out.append((a, node))
            elif leader != (a, salt):
                raise ValueError(f"node {a} has no text")
        yield _pairs([x for x, _ in out], [y for _, y in out])


def held_against(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are alike; a centre's pairs are dealt to groups of HUB with its text in each."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count("*") / HUB).alias("_n"))
    dealt_ = stored(pairs.join(many, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("_n")).alias("salt"), "b"))
    asked = dealt_.select("a", "salt", F.lit(1).alias("other"), F.col("b").alias("node")).union(dealt_.select("a", "salt", F.lit(0), "a").distinct())
    rows = asked.join(texts, F.col("node") == F.col("_node")).select("a", "salt", "other", "node", "text")
    return stored(rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "other").mapInArrow(_verified, "a long, b long"))


def links(nodes: DataFrame, texts: Callable[[DataFrame], DataFrame], bits: int = KEY_BITS, tables: int = TABLES) -> DataFrame:
    """nodes (node, f0, f1): links (a, b) that join all candidates alike. texts: wanted (_w) -> (_node, text)."""
    clouds = components(candidates(nodes, bits, tables))
    member = clouds.union(clouds.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("_m"), F.col("root").alias("g"))
    member = stored(nodes.join(member, F.col("node") == F.col("_m")).select("g", "node", "f0", "f1"))
    text = stored(texts(member.select(F.col("node").alias("_w"))))

    # The centre: nearest to the bits set in over half of the cloud's fingerprints.
    ones = lambda w, b: F.sum(F.shiftrightunsigned(F.col(f"f{w}"), b).bitwiseAND(F.lit(1)))
    word = lambda w: F.concat(*(F.when(2 * F.element_at("ones", 64 * w + b + 1) > F.col("n"), "1").otherwise("0") for b in reversed(range(64))))
    middle = member.groupBy("g").agg(F.count("*").alias("n"), F.array(*(ones(w, b) for w in range(WORDS) for b in range(64))).alias("ones"))
    middle = middle.select(F.col("g").alias("_g"), *(F.conv(word(w), 2, -10).cast("long").alias(f"m{w}") for w in range(WORDS)))
    centre = member.join(middle, F.col("g") == F.col("_g")).groupBy(F.col("g").alias("_g")).agg(F.min(F.struct(_distance("f", "m").alias("d"), F.col("node").alias("node")))["node"].alias("centre"))
    placed = stored(member.join(centre, F.col("g") == F.col("_g")).select("g", "node", "centre"))
    found = held_against(placed.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")), text)

    near = found.select(F.col("b").alias("_b"))
    rest = placed.join(near, F.col("node") == F.col("_b"), "left").select("g", "node", (F.col("_b").isNotNull() | (F.col("node") == F.col("centre"))).alias("main"))
    open_ = rest.groupBy(F.col("g").alias("_o")).agg(F.min("main").alias("all"), F.count("*").alias("n")).where("not all and n > 2").select("_o")
    rest = dealt(rest.join(open_, F.col("g") == F.col("_o"), "left_semi"), CLOUD)
    checked = grouped(rest.join(text, F.col("node") == F.col("_node")).select("g", "i", "j", "node", "text"), _cloud_links, ["node", "text"])
    return found.union(checked)


def clustered(docs: DataFrame, text: str = "text", bits: int = KEY_BITS, tables: int = TABLES) -> DataFrame:
    """doc_id, row (hash of the text) and class, a row a document: class is one of the nodes that links lead to."""
    sketches = stored(sketched(docs, text))
    nodes = stored(sketches.groupBy("node").agg(F.min(F.struct("row", "f0", "f1")).alias("x")).select("node", "x.row", "x.f0", "x.f1"))

    def texts(wanted: DataFrame) -> DataFrame:
        rows = nodes.join(wanted, F.col("node") == F.col("_w"), "left_semi").select(F.col("node").alias("_node"), F.col("row").alias("_r"))
        own = docs.select(row_hash(text).alias("_own"), F.col(text).cast("binary").alias("text"))
        return own.join(rows, F.col("_own") == F.col("_r")).groupBy("_node").agg(F.min("text").alias("text"))

    roots = components(links(nodes.select("node", "f0", "f1"), texts, bits, tables)).select(F.col("node").alias("_n"), "root")
    return sketches.join(roots, F.col("node") == F.col("_n"), "left").select("doc_id", "row", F.coalesce("root", "node").alias("class"))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each class; columns as in docs."""
    return one_of_each(docs, clustered(docs, text), text)
