"""Mixing against a queue simulated packet by packet, and rows that share an id."""

import hashlib
import heapq
from collections import Counter, defaultdict

import numpy as np

from sheafspark.llm import mixing


def simulated(sizes, targets):
    """Words taken of each row by serving queues in order of virtual finish time up to the budget; sizes: (id, source, size)."""
    key = lambda d: hashlib.md5(f"mix{d}".encode()).hexdigest()
    queues = defaultdict(list)
    for i, (d, s, n) in enumerate(sizes):
        queues[s].append((key(d), d, n, i))
    heap, taken, budget = [], Counter(), sum(n for *_, n in sizes)

    def packets(s):
        sent, most = 0, max(1, int(targets[s] // mixing.QUANTA))
        for again in range(mixing.REPEATS):
            start = 0
            for k, d, n, i in sorted(queues[s]):
                for part in range(max(1, -(-n // most))):
                    words = min(most, n - part * most)
                    yield ((sent + part * most + words) / targets[s] if targets[s] else 0.0, k, s, d, start, again, part), words, i
                sent, start = sent + n, start + n

    streams = {s: packets(s) for s in queues}
    for s, x in streams.items():
        heapq.heappush(heap, (*next(x), s))
    while heap and budget > 0:
        _, words, i, s = heapq.heappop(heap)
        taken[i] += min(words, budget)
        budget -= min(words, budget)
        if (after := next(streams[s], None)) is not None:
            heapq.heappush(heap, (*after, s))
    return [(d, n, taken[i]) for i, (d, _, n) in enumerate(sizes)]


def test_served_by_finish_time(spark):
    rng = np.random.default_rng(8)
    for docs, sources in ((400, 5), (60, 9)):
        rows = [(i, f"s{int(rng.integers(0, sources)) ** 2 % sources}", int(rng.integers(0, 3000) if rng.random() < 0.9 else rng.integers(0, 60_000))) for i in range(docs)]
        df = spark.createDataFrame(rows, "doc_id long, source string, size long")
        got = mixing.mix(df).collect()
        targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
        assert Counter((r.doc_id, r["size"], r.taken) for r in got) == Counter(simulated(rows, targets))


def test_truncation_decides(spark, monkeypatch):
    rows = [(i, f"s{i % 4}", 50 + i) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    whole = sum(n for *_, n in rows)
    assert sum(r.taken for r in mixing.mix(df).collect()) == whole
    monkeypatch.setattr(mixing.F, "least", lambda a, *b: a)  # nothing is cut at the budget
    assert sum(r.taken for r in mixing.mix(df).collect()) > 1.5 * whole


def test_rows_of_one_id(spark):
    """Equal ids, sizes and sources with unlike texts, on both sides of the cut: as many words as are taken."""
    rows = [(i // 4, " ".join(f"w{i}x{j}" for j in range(9)), "en", f"s{i % 2}") for i in range(64)] + [(None, f"a b c{i % 3}", "en", "s1") for i in range(30)] + [(7, None, None, None), (7, "", "en", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    taken, out = Counter(), Counter()
    for r in mixing.mix(mixing.sized(df)).collect():
        taken[r.source] += r.taken
    mixed = mixing.mixed(df).collect()
    for r in mixed:
        out[r.source] += len(r.text.split())
    assert out == +taken
    assert {r.text for r in mixed} >= {t for d, t, _, s in rows if s == "s1" and d is not None}
