"""Components of links against a plain union-find, and how many edges take part in the rounds."""

import random

import pytest

from sheafspark.llm import simhash


def plain(edges):
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return sorted((x, top(x)) for x in root if top(x) != x)


def graph():
    rng = random.Random(2)
    near = [(-(10**15) - rng.randrange(48), rng.randrange(400)) for _ in range(4000)]  # near copies and leads of their buckets
    path = [(1000 + i, 1001 + i) for i in range(60)]
    hub = [(5000, rng.randrange(4000, 6000)) for _ in range(600)]
    loose = [(rng.randrange(10_000, 11_000), rng.randrange(10_000, 11_000)) for _ in range(400)]
    return near + path + hub + loose


@pytest.mark.parametrize("most", [simhash.EDGES, 500, 7])
def test_components(spark, most):
    edges = graph()
    if most == 7:
        edges = edges[::40]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"), most)
    assert sorted(map(tuple, got.collect())) == plain(edges)


def test_no_edges(spark):
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert simhash.components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


@pytest.mark.parametrize("members", [1000, 2000])
def test_edges_of_near_copies(spark, members):
    """Each member has an edge to the leads of 48 buckets; the rounds get about one a member and a lead of each task."""
    edges = spark.range(members).selectExpr("id + 1000 AS a", "explode(sequence(0, 47)) AS b").selectExpr("a", "CAST(b AS long) AS b")
    rows, done = simhash.forest(edges, 12_000)
    assert not done
    assert rows.count() <= members + 48 * members * 48 // 12_000 + 100
