"""Points counted by the boxes that hold them, against every pair."""

import random

from sheafspark.operators import assembly


def test_counts_by_every_pair(spark):
    rng = random.Random(5)
    nan = float("nan")
    at = lambda: rng.choice([-0.0, 0.0, -1.5, 3.0, nan, None, rng.uniform(-5, 5), rng.randrange(-4, 5) * 1.0])
    points = [(rng.choice([1, 2, 3, None]), at(), at()) for _ in range(300)]
    boxes = [(rng.choice([1, 2, 4, None]), rng.randrange(60), at(), at(), at(), at()) for _ in range(2000)]
    p, b = spark.createDataFrame(points, "page long, x double, y double"), spark.createDataFrame(boxes, "page long, box long, x0 double, y0 double, x1 double, y1 double")
    pairs = p.join(b, "page").where("x >= x0 and x < x1 and y >= y0 and y < y1").groupBy("page", "box").count().collect()
    got = assembly.counted_in_boxes(p, b, "page")
    assert got.columns == [*b.columns, "points"]
    assert len(pairs) > 30
    assert sorted(map(tuple, got.groupBy("page", "box").agg({"points": "sum"}).collect())) == sorted(map(tuple, pairs))


def test_no_points_or_boxes(spark):
    p, b = spark.createDataFrame([(1, 1, 1)], "page long, x long, y long"), spark.createDataFrame([(1, 7, 0, 0, 2, 2)], "page long, box long, x0 long, y0 long, x1 long, y1 long")
    assert [tuple(r) for r in assembly.counted_in_boxes(p, b, "page").collect()] == [(1, 7, 0, 0, 2, 2, 1)]
    assert assembly.counted_in_boxes(p.limit(0), b, "page").count() == 0
    assert assembly.counted_in_boxes(p, b.limit(0), "page").count() == 0


def test_copies_make_no_pairs(spark):
    """As many points and boxes in one place as would make 40 thousand million pairs."""
    p = spark.range(200_000).selectExpr("1L AS page", "id % 10 AS x", "id % 10 AS y")
    b = spark.range(200_000).selectExpr("1L AS page", "id AS box", "0L AS x0", "0L AS y0", "10L AS x1", "10L AS y1")
    counts = assembly.counted_in_boxes(p, b, "page").groupBy("points").count().collect()
    assert [tuple(r) for r in counts] == [(200_000, 200_000)]
