"""Percentiles and natural places against plain versions."""

import random
import re

import numpy as np

from sheafspark.operators import stats, tables


def test_percentiles(spark):
    rng = random.Random(4)
    data = [(g, v) for g, n in (("a", 997), ("b", 1), ("c", 2), (None, 400)) for v in (rng.choice([rng.gauss(0, 1e6), rng.random(), 0.5]) for _ in range(n))]
    data += [("d", None), ("a", None), ("e", 3.0), ("e", 3.0), ("f", float("-inf")), ("f", 1.0), ("f", 2.0)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r.g: (r.low, r.mid, r.high) for r in stats.percentiles(df, "g", "v", {"low": 0.0, "mid": 0.5, "high": 0.93}, bins=16).collect()}
    assert set(got) == {g for g, _ in data} and got["d"] == (None, None, None)
    for g in {g for g, v in data if v is not None and g != "f"}:
        own = np.array([v for k, v in data if k == g and v is not None])
        assert np.allclose(got[g], np.quantile(own, [0, 0.5, 0.93]), rtol=1e-12)
    assert got["f"][:2] == (float("-inf"), 1.0)
    assert stats.percentiles(df.limit(0), "g", "v", {"mid": 0.5}).count() == 0


def test_modal(spark):
    df = spark.createDataFrame([("a", 3), ("a", 3), ("a", 1), ("a", 1), ("b", None), (None, 5)], "g string, v int")
    assert {(r.g, r["mode"], r.n) for r in stats.modal(df, "g", df.v).collect()} == {("a", 1, 2), ("b", None, 1), (None, 5, 1)}


def test_natural_places(spark):
    rng = random.Random(5)
    names = [rng.choice(["A", "b", "", "part "]) + rng.choice(["", "2", "10", "02", "2x", "7 b"]) for _ in range(300)] + [None, None]
    data = [(i, n) for i, n in enumerate(names)]
    got = {r.id: r.place for r in tables.natural_places(spark.createDataFrame(data, "id long, n string"), "n", "id").collect()}

    def key(row):
        i, n = row
        if n is None:
            return (0, "", -1, "", i)
        letters, number = re.match("([^0-9]*)([0-9]*)", n.lower()).groups()
        return (1, letters, int(number) if number else -1, n.lower(), i)

    assert [got[i] for i, _ in sorted(data, key=key)] == list(range(1, len(data) + 1))
