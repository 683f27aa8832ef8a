"""Top-k search against all inner products, with ties, copies and bad rows."""

import math
import random

import pytest
from fieldspan.llm import search
from pyspark.errors import PySparkException


def brute(rows, k):
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in good if i % 5 == 0):
        s = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s[:k])}
    return out


def run(spark, rows, k=4):
    df = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    return {tuple(r) for r in search.top_k(df.filter("s_id % 5 = 0"), df, k).collect()}


def test_top_k(spark, monkeypatch):
    for name, n in (("SHARD", 40), ("LEAF", 4), ("BLOCK", 7)):
        monkeypatch.setattr(search, name, n)
    r = random.Random(3)
    rows = [(i, [r.choice([-0.5, 0.25, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(250)]
    import numpy as np

    rows = [(i, np.float32(v).tolist()) for i, v in rows]
    rows += [(300 + i, rows[0][1]) for i in range(90)]
    rows += [(500, None), (505, [1.0, None] * 3), (510, [float("nan")] * 6), (515, [float("inf")] * 6), (None, [0.5] * 6), (520, [0.5] * 3)]
    got = run(spark, rows)
    assert got == brute(rows, 4)


def test_few(spark):
    assert run(spark, [(0, [0.5, 0.5]), (1, [0.25, 0.5])]) == {(0, 1, 1, 128 * 64 + 128 * 128)}
    assert run(spark, [(0, None)]) == set()


def test_repeated_rows_count_once(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, 0.25, 0.75]) for _ in range(3)]) for i in range(40)]
    assert run(spark, rows * 3) == brute(rows, 4)


def test_clashing_columns(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([-0.5, 0.25, 0.75]) for _ in range(3)], "x", 1) for i in range(30)]
    df = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard string, s_id int"))
    assert {tuple(x) for x in search.top_k(df.filter("s_id % 5 = 0"), df, 4).collect()} == brute([x[:2] for x in rows], 4)


@pytest.mark.parametrize("scale", [2.0**17, 2.0**20.5, 2.0**21.3])
def test_large_scores_are_exact(spark, monkeypatch, scale):
    """Scores about 2**53, 2**60 and 2**62: components up to 2**30, all near one another."""
    for name, n in (("SHARD", 40), ("LEAF", 4), ("BLOCK", 7)):
        monkeypatch.setattr(search, name, n)
    r = random.Random(7)
    rows = [(i, [scale * r.choice([1, -1]) + r.randrange(-3, 4) / 256 for _ in range(4)]) for i in range(160)]
    df = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {tuple(x) for x in search.top_k(df.filter("s_id % 5 = 0"), df, 4).collect()}
    assert got == brute(rows, 4)


def test_scores_beyond_a_long(spark):
    for x in (1e8, 1e30):
        df = search.quantised(spark.createDataFrame([(0, [x] * 4), (1, [x] * 4)], "vec_id long, embedding array<double>"))
        with pytest.raises((ValueError, PySparkException)):
            search.top_k(df, df).collect()
    small = search.quantised(spark.createDataFrame([(0, [1e8] * 4), (1, [1e-2] * 4)], "vec_id long, embedding array<double>"))
    assert search.top_k(small.filter("s_id = 1"), small, 1).first().score == 4 * 2 * 25600000000


def test_no_side_is_broadcast_in_copies(spark, monkeypatch):
    """200 queries of 16 longs for each of 100 shards are 2.5 MB, at 6 GB many times what a driver holds."""
    for name, n in (("SHARD", 10), ("LEAF", 4), ("BLOCK", 50)):
        monkeypatch.setattr(search, name, n)
    r = random.Random(8)
    rows = [(i, [r.choice([-0.5, 0.25, 0.75, r.randrange(-256, 256) / 256]) for _ in range(16)]) for i in range(1000)]
    key = "spark.sql.maxBroadcastTableSize"
    old = spark.conf.get(key)
    spark.conf.set(key, "1m")
    try:
        assert run(spark, rows) == brute(rows, 4)
    finally:
        spark.conf.set(key, old)
