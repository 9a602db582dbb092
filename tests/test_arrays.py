"""Rasters and feature maps held as arrays, against numpy."""

import numpy as np
from boxloom.operators import arrays, candidates
from pyspark.sql import functions as F


def row(spark, values):
    return spark.createDataFrame([([float(v) for v in values],)], "b array<double>")


def brute_resize(a, h, w):
    ys, xs = ((np.arange(n) + 0.5) * o / n - 0.5 for n, o in ((h, a.shape[0]), (w, a.shape[1])))
    at = lambda f, o: (np.clip(np.floor(f), 0, o - 1).astype(int), np.clip(np.floor(f) + 1, 0, o - 1).astype(int), f - np.floor(f))
    (y0, y1, wy), (x0, x1, wx) = at(ys, a.shape[0]), at(xs, a.shape[1])
    rows = a[y0] * (1 - wy)[:, None] + a[y1] * wy[:, None]
    return rows[:, x0] * (1 - wx) + rows[:, x1] * wx


def test_resize(spark):
    a = np.random.default_rng(0).integers(0, 256, (4, 6)).astype(float)
    for h, w in ((4, 6), (8, 3), (1, 1), (5, 11)):
        got = row(spark, a.ravel()).select(arrays.resize(F.col("b"), 4, 6, h, w)).first()[0]
        assert np.allclose(np.array(got).reshape(h, w), brute_resize(a, h, w))


def test_photometric(spark):
    d = spark.createDataFrame([([0, 100, 255, 7],)], "b array<int>")
    change = lambda kind, amount: d.select(arrays.photometric(F.col("b"), F.lit(kind), F.lit(amount))).first()[0]
    assert change("invert", 0) == [255, 155, 0, 248]
    assert change("brightness", 10) == [10, 110, 255, 17]
    assert change("contrast", 50) == [64, 114, 191, 67]
    assert change("channel_shift", 5) == [5, 100, 250, 12]
    assert change("channel_shuffle", 0) == [255, 0, 100, 7]
    assert change("none", 3) == [0, 100, 255, 7]


def test_change_must_be_visible(spark):
    d = spark.createDataFrame([([0] * 40, [0] * 39 + [200]), ([0] * 40, [100] * 40), ([5] * 40, [6] * 40)], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(arrays.accepted(F.col("a"), F.col("b"), 20.0)).collect()] == [False, True, False]


def test_volume_and_pools(spark):
    v = np.random.default_rng(1).normal(size=(3, 4))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s, p = row(spark, v.ravel()).select(arrays.self_similarity(F.col("b"), 4), arrays.pools(F.col("b"), 4)).first()
    assert np.allclose(np.array(s).reshape(3, 3), (u @ u.T + 1) / 2)
    assert np.allclose(p, [*v.mean(axis=0), *v.max(axis=0)])
    assert row(spark, [0, 0, 1, 0]).select(arrays.self_similarity(F.col("b"), 2)).first()[0] == [0.5, 0.5, 0.5, 1.0]


def test_strips_and_closest_color(spark):
    d = spark.createDataFrame([(g, i, float(i)) for g, n in ((0, 6), (1, 9)) for i in range(n)], "g int, i int, score double")
    got = candidates.strips(d, "g", "i").orderBy("g", "place").select("g", "i").collect()
    assert [r.i for r in got if r.g == 0] == [5, 4, 3, 2, 1, 0]
    assert [r.i for r in got if r.g == 1] == [8, 7, 5, 1, 0]
    c = spark.createDataFrame([("f", 1, 2.0, 1), ("f", 2, 1.0, 3), ("f", 3, 1.0, 2)], "g string, item int, mean_d double, place int")
    assert [tuple(r) for r in candidates.closest_color(c, ["g"], ["item"]).collect()] == [("f", 3, 3, 1.0)]
