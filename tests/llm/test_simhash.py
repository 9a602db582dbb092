import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from boxloom.llm import simhash
from boxloom.llm.components import components
from tests.conftest import SF

from . import cases


def brute_fingerprint(text):
    w = cases.words(cases.lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, fps):
    """Smallest key reachable, keys sorted."""
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = np.array(fps, np.uint64)
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [keys[find(i)] for i in range(len(keys))]


def check(spark, df):
    rows = df.select("doc_id", "text").collect()
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    fps = [brute_fingerprint(r[1]) for r in rows]
    want = sorted(zip((r[0] for r in rows), fps, brute_components([r[0] for r in rows], fps)), key=repr)
    got = sorted(((r[0], r[1] % (1 << 64), r[2]) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == want


def test_documents(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd_rows(spark):
    check(spark, cases.odd(cases.docs(spark)))
    check(spark, cases.docs(spark, []))
    check(spark, cases.docs(spark, [(None, "x y z", None, None, None), (None, "x y z", None, None, None), (4, "q r s t u v", None, None, None)]))


def test_equal_keys_dont_link_texts(spark):
    """Rows without a key, or of one key, are nodes of their own: a component is made by texts alone."""
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (None, c), (3, c), (7, d), (7, e), (8, e), (7, a)]
    df = cases.docs(spark, [(k, t, None, None, None) for k, t in rows])
    ids = {(r[0], r[1] % (1 << 64)): r[2] for r in simhash.near_duplicates(df).collect()}
    f = {t: brute_fingerprint(t) for t in (a, b, c, d, e)}
    assert len(set(f.values())) == 5
    assert ids == {(None, f[a]): 7, (7, f[a]): 7, (None, f[b]): None, (None, f[c]): 3, (3, f[c]): 3, (7, f[d]): 7, (7, f[e]): 7, (8, f[e]): 7}
    assert sorted(((r[0], r[1]) for r in simhash.keep_one(df).collect()), key=repr) == sorted([(7, a), (None, b), (3, c), (7, d), (7, e)], key=repr)


@pytest.mark.parametrize("hot,two", [(256, 1 << 23), (4, 1 << 23), (4, 0)])
def test_clusters_of_many_fingerprints(spark, monkeypatch, hot, two):
    """Every path of the index finds the same components as brute force."""
    monkeypatch.setattr(simhash, "HOT", hot)
    monkeypatch.setattr(simhash, "TWO_BYTES", two)
    rng = np.random.default_rng(5)
    fps = set()
    for _ in range(40):
        center = int(rng.integers(0, 1 << 63)) * 2
        for _ in range(int(rng.integers(1, 60))):
            fps.add(center ^ sum(1 << int(b) for b in set(rng.integers(0, 64, 4))))
    center = int(rng.integers(0, 1 << 62))
    fps |= {center ^ sum(1 << int(b) for b in set(rng.integers(0, 16, 3))) for _ in range(200)}
    fps = sorted(fps)
    nodes = rng.permutation(len(fps)).tolist()
    order = np.argsort(nodes)
    want = dict(zip(np.array(nodes)[order].tolist(), brute_components(np.array(nodes)[order].tolist(), np.array(fps, np.uint64)[order])))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, n) for f, n in zip(fps, nodes)], "fp long, node long")
    got = {n: n for n in nodes} | {r[0]: r[1] for r in components(simhash.links(df)).collect()}
    assert got == want


def test_both_comparisons_agree():
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 62)) & ~0xFFFFFF
    fp = np.unique(np.array([base | int(x) for x in rng.integers(0, 1 << 24, 3000)] + [base | 1 << i for i in range(24)], np.uint64))
    a = {p for x in simhash.near_pairs(fp, np.zeros(len(fp), int)) for p in zip(*map(np.ndarray.tolist, x))}
    b = {p for x in simhash.looked_up(fp, np.arange(24)) for p in zip(*map(np.ndarray.tolist, x))}
    assert a == b and a


def test_components_of_a_long_chain(spark):
    rows = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}
