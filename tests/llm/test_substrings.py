import hashlib
import random

import numpy as np
from boxloom.llm import substrings
from tests.conftest import SF

from . import cases


def brute(rows, window=20):
    """doc_id, text pairs -> (n_words, n_removed, digest) of each; equal pairs are one document."""
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, gone = set(), {}
    for row in order:
        w = cases.words(row[1])
        out = gone[row] = set()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in seen:
                out.update(range(i, i + window))
            seen.add(g)
    result = []
    for row in rows:
        w = cases.words(row[1])
        kept = " ".join(x for i, x in enumerate(w) if i not in gone[row])
        result.append((len(w), len(gone[row]), hashlib.sha256(kept.encode()).hexdigest()))
    return result


def check(spark, df):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(rows))), key=repr)
    got = substrings.remove_repeats(df).select("doc_id", "sd_n_words", "sd_n_removed", "sd_spans", "sd_kept").collect()
    for r in got:
        assert sum(s["end"] - s["start"] for s in r["sd_spans"]) == r["sd_n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["sd_spans"], r["sd_spans"][1:]))
    assert sorted(((r[0], r[1], r[2], hashlib.sha256(r[4].encode()).hexdigest()) for r in got), key=repr) == want
    return want


def test_documents(spark):
    assert sum(r[2] for r in check(spark, spark.read.parquet(f"{SF}/documents.parquet")))


def test_odd_rows(spark):
    check(spark, cases.odd(cases.docs(spark)))
    check(spark, cases.docs(spark, []))


def test_small_flushes(spark, monkeypatch):
    """Windows that tasks pass on in many small lots give the same result."""
    rng = random.Random(1)
    shared = [[f"s{i}_{j}" for j in range(45)] for i in range(5)]
    rows = []
    for i in range(120):
        w = [f"u{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(shared)
            w += p[rng.randint(0, 15) : 45 - rng.randint(0, 10)] + [f"u{rng.randint(0, 99)}"]
        rows.append((rng.randint(0, 10**6), " ".join(w), "en", "a", 1))
    check(spark, cases.docs(spark, rows).repartition(7))


def test_packing():
    rng = np.random.default_rng(0)
    text = np.sort(rng.integers(0, 9, 100))
    ids, sums = rng.integers(-(1 << 62), 1 << 62, 9), rng.integers(0, 1 << 32, 9)
    place, hashes = rng.integers(0, 1 << 30, 100), rng.integers(0, 1 << 62, 100).astype(np.uint64)
    got = substrings._unpack(substrings._pack(ids, sums, text, place, hashes))
    assert all(np.array_equal(a, b) for a, b in zip(got, (ids[text], sums[text], place, hashes)))
    assert not len(substrings._unpack(substrings._pack(ids, sums, text, place))[3])


def collision():
    """Two texts of 20 words that differ in the last one, a Thue-Morse word or its complement: a polynomial modulo 2 ** 64 gives both one hash."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    first = [f"w{i}" for i in range(19)]
    return [" ".join([*first, "".join("ab"[b ^ x] for b in bits)]) for x in (0, 1)]


def test_equal_hashes_are_not_equal_words(spark):
    one, two = collision()
    data = [substrings.utf8(__import__("pyarrow").array([t])) for t in (one, two)]
    assert substrings.window_hashes(*data[0], 20)[0][0] == substrings.window_hashes(*data[1], 20)[0][0]
    rows = [(1, one), (2, two), (3, f"{two} more"), (4, f"x {one}\n{two}  {one}"), (5, two), (6, f"{one} {two}"), (7, f"a {two} b {one}")]
    d = cases.docs(spark, [(i, t, "en", "a", 1) for i, t in rows])
    for n in (1, 4, 7):  # in one task, and in several
        check(spark, d.repartition(n))


def test_all_hashes_equal(spark, monkeypatch):
    """With hashes that say nothing the words alone give the result."""
    real = substrings.window_hashes

    def none(data, offsets, window):
        h, text, place = real(data, offsets, window)
        return h % np.uint64(3) << np.uint64(60), text, place

    none.__module__ = "__main__"  # so that workers get this function
    monkeypatch.setattr(substrings, "window_hashes", none)
    rng = random.Random(3)
    shared = [f"s{j}" for j in range(60)]
    rows = [(i, " ".join([f"u{rng.randint(0, 99)}" for _ in range(rng.randint(0, 9))] + shared[rng.randint(0, 30) :] + [f"u{i}"]), "en", "a", 1) for i in range(25)]
    check(spark, cases.docs(spark, [*rows, (3, "other words " * 15, "en", "a", 1)]).repartition(5))
