"""Windows that blocks of half their length find, against all windows by brute force; the bound of the benchmark."""

import random

import pytest
from boxloom.llm import decontaminate
from tests.conftest import SF

from . import cases
from .test_scans import brute_hits


@pytest.mark.parametrize("window", [1, 2, 5, 9, 10])
def test_blocks_find_all_windows(window):
    rng = random.Random(window)
    word = lambda: rng.choice("a b c é dd ee".split())
    items = [(str(i), " ".join(word() for _ in range(rng.choice([0, 1, 3, window - 1, window, 25])))) for i in range(12)]
    m = decontaminate.machine(items, window)
    for _ in range(200):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _, t in rng.sample(items, 2):
            at = rng.randint(0, len(w))
            w[at:at] = t.split()
        hit, found = set(), set()
        for i, t in items:
            t = t.split()
            for g in {tuple(t[j : j + window]) for j in range(max(1, len(t) - window + 1))} if t else ():
                for j in range(len(w) - len(g) + 1):
                    if tuple(w[j : j + len(g)]) == g:
                        hit.update(range(j, j + len(g)))
                        found.add(i)
        n, runs, got = decontaminate.scan(" ".join(w), [m])
        assert n == len(w) and {x for a, b in runs for x in range(a, b)} == hit and got == found


def test_documents(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = decontaminate.decontaminate(spark.read.parquet(f"{SF}/documents.parquet").limit(60), bench).collect()
    assert all((r.dc_n_words, r.dc_n_hit, r.dc_items) == brute_hits(r.text, items) for r in got) and any(r.dc_contaminated for r in got)


def test_more_automata_than_are_kept(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(cases.docs(spark))
    want = sorted(map(repr, decontaminate.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(map(repr, decontaminate.decontaminate(docs, bench).collect())) == want


def test_a_benchmark_too_large_is_refused(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="split it"):
        decontaminate.decontaminate(cases.docs(spark), spark.createDataFrame([(1, "more than ten bytes")], "item_id long, text string"))
