"""The host prior: hosts that differ by chance only aren't told apart, hosts that differ are."""

import random

import duckdb
import pytest
from boxloom.llm import quality
from pyspark.sql import functions as F
from tests.conftest import SF

from . import cases


def rates(spark, rows):
    d = spark.createDataFrame(rows, "source string, failed boolean")
    return {r["host"]: r["rate"] for r in quality.host_rates(d, "source", "failed").collect()}


def test_identical_hosts_are_not_condemned(spark):
    rng = random.Random(3)
    rows = [(f"h{i}", rng.random() < 0.4) for i in range(4000) for _ in range(5)]
    got = rates(spark, rows)
    assert max(got.values()) < 0.45 and min(got.values()) > 0.35


def test_a_host_that_differs_stands_out(spark):
    rng = random.Random(4)
    rows = [(f"h{i}", rng.random() < 0.2) for i in range(500) for _ in range(20)] + [("spam", i % 10 > 0) for i in range(300)] + [("one", True)]
    got = rates(spark, rows)
    assert got["spam"] > 0.8 and got["one"] < 0.5 and max(v for k, v in got.items() if k != "spam") < 0.5


def test_prior_of_known_hosts(spark):
    """Rates drawn from a beta distribution: the share found is 1 / (a + b + 1)."""
    rng = random.Random(5)
    a, b, n = 2.0, 6.0, 12
    counts = [sum(rng.random() < p for _ in range(n)) for p in (rng.betavariate(a, b) for _ in range(6000))]
    mean = sum(counts) / (n * len(counts))
    got = quality.overdispersion(mean, len(counts), n * len(counts), n * n * len(counts), sum(n * (k / n - mean) ** 2 for k in counts))
    assert abs(got - 1 / (a + b + 1)) < 0.01


@pytest.mark.parametrize("rows", [[], [("a", True)], [("a", False), (None, False)], [(None, True), (None, False)]])
def test_few_hosts(spark, rows):
    assert all(0 <= r <= 1 for r in rates(spark, rows).values())


def test_windows_of_equal_hashes_differ(spark, monkeypatch):
    """Words decide, not their hashes."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    got = quality.judge(cases.docs(spark)).collect()
    monkeypatch.undo()
    want = quality.judge(cases.docs(spark)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(r.q_n_repeat_words for r in want)


def test_texts_carried_or_not_give_the_same(spark):
    d = cases.odd(cases.docs(spark))
    short = quality.judge(d, keep=["doc_id"])
    assert sorted(map(repr, short.collect())) == sorted(map(repr, quality.judge(d).select(*short.columns).collect()))


def test_against_sql(spark):
    got = sorted(map(tuple, quality.op3_quality(spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == sorted(con.execute(quality.ORACLE).fetchall())


def test_verdicts_without_counts_are_the_same(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(rng.choice([3, 9, 40, 400]))]) for _ in range(rng.choice([2, 49, 50, 51, 120, 300]))) for _ in range(300)]
    texts += [" ".join([f"x{i}" for i in range(k)] * 2 + [f"y{i}" for i in range(m)]) for k in (5, 20, 60) for m in (0, 10, 39, 40, 41, 200)]
    d = cases.odd(cases.docs(spark, [*cases.ROWS, *((i + 100, t, "en", f"h{i % 7}", 1) for i, t in enumerate(texts))])).unionByName(cases.odd(spark.read.parquet(f"{SF}/documents.parquet")))
    columns = ["doc_id", "text", "q_base_failed", "q_host_failed", "q_kept"]
    got = quality.judge(d, counts=False)
    want = quality.judge(d).select(*columns).collect()
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, want)) and 50 < sum(r.q_base_failed for r in want) < len(want) - 50
    assert "q_n_words" not in got.columns and quality.judge(d, keep=["doc_id"], counts=False).columns == ["doc_id", "q_base_failed", "q_host_failed", "q_kept"]
