import hashlib
import random

import pytest
from boxloom.llm import exact
from tests.conftest import SF

from . import cases


def brute(rows, width):
    """doc_id, text pairs -> (n_bytes, n_removed, n_spans, digest) of each; equal pairs are one document."""
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for n, (row, raw) in enumerate(zip(rows, raws)):
        for i in range(len(raw) - width + 1):
            seen.setdefault(raw[i : i + width], set()).add((row, i))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - width + 1):
            if len(seen[raw[i : i + width]]) > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, df, width=400):
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = sorted(((r[0], *b) for r, b in zip(rows, brute(rows, width))), key=repr)
    got = exact.remove_repeats(df, width=width).select("doc_id", "sx_n_bytes", "sx_n_removed", "sx_spans", "sx_kept").collect()
    got = sorted(((r[0], r[1], r[2], len(r[3]), hashlib.sha256(r[4]).hexdigest()) for r in got), key=repr)
    assert got == want
    return got


def test_documents(spark):
    got = check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert sum(r[2] for r in got)


@pytest.mark.parametrize("width", [40, 64, 400])
def test_passages_at_all_places(spark, width):
    rng = random.Random(width)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 8)))
    texts = lambda k: " ".join(word() for _ in range(k))
    shared = [texts(rng.randint(60, 160)) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [texts(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 40)
            parts += [p[a : len(p) - rng.randint(0, 40)], texts(rng.randint(0, 60))]
        rows.append((i, " ".join(parts), "en", "a", 1))
    rows += [(100, "ab" * 700, "en", "a", 1), (101, "x" * 900, "en", "a", 1), (102, "line of text\n" * 80, "en", "a", 1), rows[3], (3, "other text of the same key " * 3, "en", "a", 1)]
    check(spark, cases.docs(spark, rows), width)


def test_many_copies(spark):
    """Pieces in far more than two places of a task, rows that repeat among them."""
    rng = random.Random(5)
    text = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    whole, passage = text(1500), text(700)
    rows = [(i, whole, "en", "a", 1) for i in range(30)] + [(i, text(rng.randint(0, 500)) + passage[rng.randint(0, 90) :] + text(rng.randint(0, 300)), "en", "a", 1) for i in range(30, 70)]
    alone = (90, text(900), "en", "a", 1)
    got = check(spark, cases.docs(spark, [*rows, rows[0], rows[40], *[alone] * 5]))
    assert all(r[2] == r[1] for r in got if r[0] < 30) and all(r[2] == 0 for r in got if r[0] == 90)


def test_odd_rows(spark):
    check(spark, cases.odd(cases.docs(spark)))
    check(spark, cases.docs(spark, []))


def test_hot_keys(spark, monkeypatch):
    """With every repeated key taken for hot, longer shared parts choose the shards and the result is the same."""
    run = exact._count

    def count(batches):
        import boxloom.llm.exact as there

        there.HOT = 0
        yield from run(batches)
        there.HOT = 2048

    count.__module__ = "__main__"  # so that workers get this function, which sets the limit there
    monkeypatch.setattr(exact, "_count", count)
    check(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(80))


def test_a_string_of_very_many_texts(spark, monkeypatch):
    """A passage that every text holds, each with other surroundings: its keys go through all rounds, whether a task or the count finds them hot."""
    rng = random.Random(9)
    text = lambda k: "".join(rng.choices("abcdefgh é", k=k))
    passage = text(430)
    rows = [(i, text(rng.randint(200, 500)) + passage + text(rng.randint(200, 500)), "en", "a", 1) for i in range(90)]
    rows += [(200, rows[7][1] + "end", "en", "a", 1), (201, text(2000), "en", "a", 1)]
    monkeypatch.setattr(exact, "IN_TASK", 3)
    kinds = []
    durable = exact.durable
    monkeypatch.setattr(exact, "durable", lambda df: kinds.append(durable(df)) or kinds[-1])
    got = check(spark, cases.docs(spark, rows).repartition(3))
    assert len(kinds) == 3 and all(k.where("many").count() for k in kinds[:2])
    assert all(r[2] >= 430 for r in got if r[0] < 90) and next(r[2] for r in got if r[0] == 201) == 0


def test_pieces_of_equal_hashes_are_compared():
    """Third and further pieces count as known only if their bytes are equal."""
    import numpy as np

    raw = b"aaaa" * 3 + b"bbbb"
    n = 4
    columns = [np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    got, known = exact._once(columns, np.arange(n) * 4, raw, 4)
    assert got[2].tolist() == [0, 1, 2, 3] and known.tolist() == [False, False, True, False]
