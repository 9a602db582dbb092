import random
import re
import string

import corpus_pipeline
from boxloom.llm import quality, secrets
from pyspark.sql import functions as F
from tests.conftest import SF

from . import cases
from .test_simhash import brute_components, brute_fingerprint


def brute_base_failed(text):
    w = cases.words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    again = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)} if len(grams) < 3000 else set()
    return len(w) < 50 or 100 * len(again) > 50 * len(w)


def staged(spark, rows, sf_dir=SF):
    docs, out = cases.docs(spark, rows), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        out.append(sorted(map(tuple, docs.collect()), key=repr))
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_stages_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]
    bench = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    first, second, third, fourth, fifth = staged(spark, rows)
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(brute_base_failed(r[1]))
    assert sum(map(sum, by.values())) / len(rows) < 0.4
    assert first == sorted((r for r in rows if not brute_base_failed(r[1])), key=repr)  # no host fails as a whole
    ordered = sorted(first)
    roots = brute_components([r[0] for r in ordered], [brute_fingerprint(r[1]) for r in ordered])
    assert second == sorted((r for r, x in zip(ordered, roots) if r[0] == x), key=repr)
    windows = set()
    for t in bench:
        w = cases.norm_words(t)
        windows |= {" ".join(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    short = [w for w in windows if w.count(" ") < 9]
    hit = lambda t: any(" ".join(w[i : i + 10]) in windows for w in [cases.norm_words(t)] for i in range(len(w))) or any(f" {s} " in f" {' '.join(cases.norm_words(t))} " for s in short)
    assert third == sorted((r for r in second if not hit(r[1])), key=repr) and len(third) < len(second)
    planted = re.compile(r'(?i)(?<=token = ")[0-9a-f]{40}|(?<=password=)[0-9a-f]{18}|AKIA[A-Z0-9]{16}')
    want = []
    for r in third:
        t = planted.sub("[SECRET]", r[1])
        want.append((r[0], t, r[2], r[3], len(t) if t != r[1] else r[4]))
    assert fourth == sorted(want, key=repr)
    assert {r[:5] for r in fifth} <= set(fourth) and len({r[6] for r in fifth}) == len(fifth)
    assert 0.8 < len(fifth) / len(fourth) < 1.2


def test_odd_rows(spark):
    out = staged(spark, cases.ROWS * 2)
    assert all(r[1] for r in out[1])
    keys = [r[0] for r in out[1]]
    assert len(keys) == len(set(keys))
    assert staged(spark, [])[-1] == []


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*corpus_pipeline.COLUMNS, "copy", "shuffle_key"] and got.count() > 100


def test_forest_holds_out():
    model = secrets.train()
    x, y = secrets.examples(secrets.labelled_findings(1500, 7))
    assert ((model.probability(x) >= 0.5) == y).mean() > 0.97


def test_long_secrets_go_whole():
    rng, alnum = random.Random(1), string.ascii_letters + string.digits
    pick = lambda k: "".join(rng.choices(alnum, k=k))
    pem = lambda n: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(pick(64) for _ in range(n)) + "\n-----END RSA PRIVATE KEY-----"
    cases = [(lead, pick(n)) for lead in ("aws_session_token = ", "Authorization: Bearer ") for n in (64, 511, 513, 800, 5000)]
    cases += [("", "ghp_" + pick(400)), ("password = ", pick(2000)), ("Bearer ", "abcdefghij" * 5 + pick(60)), ("key ", pem(12)), ("key ", pem(200))]
    texts = [f"und the {lead}{value}, lo vern" for lead, value in cases]
    _, found = secrets.scan(texts, [None] * len(texts), secrets.train(), secrets.THRESHOLD)
    assert [secrets.redact(t, f) for t, f in zip(texts, found)] == [f"und the {lead}[SECRET], lo vern" for lead, _ in cases]


def test_hosts_rejected(spark):
    """A host whose documents mostly fail loses its good ones too; rates are shrunk, so one failure condemns no small host."""
    good = " ".join(f"x{i}" for i in range(60))
    rows = [(i, good if i % 10 == 0 else "bad", "en", "spam", 1) for i in range(200)]
    rows += [(1000 + i, good, "en", f"host{i % 20}", 1) for i in range(400)] + [(2000, "bad", "en", "tiny", 1), (2001, good, "en", "tiny", 1), (2002, good, "en", None, 1)]
    kept = {r[0]: r[1] for r in quality.judge(cases.docs(spark, rows)).select("doc_id", "q_kept").collect()}
    assert not any(kept[i] for i in range(200))
    assert all(kept[1000 + i] for i in range(400)) and kept[2001] and kept[2002] and not kept[2000]
    assert quality.judge(cases.odd(cases.docs(spark))).where(F.col("q_kept").isNull()).count() == 0
