"""Decontamination, licenses, quality rules, mixing, URLs and languages against brute force, and on odd rows."""

import hashlib
import math
import re
from collections import Counter

import pytest
from boxloom.llm import decontaminate, language, licenses, mixing, quality, urls
from pyspark.sql import functions as F
from tests.conftest import SF

from . import cases


def windows(words, n):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute_hits(text, items):
    w = cases.norm_words(text)
    hit, found = set(), set()
    for item, t in items:
        for g in windows(cases.norm_words(t), 10):
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [(1, cases.PASSAGE), (2, None), (3, "..."), (4, "One"), (5, "É ÄB cd"), (12, " ".join(f"w{i}" for i in range(100, 112))), (13, "w5 w6")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    d = cases.odd(cases.docs(spark, [*cases.ROWS, (20, "W5 w6-w5 W6, w5é w6", "en", "a", 1)]))
    got = decontaminate.decontaminate(d, bench).collect()
    assert sorted((r.dc_n_words, r.dc_n_hit, r.dc_items) for r in got) == sorted(brute_hits(r.text, items) for r in got)
    for r in got:
        assert r.dc_contaminated == (r.dc_n_hit > 0)
        assert sum(len(cases.norm_words(r.text[s.start : s.end])) for s in r.dc_spans) == r.dc_n_hit
    assert decontaminate.decontaminate(cases.docs(spark, []), bench).count() == 0
    assert decontaminate.decontaminate(d, bench.limit(0)).where("dc_contaminated").count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(d.withColumn("DC_items", F.lit(1)), bench)


def brute_places(text):
    w = cases.norm_words(text)
    phrases = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    return w, sorted((i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_license_bases(spark):
    more = [
        (30, "CC BY cc by cc-BY/CC by", "en", "a", 1), (31, "GNU General Public License, all rights reserved. All  Rights\nReserved", "en", "a", 1), (32, "xcc by generalpublic license", "en", "a", 1),
        (33, "All rights reservedé cc byé", "en", "a", 1),
    ]
    d = cases.odd(cases.docs(spark, cases.ROWS + more)).unionByName(cases.odd(spark.read.parquet(f"{SF}/documents.parquet")))
    got = licenses.scan_licenses(d).collect()
    for r in got:
        w, base = brute_places(r.text)
        assert r.ls_n_words == len(w) and [(b.word, b.label) for b in r.ls_base] == base
    assert licenses.scan_licenses(cases.docs(spark, [])).count() == 0


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]), ("Released under the MIT License.", ["mit"]), ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]), ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]), ("All rights reserved.", ["reserved"]), ("a license to drive", []), ("released into the public domain", ["public-domain"]),
    ],
)
def test_license_rules(text, labels):
    found = licenses.scan(text)[2]
    assert [x[0] for x in found] == labels
    words = cases.norm_words(text)
    assert all(0 <= a < b <= len(words) for _, a, b, _ in found)


def test_license_gates_lose_nothing():
    """With and without the prefilters the same rules match, and contained detections are gone."""
    texts = ["Licensed under the Apache License, Version 2.0. Released under the MIT License", "GPL v2 license spdx license identifier mit", "creative commons attribution share alike 3 0", "permission is hereby granted free of charge to any person obtaining a copy"]
    for t in texts:
        line = f" {' '.join(cases.norm_words(t))} "
        every = [(m.start(), m.end(), r) for r in licenses.rules() for m in r.pattern.finditer(line)]
        kept = licenses.detect(line)
        assert any(k in line.encode() for k in licenses.KEYWORDS)
        assert all(any(a <= s and e <= b for a, b, _ in kept) for s, e, _ in every)
        assert not any(x is not y and x[0] <= y[0] and y[1] <= x[1] for x in kept for y in kept)
    assert len(licenses.rules()) > 300


def brute_quality(text):
    t = text or ""
    w = cases.words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if cases.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_counts(spark):
    more = [(40, "a b c a b c a b c", "en", "a", 1), (41, "a a a a", "en", "a", 1), (42, "x\ny\nx\nx \n\n", "en", "a", 1), (43, "#*$%&|<>😀é", "en", None, 1)]
    got = quality.judge(cases.odd(cases.docs(spark, cases.ROWS + more))).collect()
    assert len(got) == len(cases.ROWS) + len(more)
    for r in got:
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == brute_quality(r.text), r.doc_id
    assert quality.judge(cases.docs(spark, [])).count() == 0


def test_poisson_counts(spark):
    for rate in (0.0, 0.3, 1.0, 7.5, 900.0):
        cdf = spark.range(1).select(mixing.poisson_steps(F.lit(rate))).first()[0]
        p, total = -rate, 0.0
        for k, c in enumerate(cdf):
            total += math.exp(p) if rate or not k else 0
            assert abs(c - total) < 1e-9
            p += math.log(rate) - math.log(k + 1) if rate else 0
        assert abs(cdf[-1] - 1) < 1e-9


def test_mixing_meets_weights(spark):
    d = cases.odd(spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("source"), F.lit("t").alias("text")).drop("n"))
    d = d.drop("copy")
    got = mixing.mix(d, weights={"small": 3.0, "large": 1.0}, total=20000)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(n["small"] / 15000 - 1) < 0.05 and abs(n["large"] / 5000 - 1) < 0.05
    again = mixing.mix(d.repartition(7), weights={"small": 3.0, "large": 1.0}, total=20000)
    assert sorted(map(tuple, got.select("doc_id", "copy").collect())) == sorted(map(tuple, again.select("doc_id", "copy").collect()))
    odd = mixing.mix(cases.docs(spark, cases.ROWS * 3))
    assert odd.count() > 0 and mixing.mix(cases.docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(d.withColumn("Copy", F.lit(1)))


def test_urls(spark):
    listed = spark.createDataFrame([("bad.com/",), ("good.com/a/b",), (None,), ("",), ("bad.com/",)], "url string")
    rows = ["http://bad.com/x", "https://WWW.Bad.com", "http://notbad.com/", "http://good.com/a/b/?q#f", "http://good.com/a", None, "no scheme", "://", "http://x.net/y", "http://x.net", "http://a.example.net/en/1", "http://example.com/de/", "http://bad.com/x"]
    d = cases.odd(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string"))
    got = {r.page_id: (r.u_host, r.u_path, r.u_rule, r.u_verdict, r.u_listed) for r in urls.judge_urls(d, listed).collect()}
    assert len(got) == len(rows)
    assert got[0] == ("bad.com", "/x", None, "block", "bad.com/") == got[12]
    assert got[1] == ("www.bad.com", "", None, "block", "bad.com/") and got[2][3] == "allow"
    assert got[3] == ("good.com", "/a/b/", None, "block", "good.com/a/b") and got[4][3] == "allow"
    assert got[5] == got[6] == got[7] == ("", "", None, "allow", None)
    assert got[8][2:4] == ("net/", "block") and got[9][2:4] == (None, "allow") and got[10][2:4] == ("example.net/en/", "allow") and got[11][2:4] == ("example.com/de/", "block")
    assert urls.judge_urls(d.limit(0), listed).count() == 0 and urls.judge_urls(d, listed.limit(0)).where("u_listed IS NOT NULL").count() == 0


def test_bloom_filter_lets_listed_keys_pass(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h"), "id", F.lit(".com/")).alias("key"))
    blocks = 3000 * 16 // 512
    b = urls.bloom(keys, "key", blocks)
    asked = keys.unionByName(spark.range(3000).select(F.concat(F.lit("x"), "id").alias("key")))
    passed = asked.select("key", *urls._probes(F.col("key"), blocks)).join(b, "block").where("forall(bits, b -> coalesce(shiftright(words[b div 64], cast(b % 64 as int)) & 1L, 0L) = 1L)")
    assert passed.where("key LIKE 'h%'").count() == 3000 and passed.where("key LIKE 'x%'").count() < 60


def test_language_is_told_from_text_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.op5_language(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    labelled = cases.docs(spark, [(i, t, x, "a", 1) for i in range(30) for t, x in ((f"the cat and the dog {i}", "en"), (f"der Hund und die Katze {i}", "de"))])
    model = language.fit(labelled, "text", "lang", "doc_id")
    got = {r.doc_id: (r.li_pred, r.li_score) for r in language.predict(cases.odd(cases.docs(spark, [*cases.ROWS, (50, "123 !?", "en", "a", 1), (51, "Der Hund", None, None, None)])), model).collect()}
    assert got[1] == got[2] == got[3] == got[50] == ("und", 0.0) and got[51][0] == "de"
    empty = language.fit(labelled.limit(0), "text", "lang", "doc_id")
    assert language.predict(labelled, empty).where("li_pred <> 'und'").count() == 0
    assert language.predict(labelled.limit(0), model).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    rows = [(100 * k + i, f"{x * 3} {x}{x} {i}", x, "a", 1) for k, x in enumerate("abcdefgh") for i in range(40 - 4 * k)] + [(9000, "zz zzz zz", "z", "a", 1)]
    model = language.fit(cases.docs(spark, rows), "text", "lang", "doc_id")
    assert model.languages == [*"abcdefgh", "z"]
    got = language.predict(cases.docs(spark, rows), model).collect()
    assert all(r.li_pred == r.lang for r in got if r.lang != "z") and abs(model.weights[:, -1]).max() > 0


def test_long_texts_count_as_whole(monkeypatch):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(50))
    whole = language.counts_of(text)
    monkeypatch.setattr(language, "PIECE", 37)
    parts = language.counts_of(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, f"{x * 3} {x}{x} {i}", x, "a", 1) for i, x in enumerate("abcd" * 50)] + [(900, None, "a", "a", 1), (901, "text", None, "a", 1), (None, "bb bb", "b", "a", 1), (7, "ddd dd 7", "d", "a", 1)]
    taken = []
    real = language.train
    monkeypatch.setattr(language, "train", lambda rows, *a: taken.append(rows) or real(rows, *a))
    whole = language.fit(cases.docs(spark, rows), "text", "lang", "doc_id")
    monkeypatch.setattr(language, "SAMPLE_BYTES", sum(8 * len(some) for some, _, _ in taken[0]) // 2)
    half = language.fit(cases.docs(spark, rows).repartition(7), "text", "lang", "doc_id")
    size = lambda t: sum(8 * len(some) for some, _, _ in t)
    assert whole.languages == half.languages == [*"abcd"] and 0 < size(taken[1]) < 0.8 * size(taken[0])
    assert (whole.idf == half.idf).all()


def test_large_rates_and_totals(spark):
    d = cases.docs(spark, [(i, "t", "en", "a", 1) for i in range(40)])
    got = mixing.mix(d, weights={"a": 1.0}, total=40 * 2000)
    assert abs(got.count() / 80000 - 1) < 0.02
