"""License rules: keywords lose no match, suppression against a plain version, names that are common words."""

import random
import time

import pyarrow.parquet as pq
import pytest
from boxloom.llm import licenses
from tests.conftest import SF

from . import cases


def line_of(text):
    return f" {' '.join(cases.norm_words(text))} "


def brute(line):
    """All matches of all rules over the whole line, then those that no better one holds."""
    every = [(m.start(), m.end(), n) for n, r in enumerate(licenses.rules()) for m in r.pattern.finditer(line)]
    rank = lambda x: (licenses.rules()[x[2]].priority, x[0] - x[1], x[0], x[2])
    kept = []
    for x in sorted(every, key=rank):
        if not any(a <= x[0] and x[1] <= b for a, b, _ in kept):
            kept.append(x)
    return every, sorted(kept)


def both(text):
    line = line_of(text)
    every, kept = brute(line)
    assert sorted(licenses.matches(line)) == sorted(every), text
    got = licenses.detect(line)
    assert sorted((a, b, licenses.rules().index(r)) for a, b, r in got) == kept, text
    return len(kept)


def test_all_documents():
    texts = pq.read_table(f"{SF}/documents.parquet", columns=["text"])["text"].to_pylist()
    assert sum(both((t or "")[:20000]) for t in texts) > 0


def test_made_sentences():
    """Words of names, grants and prose in any order."""
    rng = random.Random(2)
    names = "apache software license version 2 0|mit|the mit|mit no attribution|bsd 3 clause|gnu gpl v3|gnu general public license version 2|lgpl 2 1|mozilla public license 2 0|mpl2|cc by sa 4 0|creative commons attribution non commercial international 4 0|cc0 1 0|ruby|vim|curl|gpl|eupl 1 2|open ofl|wtfpl|do what the fuck you want to public license|odc by v1 0|zlib libpng|asl 2 0|mulan psl2|blue oak model license 1 0 0".split("|")
    grants = "spdx license identifier|licensed under the terms of the|relicensed under|released under the|distributed with the|available on|provided with|subject to the terms of|license|licence|lizenz|licencia|licensed|all rights are reserved|copyright c 2020|public domain".split("|")
    prose = "und mit der von the work is a version of software für plötzlich 2 0 v c by license under".split()
    n = 0
    for _ in range(400):
        parts = []
        for _ in range(rng.randint(1, 30)):
            kind = rng.random()
            parts.append(rng.choice(names) if kind < 0.3 else rng.choice(grants) if kind < 0.6 else " ".join(rng.choices(prose, k=rng.randint(1, 40))))
        n += both(" ".join(parts))
    assert n > 500


def test_every_rule_has_its_keywords():
    """A match of every name rule, made from the first alternative of its pattern, holds one of its keywords."""
    import re

    for label, (name, _) in licenses.NAMES.items():
        sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", name)).replace(" ?", " ").replace("[cs]", "s").replace("[23]", "2").replace("?", "")
        sample = re.sub(r"[()|:].*", "", re.sub(r"\s+", " ", sample)).strip()
        assert both(f"spdx license identifier {sample} und licensed under the {sample} license") > 0, label


@pytest.mark.parametrize(
    "text",
    [
        "Das Werk steht unter einer Lizenz mit weiteren Bedingungen.", "Lizenz mit", "Die Lizenz: mit Auflagen des Verlags", "Software mit License Key", "licence mit dem Verlag", "the license ruby slippers", "a driver's license, vim and vigour",
        "une licence avec curl", "la licencia ruby del conductor", "available on Ruby", "distributed with curl and zlib", "published on vim", "provided with OpenSSL", "Sous licence d'exploitation mit", "Er fährt mit Lizenz", "la licencia de conducir", "el permiso con licencia vim",
    ],
)
def test_common_words_are_no_licenses(text):
    assert licenses.scan(text)[2] == []


@pytest.mark.parametrize(
    "text,label",
    [
        ("License: MIT", "mit"), ("Lizenz: MIT", "mit"), ('"license": "mit",', "mit"), ("license = 'Ruby'", "ruby"), ("License (MIT)", "mit"), ("under the mit license", "mit"), ("The Vim License", "vim"), ("curl license", None),
        ("Licensed under MIT", "mit"), ("released under the Ruby license", "ruby"), ("distributed with the OpenSSL license", "openssl"), ("SPDX-License-Identifier: curl", "curl"), ("tous droits réservés", "reserved"), ("Alle Rechte vorbehalten", "reserved"),
    ],
)
def test_plain_names_where_the_text_shows_them(text, label):
    assert [x[0] for x in licenses.scan(text)[2]] == ([label] if label else [])


@pytest.mark.parametrize("unit", ["available ruby ", "mit der Lizenz von und ", "license ruby ", "é licensed under ü "])
def test_long_texts_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    licenses.scan(unit)
    began = time.process_time()
    licenses.scan(text)
    assert time.process_time() - began < 3
