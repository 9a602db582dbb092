"""License scans: ordered signature rules behind a keyword prefilter, with priorities and interval containment."""

from __future__ import annotations

import re
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM, extended, read, slices

#: Base phrases and their labels, as the contract fixes them.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label: a regular expression of the name as it stands in normalised words (a-z, digits, single spaces), and keywords, one of which is in every match
#: (whole words; with a star the beginning of one).
NAMES = {
    "apache-1.0": (r"apache(?: software)?(?: license)? (?:v |version )?1 0", "apache"),
    "apache-1.1": (r"apache(?: software)?(?: license)? (?:v |version )?1 1", "apache"),
    "apache-2.0": (r"(?:apache(?: software)?(?: license)? (?:v |version )?2(?: 0)?|asl 2 0|al2)", "apache|asl 2 0|al2"),
    "mit": (r"(?:mit|expat|x11)", "mit|expat|x11"),
    "mit-0": (r"mit (?:0|no attribution)", "mit"),
    "isc": (r"(?:isc|internet systems consortium)", "isc|internet systems consortium"),
    "bsd-2-clause": (r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd|freebsd"),
    "bsd-3-clause": (r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd"),
    "bsd-4-clause": (r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)", "bsd"),
    "bsd": (r"(?:bsd|berkeley software distribution)", "bsd|berkeley software distribution"),
    "0bsd": (r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd|bsd"),
    "gpl-1.0": (r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?1(?: 0)?", "gpl*|general public license*"),
    "gpl-2.0": (r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?2(?: 0)?", "gpl*|general public license*"),
    "gpl-3.0": (r"(?:gnu )?(?:gpl|general public license)(?: v| version)? ?3(?: 0)?", "gpl*|general public license*"),
    "gpl": (r"(?:gnu gpl|gnu general public license)", "gnu"),
    "lgpl-2.0": (r"(?:gnu )?(?:lgpl|(?:lesser|library) general public license)(?: v| version)? ?2(?: 0)?", "lgpl*|general public license*"),
    "lgpl-2.1": (r"(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?2 1", "lgpl*|lesser general public license*"),
    "lgpl-3.0": (r"(?:gnu )?(?:lgpl|lesser general public license)(?: v| version)? ?3(?: 0)?", "lgpl*|lesser general public license*"),
    "lgpl": (r"(?:gnu lgpl|(?:gnu )?(?:lesser|library) general public license)", "gnu lgpl|general public license"),
    "agpl-3.0": (r"(?:gnu )?(?:agpl|affero general public license)(?: v| version)? ?3(?: 0)?", "agpl*|affero general public license*"),
    "agpl": (r"(?:gnu agpl|(?:gnu )?affero general public license)", "gnu agpl|affero general public license"),
    "gfdl-1.1": (r"(?:gnu )?(?:fdl|gfdl|free documentation license)(?: v| version)? ?1 1", "fdl*|gfdl*|free documentation license*"),
    "gfdl-1.2": (r"(?:gnu )?(?:fdl|gfdl|free documentation license)(?: v| version)? ?1 2", "fdl*|gfdl*|free documentation license*"),
    "gfdl-1.3": (r"(?:gnu )?(?:fdl|gfdl|free documentation license)(?: v| version)? ?1 3", "fdl*|gfdl*|free documentation license*"),
    "mpl-1.0": (r"(?:mpl|mozilla public license)(?: v| version)? ?1 0", "mpl*|mozilla public license*"),
    "mpl-1.1": (r"(?:mpl|mozilla public license)(?: v| version)? ?1 1", "mpl*|mozilla public license*"),
    "mpl-2.0": (r"(?:mpl|mozilla public license)(?: v| version)? ?2(?: 0)?", "mpl*|mozilla public license*"),
    "epl-1.0": (r"(?:epl|eclipse public license)(?: v| version)? ?1(?: 0)?", "epl*|eclipse public license*"),
    "epl-2.0": (r"(?:epl|eclipse public license)(?: v| version)? ?2(?: 0)?", "epl*|eclipse public license*"),
    "edl-1.0": (r"(?:edl|eclipse distribution license)(?: v| version)? ?1(?: 0)?", "edl*|eclipse distribution license*"),
    "cddl-1.0": (r"(?:cddl|common development and distribution license)(?: v| version)? ?1 0", "cddl*|common development and distribution license*"),
    "cddl-1.1": (r"(?:cddl|common development and distribution license)(?: v| version)? ?1 1", "cddl*|common development and distribution license*"),
    "cpl-1.0": (r"(?:cpl|common public license)(?: v| version)? ?1 0", "cpl*|common public license*"),
    "cpal-1.0": (r"(?:cpal|common public attribution license)(?: v| version)? ?1 0", "cpal*|common public attribution license*"),
    "eupl-1.1": (r"(?:eupl|european union public licen[cs]e)(?: v| version)? ?1 1", "eupl*|european union public*"),
    "eupl-1.2": (r"(?:eupl|european union public licen[cs]e)(?: v| version)? ?1 2", "eupl*|european union public*"),
    "osl-3.0": (r"(?:osl|open software license)(?: v| version)? ?3 0", "osl*|open software license*"),
    "afl-3.0": (r"(?:afl|academic free license)(?: v| version)? ?3 0", "afl*|academic free license*"),
    "artistic-1.0": (r"artistic license(?: v| version)? ?1 0", "artistic license*"),
    "artistic-2.0": (r"artistic license(?: v| version)? ?2 0", "artistic license*"),
    "ms-pl": (r"(?:ms pl|microsoft public license)", "ms pl|microsoft public license"),
    "ms-rl": (r"(?:ms rl|microsoft reciprocal license)", "ms rl|microsoft reciprocal license"),
    "bsl-1.0": (r"(?:bsl 1 0|boost software license)", "bsl|boost software license"),
    "busl-1.1": (r"(?:busl|business source license)(?: v| version)? ?1 1", "busl*|business source license*"),
    "sspl-1.0": (r"(?:sspl|server side public license)(?: v| version)?(?: 1)?", "sspl*|server side public license*"),
    "elastic-2.0": (r"elastic license(?: v| version)? ?2 0", "elastic license*"),
    "unlicense": (r"(?:the )?unlicense", "unlicense"),
    "wtfpl": (r"(?:wtfpl|do what the fuck you want to public license)", "wtfpl|public license"),
    "zlib": (r"(?:zlib|zlib libpng)", "zlib"),
    "libpng": (r"libpng", "libpng"),
    "openssl": (r"openssl", "openssl"),
    "python-2.0": (r"(?:psf|python software foundation)(?: license)?(?: version)?(?: 2)?", "psf|python software foundation"),
    "php-3.01": (r"php license(?: version)? 3 01", "php license"),
    "ruby": (r"ruby", "ruby"),
    "vim": (r"vim", "vim"),
    "postgresql": (r"postgresql", "postgresql"),
    "curl": (r"curl", "curl"),
    "ntp": (r"ntp", "ntp"),
    "ncsa": (r"(?:ncsa|university of illinois ncsa)", "ncsa"),
    "ofl-1.1": (r"(?:sil )?(?:ofl|open font license)(?: v| version)?(?: 1 1)?", "ofl*|open font license*"),
    "lppl-1.3c": (r"(?:lppl|latex project public license)(?: v| version)?(?: 1 3c?)?", "lppl*|latex project public license*"),
    "cecill-2.1": (r"cecill(?: version)? 2 1", "cecill"),
    "cecill-b": (r"cecill b", "cecill"),
    "cecill-c": (r"cecill c", "cecill"),
    "mulan-psl-2.0": (r"mulan psl(?: v| version)? ?2", "mulan"),
    "odbl-1.0": (r"(?:odbl|open database license)(?: v| version)?(?: ?1 0)?", "odbl*|open database license*"),
    "odc-by-1.0": (r"(?:odc by|open data commons attribution license)(?: v?1 0)?", "odc by|open data commons attribution license"),
    "pddl-1.0": (r"(?:pddl|public domain dedication and license)(?: v?1 0)?", "pddl|public domain dedication and license"),
    "cc0-1.0": (r"(?:cc0|cc zero|creative commons zero)(?: 1 0| universal)?", "cc0|cc zero|creative commons zero"),
    "openrail": (r"(?:open ?rail|responsible ai license)(?: m)?", "openrail|open rail|responsible ai license"),
    "llama-community": (r"llama(?: [23])? community license", "llama"),
    "apsl-2.0": (r"(?:apsl|apple public source license)(?: version)? ?2 0", "apsl*|apple public source license*"),
    "ipl-1.0": (r"ibm public license(?: version)? ?1 0", "ibm public license"),
    "spl-1.0": (r"sun public license(?: version)? ?1 0", "sun public license"),
    "npl-1.1": (r"netscape public license(?: version)? ?1 1", "netscape public license"),
    "qpl-1.0": (r"q public license(?: version)?(?: 1 0)?", "q public license"),
    "w3c": (r"w3c(?: software)?", "w3c"),
    "hpnd": (r"historical permission notice and disclaimer", "historical permission notice"),
    "upl-1.0": (r"universal permissive license(?: version)?(?: 1 0)?", "universal permissive license"),
    "blueoak-1.0.0": (r"blue oak model license(?: 1 0 0)?", "blue oak model license"),
}
#: The Creative Commons family by rule: kind, then version.
CC_KINDS = {"by-nc-nd": "by nc nd|attribution non ?commercial no ?deriv(?:ative)?s", "by-nc-sa": "by nc sa|attribution non ?commercial share ?alike", "by-nc": "by nc|attribution non ?commercial", "by-nd": "by nd|attribution no ?deriv(?:ative)?s", "by-sa": "by sa|attribution share ?alike", "by": "by|attribution"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Names that are common words or names of programs as well: they need the word license, or marks in the text that set them apart.
PLAIN = frozenset(("mit", "ruby", "vim", "curl", "ntp", "postgresql", "openssl", "libpng", "zlib", "w3c"))
_UNDER = r"under(?: the)?(?: terms of)?(?: the)? "
_GIVEN = r"(?:released|distributed|published|available|provided) "
_GIVEN_KEYWORDS = "released {0}|distributed {0}|published {0}|available {0}|provided {0}"

#: How a name is put forward: template, template for plain names, keywords, priority (a lower one wins), score, what the text itself must show
#: (of plain names): "gap": a quote before the name, or a colon, equals sign or bracket and a capital; "case": a capital in the name, or an article before it.
GRANTS = (
    ("spdx license identifier {name}", "spdx license identifier {name}", "spdx license identifier", 1, 1.0, ""),
    (rf"(?:re)?licensed {_UNDER}{{name}}(?: licen[cs]e)?", rf"(?:re)?licensed {_UNDER}{{name}}(?: licen[cs]e)?", "licensed under|relicensed under", 2, 0.95, ""),
    (rf"{_GIVEN}{_UNDER}{{name}}(?: licen[cs]e)?", rf"{_GIVEN}{_UNDER}{{name}} licen[cs]e", _GIVEN_KEYWORDS.format("under"), 2, 0.95, ""),
    (rf"{_GIVEN}(?:on|with)(?: the)? {{name}} licen[cs]e", rf"{_GIVEN}(?:on|with)(?: the)? {{name}} licen[cs]e", _GIVEN_KEYWORDS.format("on") + "|" + _GIVEN_KEYWORDS.format("with"), 2, 0.95, ""),
    (r"subject to(?: the)?(?: terms of)?(?: the)? {name}(?: licen[cs]e)?", r"subject to(?: the)?(?: terms of)?(?: the)? {name} licen[cs]e", "subject to", 3, 0.9, ""),
    (r"(?:licen[cs]e|lizenz|licencia) {name}", r"(?:licen[cs]e|lizenz|licencia) {name}", "license|licence|lizenz|licencia", 4, 0.8, "gap"),
    (r"{name} licen[cs]ed?", r"{name} licen[cs]e", "license*|licence*", 4, 0.8, "case"),
)

#: Rules that stand alone: pattern, keywords, label, priority, score.
SINGLE = (
    (r"permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted", "mit", 1, 1.0),
    (r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use", "bsd", 1, 1.0),
    (r"permission to use copy modify and or distribute this software for any purpose with or without fee", "permission to use copy", "isc", 1, 1.0),
    (r"you may not use this file except in compliance with the license", "you may not use this file", "apache-2.0", 1, 0.9),
    (r"this program is free software you can redistribute it and or modify it", "program is free software", "gpl", 1, 0.9),
    (r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form", "mpl-2.0", 1, 1.0),
    (r"this is free and unencumbered software released into the public domain", "unencumbered", "unlicense", 1, 1.0),
    (r"(?:released|dedicated|placed) (?:in|into|to) the public domain", "public domain", "public-domain", 2, 0.9),
    (r"this work is in the public domain", "public domain", "public-domain", 2, 0.9),
    (r"public domain mark 1 0", "public domain", "public-domain", 2, 0.9),
    (r"without (?:the )?(?:prior )?(?:express )?written permission", "written permission", "reserved", 5, 0.6),
    (r"no part of this (?:publication|work|book|document) may be reproduced", "may be reproduced", "reserved", 3, 0.9),
    (r"all rights (?:are )?reserved", "all rights", "reserved", 3, 0.9),
    (r"alle rechte vorbehalten", "rechte vorbehalten", "reserved", 3, 0.9),
    (r"tous droits réservés", "tous droits", "reserved", 3, 0.9),
    (r"todos los derechos reservados", "derechos reservados", "reserved", 3, 0.9),
    (r"for personal and non ?commercial use only", "for personal and", "non-commercial", 4, 0.7),
    (r"(?:proprietary and confidential|confidential and proprietary)", "proprietary and confidential|confidential and proprietary", "proprietary", 3, 0.9),
    (r"(?:end user license agreement|eula)", "end user license|eula", "proprietary", 4, 0.7),
    (r"copyright (?:c )?(?:19|20)[0-9][0-9]", "copyright", "copyright-notice", 6, 0.5),
    (r"general public license", "general public license", "gpl", 5, 0.6),
    (r"creative commons", "creative commons", "cc", 6, 0.5),
)
#: No match has more words than this.
REACH = 30


class Rule(NamedTuple):
    pattern: re.Pattern
    label: str
    priority: int
    score: float
    names: tuple[int, ...]  # numbers of keywords: one of them is in every match,
    grants: tuple[int, ...]  # and one of these, if any
    shows: str  # "", "gap" or "case"


def _plain(keywords: str) -> list[str]:
    return [f" {k[:-1]}" if k.endswith("*") else f" {k} " for k in keywords.split("|")]


@lru_cache(1)
def _numbers() -> dict[str, int]:
    """All keywords, numbered."""
    every = [k for _, k in NAMES.values()] + ["cc|creative commons"] + [g[2] for g in GRANTS] + [x[1] for x in SINGLE]
    return {k: i for i, k in enumerate(dict.fromkeys(k for x in every for k in _plain(x)))}


#: A text without any of these has no license words; each rule's pattern holds at least one.
KEYWORDS = tuple(k.encode() for k in _numbers())


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: names by grants, the Creative Commons family, single sentences. Some 800 of them."""
    names = dict(NAMES)
    for kind, words in CC_KINDS.items():
        for version in CC_VERSIONS:
            names[f"cc-{kind}-{version.replace(' ', '.')}"] = rf"(?:cc|creative commons) (?:{words})(?: [^ ]+)? {version}", "cc|creative commons"
        names[f"cc-{kind}"] = rf"(?:cc|creative commons) (?:{words})", "cc|creative commons"
    number = lambda keywords: tuple(_numbers()[k] for k in _plain(keywords))
    whole = lambda p: re.compile(rf"(?<![^ ]){p}(?![^ ])")
    out = []
    for label, (name, keywords) in names.items():
        for usual, plain, grants, priority, score, shows in GRANTS:
            pattern = (plain if label in PLAIN else usual).format(name=f"(?:{name})")
            out.append(Rule(whole(pattern), label, priority, score, number(keywords), number(grants), shows if label in PLAIN else ""))
        if label.startswith("cc-"):
            out.append(Rule(whole(name), label, 5, 0.6, number(keywords), (), ""))
    return tuple(out + [Rule(whole(p), label, priority, score, number(keywords), (), "") for p, keywords, label, priority, score in SINGLE])


@lru_cache(1)
def _machine() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, i in _numbers().items():
        out.add_word(k, i)
    out.make_automaton()
    return out


def _blanks(line: str) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(line.encode() if line.isascii() else line.encode("utf-32-le"), np.uint8 if line.isascii() else np.uint32) == 32)


def matches(line: str) -> list[tuple[int, int, int]]:
    """start, end and rule number of all matches, each rule's pattern run only around its keywords."""
    hits: dict[int, list[int]] = {}
    for end, k in _machine().iter(line):
        hits.setdefault(k, []).append(end)
    if not hits:
        return []
    blanks = _blanks(line)
    words = {k: np.searchsorted(blanks, np.array(ends)) for k, ends in hits.items()}
    found, regions = [], {}

    def places(kinds: tuple[int, ...]) -> np.ndarray:
        """Words at which the keywords of these numbers end, in order."""
        some = [words[k] for k in kinds if k in words]
        return some[0] if len(some) == 1 else np.sort(np.concatenate(some))

    for n, rule in enumerate(rules()):
        if not any(k in hits for k in rule.names) or rule.grants and not any(k in hits for k in rule.grants):
            continue
        if (kinds := (rule.names, rule.grants)) not in regions:
            at = places(rule.names)
            if rule.grants:
                grants = places(rule.grants)
                after = np.searchsorted(grants, at)
                gap = np.minimum(np.abs(grants[np.minimum(after, len(grants) - 1)] - at), np.abs(grants[np.maximum(after - 1, 0)] - at))
                at = at[gap <= REACH]
            cut = np.flatnonzero(np.diff(at) > 2 * REACH + 2)
            first, last = (at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]) if len(at) else (at, at)
            starts, ends = blanks[np.maximum(first - REACH - 1, 0)], blanks[np.minimum(last + REACH + 1, len(blanks) - 1)] + 1
            regions[kinds] = list(zip(starts.tolist(), ends.tolist()))
        for a, b in regions[kinds]:
            found += [(m.start(), m.end(), n) for m in rule.pattern.finditer(line, a, b)]
    return found


class Original:
    """The words of a text as they stand in it."""

    def __init__(self, text: str):
        self.raw = text.encode()
        blank = np.frombuffer(self.raw.translate(ALNUM), np.uint8) == 32
        word = np.concatenate(([False], ~blank, [False]))
        self.starts, self.ends = np.flatnonzero(word[1:] & ~word[:-1]).tolist(), np.flatnonzero(word[:-1] & ~word[1:]).tolist()

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def shows(self, what: str, first: int) -> bool:
        """Do the marks around a plain name show that it is meant? first: the match's first word."""
        if what == "gap":
            gap, name = self.raw[self.ends[first] : self.starts[first + 1]], self.word(first + 1)
            return gap.rstrip()[-1:] in (b'"', b"'", b"`", b">") or name != name.lower() and any(x in gap for x in b":=(")
        name = self.word(first)
        return name != name.lower() or first > 0 and self.word(first - 1).lower() in (b"the", b"an", b"under")


def detect(line: str, text: str | None = None) -> list[tuple[int, int, Rule]]:
    """Detections in normalised text, as code point ranges of it, after suppression. text: the original, for rules on plain names.

    In order of priority, then length, then place, then rule; one that lies within a kept one's range goes, as does one
    of equal range.
    """
    found, all_rules = [], rules()
    original = blanks = None
    for start, end, n in matches(line):
        rule = all_rules[n]
        if rule.shows and text is not None:
            if original is None:
                original, blanks = Original(text), _blanks(line).tolist()
            if not original.shows(rule.shows, bisect_right(blanks, start) - 1):
                continue
        found.append((rule.priority, start - end, start, n, end, rule))
    kept: list[tuple[int, int, Rule]] = []
    longest = 0
    for *_, start, _, end, rule in sorted(found, key=lambda x: x[:4]):
        # only a kept one that starts within the longest one's length before end can hold this one
        at = bisect_right(kept, start, key=lambda x: x[0])
        while at and kept[at - 1][0] >= end - longest and kept[at - 1][1] < end:
            at -= 1
        if not at or kept[at - 1][0] < end - longest:
            insort(kept, (start, end, rule), key=lambda x: x[:2])
            longest = max(longest, end - start)
    return kept


def places(line: bytes, phrase: bytes) -> Iterator[int]:
    """Words at which the phrase's words start in a line with a space before and after each word."""
    word, before, at = 0, 0, line.find(phrase)
    while at >= 0:
        word, before = word + line.count(b" ", before, at), at
        yield word
        at = line.find(phrase, at + 1)


def scan(text: str | None) -> tuple:
    """n_words, base places as (word, label), detections as (label, first word, last word + 1, score)."""
    words = (text or "").encode().translate(ALNUM).split()
    line = b" %s " % b" ".join(words) if words else b" "
    base = [(p, label) for phrase, label in BASE.items() for p in places(line, b" %s " % phrase.encode())]
    found = []
    plain, first, before = line.decode(), -1, 0
    for start, end, rule in detect(plain, text):
        first, before = first + plain.count(" ", before, start), start
        found.append((rule.label, first, first + plain.count(" ", start, end) + 1, rule.score))
    return len(words), sorted(base), found


SCHEMA = "n_words long, {p}base array<struct<word:long,label:string>>, {p}found array<struct<label:string,first:long,last:long,score:double>>"


def scan_licenses(docs: DataFrame, text: str = "text", prefix: str = "ls_", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with the licenses that each row's whole text names.

    New columns, named with prefix: n_words; base (the fixed phrases' places: word index and label); found (the signature
    rules' detections: label, first word, last word + 1, score). A null or empty text has none; rows are judged one by one, so
    repeated rows get equal results; an empty table gives an empty one; a column called like a new one is an error. A very long
    text is scanned whole, in one task, in time linear in its length and its matches. Of equal detections the earlier rule's stays.

    A rule's pattern runs only around places of its own keywords, which one automaton finds. Names that are common words too ("mit" is
    German for with) count only beside the word license or where the text sets them apart: License: MIT, "license": "mit".
    """
    schema = extended(docs, keep, prefix + SCHEMA.format(p=prefix))
    carried = [f.name for f in schema.fields[:-3]]
    base = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    found = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = [scan(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(np.array([x[0] for x in got], np.int64)),
                    pa.array([[{"word": w, "label": s} for w, s in x[1]] for x in got], base),
                    pa.array([[dict(zip(("label", "first", "last", "score"), d)) for d in x[2]] for x in got], found),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: of the surest detection, at least 0.5 where a base phrase stands; 0 without any."""
    d = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    labels = lambda x: F.array_sort(F.array_distinct(x))
    return d.select(
        "doc_id",
        F.col("ls_n_words").alias("n_words"),
        F.size("ls_base").cast("long").alias("n_base"),
        F.array_min("ls_base.word").alias("first_word"),
        F.array_max("ls_base.word").alias("last_word"),
        F.array_join(labels(F.col("ls_base.label")), ",").alias("base_labels"),
        F.array_join(labels(F.concat("ls_base.label", "ls_found.label")), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("ls_found.score"), F.lit(0.0)), F.when(F.size("ls_base") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
