"""Secret scans: candidates by pattern, false positives removed by a random forest trained on labelled findings."""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest
from ._common import extended, read, slices

#: Kinds of candidates in order of preference; the group "s" is the candidate, a whole run of any length. Each needs its keyword in the text ("": none).
KINDS = (
    ("private-key", "-----BEGIN", re.compile(r"(?P<s>-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+(?:-----END [A-Z ]*PRIVATE KEY-----)?)")),
    ("jwt", "eyJ", re.compile(r"(?<![\w-])(?P<s>eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})")),
    ("aws-key-id", "A", re.compile(r"(?<![A-Za-z0-9])(?P<s>(?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])")),
    ("github-token", "_", re.compile(r"(?<![A-Za-z0-9])(?P<s>(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{22,})")),
    ("vendor-token", "", re.compile(r"(?<![A-Za-z0-9])(?P<s>(?:xox[abprs]-[\w-]{10,}|AIza[\w-]{35,}|[rs]k_live_[A-Za-z0-9]{16,}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{36,}|SG\.[\w-]{16,}\.[\w-]{16,}))")),
    (
        "assignment",
        "",
        re.compile(
            r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credentials?)[\"']?[ \t]{0,4}(?:=>|:=|[:=])[ \t]{0,4}[\"']?(?P<s>[^\s\"'<>;,]{6,})"
        ),
    ),
    ("random", "", re.compile(r"(?<![A-Za-z0-9+/_=-])(?P<s>(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2})(?![A-Za-z0-9])")),
)
CONTEXT = 48
THRESHOLD = 0.5
#: Rows of labelled findings on which the forest is trained by default, and at most from a table.
LABELLED, MOST_LABELLED = 3000, 50_000

#: Words of prose and of code; a random string holds few of them.
DICTIONARY = frozenset(
    """the and for with from this that have not are was you your here example test sample default change value name user admin login host local
    server client config data file path image home page index list item type code class method function return string number object array null true
    false public private static final import export module package version build release debug error warning info message time date year month day
    hour hash sum check commit branch merge main master token secret password key access auth api http https www com org net html json xml text
    content header body form field table column row cell query select insert update delete create drop alter where order group limit count max min
    width height color font size style left right top bottom center icon button link menu nav footer section article div span input output read
    write open close start stop begin end first last next prev new old add remove set get put post call send receive""".split()
)
FOR_WORDS = ("password", "passwd", "pwd", "secret", "token", "api", "key", "auth", "credential", "bearer")
AGAINST_WORDS = ("sha", "md5", "checksum", "digest", "commit", "hash", "uuid", "guid", "example", "placeholder", "integrity", "revision", "blob", "id", "etag", "sample", "test", "base64")
_CLASS = {**dict.fromkeys(string.ascii_lowercase, 0), **dict.fromkeys(string.ascii_uppercase, 1), **dict.fromkeys(string.digits, 2)}
_LETTERS = re.compile(r"[A-Za-z]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_VOWELS = frozenset("aeiouAEIOU")


class Candidate(NamedTuple):
    start: int
    end: int
    kind: str


def candidates(text: str) -> list[Candidate]:
    """In order of place; of overlapping ones the kind that comes first in KINDS stays."""
    found: list[Candidate] = []
    for kind, keyword, pattern in KINDS:
        if keyword in text:
            for m in pattern.finditer(text):
                a, b = m.span("s")
                at = bisect_left(found, (a,))
                if (at == 0 or found[at - 1].end <= a) and (at == len(found) or b <= found[at].start):
                    found.insert(at, Candidate(a, b, kind))
    return found


def features(text: str, c: Candidate, path: str) -> list[float]:
    s = text[c.start : c.end]
    n = len(s)
    classes = [_CLASS.get(x, 3) for x in s]
    counts = [classes.count(k) / n for k in range(4)]
    moves = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1)
    share = np.array([s.count(x) for x in set(s)]) / n
    entropy = float(-(share * np.log2(share)).sum())
    pairs = [a + b for a, b in zip(s, s[1:])]
    same = sum(a == b for a, b in zip(s, s[1:])) / max(1, n - 1)
    steps = sum(ord(b) - ord(a) == 1 for a, b in zip(s, s[1:])) / max(1, n - 1)
    letters = sum(map(len, _LETTERS.findall(s)))
    covered = sum(len(w) for w in _PART.findall(s) if w.lower() in DICTIONARY)
    vowels = sum(x in _VOWELS for x in s) / max(1, letters)
    longest = max(map(len, _LETTERS.findall(s)), default=0)
    before, after = text[max(0, c.start - CONTEXT) : c.start].lower(), text[c.end : c.end + CONTEXT].lower()
    near = re.findall(r"[a-z0-9]+", before)[-3:]
    words = " ".join(near)
    path = path.lower()
    return [
        n, *counts, moves, entropy, entropy / max(1.0, np.log2(n)), len(set(pairs)) / max(1, len(pairs)), same, steps, covered / n, covered / max(1, letters), vowels, longest,
        any(w in words for w in FOR_WORDS), any(w in near for w in AGAINST_WORDS), any(w in s.lower() for w in ("example", "your", "xxxx", "changeme", "placeholder", "dummy", "test", "sample")),
        before.rstrip().endswith(("=", ":", '"', "'")) or before.rstrip("\"' ").endswith(("=", ":")), after.startswith(('"', "'")), bool(re.fullmatch(r"[0-9a-fA-F]+", s)), s.count("-") / n, s.count("/") / n, s.count("_") / n,
        bool(re.search(r"test|example|fixture|sample|doc|vendor|node_modules|lock", path)), bool(re.search(r"\.env|config|secret|deploy|setting|credential", path)),
        [k for k, *_ in KINDS].index(c.kind),
    ]


def labelled_findings(n: int = LABELLED, seed: int = 0) -> list[tuple[str, int, str, bool]]:
    """Findings with their labels, made by rule: (text, start of the candidate, path, is it a secret)."""
    rng = random.Random(seed)
    pick = lambda letters, k: "".join(rng.choices(letters, k=k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    prose = lambda: " ".join(rng.choices(["ther", "ingo", "lo", "un", "des", "pour", "and", "vern", "the", "está", "über", "code", "line", "of"], k=rng.randint(0, 6)))
    word = lambda: rng.choice(sorted(DICTIONARY))
    good_keys = ["password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "SECRET_KEY"]
    paths = ["", "", "src1", "app/.env", "config/prod.yml", "deploy/settings.py", "src/main.go", "docs/readme.md", "test/fixtures/a.json", "package-lock.json", "notes.txt"]
    out = []
    while len(out) < n:
        key, gap = rng.choice(good_keys), rng.choice(["=", " = ", ": ", ":", " := "])
        quote = rng.choice(['"', "'", ""])
        path, before, after = rng.choice(paths), prose(), prose()
        kind = rng.randrange(23)
        label = kind < 10 or kind in (20, 21)
        if kind < 4:
            value = pick(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))
            lead = f"{key}{gap}{quote}"
        elif kind < 6:
            value = pick(alnum + "+/-_", rng.randint(12, 64)) + rng.choice(["", "", "=", "=="])
            lead = f"{key}{gap}{quote}"
        elif kind == 6:
            value, lead = pick(alnum + "!#%&*", rng.randint(8, 20)), f"{rng.choice(['password', 'passwd', 'pwd'])}{gap}{quote}"
        elif kind == 7:
            value, lead = rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), rng.choice(["", "key ", "aws_access_key_id = ", quote])
        elif kind == 8:
            value, lead = rng.choice(["ghp_", "gho_"]) + pick(alnum, 36), rng.choice(["", "Authorization: token ", quote])
        elif kind == 9:
            value = rng.choice(["xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "AIza" + pick(alnum + "-_", 35), "sk_live_" + pick(alnum, 24), f"eyJ{pick(alnum, 20)}.eyJ{pick(alnum, 40)}.{pick(alnum + '-_', 43)}"])
            lead = rng.choice(["", "Bearer ", quote])
        elif kind < 13:
            value = pick(hexa, rng.choice([32, 40, 64]))
            lead = rng.choice(["commit ", "sha1 ", "sha256 ", "md5 ", "checksum ", "digest sha256:", "blob ", "revision ", "etag: ", "hash "]) + quote
        elif kind == 13:
            value, lead = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), rng.choice(["uuid ", "id: ", "guid=", quote])
        elif kind < 16:
            value = rng.choice(["your_api_key_here_123", "changeme123", "xxxxxxxxxxxxxxxxxxxx", "example-token-0001", "password123", "placeholder_value_1", "${SECRET_KEY}", "{{api_key}}", "os.environ[1]", "process.env.TOKEN", "********", "my_secret_value_1", "12345678", "insert_token_here_2", "None,None"])
            lead = f"{key}{gap}{quote}"
        elif kind == 16:
            value, lead = rng.choice(["_", "-"]).join(word() for _ in range(rng.randint(4, 7))) + rng.choice(["1", "_2", "-2020"]), rng.choice(["", "see ", quote])
        elif kind == 17:
            value, lead = "".join(word().title() for _ in range(rng.randint(3, 6))) + str(rng.randint(1, 99)), rng.choice(["", "class ", "function "])
        elif kind == 18:
            value, lead = "/".join(word() for _ in range(rng.randint(4, 7))) + f"/{rng.randint(1, 999)}", rng.choice(["", "path ", "from "])
        elif kind == 20:
            value = pick(alnum + rng.choice(["", "+/", "-_"]), rng.choice([100, 300, 600, 1200, 3000])) + rng.choice(["", "", "=", "=="])
            lead = rng.choice([f"{key}{gap}{quote}", f"aws_session_token{gap}{quote}", "Bearer "])
        elif kind == 21:
            name = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            lines = "\n".join(pick(alnum + "+/", 64) for _ in range(rng.choice([2, 3, 12, 25, 50, 150])))
            value, lead = f"-----BEGIN {name}PRIVATE KEY-----\n{lines}\n" + rng.choice([f"-----END {name}PRIVATE KEY-----", ""]), rng.choice(["", "key ", quote])
        elif kind == 22:
            value, lead = pick(alnum + "+/", rng.choice([40, 100, 300, 600, 1200, 3000])) + rng.choice(["", "=", "=="]), f"data:{rng.choice(['image/png', 'image/jpeg', 'font/woff2', 'text/html'])};base64,"
        else:
            value, lead = rng.choice(["1234567890" * 2, pick("01", 32), pick(string.digits, 24), "a1" * 12, "abcdefghijklmnopqrstuvwxyz0123456789", "0" * 32]), rng.choice(["", "number ", "alphabet "])
        text = f"{before} {lead}"
        start = len(text)
        out.append((f"{text}{value}{quote if lead.endswith(quote) and quote else ''} {after}", start, path, label))
    return out


def examples(findings: list[tuple[str, int, str, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the findings that the patterns propose where they are labelled."""
    x, y = [], []
    for text, start, path, label in findings:
        for c in candidates(text):
            if c.start <= start < c.end:
                x.append(features(text, c, path))
                y.append(label)
    return np.array(x, float), np.array(y, bool)


def train(findings: list[tuple[str, int, str, bool]] | None = None) -> forest.Forest:
    """From findings (text, start of the candidate, path, is it a secret); without any from those that labelled_findings makes."""
    return forest.fit(*examples(labelled_findings() if findings is None else findings))


def train_on(labelled: DataFrame, text: str = "text", start: str = "start", path: str = "path", label: str = "label", most: int = MOST_LABELLED) -> forest.Forest:
    """From a table of labelled findings, of which about most rows are taken by a hash of their content (the documented bound of what is learned from).

    Rows with a null text, start or label are left out, a null path is empty, of repeated rows all or none are taken, other columns aren't
    looked at; an empty table, or one whose findings no pattern proposes, is an error.
    """
    rows = labelled.select(F.col(text), F.col(start).cast("int"), F.coalesce(F.col(path), F.lit("")), F.col(label).cast("boolean")).toDF("t", "s", "p", "y").where("t IS NOT NULL AND s IS NOT NULL AND y IS NOT NULL")
    n = rows.count()
    taken = rows.where(F.pmod(F.xxhash64("t", "s", "p"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, most / max(1, n)))))
    x, y = examples(sorted(map(tuple, taken.collect())))
    if not len(y):
        raise ValueError("no labelled finding that a pattern proposes")
    return forest.fit(x, y)


class Finding(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def scan(texts: list[str | None], paths: list[str | None], model: forest.Forest, threshold: float) -> tuple[list[int], list[list[Finding]]]:
    """Candidates of each text, and those that the forest takes for secrets."""
    found = [candidates(t or "") for t in texts]
    rows = [features(t, c, p or "") for t, p, cs in zip(texts, paths, found) for c in cs]
    score = iter(model.probability(np.array(rows, float)).tolist() if rows else [])
    judged = [[Finding(*c, next(score)) for c in cs] for cs in found]
    return [len(x) for x in found], [[f for f in fs if f.score >= threshold] for fs in judged]


def redact(text: str, findings: list[Finding], by: str = "[SECRET]") -> str:
    out, at = [], 0
    for f in findings:
        out += [text[at : f.start], by]
        at = f.end
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, text: str = "text", path: str | None = "source", model: forest.Forest | None = None, threshold: float = THRESHOLD, prefix: str = "ss_",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns keep) with the secrets in each row's whole text.

    New columns, named with prefix: n_candidates, findings (array<struct<start,end,kind,score>>: code point ranges) and redacted (the
    text with each finding replaced by [SECRET]). path: the column with the text's path or source, part of what the forest
    looks at. Null texts have no candidates and stay null; a null path is empty; rows are judged one by one, so repeated rows
    get equal results; of candidates that overlap (a tie) the kind that KINDS names first stays; an empty table gives an empty one; a column
    called like a new one is an error. A very long text is scanned whole, in one task; a candidate is its whole run, however long.
    """
    schema = extended(docs, keep, f"{prefix}n_candidates long, {prefix}findings array<struct<start:int,end:int,kind:string,score:double>>, {prefix}redacted string")
    carried = [f.name for f in schema.fields[:-3]]
    model = train() if model is None else model
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts = batch.column(text).to_pylist()
            n, found = scan(texts, batch.column(path).to_pylist() if path else [None] * len(texts), model, threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(n, pa.int64()),
                    pa.array([[f._asdict() for f in fs] for fs in found], kind),
                    pa.array([redact(t, fs) if fs else t for t, fs in zip(texts, found)], pa.string()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: candidates, findings, their kinds, the highest score, and the digest of the redacted text."""
    d = scan_secrets(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return d.select(
        "doc_id",
        F.col("ss_n_candidates").alias("n_candidates"),
        F.size("ss_findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct("ss_findings.kind")), ",").alias("kinds"),
        F.coalesce(F.array_max("ss_findings.score"), F.lit(0.0)).alias("score"),
        F.array_join(F.transform("ss_findings", lambda f: F.concat_ws("-", f["start"], f["end"])), ",").alias("spans"),
        F.sha2(F.coalesce("ss_redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"),
    )
