"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

import re

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(3000))
PASSAGE = " ".join(f"shared{i}" for i in range(30))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", None, "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "One", "en", "a", 3),
    (5, LONG, "en", "a", 9),
    (6, LONG, "en", "b", 9),
    (6, LONG, "en", "b", 9),
    (7, f"before {PASSAGE} after", "en", "b", 9),
    (8, f"{PASSAGE} {PASSAGE} end", "fr", "b", 9),
    (None, f"no key {PASSAGE}", "fr", None, 9),
    (9, "É ä ÀB\x0bcd\x0cef " * 40, "fr", "b", 9),
    (10, f"line\nline\n\n \nother\n{PASSAGE.upper()}", "fr", "b", 9),
    (11, "é" * 500 + " " + "é" * 500 + " x", "fr", "c", 9),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def odd(df):
    """The same with columns whose names the operators use inside."""
    return df.withColumns({c: F.lit(7) for c in ("id", "sum", "node", "fp2", "bucket", "key", "a", "b", "h", "n", "w", "words", "count", "root", "rate", "host", "mix", "block", "label")})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def norm_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
