"""Draws that depend only on a key and a salt, so every run on every cluster makes the same ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(key: Column | str, salt: str) -> Column:
    """A number in [0, 1): the first 32 bits of md5(key:salt)."""
    text = F.concat(F.col(key).cast("string") if isinstance(key, str) else key.cast("string"), F.lit(f":{salt}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def hex_mod(digest: Column, n: int) -> Column:
    """The whole number that a hex digest stands for, modulo n: folded over its 8-digit chunks (n below 2 ** 31)."""
    chunks = F.regexp_extract_all(digest, F.lit("[0-9a-f]{8}"), F.lit(0))
    step = lambda acc, c: (acc * F.lit(4294967296) + F.conv(c, 16, 10).cast("long")) % F.lit(n)
    return F.aggregate(chunks, F.lit(0).cast("long"), step)


def md5_shard(key: Column, n: int) -> Column:
    return hex_mod(F.md5(key.cast("string").cast("binary")), n)


def sha1_shard(key: Column, n: int) -> Column:
    return hex_mod(F.sha1(key.cast("string").cast("binary")), n)


def weighted_key(score: Column, draw: Column) -> Column:
    """Of rows of one group, the one with the largest key is drawn with probability in proportion to its score (A-Res)."""
    return F.log(F.greatest(draw, F.lit(1e-12))) / score
