"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.durable import durable, shared_folder  # noqa: F401  for the operators and the pipeline

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes that are no part of a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ become spaces, A-Z become a-z.
ALNUM = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_MASK = (1 << 64) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def bucket_count(df: DataFrame, bytes_per_byte: float, target: int = 32 << 20) -> int:
    """Hash buckets such that one holds about target bytes, given the bytes that are exchanged for each byte of df's files.

    At least spark.sql.shuffle.partitions. Catalyst's size estimate is used, so nothing is read.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 52 else max(least, math.ceil(size * bytes_per_byte / target))


def extended(df: DataFrame, columns: list[str] | None, ddl: str) -> T.StructType:
    """The schema of the given columns of df (None: all) and of further ones, which must not clash with them."""
    kept = [f for f in df.schema.fields if columns is None or f.name in columns]
    new = T.StructType.fromDDL(ddl).fields
    if clash := {f.name.lower() for f in kept} & {f.name.lower() for f in new}:
        raise ValueError(f"columns {sorted(clash)} are there already: choose another prefix")
    return T.StructType([*kept, *new])


def refuse_prefix(columns: list[str], prefix: str) -> None:
    if clash := [c for c in columns if c.lower().startswith(prefix.lower())]:
        raise ValueError(f"columns {clash} begin like the operator's own: choose another prefix")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and len + 1 offsets; a null has no bytes."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about most bytes of text at a time; a longer text stands alone, whole."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0)), dtype=np.int64)
        at = 0
        while at < len(ends):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1) modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(seed: int) -> np.ndarray:
    """256 odd pseudo-random 64-bit values."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(seed)) | np.uint64(1)


class Rolling:
    """Polynomial (Rabin-Karp) hashes modulo 2 ** 64 of any ranges of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(INVERSE, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(BASE, n), out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts]

    def windows(self, width: int) -> np.ndarray:
        """Of every window of so many values; empty if there are fewer."""
        last = len(self.sums) - width
        return (self.sums[width:] - self.sums[: max(0, last)]) * self.inverse[: max(0, last)]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+, none across texts, and len + 1 offsets of the texts' words."""
    space = SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = offsets[offsets < len(data)]
    before[inner] = True
    inner = offsets[offsets > 0]
    after[inner - 1] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    return starts, np.flatnonzero(word & after) + 1, np.searchsorted(starts, offsets)
