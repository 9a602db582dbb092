"""Benchmark decontamination: one Aho-Corasick automaton over the normalised benchmark texts.

Of an item's windows the automaton holds every other half: the blocks of (window + 1) // 2 words at multiples of that length, of which each
window holds one whole. Where a block stands in a text, the windows around it are looked up as they are. This takes a fifth of the memory
of an automaton of all windows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM, extended, read, slices

#: Bytes of benchmark text that one automaton takes (some 80 bytes of memory for each); further items go to further automata, each scanned in turn.
BLOCK_BYTES = 4 << 20
#: A benchmark of more bytes is refused: it is broadcast, and a worker keeps so many automata.
MOST_BYTES, KEPT = 64 << 20, 2


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(ALNUM).split()


def windows_of(text: str | None, window: int) -> set[bytes]:
    w = words(text)
    if len(w) < window:
        return {b" ".join(w)} if w else set()
    return {b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)}


class Machine(NamedTuple):
    blocks: ahocorasick.Automaton  # words of a block, or of a whole short item -> the number of its words
    windows: dict[bytes, list[str]]  # the items of each window
    window: int


def machine(items: list[tuple[str, str]], window: int) -> Machine:
    of: dict[bytes, set[str]] = defaultdict(set)
    half = (window + 1) // 2
    out = ahocorasick.Automaton()
    for item, text in items:
        for w in windows_of(text, window):
            of[w].add(item)
        w = words(text)
        for block in [w[i : i + half] for i in range(0, len(w) - half + 1, half)] if len(w) >= window else [w] if w else []:
            out.add_word(f" {b' '.join(block).decode()} ", len(block))
    if len(out):
        out.make_automaton()
    return Machine(out, {k: sorted(v) for k, v in of.items()}, window)


def scan(text: str | None, machines: Iterator[Machine] | list[Machine]) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words of the text, merged runs of hit words as [first, last + 1), and the items that occur."""
    found = words(text)
    if not found:
        return 0, [], set()
    # the automaton's positions are those of code points in the words joined by one space
    line = f" {b' '.join(found).decode()} "
    runs: set[tuple[int, int]] = set()
    items: set[str] = set()
    for m in machines:
        matched = list(m.blocks.iter(line)) if len(m.blocks) else []
        if not matched:
            continue
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
        after = np.searchsorted(blanks, np.array([e for e, _ in matched])).tolist()
        half = (m.window + 1) // 2
        tried: set[tuple[int, int]] = set()
        for end, (_, n) in zip(after, matched):
            begin = end - n
            # a block's windows, and the short item itself
            some = {(begin, end), *((a, a + m.window) for a in range(max(0, begin + half - m.window), begin + 1))} if n == half else {(begin, end)}
            for a, b in some - tried:
                if of := m.windows.get(b" ".join(found[a:b])):
                    if b <= len(found):
                        runs.add((a, b))
                        items.update(of)
            tried |= some
    return len(found), merged(runs), items


def merged(runs) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point ranges of the original text."""
    data = np.frombuffer(text.encode(), np.uint8)
    blank = np.frombuffer(data.tobytes().translate(ALNUM), np.uint8) == 32
    word = np.concatenate(([False], ~blank, [False]))
    starts, ends = np.flatnonzero(word[1:] & ~word[:-1]), np.flatnonzero(word[:-1] & ~word[1:])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def blocks(rows: list[tuple[str, str]], most: int) -> list[list[tuple[str, str]]]:
    out, size = [[]], 0
    for item, text in rows:
        if size and size + len(text) > most:
            out.append([])
            size = 0
        out[-1].append((item, text))
        size += len(text)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, prefix: str = "dc_",
    keep: list[str] | None = None,
) -> DataFrame:
    """docs (or its columns keep) with, for each row, what it shares with the benchmark's items.

    New columns, named with prefix: n_words, n_hit, items (array<string>, sorted as strings), spans
    (array<struct<start,end>>: code point ranges of the original text, merged) and contaminated.

    The benchmark is a stated query set that the driver reads and broadcasts once, after its size was summed up: more than MOST_BYTES is an error
    (split it and join the results). BLOCK_BYTES bounds an automaton; more text makes more automata, each of which scans a text again, and of which
    a worker keeps KEPT, so that more than those are built anew for each batch of rows.

    Null or empty texts have no words and no hits; items without words match nothing; a null item is the empty string; rows are judged one by
    one, so repeated rows get equal results, and a very long one is scanned whole in one task; an empty table gives an empty one. Columns of docs
    stay as they are; one that is called like a new column is an error.
    """
    bench = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes, of which {MOST_BYTES} at most are broadcast: split it")
    sent = docs.sparkSession.sparkContext.broadcast(blocks(sorted(map(tuple, bench.collect())), BLOCK_BYTES))
    kept = KEPT
    schema = extended(
        docs,
        keep,
        f"{prefix}n_words long, {prefix}n_hit long, {prefix}items array<string>, {prefix}spans array<struct<start:int,end:int>>, {prefix}contaminated boolean",
    )
    carried = [f.name for f in schema.fields[:-5]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = sent.value
        held = [machine(p, window) for p in parts[:kept]]
        for batch in slices(batches, text, 32 << 20):
            texts = batch.column(text).to_pylist()
            runs_of: list[list[tuple[int, int]]] = [[] for _ in texts]
            items_of: list[set[str]] = [set() for _ in texts]
            n = [0] * len(texts)
            for k in range(len(parts)):
                m = held[k] if k < kept else machine(parts[k], window)
                for i, t in enumerate(texts):
                    n[i], runs, found = scan(t, [m])
                    runs_of[i] += runs
                    items_of[i] |= found
            runs_of = [merged(r) for r in runs_of]
            hit = [sum(b - a for a, b in r) for r in runs_of]
            items = [sorted(x) for x in items_of]
            spans = [[{"start": a, "end": b} for a, b in char_spans(t, r)] if r else [] for t, r in zip(texts, runs_of)]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(n, pa.int64()),
                    pa.array(hit, pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([x > 0 for x in hit], pa.bool_()),
                ],
                names=schema.names,
            )

    return docs.mapInArrow(run, schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        F.col("dc_n_words").alias("n_words"),
        F.col("dc_n_hit").alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc_items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("dc_contaminated").alias("contaminated"),
    )


ORACLE = r"""
WITH b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, array_to_string(w[i:least(i + 9, len(w))], ' ') AS g, least(10, len(w)) AS k
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
m AS (
  SELECT x.r, x.i, bw.item, bw.k
  FROM (SELECT r, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM
          (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)) x
  JOIN bw ON x.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
