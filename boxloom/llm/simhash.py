"""SimHash near-dedup: fingerprints, an inverted index of byte positions with count filtering, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import LOWER, durable, extended, read, slices
from .components import components, local_roots

SHINGLE, SEED, MOST = 3, 42, 3
#: Bytes of a fingerprint, and how many of them two fingerprints within MOST bits share at least.
BYTES, SHARED = 8, 5
#: A posting list longer than this is dealt out by further bytes.
HOT = 256
#: A list of fingerprints that share SHARED bytes is compared pair by pair up to this length, beyond it by looking up all near values.
PAIRWISE = 16_384
#: Up to this many distinct fingerprints lists are keyed by two bytes, beyond by three.
TWO_BYTES = 1 << 23

#: Each byte's bits, the first one highest, as eight lanes of one byte.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """The 64-bit SimHash of each text; 0 for a null or a text without words."""
    digest, seed = xxhash.xxh64_digest, SEED
    hashes, counts = [], []
    for text in texts.to_pylist():
        words = (text or "").encode().translate(LOWER).split()
        n = len(words)
        if n < SHINGLE:
            counts.append(bool(n))
            hashes += [digest(b" ".join(words), seed)] if n else []
            continue
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: 1 - SHINGLE]))[: n - SHINGLE + 1].tolist()
        hashes += [digest(line[a:b], seed) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())]
        counts.append(n - SHINGLE + 1)
    out = np.zeros(len(counts), np.uint64)
    counts = np.array(counts, np.int64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    lanes = _LANES[np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)]
    # sums of up to 255 hashes fit in a lane's byte
    ends = np.cumsum(counts[some])
    starts = ends - counts[some]
    parts = -(-counts[some] // 255)
    firsts = np.cumsum(parts) - parts
    blocks = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(firsts, parts))
    sums = np.add.reduceat(lanes, blocks, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
    ones = np.add.reduceat(sums, firsts, axis=0)
    out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1).view(">u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with the fingerprint of each row's whole text, as a signed long."""
    schema = extended(docs, keep, f"{name} long")
    carried = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            made = pa.array(fingerprints_of(batch.column(text)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), made], names=schema.names)

    return docs.mapInArrow(run, schema)


def key_sets(n: int) -> list[list[tuple[int, ...]]]:
    """Positions by which lists are keyed, level by level: any SHARED of all BYTES positions contain a set of each level's choices."""
    if n <= TWO_BYTES:
        return [[(0, 1), (2, 3), (4, 5), (6, 7)]]
    return [[*combinations(range(4), 3), *combinations(range(4, 8), 3)]]


def finer(positions: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Larger sets, one of which two fingerprints share that share these positions and SHARED in all."""
    rest = [p for p in range(BYTES) if p not in positions]
    need = SHARED - len(positions)
    if need >= 3:  # of six others three are shared: two of one half
        halves = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        return [(*positions, *c) for half in halves for c in combinations(half, 2)]
    return [(*positions, p) for p in rest] if need else []


def _keys(df: DataFrame, sets: list[tuple[int, ...]], prior: DataFrame | None = None) -> DataFrame:
    """fp, node, at (which positions) and key (the positions' bytes) for each set."""

    def key(positions: tuple[int, ...]):
        out = F.lit(0).cast("long")
        for p in positions:
            out = out * 256 + F.shiftrightunsigned("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))
        code = sum(1 << p for p in positions)
        return F.struct(F.lit(code).alias("at"), out.alias("key"))

    return df.select("fp", "node", F.explode(F.array(*map(key, sets))).alias("k")).select("fp", "node", "k.at", "k.key")


def near_pairs(fp: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of linked fingerprints of equal group; the groups stand together.

    For each distance of places: tally the bytes that the pairs share, retain those that reach SHARED, verify the bits.
    """
    left = np.arange(len(fp))
    d = 1
    while True:
        left = left[: np.searchsorted(left, len(fp) - d)]
        left = left[group[left] == group[left + d]]
        if not len(left):
            return
        x = fp[left] ^ fp[left + d]
        tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
        some = np.flatnonzero(tally >= SHARED)
        some = some[np.bitwise_count(x[some]) <= MOST]
        if len(some):
            yield left[some], left[some] + d
        d += 1


def looked_up(fp: np.ndarray, free: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As near_pairs, for one group of sorted distinct fingerprints that differ at most in the free bits."""
    for k in range(1, MOST + 1):
        for bits in combinations(free.tolist(), k):
            other = fp ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            found = np.flatnonzero((fp[at] == other) & (at > np.arange(len(fp))))
            if len(found):
                yield found, at[found]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each list of this partition: never all pairs."""
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    at, key, fp, node = (table.column(c).to_numpy() for c in ("at", "key", "fp", "node"))
    fp = fp.view(np.uint64) if fp.dtype == np.int64 else fp
    order = np.lexsort((fp, key, at))
    at, key, fp, node = at[order], key[order], fp[order], node[order]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (key[1:] != key[:-1])))
    group = np.cumsum(new) - 1
    starts = np.append(np.flatnonzero(new), len(fp))
    long = np.diff(starts) > PAIRWISE
    kept_a, kept_b, waiting = [], [], 0

    def forest() -> None:
        root = local_roots(len(fp), np.concatenate(kept_a), np.concatenate(kept_b))
        away = np.flatnonzero(root != np.arange(len(fp)))
        kept_a[:], kept_b[:] = [away], [root[away]]

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        usual = np.flatnonzero(~long[group])
        for a, b in near_pairs(fp[usual], group[usual]):
            yield usual[a], usual[b]
        for g in np.flatnonzero(long):
            lo, hi = starts[g], starts[g + 1]
            if bin(int(at[lo])).count("1") < SHARED:
                for a, b in near_pairs(fp[lo:hi], group[lo:hi]):
                    yield lo + a, lo + b
                continue
            free = np.array([8 * (7 - p) + b for p in range(BYTES) if not int(at[lo]) >> p & 1 for b in range(8)])
            for a, b in looked_up(fp[lo:hi], free):
                yield lo + a, lo + b

    for a, b in pairs():
        kept_a.append(a)
        kept_b.append(b)
        waiting += len(a)
        if waiting > 1 << 20:
            forest()
            waiting = 0
    if kept_a:
        forest()
        if len(kept_a[0]):
            yield pa.RecordBatch.from_arrays([pa.array(node[kept_a[0]]), pa.array(node[kept_b[0]])], names=["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """a, b: a spanning forest, list by list, of all links between the distinct fingerprints (fp, node)."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = key_sets(distinct.count())[0]
    rows = _keys(distinct, sets)
    out, level = None, 0
    while True:
        last = not any(finer(s) for s in sets)
        if not last:
            hot = durable(rows.groupBy("at", "key").count().where(F.col("count") > HOT).select("at", "key"))
            n_hot = hot.count()
            if 0 < n_hot <= 100_000:
                hot = F.broadcast(hot)
        cold = rows if last or not n_hot else rows.join(hot, ["at", "key"], "left_anti")
        found = cold.repartition(parts, "at", "key").mapInArrow(_links, "a long, b long")
        out = found if out is None else out.unionByName(found)
        if last or not n_hot:
            return out
        held = rows.join(hot, ["at", "key"], "left_semi")
        rows = None
        nexts = []
        for s in sets:
            code = sum(1 << p for p in s)
            deeper = finer(s)
            part = _keys(held.where(F.col("at") == code).select("fp", "node"), deeper)
            rows = part if rows is None else rows.unionByName(part)
            nexts += deeper
        # one list of the same positions and bytes may come from several shorter ones
        rows = durable(rows.distinct())
        sets = list(dict.fromkeys(tuple(sorted(s)) for s in nexts))
        level += 1


#: Stands for a null key: larger than all others.
_LAST = (1 << 63) - 1


def _node(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_LAST))


def _judged(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """node, sum (a hash of the text) and fp of each row; fp, root (its component's smallest fingerprint), node and sum (the smallest of its rows) of each fingerprint.

    A fingerprint is a node of its own, whatever keys its rows have: rows of one key, or without one, link only by their texts.
    """
    marked = durable(fingerprints(docs.select(_node(key).alias("node"), F.xxhash64(text).alias("sum"), F.col(text).alias("text")), keep=["node", "sum"]))
    distinct = durable(marked.groupBy("fp").agg(F.min(F.struct("node", "sum")).alias("first")))
    roots = components(links(distinct.select("fp", F.col("fp").alias("node")))).withColumnRenamed("node", "fp")
    return marked, durable(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (signed long) and component_id (smallest key reachable over links) of each row of docs.

    Rows link if their fingerprints differ in at most MOST bits. Null and empty texts have fingerprint 0 and link like any other;
    rows with equal keys are judged each by its own text; a null key counts as larger than all others, so a component of null keys
    only has a null id; an empty table gives an empty one; other columns of docs aren't looked at. key is a whole number.
    """
    null = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    marked, distinct = _judged(docs, key, text)
    ids = distinct.groupBy("root").agg(F.min("first.node").alias("component_id"))
    return marked.join(distinct.join(ids, "root").select("fp", "component_id"), "fp").select(null("node").alias(key), "fp", null("component_id").alias("component_id"))


#: Keys of documents that go up to which they are broadcast (16 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 1_000_000


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of the smallest key; of several rows with it, one of the smallest hash of a text.

    Else as near_duplicates; of repeated rows (equal keys and texts) one stays. Columns called nd_node or nd_sum are an error. What stays is
    found from keys and hashes alone; whole texts are only filtered, and shuffled only if more than BROADCAST_KEYS rows go.
    """
    if clash := {"nd_node", "nd_sum"} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    marked, distinct = _judged(docs, key, text)
    kept = distinct.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.node").alias("node"), F.col("first.sum").alias("sum"), F.lit(True).alias("stays"))
    keys = marked.groupBy("node", "sum").agg(F.count(F.lit(1)).alias("n")).join(kept, ["node", "sum"], "left")
    keys = durable(keys.where("stays IS NULL OR n > 1").select(F.col("node").alias("nd_by_node"), F.col("sum").alias("nd_by_sum"), F.col("stays").isNull().alias("goes")))
    sizes = keys.groupBy("goes").count().collect()

    def those(goes: bool) -> DataFrame:
        small = sum(r["count"] for r in sizes if r["goes"] == goes) <= BROADCAST_KEYS
        some = keys.where("goes" if goes else "NOT goes").drop("goes")
        return F.broadcast(some) if small else some.hint("shuffle_hash")

    same = F.expr("nd_node = nd_by_node AND nd_sum = nd_by_sum")
    out = docs.withColumns({"nd_node": _node(key), "nd_sum": F.xxhash64(text)}).join(those(True), same, "left_anti")
    if any(not r["goes"] for r in sizes):
        once = out.join(those(False), same, "left_semi").dropDuplicates(["nd_node", "nd_sum"])
        out = out.join(those(False), same, "left_anti").unionByName(once)
    return out.select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = near_duplicates(read(spark, sf_dir, "documents"))
    return d.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
