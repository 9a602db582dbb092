"""Substring dedup: Rabin-Karp hashes of every window of words, counted bucket by bucket; repeated windows merge into intervals.

Hashes find repeats, words decide. Texts stand as their words joined by one space; a window's place is the byte at which it begins there.

1. A task passes on the first of equal windows (their bytes are compared there), packed by hash bucket.
2. A bucket is one partition. Of windows of equal hash all but the first are claims: (place, first one's text and place), dealt to their texts.
3. A run of claims becomes one string of bytes, joined to the text of the first ones and compared with it in the JVM. Windows whose bytes
   differ are grouped by their words, and the first of each group stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Rolling, bucket_count, byte_values, durable, extended, mix, read, refuse_prefix, slices, utf8, word_bounds

WINDOW = 20
#: Words that a task gathers before it counts their windows and passes the distinct ones on.
FLUSH = 1 << 20
#: Low bits of a hash choose its bucket, what is above _TOP bits travels.
_LOW, _TOP = np.uint64((1 << 24) - 1), np.uint64(16)

_VALUES = byte_values(1)
_NULL = np.iinfo(np.int64).min


def window_hashes(data: np.ndarray, offsets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and first word of every window of words of the texts, in order."""
    starts, ends, words = word_bounds(data, offsets)
    per_text = np.maximum(np.diff(words) - window + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    hashes = mix(Rolling(mix(Rolling(_VALUES[data]).ranges(starts, ends))).windows(window))
    return hashes[words[text] + place], text, place


def later(hashes: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All but the first one of each hash, and for each of them the first one; order: most significant first."""
    by = np.argsort(hashes, kind="stable")
    h = hashes[by]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    some = by[same[1:] | same[:-1]]  # only those of a hash with others are put in order
    some = some[np.lexsort((*(x[some] for x in reversed(order)), hashes[some]))]
    h = hashes[some]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    first = np.maximum.accumulate(np.where(again, 0, np.arange(len(some))))
    return some[again], some[first[again]]


class Words(NamedTuple):
    """Texts as their words joined by one space, one after the other; bounds of all words, and where each text begins."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    texts: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> Words:
        """From bounds of words in data and the first word of each text."""
        size = ends - starts
        at = np.cumsum(size + 1) - size - 1
        out = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        inner = np.repeat(starts - at, size) + (move := np.repeat(at - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
        out[move] = data[inner]
        return cls(out.tobytes(), at, at + size, np.append(at, len(out))[texts])


def unequal(words: Words, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Which windows, given by their first words a, are not those that begin at words b: runs of both are compared at once, then single ones."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    cut = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1), [True])))
    same = lambda i, j: words.raw[words.starts[x[i]] : words.ends[x[j] + window - 1]] == words.raw[words.starts[y[i]] : words.ends[y[j] + window - 1]]
    for i, j in zip(cut[:-1].tolist(), (cut[1:] - 1).tolist()):
        if not same(i, j):
            out[order[i : j + 1]] = [not same(k, k) for k in range(i, j + 1)]
    return out


def _planes(x: np.ndarray, kind: str = "<i4") -> bytes:
    """Differences of whole numbers, all lowest bytes first: what is left of the others compresses well."""
    x = x.astype(kind)
    return np.diff(x, prepend=x.dtype.type(0)).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(blob: bytes, n: int, at: int = 0, kind: str = "<i4") -> tuple[np.ndarray, int]:
    """The numbers, and where their bytes end."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(blob, np.uint8, size * n, at).reshape(size, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind)[:, 0], dtype=kind), at + size * n


def _hash_bytes(hashes: np.ndarray) -> int:
    """Six bytes of a hash travel: within a bucket they tell all but a few windows apart, and words decide."""
    return 6 if not len(hashes) or int(hashes.max()) < 1 << 48 else 8


def _pack(ids: np.ndarray, sums: np.ndarray, text: np.ndarray, place: np.ndarray, hashes: np.ndarray | None = None) -> bytes:
    """Windows in order of text: the texts in use, how many windows each has, their places and, if given, hashes."""
    used, counts = np.unique(text, return_counts=True)
    parts = np.array([len(used), len(text)], np.int64).tobytes(), sums[used].astype("<u4").tobytes(), _planes(ids[used], "<i8"), _planes(counts), _planes(place)
    return b"".join([*parts, b"" if hashes is None else hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _hash_bytes(hashes)].tobytes()])


def _unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """ids, sums, places and the hashes, if any, of each window."""
    n, m = map(int, np.frombuffer(blob, np.int64, 2))
    sums = np.frombuffer(blob, "<u4", n, 16).astype(np.int64)
    ids, at = _from_planes(blob, n, 16 + 4 * n, "<i8")
    counts, at = _from_planes(blob, n, at)
    place, at = _from_planes(blob, m, at)
    hashes = np.zeros((m if len(blob) > at else 0, 8), np.uint8)
    if len(hashes):
        hashes[:, : (len(blob) - at) // m] = np.frombuffer(blob, np.uint8, -1, at).reshape(m, -1)
    return np.repeat(ids, counts), np.repeat(sums, counts), place, hashes.view("<u8")[:, 0]


def _by_text(ids: np.ndarray, sums: np.ndarray, place: np.ndarray, first: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    """Claims packed for the bucket of each text; first: id, sum and place of the window that comes first."""
    order = np.lexsort((place, sums, ids))
    ids, sums, place, first = ids[order], sums[order], place[order], [x[order] for x in first]
    text = np.cumsum(_new(ids, sums)) - 1
    at = np.flatnonzero(_new(ids, sums))
    to = sums % buckets
    by = np.argsort(to, kind="stable")
    cut = np.searchsorted(to[by], np.arange(buckets + 1))
    rows = [(int(b), by[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
    blobs = [_pack(ids[at], sums[at], text[r], place[r]) for _, r in rows]
    firsts = [b"".join(_planes(x[r], k) for x, k in zip(first, _FIRST)) for _, r in rows]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array(blobs, pa.binary()), pa.array(firsts, pa.binary())], names=["bucket", "blob", "firsts"])


_FIRST = ("<i8", "<i8", "<i4")  # id, sum and place of a first window


def _new(*columns: np.ndarray) -> np.ndarray:
    """Is each row other than the one before it?"""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return out


def hash_windows(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """bucket, blob: the windows of (id, sum, text), of equal ones of a task only the first; gone: those after it, by bucket of their text."""

    def flush(ids: np.ndarray, sums: np.ndarray, text: np.ndarray, first_word: np.ndarray, hashes: np.ndarray, words: Words) -> pa.RecordBatch:
        place = words.starts[first_word] - words.texts[text]
        again, first = later(hashes, ids[text], sums[text], place)
        differ = unequal(words, first_word[again], first_word[first], window)
        gone = np.zeros(len(hashes), bool)
        gone[again[~differ]] = True
        # windows of a text that are known to go travel together, without hashes
        to = np.where(gone, (sums[text] % buckets) + buckets, (hashes & _LOW).astype(np.int64) % buckets)
        by = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[by], np.arange(2 * buckets + 1))
        rows = [(b, by[cut[b] : cut[b + 1]]) for b in np.flatnonzero(np.diff(cut))]
        blobs = [_pack(ids, sums, text[r], place[r], hashes[r] >> _TOP if b < buckets else None) for b, r in rows]
        return pa.RecordBatch.from_arrays(
            [pa.array([int(b) % buckets for b, _ in rows], pa.int32()), pa.array([bool(b >= buckets) for b, _ in rows]), pa.array(blobs, pa.binary())], names=["bucket", "gone", "blob"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, words_held, texts_held = [], 0, 0, 0

        def all_held() -> pa.RecordBatch:
            *columns, words = zip(*held)
            sizes = np.cumsum([0, *(len(w.raw) for w in words)])
            joined = Words(b"".join(w.raw for w in words), *(np.concatenate([getattr(w, x) + size for w, size in zip(words, sizes)]) for x in ("starts", "ends", "texts")))
            return flush(*map(np.concatenate, columns), joined)

        for batch in slices(batches, "text"):
            data, offsets = utf8(batch.column("text"))
            starts, ends, first = word_bounds(data, offsets)
            hashes, text, place = window_hashes(data, offsets, window)
            ids, sums = (batch.column(c).to_numpy() for c in ("id", "sum"))
            held.append((ids, sums, text + texts_held, first[text] + place + words_held, hashes, Words.of(data, starts, ends, first[:-1])))
            texts_held += len(ids)
            words_held += len(starts)
            n += len(starts)
            if n >= FLUSH:
                yield all_held()
                held, n, words_held, texts_held = [], 0, 0, 0
        if n:
            yield all_held()

    return texts.mapInArrow(run, "bucket int, gone boolean, blob binary")


def _judged(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """bucket (of texts), blob, firsts: windows that another one precedes, as known (no firsts) or by its hash; one bucket of hashes is one partition."""
        parts = []
        for batch in batches:
            gone = batch.filter(batch.column("gone"))
            yield pa.RecordBatch.from_arrays([gone.column("bucket"), gone.column("blob"), pa.nulls(len(gone), pa.binary())], names=["bucket", "blob", "firsts"])
            parts += [_unpack(b) for b in batch.filter(pc.invert(batch.column("gone"))).column("blob").to_pylist()]
        if parts:
            ids, sums, place, hashes = map(np.concatenate, zip(*parts))
            del parts
            go, first = later(hashes, ids, sums, place)
            if len(go):
                yield _by_text(ids[go], sums[go], place[go], (ids[first], sums[first], place[first]), buckets)

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, sum, places (all that go or are claimed to), claims (places, then the first windows'): a row for each text that loses windows."""
    parts, claims = [], []
    for batch in batches:
        for blob, firsts in zip(batch.column("blob").to_pylist(), batch.column("firsts").to_pylist()):
            ids, sums, place, _ = _unpack(blob)
            parts.append((ids, sums, place))
            if firsts is not None:
                at, first = 0, []
                for kind in _FIRST:
                    x, at = _from_planes(firsts, len(ids), at, kind)
                    first.append(x)
                claims.append((ids, sums, place, *first))
    if not parts:
        return
    texts = np.unique(np.stack([np.concatenate([p[k] for p in parts]) for k in (0, 1)], axis=1), axis=0)

    def blobs(parts: list[tuple]) -> dict[tuple[int, int], bytes]:
        columns = list(map(np.concatenate, zip(*parts)))
        order = np.lexsort((columns[2], columns[1], columns[0]))
        ids, sums, place, *first = (x[order] for x in columns)
        cut = np.append(np.flatnonzero(_new(ids, sums)), len(ids)).tolist()
        return {(int(ids[a]), int(sums[a])): b"".join([_planes(place[a:b]), *(_planes(x[a:b], k) for x, k in zip(first, _FIRST))]) for a, b in zip(cut, cut[1:])}

    places, of = blobs(parts), blobs(claims) if claims else {}
    keys = list(map(tuple, texts.tolist()))
    yield pa.RecordBatch.from_arrays(
        [pa.array(texts[:, 0]), pa.array(texts[:, 1]), pa.array([places[k] for k in keys], pa.binary()), pa.array([of.get(k) for k in keys], pa.binary())], names=["id", "sum", "sd_places", "sd_claims"]
    )


#: Columns of a claim: the first windows' text and place, the place of its own, the bytes from there on.
CLAIM = "sd_f_id long, sd_f_sum long, sd_f_place int, sd_c_id long, sd_c_sum long, sd_c_place int, sd_bytes binary"


def _claimed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each run of claims of a text on places of another one that follow each other alike."""
        for batch in slices(batches, "sd_norm"):
            rows = []
            for raw, i, check, blob in zip(*(batch.column(c).to_pylist() for c in ("sd_norm", "sd_id", "sd_sum", "sd_claims"))):
                n, at, columns = len(blob) // 24, 0, []
                for kind in ("<i4", *_FIRST):
                    x, at = _from_planes(blob, n, at, kind)
                    columns.append(x)
                place, f_id, f_sum, f_place = columns
                word, ends = _word_ends(raw, place, window)
                cut = np.flatnonzero(_new(f_id, f_sum, f_place - place, word - np.arange(n))).tolist()
                for a, b in zip(cut, [*cut[1:], n]):
                    rows.append((int(f_id[a]), int(f_sum[a]), int(f_place[a]), i, check, int(place[a]), raw[place[a] : ends[b - 1]]))
            yield _records(rows, CLAIM)

    return run


def _word_ends(raw: bytes, place: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The words at which the windows at these bytes begin, and the bytes at which they end."""
    blanks = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == 0x20), len(raw))
    word = np.searchsorted(blanks, place)
    return word, blanks[word + window - 1]


def _records(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def _unlike(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of claims that differ from the first ones: text, place, words."""
        for batch in batches:
            rows = []
            for i, check, place, own, other in zip(*(batch.column(c).to_pylist() for c in ("sd_c_id", "sd_c_sum", "sd_c_place", "sd_bytes", "sd_first"))):
                begins = np.append(0, np.flatnonzero(np.frombuffer(own, np.uint8) == 0x20) + 1)
                begins = begins[: len(begins) - window + 1]
                _, ends = _word_ends(own, begins, window)
                for a, b in zip(begins.tolist(), ends.tolist()):
                    # equal bytes between other word bounds aren't equal words
                    if own[a:b] != other[a:b] or other[b : b + 1] not in (b"", b" "):
                        rows.append((i, check, place + a, own[a:b]))
            yield _records(rows, "sd_c_id long, sd_c_sum long, sd_c_place int, sd_words binary")

    return run


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, prefix: str = "sd_", keep: list[str] | None = None
) -> DataFrame:
    """docs (or its columns keep) without the words of windows that start earlier too: in a smaller key, or before in the same text.

    New columns, named with prefix: n_words, n_removed, spans (array<struct<start,end>>: maximal removed intervals of words)
    and kept (the other words, joined by one space). Words are [^\\x20\\x09-\\x0D]+. Windows are judged on the input.

    Null and empty texts have no words. Rows with equal keys and equal texts are one document and keep what it keeps; rows with
    equal keys and different texts are in order of 32 bits of a hash of the text. A null key comes before all others. An empty table gives
    an empty one; a column whose name begins with sd_ or is a new one's is an error. key is a whole number. A very long text is hashed
    whole, in one task.

    Hashes only choose what is compared: equal windows are equal words.
    """
    carried = docs.columns if keep is None else keep
    refuse_prefix([*carried, text], "sd_")
    schema = extended(docs, carried, f"{prefix}n_words long, {prefix}n_removed long, {prefix}spans array<struct<start:int,end:int>>, {prefix}kept string")
    check = F.xxhash64(text).bitwiseAND(F.lit((1 << 32) - 1))
    identity = F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL)))
    buckets = bucket_count(docs, 3.0)
    hashed = hash_windows(docs.select(identity.alias("id"), check.alias("sum"), F.col(text).alias("text")), window, buckets)
    judged = hashed.repartitionById(buckets, "bucket").mapInArrow(_judged(buckets), "bucket int, blob binary, firsts binary")
    by = durable(judged.repartitionById(buckets, "bucket").mapInArrow(_gathered, "sd_by_id long, sd_by_sum long, sd_places binary, sd_claims binary"))
    norm = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")).cast("binary")
    rows = docs.select(*carried, norm.alias("sd_norm"), identity.alias("sd_id"), check.alias("sd_sum"))
    # all columns of the texts, though some aren't looked at, so that three joins read one exchange of them
    claims = rows.join(by.select("sd_by_id", "sd_by_sum", "sd_claims").where("sd_claims IS NOT NULL"), F.expr("sd_id = sd_by_id AND sd_sum = sd_by_sum")).mapInArrow(_claimed(window), CLAIM)
    at, n = F.col("sd_f_place"), F.length("sd_bytes")
    first = F.col("sd_norm").substr(at + 1, n)
    # a first window ends where a word does
    differs = (first != F.col("sd_bytes")) | ~F.col("sd_norm").substr(at + n + 1, F.lit(1)).isin(F.lit(b""), F.lit(b" "))
    compared = rows.join(claims, F.expr("sd_id = sd_f_id AND sd_sum = sd_f_sum")).where(differs).select(*rows.columns, "sd_c_id", "sd_c_sum", "sd_c_place", "sd_bytes", F.col("sd_norm").substr(at + 1, n + 1).alias("sd_first"))
    unlike = compared.mapInArrow(_unlike(window), "sd_c_id long, sd_c_sum long, sd_c_place int, sd_words binary")
    stays = unlike.groupBy("sd_words").agg(F.min(F.struct("sd_c_id", "sd_c_sum", "sd_c_place")).alias("w"))
    stays = stays.groupBy(F.col("w.sd_c_id").alias("sd_s_id"), F.col("w.sd_c_sum").alias("sd_s_sum")).agg(F.collect_list("w.sd_c_place").alias("sd_stays"))
    joined = rows.join(by.drop("sd_claims"), F.expr("sd_id = sd_by_id AND sd_sum = sd_by_sum"), "left").join(stays, F.expr("sd_id = sd_s_id AND sd_sum = sd_s_sum"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "sd_norm"):
            n_words, n_removed, spans, kept = [], [], [], []
            for t, places, stay in zip(*(batch.column(c).to_pylist() for c in ("sd_norm", "sd_places", "sd_stays"))):
                words = t.split()
                n_words.append(len(words))
                starts = _from_planes(places, len(places) // 4)[0] if places else np.zeros(0, np.int32)
                if stay:
                    starts = starts[~np.isin(starts, stay)]
                if not len(starts):
                    n_removed.append(0)
                    spans.append([])
                    kept.append(t)
                    continue
                starts, _ = _word_ends(t, starts, window)
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, starts, 1)
                np.subtract.at(cover, starts + window, 1)
                cover = np.cumsum(cover)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], cover, [False]))))
                n_removed.append(int(cover.sum()))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(b" ".join(compress(words, ~cover)))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in carried),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(spans, spans_of),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return d.select("doc_id", F.col("sd_n_words").alias("n_words"), F.col("sd_n_removed").alias("n_removed"), F.sha2(F.col("sd_kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k
      FROM (SELECT doc_id, i, sha256(array_to_string(w[i:i + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20))),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM g WHERE k > 1),
l AS (SELECT doc_id, list(p) AS p FROM r GROUP BY doc_id),
t AS (SELECT d.doc_id, w, p FROM d LEFT JOIN l USING (doc_id)),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x ANTI JOIN r ON r.doc_id = x.doc_id AND r.p = x.i GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(p), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
