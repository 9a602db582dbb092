"""Suffix-array dedup: every byte of a long string that starts anywhere else too goes.

Suffixes are dealt to shards by content, so that equal long strings meet in one shard whatever documents hold them:

1. Of every window of the given width the smallest hash of a short gram is its anchor. Starts next to each other with one anchor
   are a piece; its key is a hash of the bytes that all windows of the anchor's class (its offset: one of two halves) share. Equal windows
   have equal keys, so a key that only one piece has can't repeat: pieces are counted by key, without their bytes. Of equal
   pieces in more than two places of a task two are counted; the others repeat, as their bytes are compared there.
2. A key of very many different pieces is dealt out anew by finer classes, whose windows share more bytes, and at last by whole windows, of which
   a task passes two equal ones at most: no string that many texts share, each with other surroundings, brings them into one task.
3. Pieces of repeated keys travel with their bytes, each distinct one of a task once, to the shard of their key, with two places of a task
   at most; further ones have the same bytes and repeat. What is known goes straight to its text.
4. Each shard sorts its suffixes by induction and computes permuted common prefixes; a start repeats if its suffix has the width in
   common with a neighbour's, or its piece stands in two places (of equal pieces a shard holds one; the only piece of a key has nothing to be
   sorted with). Hashes only choose shards here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Rolling, bucket_count, byte_values, durable, extended, mix, read, refuse_prefix, slices, utf8
from .suffixes import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 400, 32
#: Bytes of a shard's string, such that its lists stay in a core's cache; one key's pieces stay together.
SHARD = 1 << 18
#: Into how many classes an anchor's offsets are divided, round by round; the last round is of whole windows.
CLASSES = (2, 16, None)
#: A key of more distinct pieces than this, or than IN_TASK of one lot of a task, goes on to the next round.
HOT, IN_TASK = 2048, 32
#: Bytes of starts up to which the texts that go on are found by a broadcast join; beyond it the join shuffles.
BROADCAST_BYTES = 8 << 20
#: Pieces or bytes that a task gathers before it passes them on.
FLUSH_PIECES, FLUSH_BYTES = 1 << 18, 24 << 20

_VALUES = byte_values(7)
_NULL = np.iinfo(np.int64).min
_PLACE = np.uint64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, rolling: Rolling, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows, in order, and the place of each one's anchor: the first gram of smallest hash."""
    n, span = len(data), width - gram + 1
    counts = np.maximum(np.diff(offsets) - width + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.arange(total) + np.repeat(offsets[:-1] - (np.cumsum(counts) - counts), counts)
    hashes = mix(rolling.windows(gram))
    if n < 1 << 24:
        value = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    else:  # one very long text: the same order, by the bits of hashes that are left above, then places
        order = np.argsort(hashes & ~_PLACE, kind="stable")
        value = np.empty(len(hashes), np.uint64)
        value[order] = np.arange(len(hashes), dtype=np.uint64)
    blocks = -(-len(value) // span) + 1
    padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(value)] = value
    grid = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + span - 1])
    return starts, (least & _PLACE).astype(np.int64) if n < 1 << 24 else order[least.astype(np.int64)]


def pieces(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, halves: int = 2, within: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """first and last start (places in data), text, key and a hash of the bytes of each piece.

    halves: into how many classes an anchor's offsets in its windows are divided; within: only of starts where it is true.
    """
    rolling = Rolling(_VALUES[data])
    starts, anchor = anchors(data, offsets, rolling, width, gram)
    if within is not None:
        some = within[starts]
        starts, anchor = starts[some], anchor[some]
    if not len(starts):
        return {x: np.zeros(0, np.uint64 if x in ("key", "sum") else np.int64) for x in ("first", "last", "text", "key", "sum")}
    span = width - gram + 1
    wide = -(-span // halves)
    kind = (anchor - starts) // wide
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1]
    a, kind = anchor[at], kind[at]
    low, high = kind * wide, np.minimum((kind + 1) * wide, span)
    # what all windows of the class share
    key = mix(rolling.ranges(a - low, a - high + 1 + width) + mix((kind + 1 + 64 * halves).astype(np.uint64)))
    return {
        "first": first,
        "last": last,
        "text": np.searchsorted(offsets, first, "right") - 1,
        "key": key,
        "sum": mix(rolling.ranges(first, last + width) + key),
    }


def _groups(kinds: tuple, blob: bytes) -> list[np.ndarray]:
    n = len(blob) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += out[-1].nbytes
    return out


_KINDS = ("<u8", "<u8", "<i8", "<i8", "<i4", "<i4")  # key, sum, id, check, first, last
_RUNS = ("<i8", "<i8", "<i4", "<i4", "<i4")  # id, check, first, last or end, kind
MANY, KNOWN = 8, 9  # kinds of a piece: its key goes on to the next round; known to repeat; else the round in which its bytes travel
_MARK = -1  # the start of a row that stands for a key of more than IN_TASK pieces


def _cut(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b] : cut[b + 1]]


def _differ(*columns: np.ndarray) -> np.ndarray:
    """Is each row other than the one before it?"""
    return np.concatenate(([True], np.logical_or.reduce([x[1:] != x[:-1] for x in columns])))


def _once(columns: list[np.ndarray], at: np.ndarray, raw: bytes, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Pieces in order of key and sum, each place once, and which of them have the bytes of two others before them."""
    key, total, ids, check, first, _ = columns
    order = np.lexsort((first, check, ids, total, key))
    key, total, ids, check, first, last = columns = [c[order] for c in columns]
    at, size = at[order], last - first + width
    new = _differ(key, total)
    fresh = new | _differ(ids, check, first)
    place = np.cumsum(fresh)
    of = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    beyond = fresh & (place - place[of] >= 2)
    for i in np.flatnonzero(beyond).tolist():
        a, b = at[i], at[of[i]]
        beyond[i] = size[i] == size[of[i]] and raw[a : a + size[i]] == raw[b : b + size[i]]
    return [c[fresh] for c in columns], beyond[fresh]


def _found(ids: np.ndarray, check: np.ndarray, first: np.ndarray, last: np.ndarray, kind: np.ndarray) -> Iterator[pa.RecordBatch]:
    """id, check, many, found (first, last, kind): what goes on to the next round apart from the rest."""
    for many in (False, True):
        some = np.flatnonzero((kind == MANY) == many)
        if not len(some):
            continue
        order = some[np.lexsort((first[some], check[some], ids[some]))]
        rows = np.stack([first[order], last[order], kind[order]], axis=1).astype("<i4")
        at = np.flatnonzero(_differ(ids[order], check[order]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[order][at]), pa.array(check[order][at]), pa.array(np.full(len(at), many)), pa.array([x.tobytes() for x in np.split(rows, at[1:])], pa.binary())],
            names=["id", "check", "many", "found"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _found gives of keys that more than one piece has, and of pieces that came straight; one bucket of keys is one partition."""
    parts, level = [], 0
    for batch in batches:
        straight = batch.column("straight")
        if blobs := batch.filter(straight).column("blob").to_pylist():
            yield from _found(*map(np.concatenate, zip(*(_groups(_RUNS, b) for b in blobs))))
        if rest := batch.filter(pc.invert(straight)).select(["round", "blob"]).to_pylist():
            level = rest[0]["round"]
            parts += [_groups(_KINDS, r["blob"]) for r in rest]
    if not parts:
        return
    key, total, ids, check, first, last = map(np.concatenate, zip(*parts))
    del parts
    order = np.lexsort((total, key))
    key, total, ids, check, first, last = (x[order] for x in (key, total, ids, check, first, last))
    group = np.cumsum(_differ(key)) - 1
    many = np.bincount(group, weights=_differ(key, total)) > HOT
    many[group[first == _MARK]] = True
    some = (np.bincount(group)[group] > 1) & (first != _MARK)
    if some.any():
        yield from _found(*(x[some] for x in (ids, check, first, last)), np.where(many[group] & (level < len(CLASSES) - 1), MANY, level)[some])


def _repeated(shard: dict[bytes, int], width: int) -> dict[bytes, np.ndarray]:
    """For each distinct piece, in how many places it stands given, at which of its starts a window begins that is elsewhere too."""
    texts = list(shard)
    # no UTF-8 text has this byte, so no common prefix of a start's window reaches over it
    s = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    common = permuted_common_prefixes(s, sa := suffix_array(s, 256))
    most = common.copy()
    most[sa[:-1]] = np.maximum(most[sa[:-1]], common[sa[1:]])
    out, at = {}, 0
    for t in texts:
        k = len(t) - width + 1
        out[t] = np.ones(k, bool) if shard[t] > 1 else most[at : at + k] >= width
        at += len(t) + 1
    return out


def _sorted_shards(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """id, check, starts (first, end of runs of repeated starts)."""
        of: dict[bytes, list] = {}
        keys: dict[int, list[bytes]] = {}
        for batch in batches:
            known = pc.is_null(batch.column("piece"))
            if blobs := batch.filter(known).column("places").to_pylist():
                yield _by_text(blobs)
                batch = batch.filter(pc.invert(known))
            for key, piece, places in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist(), batch.column("places").to_pylist()):
                if piece not in of:
                    of[piece] = []
                    keys.setdefault(key, []).append(piece)
                of[piece].append(places)
        shard: dict[bytes, int] = {}
        size = 0

        def judged(repeated: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
            rows = []
            for piece, starts in repeated.items():
                edge = np.flatnonzero(np.diff(np.concatenate(([False], starts, [False])))).reshape(-1, 2)
                if len(edge):
                    for ids, check, first in zip(*(x.tolist() for x in _groups(("<i8", "<i8", "<i4"), _joined(of[piece])))):
                        rows.append((ids, check, (edge + first).astype("<i4").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["id", "check", "starts"])

        alone: dict[bytes, np.ndarray] = {}
        for key in sorted(keys):
            # one key's pieces together; nothing else holds a window of a key's only piece, which repeats if it stands in two places
            for piece in keys[key]:
                n = len(set(zip(*(x.tolist() for x in _groups(("<i8", "<i8", "<i4"), _joined(of[piece]))))))
                if len(keys[key]) > 1:
                    shard[piece] = n
                    size += len(piece)
                elif n > 1:
                    alone[piece] = np.ones(len(piece) - width + 1, bool)
            if size > SHARD:
                yield from judged(_repeated(shard, width))
                shard, size = {}, 0
        if shard:
            yield from judged(_repeated(shard, width))
        yield from judged(alone)

    return run


def _by_text(blobs: list[bytes]) -> pa.RecordBatch:
    """id, check, starts of packed runs of starts that are known to repeat."""
    ids, check, first, end, _ = map(np.concatenate, zip(*(_groups(_RUNS, b) for b in blobs)))
    order = np.lexsort((first, check, ids))
    ids, check, runs = ids[order], check[order], np.stack([first[order], end[order]], axis=1)
    at = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (check[1:] != check[:-1]))))
    return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(check[at]), pa.array([x.tobytes() for x in np.split(runs, at[1:])], pa.binary())], names=["id", "check", "starts"])


def _joined(parts: list[bytes]) -> bytes:
    """Packed places of several tasks as one."""
    if len(parts) > 1:
        parts[:] = [b"".join(np.concatenate(x).tobytes() for x in zip(*(_groups(("<i8", "<i8", "<i4"), p) for p in parts)))]
    return parts[0]


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, prefix: str = "sx_", keep: list[str] | None = None
) -> DataFrame:
    """docs (or its columns keep) without the bytes of strings of width bytes that start anywhere else too, all copies alike.

    New columns, named with prefix: n_bytes, n_removed, spans (array<struct<start,end>>: maximal removed runs of UTF-8 bytes) and kept
    (binary: the other bytes; a cut may fall inside a character). Strings don't cross rows and are judged on the input.

    Null and empty texts have no bytes. Rows with equal keys and equal texts are one document; rows with equal keys and
    different texts are told apart by a hash of the text; a null key is a key; an empty table gives an empty one; a column whose
    name begins with sx_ or is a new one's is an error. key is a whole number. A very long text is hashed and cut in one task, whole.
    Counts of keys are checkpointed; what a round passes on decides whether there is a next one.
    """
    carried = docs.columns if keep is None else keep
    refuse_prefix([*carried, text], "sx_")
    schema = extended(docs, carried, f"{prefix}n_bytes long, {prefix}n_removed long, {prefix}spans array<struct<start:int,end:int>>, {prefix}kept binary")
    gram = min(GRAM, width)
    buckets = bucket_count(docs, 1.5)
    rows = docs.select(
        *carried, *([] if text in carried else [text]), F.coalesce(F.col(key).cast("long"), F.lit(int(_NULL))).alias("sx_id"), F.xxhash64(text).alias("sx_check")
    )

    span = width - gram + 1
    classes = [min(c or span, span) for c in CLASSES]

    def find(level: int):
        last_level = level == len(classes) - 1

        def flush(held: list[tuple], raws: list[np.ndarray]) -> pa.RecordBatch:
            *columns, at = map(np.concatenate, zip(*held))
            columns, known = _once(columns, at, np.concatenate(raws).tobytes(), width)
            key, total = columns[:2]
            group = np.cumsum(_differ(key)) - 1
            wide = np.bincount(group, weights=_differ(key, total)) > IN_TASK if not last_level else np.zeros(group[-1] + 1, bool)
            many = wide[group] & ~known
            marks = np.flatnonzero(_differ(key) & wide[group])
            kind = np.where(known, KNOWN, MANY).astype(np.int64)
            # what is known or goes on is dealt by text, the rest by key, with a mark for each key that goes on
            to = np.where(known | many, (columns[2] + columns[3]) % buckets + buckets, (key % np.uint64(buckets)).astype(np.int64))
            cuts = [(b, r, columns) for b, r in _cut(to, 2 * buckets)]
            if len(marks):
                nothing = np.zeros(len(marks), np.int64)
                mark = [key[marks], total[marks], nothing, nothing, nothing + _MARK, nothing + _MARK]
                cuts += [(b, r, mark) for b, r in _cut((mark[0] % np.uint64(buckets)).astype(np.int64), buckets)]
            blobs = [b"".join(c[r].astype(k).tobytes() for c, k in (zip(x, _KINDS) if b < buckets else zip([*x[2:], kind], _RUNS))) for b, r, x in cuts]
            return pa.RecordBatch.from_arrays([pa.array([b % buckets for b, *_ in cuts], pa.int32()), pa.array([level] * len(cuts), pa.int32()), pa.array([b >= buckets for b, *_ in cuts]), pa.array(blobs, pa.binary())], names=["bucket", "round", "straight", "blob"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, raws, n, size = [], [], 0, 0
            for batch in slices(batches, "text"):
                data, offsets = utf8(batch.column("text"))
                within = None
                if level:
                    within = np.zeros(len(data), bool)
                    for at, blobs in zip(offsets.tolist(), batch.column("sx_open").to_pylist()):
                        for a, b, _ in np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 3).tolist():
                            within[at + a : at + b + 1] = True
                p = pieces(data, offsets, width, gram, classes[level], within)
                t = p["text"]
                if not len(t):
                    continue
                ids, check = (batch.column(c).to_numpy()[t] for c in ("sx_id", "sx_check"))
                held.append((p["key"], p["sum"], ids, check, p["first"] - offsets[t], p["last"] - offsets[t], p["first"] + size))
                raws.append(data)
                n += len(t)
                size += len(data)
                if n > FLUSH_PIECES or size > FLUSH_BYTES:
                    yield flush(held, raws)
                    held, raws, n, size = [], [], 0, 0
            if n:
                yield flush(held, raws)

        return run

    texts = rows.select("sx_id", "sx_check", F.col(text).alias("text"))
    counted = []
    for level in range(len(classes)):
        hashed = texts.mapInArrow(find(level), "bucket int, round int, straight boolean, blob binary").repartitionById(buckets, "bucket")
        counted.append(durable(hashed.mapInArrow(_count, "id long, check long, many boolean, found binary")))
        on = counted[-1].where("many")
        size = on.agg(F.sum(F.length("found") + F.lit(64))).first()[0]
        if not size:
            break
        on = on.groupBy("id", "check").agg(F.collect_list("found").alias("sx_open"))
        texts = rows.select("sx_id", "sx_check", F.col(text).alias("text")).join(F.broadcast(on) if size <= BROADCAST_BYTES else on, F.expr("sx_id = id AND sx_check = check")).drop("id", "check")
    judging = counted[0]
    for c in counted[1:]:
        judging = judging.unionByName(c)
    found = judging.where("NOT many").groupBy("id", "check").agg(F.collect_list("found").alias("sx_found")).toDF("sx_by_id", "sx_by_check", "sx_found")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bytes], list] = {}
        known: list[tuple[int, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [], [], [], []
            for (k, piece), places in held.items():
                if len(places) > 2:
                    places = list(dict.fromkeys(places))
                    known.extend((*p, p[2] + len(piece) - width + 1) for p in places[2:])
                ids, check, first = zip(*places[:2])
                columns[0].append(k % buckets)
                columns[1].append(k - (1 << 63))
                columns[2].append(piece)
                columns[3].append(b"".join(np.array(x, y).tobytes() for x, y in ((ids, "<i8"), (check, "<i8"), (first, "<i4"))))
            if known:
                runs = np.column_stack([np.array(known, np.int64), np.full(len(known), KNOWN)])
                for b, r in _cut((runs[:, 0] + runs[:, 1]) % buckets, buckets):
                    for c, x in zip(columns, (b, 0, None, b"".join(runs[r, i].astype(k).tobytes() for i, k in enumerate(_RUNS)))):
                        c.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "key", "piece", "places"])

        for batch in slices(batches, text):
            data, offsets = utf8(batch.column(text))
            travels = [np.zeros(len(data), bool) for _ in classes]
            ids, checks = (batch.column(c).to_pylist() for c in ("sx_id", "sx_check"))
            for at, blobs, i, c in zip(offsets.tolist(), batch.column("sx_found").to_pylist(), ids, checks):
                for a, b, kind in np.frombuffer(b"".join(blobs), "<i4").reshape(-1, 3).tolist():
                    if kind == KNOWN:
                        known.append((i, c, a, b + 1))
                        size += 100
                    else:
                        travels[kind][at + a : at + b + 1] = True
            raw = data.tobytes()
            for n, within in zip(classes, travels):
                if not within.any():
                    continue
                p = pieces(data, offsets, width, gram, n, within)
                for a, b, t, k in zip(p["first"].tolist(), p["last"].tolist(), p["text"].tolist(), p["key"].tolist()):
                    piece = raw[a : b + width]
                    if (k, piece) not in held:
                        held[k, piece] = []
                        size += len(piece) + 200
                    held[k, piece].append((ids[t], checks[t], a - int(offsets[t])))
                    size += 100
            if size > FLUSH_BYTES:
                yield flush()
                held, known, size = {}, [], 0
        if held or known:
            yield flush()

    # the same columns as below, though some aren't looked at, so that both joins read one exchange of the texts
    judged_texts = rows.join(found, F.expr("sx_id = sx_by_id AND sx_check = sx_by_check")).select(*rows.columns, "sx_found")
    cuts = judged_texts.mapInArrow(cut, "bucket int, key long, piece binary, places binary")
    judged = cuts.repartitionById(buckets, "bucket").mapInArrow(_sorted_shards(width), "id long, check long, starts binary")
    by = judged.groupBy("id", "check").agg(F.collect_list("starts").alias("sx_starts")).toDF("sx_by_id", "sx_by_check", "sx_starts")
    same = F.expr("sx_id = sx_by_id AND sx_check = sx_by_check")
    joined = rows.join(by, same, "left").select(*carried, *([] if text in carried else [text]), "sx_starts")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, text):
            n_bytes, n_removed, spans, kept = [], [], [], []
            for t, starts in zip(batch.column(text).to_pylist(), batch.column("sx_starts").to_pylist()):
                raw = (t or "").encode()
                n_bytes.append(len(raw))
                merged: list[list[int]] = []
                for a, b in sorted(map(tuple, np.frombuffer(b"".join(starts or []), "<i4").reshape(-1, 2).tolist())):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b + width - 1)
                    else:
                        merged.append([a, b + width - 1])
                n_removed.append(sum(b - a for a, b in merged))
                spans.append([{"start": a, "end": b} for a, b in merged])
                ends = [0, *(b for _, b in merged)]
                kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in merged), len(raw)])) if merged else raw)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carried), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, spans_of), pa.array(kept, pa.binary())], names=schema.names
            )

    return joined.mapInArrow(remove, schema)


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return d.select(
        "doc_id", F.col("sx_n_bytes").alias("n_bytes"), F.col("sx_n_removed").alias("n_removed"), F.size("sx_spans").cast("long").alias("n_spans"), F.sha2("sx_kept", 256).alias("kept_sha256")
    )
