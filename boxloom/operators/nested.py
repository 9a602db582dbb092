"""Nested annotations of documents (pages, blocks, paragraphs, words, symbols) as Arrow arrays: made of boxes, and flattened again."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..sources.bridges import CHAR, PER_ROW

def vertices(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> pa.ListArray:
    """The four corners of each box, as lists of struct<x, y>."""
    x, y = np.empty((len(x0), 4), np.int32), np.empty((len(x0), 4), np.int32)
    x[:, 0], x[:, 1], x[:, 2], x[:, 3] = x0, x1, x1, x0
    y[:, 0], y[:, 1], y[:, 2], y[:, 3] = y0, y0, y1, y1
    return listed(pa.StructArray.from_arrays([pa.array(x.ravel()), pa.array(y.ravel())], ["x", "y"]), np.arange(len(x0) + 1) * 4)


def listed(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def of_one(field: str, values: pa.Array) -> pa.ListArray:
    """Each value in a struct of one field in a list of its own."""
    return listed(pa.StructArray.from_arrays([values], [field]), np.arange(len(values) + 1))


def characters(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The characters of all words, one after the other, and where each word's begin."""
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4)
    data = data[ends[0] : ends[-1]]
    begins = np.flatnonzero((data & 0xC0) != 0x80)
    text = pa.StringArray.from_buffers(len(begins), pa.py_buffer(np.append(begins, len(data)).astype(np.int32)), pa.py_buffer(data))
    return text, np.searchsorted(begins, ends - ends[0])


def annotations(boxes: dict[str, np.ndarray], words: pa.Array) -> tuple[np.ndarray, pa.ListArray]:
    """The documents that have a box, and the pages of each: one page, a block of one paragraph for a row of words, characters of equal width. boxes in order of doc, then of box_id."""
    doc, row = boxes["doc"], boxes["box_id"] // PER_ROW
    left, top, bottom = boxes["W_d"], boxes["H_b"], boxes["H_h"]
    chars, first = characters(words)
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(first))
    x = (left - CHAR * first[:-1]).astype(np.int32)[word] + CHAR * np.arange(len(chars), dtype=np.int32)
    symbols = pa.StructArray.from_arrays([chars, vertices(x, x + CHAR, top.astype(np.int32)[word], bottom.astype(np.int32)[word])], ["text", "vertices"])
    made = pa.StructArray.from_arrays([listed(symbols, first), vertices(left, boxes["W_g"], top, bottom)], ["symbols", "vertices"])
    start = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    blocks = pa.StructArray.from_arrays([of_one("words", listed(made, np.append(start, len(doc))))], ["paragraphs"])
    some, at = np.unique(doc[start], return_index=True)
    return some, of_one("blocks", listed(blocks, np.append(at, len(start))))


def inner(lists: pa.ListArray, parent: np.ndarray, field: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """What lists hold, or a field of it, and the parent of each."""
    values, at = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    return values if field is None else pc.struct_field(values, field), parent[at]


def flattened(pages: pa.ListArray) -> dict[str, dict[str, pa.Array | np.ndarray]]:
    """As boxes.flatten_annotation: of each kind (word, char) doc (the place of its pages), text, W_d, W_g, H_b and H_h of the boxes that have an extent."""
    values, doc = pages, np.arange(len(pages))
    for field in ("blocks", "paragraphs", "words"):
        values, doc = inner(values, doc, field)
    words, doc = inner(values, doc)
    symbols = pc.struct_field(words, "symbols")
    held, of = inner(symbols, doc)
    # a word's symbols in one list each, those without text left out
    text, some = pc.struct_field(held, "text"), pc.is_valid(pc.struct_field(held, "text"))
    n = np.bincount(pc.list_parent_indices(symbols).filter(some).to_numpy(), minlength=len(words)) if text.null_count else pc.fill_null(pc.list_value_length(symbols), 0).to_numpy()
    joined = pc.binary_join(listed(text.drop_null(), np.concatenate([[0], np.cumsum(n)])), "")
    if symbols.null_count:
        joined = pc.if_else(symbols.is_valid(), joined, pa.scalar(None, pa.string()))
    return {"word": extents(doc, joined, pc.struct_field(words, "vertices")), "char": extents(of, text, pc.struct_field(held, "vertices"))}


def extents(doc: np.ndarray, text: pa.Array, corners: pa.ListArray) -> dict[str, pa.Array | np.ndarray]:
    """The box of each one's corners, a missing x or y being 0; those of no extent, and of no corners, are left out."""
    n = pc.fill_null(pc.list_value_length(corners), 0).to_numpy()
    flat = corners.flatten()
    x, y = (pc.fill_null(pc.struct_field(flat, c), 0).to_numpy() for c in ("x", "y"))
    has = None
    if len(n) and (n == n[0]).all() and n[0]:
        x, y = x.reshape(-1, n[0]), y.reshape(-1, n[0])
        # column by column, which is many times as fast as along short rows
        low, high = lambda v: lowest(v, np.minimum), lambda v: lowest(v, np.maximum)
    else:
        has = n > 0
        start = (np.cumsum(n) - n)[has]
        low, high = (lambda v: np.minimum.reduceat(v, start) if len(start) else v[:0]), (lambda v: np.maximum.reduceat(v, start) if len(start) else v[:0])
    box = {"W_d": low(x), "W_g": high(x), "H_b": low(y), "H_h": high(y)}
    if has is not None and not has.all():
        doc, text = doc[has], text.filter(pa.array(has))
    keep = (box["W_d"] < box["W_g"]) & (box["H_b"] < box["H_h"])
    if not keep.all():
        doc, text, box = doc[keep], text.filter(pa.array(keep)), {k: v[keep] for k, v in box.items()}
    return {"doc": doc, "text": text, **box}


def lowest(rows: np.ndarray, by: np.ufunc) -> np.ndarray:
    """by of each row's numbers."""
    out = rows[:, 0].copy()
    for k in range(1, rows.shape[1]):
        by(out, rows[:, k], out=out)
    return out


def summed(found: dict[str, pa.Array | np.ndarray], n_docs: int) -> dict[str, np.ndarray]:
    """By doc, of those that have a box: doc, n, n_texts (different ones that aren't null) and the sums of the sides."""
    doc = found["doc"]
    text = found["text"].dictionary_encode()
    held, code, own = len(text.dictionary), text.indices.drop_null().to_numpy(), doc
    if text.null_count:
        own = doc[pc.is_valid(found["text"]).to_numpy(zero_copy_only=False)]
    if n_docs * held <= 1 << 26:
        seen = np.zeros((n_docs, held), bool)
        seen[own, code] = True
        n_texts = np.count_nonzero(seen, axis=1)
    else:
        n_texts = np.bincount(np.unique(own * np.int64(held) + code) // held, minlength=n_docs)
    n = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero(n)
    sums = {}
    # neighbours of one document are added first: they stand together
    start = np.flatnonzero(np.diff(doc, prepend=-1))
    for c in ("W_d", "W_g", "H_b", "H_h"):
        sums[c] = np.zeros(n_docs, np.int64)
        if len(start):
            np.add.at(sums[c], doc[start], np.add.reduceat(found[c], start, dtype=np.int64))
    return {"doc": some, "n": n[some], "n_texts": n_texts[some], **{c: v[some] for c, v in sums.items()}}
