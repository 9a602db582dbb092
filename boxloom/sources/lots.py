"""Box tables and OCR entries as files of a lot of documents at once, in Arrow: the formats of files, without a row of Spark's for each box."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyarrow import json as pa_json

from .rasters import put

#: Columns of a box table's CSV file, as files.BOXES has them.
NUMBERS = ("W_d", "W_g", "H_h", "H_b", "Width", "Height")
HEADER = ("text", "filename", *NUMBERS, "ratio", "fg_color", "bg_color", "len_text")
TYPES = {**{c: pa.string() for c in ("text", "filename", "fg_color", "bg_color")}, **{c: pa.int32() for c in (*NUMBERS, "len_text")}, "ratio": pa.float64()}
HEAD = (",".join(HEADER) + "\n").encode()


def stem(filename: str) -> str:
    """A file's name without folder and suffix."""
    return re.sub(r"\.[^.]*$", "", filename.rpartition("/")[2])


def quoted(text: pa.Array) -> pa.Array:
    """Fields of a CSV file: those that hold a comma, a quote or a line's end in quotes, quotes in them doubled."""
    odd = holding(text, b',"\r\n')
    if not odd.any():
        return text
    return pc.replace_with_mask(text, pa.array(odd), pc.binary_join_element_wise('"', pc.replace_substring(text.filter(pa.array(odd)), '"', '""'), '"', ""))


def holding(text: pa.Array, some: bytes) -> np.ndarray:
    """Which strings hold one of some bytes. No string may be null."""
    offsets, data = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4), np.frombuffer(text.buffers()[2] or b"", np.uint8)
    found = np.flatnonzero(np.isin(np.arange(256), list(some))[data[offsets[0] : offsets[-1]]]) + offsets[0]
    out = np.zeros(len(text), bool)
    out[np.searchsorted(offsets, found, "right") - 1] = True
    return out


def numbers(values: np.ndarray, before: str = "", after: str = "") -> pa.Array:
    """Whole numbers as text. Where they are few, each is made once."""
    low, high = int(values.min(initial=0)), int(values.max(initial=0))
    few = high - low < 1 << 16
    text = pa.array(np.arange(low, high + 1) if few else values).cast(pa.string())
    text = pc.binary_join_element_wise(before, text, after, "") if before or after else text
    return text.take(pa.array(values - low if low else values)) if few else text


def pieces(rows: pa.Array, first: np.ndarray) -> Iterator[bytes]:
    """The strings from first[k] to before first[k + 1], one after the other, for each k."""
    text = rows.cast(pa.large_string())
    offsets, data = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8), text.buffers()[2]
    at = offsets[first].tolist()
    for x, y in zip(at[:-1], at[1:], strict=True):
        yield data[x:y].to_pybytes() if y > x else b""


def csv_files(names: list[str], boxes: dict[str, np.ndarray], words: pa.Array) -> Iterator[tuple[str, bytes]]:
    """stem.csv and its content for each of the documents with a box. boxes: as pages.laid_out makes them, in order of doc; words: their texts."""
    doc, colors = boxes["doc"], boxes["colors"]
    shape, at = np.unique(boxes["Width"] << 20 | boxes["Height"], return_index=True, return_inverse=True)[1:]
    size = pc.binary_join_element_wise(*(numbers(boxes[c][shape]) for c in ("Width", "Height")), pa.array([repr(x) for x in boxes["ratio"][shape].tolist()], pa.string()), ",").take(pa.array(at))
    own = quoted(pa.array(names, pa.string())).take(pa.array(doc))
    color = lambda k: (numbers(colors[:, k], '"['), numbers(colors[:, k + 1]), numbers(colors[:, k + 2], "", ']"'))
    rows = pc.binary_join_element_wise(quoted(words), own, *(numbers(boxes[c]) for c in NUMBERS[:4]), size, *color(0), *color(3), numbers(boxes["len_text"], "", "\n"), ",")
    some, first = np.unique(doc, return_index=True)
    for k, body in zip(some.tolist(), pieces(rows, np.append(first, len(doc))), strict=True):
        yield f"{stem(names[k])}.csv", HEAD + body


def read_csv_files(contents: list[bytes]) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """Rows of box tables, one below the other, and the place of the file each is from; which files are none, and give no rows.

    As files.read_box_files: a file is none if its header is another one or a row of it has no filename or side; what else can't be read is null.
    """
    bad = np.array([not c.startswith(HEAD) or c.count(HEAD[:-1]) > 1 for c in contents], bool)
    good = np.flatnonzero(~bad)
    bodies = [contents[i][len(HEAD) :] for i in good]
    bodies = [b if b.endswith(b"\n") or not b else b + b"\n" for b in bodies]
    ends = np.array([b.count(b"\n") for b in bodies], np.int64)
    try:
        table = parsed(b"".join(bodies), TYPES, False)
        if len(table) != ends.sum():
            raise pa.ArrowInvalid("a line's end within a field")
    except pa.ArrowInvalid:
        tables = [leniently(b) for b in bodies]
        table, ends = pa.concat_tables([schema().empty_table(), *tables]), np.array([len(t) for t in tables], np.int64)
    file = np.repeat(good, ends)
    broken = np.zeros(len(table), bool)
    for c in ("filename", "W_d", "W_g", "H_b", "H_h"):
        if table[c].null_count:
            broken |= table[c].is_null().to_numpy()
    bad[file[broken]] = True
    keep = ~bad[file]
    return (table, file, bad) if keep.all() else (table.filter(pa.array(keep)), file[keep], bad)


def schema() -> pa.Schema:
    return pa.schema([(c, TYPES[c]) for c in HEADER])


def parsed(body: bytes, types: dict[str, pa.DataType], nulls: bool, skip: Callable | None = None) -> pa.Table:
    if not body:
        return pa.schema([(c, types[c]) for c in HEADER]).empty_table()
    return csv.read_csv(
        pa.BufferReader(body), read_options=csv.ReadOptions(column_names=list(HEADER), use_threads=False, block_size=max(len(body) + 1, 1 << 20)),
        parse_options=csv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False, invalid_row_handler=skip),
        convert_options=csv.ConvertOptions(column_types=types, strings_can_be_null=False, quoted_strings_can_be_null=False, null_values=[""] if nulls else []),
    )


def leniently(body: bytes) -> pa.Table:
    """A file's rows, by fields: what is no number is null; a row of fewer fields lacks the last ones, one of more loses those."""
    import csv as lines
    import io

    rows = [r for r in lines.reader(io.StringIO(body.decode(errors="replace"), newline="")) if r]

    def value(text: str, kind: pa.DataType):
        if pa.types.is_string(kind):
            return text
        try:
            return float(text) if pa.types.is_floating(kind) else x if -(1 << 31) <= (x := int(text)) < 1 << 31 else None
        except ValueError:
            return None

    return pa.table([pa.array([value(r[k], TYPES[c]) if k < len(r) else None for r in rows], TYPES[c]) for k, c in enumerate(HEADER)], schema=schema())


def channels(colors: pa.ChunkedArray) -> list[pa.ChunkedArray | pa.Array]:
    """The three channels of colours as text; nulls for what is no list of whole numbers."""
    some = colors.combine_chunks() if isinstance(colors, pa.ChunkedArray) else colors
    inner = pc.utf8_slice_codeunits(some, 1, -1)
    plain = len(some) and not some.null_count and pc.all(pc.match_substring_regex(some, r"^\[\d{1,3},\d{1,3},\d{1,3}\]$")).as_py()
    if plain:
        body = b"".join(pieces(pc.binary_join_element_wise(inner, "\n", ""), np.array([0, len(inner)])))
        return csv.read_csv(pa.BufferReader(body), read_options=csv.ReadOptions(column_names=list("abc"), use_threads=False, block_size=len(body) + 1), convert_options=csv.ConvertOptions(column_types=dict.fromkeys("abc", pa.int32()))).columns
    rows = []
    for text in some.to_pylist():
        try:
            row = json.loads(text) if text is not None else None
        except ValueError:
            row = None
        whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
        rows.append([x if whole(x) else None for x in row][:3] + [None] * (3 - len(row[:3])) if isinstance(row, list) else [None] * 3)
    return [pa.array([r[k] for r in rows], pa.int32()) for k in range(3)]


#: Of an OCR entry, as files.write_entries indents it.
SIDES = ("W_d", "W_g", "H_b", "H_h")
BOX = pa.struct([(c, pa.int32()) for c in SIDES])
ENTRIES = pa.list_(pa.struct([("Word", pa.string()), ("BoundingBox", BOX)]))


def escaped(text: pa.Array) -> pa.Array:
    """Strings as in JSON, without the quotes around them."""
    odd = holding(text, bytes([*range(0x20), *b'"\\', 0x7F]))
    if not odd.any():
        return text
    made = text.filter(pa.array(odd)).dictionary_encode()
    return pc.replace_with_mask(text, pa.array(odd), pa.array([json.dumps(x, ensure_ascii=False)[1:-1] for x in made.dictionary.to_pylist()], pa.string()).take(made.indices))


def entry_files(names: list[str | None], boxes: dict[str, np.ndarray], words: pa.Array) -> Iterator[tuple[str, bytes]]:
    """stem.json and its content, the entries of its boxes in order, for each of the documents with a box; of no stem for those without a name."""
    doc = boxes["doc"]
    sides = [numbers(boxes[c], f'\n    "{c}" : ') for c in SIDES[:3]] + [numbers(boxes["H_h"], '\n    "H_h" : ', "\n  }\n}, ")]
    word = pc.binary_join_element_wise('{\n  "Word" : "', escaped(words), '",\n  "BoundingBox" : {', "")
    rows = pc.binary_join_element_wise(pc.binary_join_element_wise(word, sides[0], ""), *sides[1:], ",")
    some, first = np.unique(doc, return_index=True)
    for k, body in zip(some.tolist(), pieces(rows, np.append(first, len(doc))), strict=True):
        yield f"{stem(names[k] or '')}.json", b"[ " + body[:-2] + b" ]"


def read_entry_files(contents: list[bytes]) -> pa.ListArray:
    """The entries of OCR JSON files, a list for each; null for broken files. As files.ocr_entries: what isn't of an entry's types is null."""
    # in JSON a line's end stands between tokens only, or what it stands in is broken
    lines = [c.replace(b"\n", b" ").replace(b"\r", b" ") for c in contents]
    try:
        # what could end one file's array and begin another's is looked at file by file
        if not all(x.lstrip(b" \t").startswith(b"[") and x.rstrip(b" \t").endswith(b"]") for x in lines):
            raise pa.ArrowInvalid("no array")
        body = b"".join(b'{"e":%b}\n' % x for x in lines)
        table = pa_json.read_json(pa.BufferReader(body), read_options=pa_json.ReadOptions(use_threads=False, block_size=len(body) + 1), parse_options=pa_json.ParseOptions(explicit_schema=pa.schema([("e", ENTRIES)]), unexpected_field_behavior="ignore"))
        if len(table) != len(contents):
            raise pa.ArrowInvalid("several values")
        return pa.concat_arrays(table["e"].chunks)
    except pa.ArrowInvalid:
        return pa.array([entries(c) for c in contents], ENTRIES)


def entries(content: bytes) -> list | None:
    """One file's, of its first value."""
    try:
        found = json.JSONDecoder().raw_decode(content.decode(errors="replace").lstrip())[0]
    except ValueError:
        return None
    of = lambda x, k: x.get(k) if isinstance(x, dict) else None
    text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    whole = lambda x: x if isinstance(x, int) and not isinstance(x, bool) and -(1 << 31) <= x < 1 << 31 else None
    box = lambda x: {c: whole(of(x, c)) for c in SIDES} if isinstance(x, dict) else None
    some = found if isinstance(found, list) else [found] if isinstance(found, dict) else None
    return None if some is None else [{"Word": text(of(x, "Word")), "BoundingBox": box(of(x, "BoundingBox"))} if isinstance(x, dict) else None for x in some]


class Shelf:
    """A folder of its own below root for one lot's files, in any store that Arrow reaches; it goes once they are read."""

    def __init__(self, root: str):
        self.store, base = fs.FileSystem.from_uri(root if "://" in root else root.replace("file:/", "/", 1))
        self.path = f"{base}/{uuid.uuid4().hex}"

    def __enter__(self) -> Shelf:
        self.store.create_dir(self.path, recursive=True)
        return self

    def __exit__(self, *_) -> None:
        self.store.delete_dir(self.path)

    def write(self, files: Iterator[tuple[str, bytes]], overwrite: bool = True) -> int:
        return put(self.store, self.path, files, overwrite)

    def read(self, suffix: str) -> tuple[list[str], list[bytes]]:
        """Stems and contents of the files with a suffix, in order of name."""
        found = sorted(f.base_name for f in self.store.get_file_info(fs.FileSelector(self.path)) if f.type == fs.FileType.File and f.base_name.endswith(suffix))
        contents = []
        for name in found:
            with self.store.open_input_stream(f"{self.path}/{name}") as f:
                contents.append(f.read())
        return [name.removesuffix(suffix) for name in found], contents
