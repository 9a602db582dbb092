"""Image files: a plain PNG codec, and a sink that writes named files to any store."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MAGIC = b"\x89PNG\r\n\x1a\n"


def _part(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(a: np.ndarray) -> bytes:
    """An 8-bit grey (height, width) or RGB (height, width, 3) raster as PNG, unfiltered."""
    h, w = a.shape[:2]
    rows = np.ascontiguousarray(a, np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rows], axis=1).tobytes()
    return _MAGIC + _part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)) + _part(b"IDAT", zlib.compress(raw)) + _part(b"IEND", b"")


def read_png(content: bytes) -> np.ndarray | None:
    """The raster of a PNG as png makes them (8 bits, grey or RGB, no filter, not interlaced); None for anything else."""
    if content is None or content[:8] != _MAGIC:
        return None
    at, data, head = 8, b"", None
    while at + 8 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        if at + 12 + n > len(content):
            return None
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", content[at + 8 : at + 21])
        elif kind == b"IDAT":
            data += content[at + 8 : at + 8 + n]
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2) or head[6]:
        return None
    try:
        rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(head[1], -1)
    except (zlib.error, ValueError):
        return None
    channels = 3 if head[3] == 2 else 1
    if rows[:, 0].any() or rows.shape[1] != 1 + head[0] * channels:
        return None
    return rows[:, 1:].reshape((head[1], head[0], 3) if channels == 3 else (head[1], head[0]))


@F.pandas_udf(T.BinaryType())
def png_of(pixels: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
    """PNG of arrays of levels, row by row."""
    out = [png(np.array(p, np.uint8).reshape((-1, w, 3) if c == 3 else (-1, w))) for p, w, c in zip(pixels, width, channels)]
    return pd.Series(out)


@F.pandas_udf(T.StructType([T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("channels", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))]))
def decoded(content: pd.Series) -> pd.DataFrame:
    """Height, width, channels and levels of PNG files; nulls for what isn't one."""
    rows = [(None,) * 4 if (a := read_png(c)) is None else (a.shape[0], a.shape[1], a.ndim * 2 - 3, a.ravel().tolist()) for c in content]
    return pd.DataFrame(rows, columns=["height", "width", "channels", "pixels"])


def luma(r: Column, g: Column, b: Column) -> Column:
    """Grey level of whole-number channels: weights 0.299, 0.587, 0.114 in 16-bit fixed point, rounded."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 32768, 16)


def grey_copies(images: DataFrame, name: str = "name", image: str = "image") -> DataFrame:
    """name_black.ext and the grey levels of decoded images (see decoded) that aren't grey already; what couldn't be decoded is left out."""
    at = lambda i, k: F.get(F.col(f"{image}.pixels"), 3 * i + k)
    places = F.sequence(F.lit(0), F.expr(f"{image}.height * {image}.width - 1"))
    coloured = F.exists(places, lambda i: (at(i, 0) != at(i, 1)) | (at(i, 1) != at(i, 2)))
    some = images.where((F.col(f"{image}.channels") == 3) & coloured)
    grey = F.transform(places, lambda i: luma(at(i, 0), at(i, 1), at(i, 2)))
    return some.select(name, F.regexp_replace(name, r"(\.[^.]*)$", "_black$1").alias("copy"), F.col(f"{image}.width").alias("width"), grey.alias("pixels"))


def sample_names(base: Column, idx: Column, dataset: Column | None = None) -> tuple[Column, Column]:
    """Paths of a sample's image and mask: two folders of one name each, or (with a dataset) a folder for each dataset with both in it."""
    if dataset is None:
        return (F.concat(F.lit(f"{kind}/"), base, F.lit("_"), idx, F.lit(".png")) for kind in ("images", "masks"))
    return (F.concat(dataset, F.lit("/"), base, F.lit(f"_{kind}_"), idx, F.lit(".png")) for kind in ("image", "mask"))


def put(store: fs.FileSystem, base: str, files: Iterable[tuple[str, bytes]], overwrite: bool = True) -> int:
    """Write paths' contents under base, each by a move; how many were written."""
    n, made = 0, set()
    for p, c in files:
        target = f"{base}/{p}"
        if not overwrite and store.get_file_info(target).type != fs.FileType.NotFound:
            continue
        folder = target.rpartition("/")[0]
        if folder not in made:
            store.create_dir(folder, recursive=True)
            made.add(folder)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(c)
        store.move(part, target)
        n += 1
    return n


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content", overwrite: bool = True) -> int:
    """Write each row's content (binary or string) to its path under root, from the executors; how many were written.

    A file appears whole, under its name, by a move, so that a task that runs twice does no harm. Without overwrite files that are there stay as they
    are. root is a path or URI of a store that Arrow reaches.
    """
    at = root if "://" in root else root.replace("file:/", "/", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(at)
        rows = ((p, c) for batch in batches for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        n = put(store, base, rows, overwrite)
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return files.select(path, F.col(content).cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def with_backend(df: DataFrame, backend: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """The slot for a decoder or an OCR service, which this library doesn't have: backend maps batches of rows (content, page, ...) to rows of schema."""
    return df.mapInPandas(backend, schema)
