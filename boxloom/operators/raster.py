"""Pixel arithmetic that needs whole rasters: local thresholds, connected components, cut tests. Numpy on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def window_stats(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over the square window around each pixel, edges mirrored."""
    r = size // 2
    p = np.pad(a.astype(float), r, mode="symmetric" if min(a.shape) <= r else "reflect")

    def box(x: np.ndarray) -> np.ndarray:
        s = np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]) / (size * size)

    m = box(p)
    return m, np.sqrt(np.maximum(box(p * p) - m * m, 0))


def sauvola(a: np.ndarray, size: int = 21, k: float = 0.5, r: float = 128.0) -> np.ndarray:
    m, s = window_stats(a, size)
    return m * (1 + k * (s / r - 1))


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, width, height and area of each 8-connected component, in order of its first pixel."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        p = np.pad(np.where(label > 0, label, mask.size + 1), 1, constant_values=mask.size + 1)
        near = np.min([p[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        near = np.where(label > 0, near, 0)
        if np.array_equal(near, label):
            break
        label = near
    out = []
    for v in np.unique(label[label > 0]):
        y, x = np.nonzero(label == v)
        out.append((int(x.min()), int(y.min()), int(np.ptp(x)) + 1, int(np.ptp(y)) + 1, len(x)))
    return out


def otsu_level(a: np.ndarray) -> int:
    n = np.bincount(a.astype(int).ravel(), minlength=256).astype(float)
    t = np.arange(256)
    w0, s0 = n.cumsum(), (n * t).cumsum()
    w1, s1 = w0[-1] - w0, s0[-1] - s0
    with np.errstate(invalid="ignore", divide="ignore"):
        between = np.where((w0 > 0) & (w1 > 0), w0 * w1 * (s0 / w0 - s1 / w1) ** 2, 0)
    return int(np.round(between, 3).argmax())


def is_cut(a: np.ndarray, tolerance: int = 0) -> bool:
    """Does ink (darker than Otsu's level) reach the crop's edge without filling it?"""
    h, w = a.shape
    ink = a <= otsu_level(a)
    if ink.all() or not ink.any():
        return False
    return any(x <= tolerance or y <= tolerance or x + cw >= w - tolerance or y + ch >= h - tolerance for x, y, cw, ch, _ in components(ink))


def crosses(boxes: list[tuple[int, ...]], left: int, right: int, top: int, bottom: int, inset: int, least: int) -> bool:
    """Does a component of at least least pixels touch the rectangle without lying inset pixels within it?"""
    return any(
        area >= least and x <= right and x + w >= left and y <= bottom and y + h >= top and not (x >= left + inset and x + w <= right - inset and y >= top + inset and y + h <= bottom - inset)
        for x, y, w, h, area in boxes
    )


def dark(a: np.ndarray) -> list[tuple[int, ...]]:
    return components(a <= otsu_level(a))


def cuts(page: np.ndarray, left: int, right: int, top: int, bottom: int, inset: int = 1, least: int = 4) -> tuple[bool, bool]:
    """Does the crop cut ink, as it stands alone, and by it or by its context: half its height, 8 pixels at least, on all sides within the page?

    Ink is what is not lighter than Otsu's level of the part that is looked at.
    """
    crop = page[top:bottom, left:right]
    alone = crosses(dark(crop), 0, crop.shape[1], 0, crop.shape[0], inset, least)
    around = max((bottom - top) // 2, 8)
    x, y = max(0, left - around), max(0, top - around)
    context = page[y : bottom + around, x : right + around]
    return alone, alone or crosses(dark(context), left - x, right - x, top - y, bottom - y, inset, least)


@F.pandas_udf(T.StructType([T.StructField("cut_alone", T.BooleanType()), T.StructField("cut", T.BooleanType())]))
def cut_report(pixels: pd.Series, width: pd.Series, left: pd.Series, right: pd.Series, top: pd.Series, bottom: pd.Series) -> pd.DataFrame:
    """cuts of a rectangle of each page."""
    rows = [cuts(np.asarray(p, float).reshape(-1, w), *box) for p, w, *box in zip(pixels, width, left, right, top, bottom)]
    return pd.DataFrame(rows, columns=["cut_alone", "cut"])


def filled(a: np.ndarray, mask: np.ndarray, rounds: int = 50) -> np.ndarray:
    """The masked pixels filled from around by diffusion: from the mean of all others, in each round, to the mean of their up to four neighbours."""
    if mask.all() or not mask.any():
        return a.astype(float)
    out = np.where(mask, a[~mask].mean(), a.astype(float))

    def around(x: np.ndarray) -> np.ndarray:
        p = np.pad(x, 1)
        return sum(p[1 + dy : 1 + dy + a.shape[0], 1 + dx : 1 + dx + a.shape[1]] for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)))

    n = around(np.ones(a.shape))
    for _ in range(rounds):
        out = np.where(mask, around(out) / n, out)
    return out


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def filled_in(pixels: pd.Series, width: pd.Series, left: pd.Series, right: pd.Series, top: pd.Series, bottom: pd.Series, rounds: pd.Series) -> pd.Series:
    """filled, of a rectangle of each raster."""
    out = []
    for p, w, x1, x2, y1, y2, n in zip(pixels, width, left, right, top, bottom, rounds):
        a = np.asarray(p, float).reshape(-1, w)
        mask = np.zeros(a.shape, bool)
        mask[y1:y2, x1:x2] = True
        out.append(filled(a, mask, n).ravel().tolist())
    return pd.Series(out)


def levels(embedding: Column) -> Column:
    """64 numbers as levels 0 to 255."""
    return F.transform(embedding, lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x.cast("double") * 64 + 128).cast("int"))))


REPORT = T.StructType([T.StructField("mean_threshold", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in ("n_ink", "n_components", "largest", "otsu")), T.StructField("cut", T.BooleanType())])


@F.pandas_udf(REPORT)
def raster_report(pixels: pd.Series) -> pd.DataFrame:
    """Of square rasters: mean Sauvola threshold, pixels under it, their components, the largest one's area, Otsu's level and the cut test."""
    rows = []
    for values in pixels:
        a = np.asarray(values, float)
        a = a.reshape(int(len(a) ** 0.5), -1)
        t = sauvola(a, 5)
        c = components(a < t)
        rows.append((round(float(t.mean()), 6), int((a < t).sum()), len(c), max((x[4] for x in c), default=0), otsu_level(a), is_cut(a)))
    return pd.DataFrame(rows, columns=["mean_threshold", "n_ink", "n_components", "largest", "otsu", "cut"])
