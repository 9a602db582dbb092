"""Rasters and feature maps held as arrays, row by row; all inside higher-order functions, so a row is one unit of work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import bound

KINDS = ("invert", "brightness", "contrast", "channel_shift", "channel_shuffle")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def resize(block: Column, h: int, w: int, to_h: int, to_w: int) -> Column:
    """An h x w raster as to_h x to_w, bilinear between pixel centres, edges repeated; libraries with fixed-point weights differ in the last level."""

    def at(place: Column, old: int, new: int) -> tuple[Column, Column, Column]:
        f = (place + 0.5) * (old / new) - 0.5
        low = F.floor(f)
        clip = lambda x: F.least(F.lit(old - 1), F.greatest(F.lit(0), x)).cast("int")
        return clip(low), clip(low + 1), f - low

    def value(i: Column) -> Column:
        y0, y1, wy = at(F.floor(i / to_w), h, to_h)
        x0, x1, wx = at(i % to_w, w, to_w)
        row = lambda y: block[y * w + x0] * (1 - wx) + block[y * w + x1] * wx
        return row(y0) * (1 - wy) + row(y1) * wy

    return F.transform(F.sequence(F.lit(0), F.lit(to_h * to_w - 1)), value)


def photometric(block: Column, kind: Column, amount: Column, order: tuple[int, ...] = (2, 0, 1)) -> Column:
    """Levels 0 to 255 after one change of KINDS, else as they are.

    invert: 255 - v; brightness: v + amount; contrast: amount per cent of the distance to 128, rounded down; channel_shift: of each three
    values the first one up and the last one down by amount; channel_shuffle: each three values in the given order, a rest stays.
    """
    clip = lambda x: F.least(F.lit(255), F.greatest(F.lit(0), x)).cast("int")
    whole = F.floor(F.size(block) / 3) * 3

    def moved(i: Column) -> Column:
        from_place = F.array(*map(F.lit, order))[(i % 3).cast("int")]
        return F.when(i < whole, block[(i - i % 3 + from_place).cast("int")]).otherwise(block[i])

    return (
        F.when(kind == "invert", F.transform(block, lambda v: clip(255 - v)))
        .when(kind == "brightness", F.transform(block, lambda v: clip(v + amount)))
        .when(kind == "contrast", F.transform(block, lambda v: clip(F.floor((v - 128) * amount / 100) + 128)))
        .when(kind == "channel_shift", F.transform(block, lambda v, i: clip(v + amount * (1 - i % 3))))
        .when(kind == "channel_shuffle", F.transform(block, lambda v, i: clip(moved(i))))
        .otherwise(block)
    )


def difference(before: Column, after: Column) -> tuple[Column, Column]:
    """Share of values that differ, and the root of the mean squared difference."""
    n = F.size(before)
    d = F.zip_with(before, after, lambda x, y: (x - y).cast("double"))
    return F.size(F.filter(d, lambda x: x != 0)) / n, F.sqrt(total(F.transform(d, lambda x: x * x)) / n)


def accepted(before: Column, after: Column, least_rms: float, least_share: float = 0.05) -> Column:
    """Whether a change is visible: enough values differ, and by enough."""
    share, rms = difference(before, after)
    return (share >= least_share) & (rms >= least_rms)


def self_similarity(features: Column, channels: int) -> Column:
    """Cosines of all pairs of one map's positions, scaled to 0 to 1, row by row; a position of length zero has cosine 0 with all."""

    def volume(u: Column) -> Column:
        dot = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
        return F.flatten(F.transform(u, lambda a: F.transform(u, lambda b: (dot(a, b) + 1) / 2)))

    def unit(v: Column) -> Column:
        return bound(F.sqrt(total(F.transform(v, lambda x: x * x))), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    return bound(F.transform(positions(features, channels), unit), volume)


def positions(features: Column, channels: int) -> Column:
    """One array of channels for each position."""
    n = F.floor(F.size(features) / channels).cast("int")
    doubles = F.transform(features, lambda x: x.cast("double"))
    return bound(doubles, lambda d: F.transform(F.sequence(F.lit(0), n - 1), lambda p: F.slice(d, p * channels + 1, channels)))


def pools(features: Column, channels: int) -> Column:
    """Each channel's mean over all positions, then each channel's maximum."""
    channel = lambda p, c: F.transform(p, lambda v: v[c])
    every = F.sequence(F.lit(0), F.lit(channels - 1))
    return bound(
        positions(features, channels),
        lambda p: F.concat(F.transform(every, lambda c: total(channel(p, c)) / F.size(p)), F.transform(every, lambda c: F.array_max(channel(p, c)))),
    )
