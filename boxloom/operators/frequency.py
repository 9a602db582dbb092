"""8 x 8 blocks: cosine transform, zigzag, quantisation, wavelets, filters; pixels as rows or arrays of 64."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bound

#: The luminance table of the JPEG standard, row by row: fixed values.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def basis() -> list[list[float]]:
    """64 x 64: row k = 8 u + v, column n = 8 y + x of the orthonormal two-dimensional cosine transform."""
    c = [[(math.sqrt(1 / 8) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    return [[c[k // 8][n // 8] * c[k % 8][n % 8] for n in range(64)] for k in range(64)]


def zigzag() -> list[int]:
    """Places 8 y + x in the order of rising y + x, turning at each diagonal."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return [8 * y + x for y, x in sorted(cells, key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))]


def _projection(matrix: np.ndarray, before: float, after: float):
    """Arrow batches of blocks by one matrix product each: some hundred times as fast as a lambda for each of 4,096 products."""

    def run(blocks: pd.Series) -> pd.Series:
        if not len(blocks):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(blocks.to_numpy()).astype(float) - before) @ matrix + after))

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))


def dct(block: Column, shift: float = 0.0) -> Column:
    """64 coefficients of an array of 64 values, less shift. Null blocks must be dropped before."""
    return _projection(np.array(basis()).T, shift, 0.0)(block)


def inverse_dct(coefficients: Column, shift: float = 0.0) -> Column:
    return _projection(np.array(basis()), 0.0, shift)(coefficients)


def in_zigzag(block: Column) -> Column:
    return F.transform(F.array(*map(F.lit, zigzag())), lambda i: block[i])


def quality_table(quality: Column) -> Column:
    """The luminance table at a quality of 1 to 100, at least 1 and without an upper bound."""
    q = F.least(F.lit(100), F.greatest(F.lit(1), quality)).cast("int")
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q)
    return F.transform(F.array(*map(F.lit, LUMINANCE)), lambda v: F.greatest(F.lit(1), F.floor((v * scale + 50) / 100)).cast("int"))


def quantise(coefficients: Column, table: Column, most: int = 20) -> Column:
    """Size of each coefficient in steps of the table, half to even, at most most."""
    return F.transform(F.zip_with(coefficients, table, lambda c, q: F.abs(F.rint(c / q))), lambda x: F.least(F.lit(float(most)), x).cast("int"))


def volume(levels: Column, top: int = 20) -> Column:
    """One-hot channels 0 to top, as counts of the block's levels."""
    return bound(levels, lambda a: F.transform(F.sequence(F.lit(0), F.lit(top)), lambda t: F.size(F.filter(a, lambda v: v == t))))


def haar(block: Column) -> dict[str, Column]:
    """Four 4 x 4 bands of an 8 x 8 block."""
    places = F.sequence(F.lit(0), F.lit(15))
    at = lambda i, dy, dx: block[(F.floor(i / 4) * 2 + dy).cast("int") * 8 + (i % 4) * 2 + dx].cast("double")
    make = lambda s: F.transform(places, lambda i: (at(i, 0, 0) + s[0] * at(i, 0, 1) + s[1] * at(i, 1, 0) + s[2] * at(i, 1, 1)) / 2)
    return {"ll": make((1, 1, 1)), "lh": make((-1, 1, -1)), "hl": make((1, -1, -1)), "hh": make((-1, -1, 1))}


def pixels(df: DataFrame, key: str, block: str, width: int = 8) -> DataFrame:
    """key, y, x, v of each value of an array laid out row by row."""
    p = df.select(key, F.posexplode(block).alias("i", "v"))
    return p.select(key, F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def box_filter(p: DataFrame, key: str, r: int) -> DataFrame:
    """Mean over the square of radius r around each pixel, within the image: two windows, one for each axis."""
    across = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-r, r)
    down = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-r, r)
    p = p.withColumns({"s": F.sum("v").over(across), "n": F.count(F.lit(1)).over(across)})
    return p.withColumns({"s": F.sum("s").over(down), "n": F.sum("n").over(down)}).select(key, "y", "x", (F.col("s") / F.col("n")).alias("v"))


#: Weights of two residual filters by row and column offset, and their divisors: fixed values.
RESIDUAL = {
    "second": ({(0, -1): 1, (0, 0): -2, (0, 1): 1}, 2),
    "square": ({(-1, -1): -1, (-1, 0): 2, (-1, 1): -1, (0, -1): 2, (0, 0): -4, (0, 1): 2, (1, -1): -1, (1, 0): 2, (1, 1): -1}, 4),
}


def residual(p: DataFrame, key: str, name: str, most: float = 3.0) -> DataFrame:
    """A filter's sum over its offsets (pixels outside count 0), between -most and most."""
    weights, by = RESIDUAL[name]
    moved = F.explode(F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(w / by).alias("w")) for (dy, dx), w in weights.items())))
    size = p.agg(F.max("y"), F.max("x")).first()
    spread = p.select(key, "y", "x", "v", moved.alias("o")).select(key, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), (F.col("v") * F.col("o.w")).alias("v"))
    spread = spread.where((F.col("y").between(0, size[0])) & (F.col("x").between(0, size[1])))
    return spread.groupBy(key, "y", "x").agg(F.least(F.lit(most), F.greatest(F.lit(-most), F.sum("v"))).alias("v"))


def otsu(p: DataFrame, key: str) -> DataFrame:
    """Level 0 to 255 of each image that divides its levels with the largest variance between the two classes; the lowest of equal ones."""
    h = p.groupBy(key, F.col("v").cast("int").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    run = w.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("n") * F.col("t")
    h = h.withColumns({"w0": F.sum("n").over(run), "s0": F.sum(s).over(run), "w": F.sum("n").over(w), "s": F.sum(s).over(w)})
    w1, s1 = F.col("w") - F.col("w0"), F.col("s") - F.col("s0")
    d = F.col("s0") / F.col("w0") - s1 / F.nullif(w1, F.lit(0))
    between = F.round(F.coalesce(F.col("w0") * w1 * d * d, F.lit(0.0)), 3)
    return h.withColumn("b", between).groupBy(key).agg(F.max_by("t", F.struct("b", -F.col("t"))).alias("threshold"))


def tiles(sizes: DataFrame, window: int, h: str = "h", w: str = "w") -> DataFrame:
    """top and left of tiles of window that cover each image: side by side, the last one moved inside."""
    starts = lambda c: F.transform(F.expr(f"sequence(0, greatest({c} - 1, 0), {window})"), lambda t: F.when(F.col(c) - t < window, F.greatest(F.col(c) - window, F.lit(0))).otherwise(t))
    return sizes.withColumn("top", F.explode(starts(h))).withColumn("left", F.explode(starts(w)))


def sliding(sizes: DataFrame, crop: int, stride: int, h: str = "h", w: str = "w") -> DataFrame:
    """As tiles, but stride apart."""
    starts = lambda c: F.array_distinct(F.transform(F.expr(f"sequence(0, cast(greatest({c} - {crop} + {stride - 1}, 0) div {stride} as int))"), lambda i: F.greatest(F.least(i * stride, F.col(c) - crop), F.lit(0))))
    return sizes.withColumn("top", F.explode(starts(h))).withColumn("left", F.explode(starts(w)))


def merged(tile_pixels: DataFrame, key: list[str]) -> DataFrame:
    """Pixels of overlapping tiles: mean, maximum and how many."""
    return tile_pixels.groupBy(*key, "y", "x").agg(F.avg("v").alias("mean"), F.max("v").alias("max"), F.count(F.lit(1)).alias("n"))


def soft_encoding(df: DataFrame, vector: str, codewords: list[list[float]], scale: float = 1.0) -> Column:
    """Softmax over codewords of the scaled squared distance."""
    far = F.array(*(F.aggregate(F.zip_with(vector, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for c in codewords))
    raised = bound(far, lambda f: bound(F.array_min(f), lambda least: F.transform(f, lambda d: F.exp(-scale * (d - least)))))
    return bound(raised, lambda e: bound(F.aggregate(e, F.lit(0.0), lambda s, y: s + y), lambda total: F.transform(e, lambda x: x / total)))


def parameter_rows(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations of the parameters' values: a small grid."""
    out = spark.range(1).select()
    for name, v in values.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, v))).alias(name))
    return out
