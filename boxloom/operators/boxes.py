"""Projections and filters of box tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.scalars import half_even


def flatten_annotation(annotations: DataFrame, key: str = "filename", pages: str = "pages") -> DataFrame:
    """Words and characters (kind) of nested pages, blocks, paragraphs, words and symbols, with the box of each one's vertices.

    A word's text is that of its symbols joined; boxes without extent are dropped; a missing x or y is 0.
    """
    p = annotations.select(key, F.posexplode(pages).alias("p", "page"))
    p = p.select(key, "p", F.posexplode("page.blocks").alias("b", "block"))
    p = p.select(key, "p", "b", F.posexplode("block.paragraphs").alias("g", "paragraph"))
    p = p.select(key, "p", "b", "g", F.posexplode("paragraph.words").alias("w", "word"))
    words = p.select(key, F.lit("word").alias("kind"), F.array_join(F.transform("word.symbols", lambda s: s["text"]), "").alias("text"), F.col("word.vertices").alias("vertices"))
    chars = p.select(key, F.explode("word.symbols").alias("s")).select(key, F.lit("char").alias("kind"), F.col("s.text").alias("text"), F.col("s.vertices").alias("vertices"))
    return bounding_box(words.unionByName(chars))


def bounding_box(df: DataFrame, vertices: str = "vertices") -> DataFrame:
    """W_d, W_g, H_b, H_h of an array of struct<x,y>; rows of no extent are dropped."""
    x, y = F.transform(vertices, lambda v: F.coalesce(v["x"], F.lit(0))), F.transform(vertices, lambda v: F.coalesce(v["y"], F.lit(0)))
    out = df.withColumns({"W_d": F.array_min(x), "W_g": F.array_max(x), "H_b": F.array_min(y), "H_h": F.array_max(y)}).drop(vertices)
    return positive(out)


def parse_char_boxes(df: DataFrame, line: str = "line", height: str = "height") -> DataFrame:
    """Text lines "char x1 y1 x2 y2 page" with the origin at the bottom left; lines of fewer fields or without whole numbers are dropped."""
    whole = lambda p, i: F.get(p, F.lit(i)).try_cast("int")
    # a generator, which no filter is pushed through: a line is split once, not once for each use of a field
    fields = F.transform(F.array(F.split(line, " ")), lambda p: F.when(F.size(p) >= 5, F.struct(p[0].alias("text"), *(whole(p, i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"), 1)))))
    kept = [c for c in df.columns if c not in ("text", "x1", "y1", "x2", "y2")]
    out = df.select(*kept, F.inline(fields)).dropna(subset=["x1", "y1", "x2", "y2"])
    return out.withColumns({
        "W_d": F.greatest(F.lit(0), "x1"), "W_g": F.greatest(F.lit(0), "x2"),
        "H_b": F.greatest(F.lit(0), F.col(height) - F.col("y2")), "H_h": F.greatest(F.lit(0), F.col(height) - F.col("y1")),
    }).drop("x1", "y1", "x2", "y2").where("trim(text) <> '' AND W_g > W_d AND H_h > H_b")


#: Fields of a row of an OCR engine's word table, tab-separated.
WORD_ROW = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def parse_word_rows(df: DataFrame, line: str = "line") -> DataFrame:
    """Words of tab-separated rows, corner at the top left: text without outer space and box, cut at 0; rows without text, extent or whole numbers are dropped."""
    field = lambda name: F.get(F.split(line, "\t"), F.lit(WORD_ROW.index(name)))
    number = lambda name: field(name).try_cast("int")
    rows = df.withColumns({"text": F.regexp_replace(field("text"), r"^\s+|\s+$", ""), "x": number("left"), "y": number("top"), "w": number("width"), "h": number("height")})
    some = rows.where("text <> '' AND x IS NOT NULL AND y IS NOT NULL AND w > 0 AND h > 0")
    edge = lambda v: F.greatest(F.lit(0), v)
    sides = {"W_d": edge(F.col("x")), "W_g": edge(F.col("x") + F.col("w")), "H_b": edge(F.col("y")), "H_h": edge(F.col("y") + F.col("h"))}
    return some.withColumns(sides).drop("x", "y", "w", "h")


def positive(df: DataFrame) -> DataFrame:
    return df.where("H_b < H_h AND W_d < W_g")


def pad(df: DataFrame, by: int = 1, w: str = "page_w", h: str = "page_h") -> DataFrame:
    """Boxes grown on all sides, within the image."""
    return df.withColumns({
        "W_d": F.greatest(F.lit(0), F.col("W_d") - by), "W_g": F.least(F.col(w), F.col("W_g") + by),
        "H_b": F.greatest(F.lit(0), F.col("H_b") - by), "H_h": F.least(F.col(h), F.col("H_h") + by),
    })


def derive(df: DataFrame) -> DataFrame:
    return df.withColumns({"Width": F.col("W_g") - F.col("W_d"), "Height": F.col("H_h") - F.col("H_b"), "len_text": F.length("text")}).withColumn(
        "ratio", half_even(F.col("Height") / F.col("Width"))
    )


def expand_datasets(df: DataFrame, datasets: list[str], by: int = 1) -> DataFrame:
    """Boxes of the given datasets grown on all sides, not clipped."""
    some = F.col("dataset").isin(datasets)
    return df.withColumns({c: F.when(some, F.col(c) + s * by).otherwise(F.col(c)) for c, s in (("W_d", -1), ("W_g", 1), ("H_b", -1), ("H_h", 1))})


def jitter(df: DataFrame, p: float = 0.1) -> DataFrame:
    """With probability p a document's boxes move: each column by one draw of 1, 0 or -1 for the whole document."""
    moved = uniform("filename", "jitter") < p
    step = lambda c: F.floor(uniform("filename", f"jitter-{c}") * 3).cast("int") - 1
    return df.withColumns({c: F.when(moved, F.col(c) + step(c)).otherwise(F.col(c)) for c in ("W_d", "W_g", "H_b", "H_h")})


def clamp(df: DataFrame, w: str = "page_w", h: str = "page_h", least: int = 2) -> DataFrame:
    """Boxes moved into the image; those left with a side under least are dropped; Width, Height and the unrounded ratio are new."""
    out = df.withColumns({
        "W_d": F.greatest(F.lit(0), F.least("W_d", F.col(w) - 1)), "W_g": F.greatest(F.lit(0), F.least("W_g", F.col(w))),
        "H_b": F.greatest(F.lit(0), F.least("H_b", F.col(h) - 1)), "H_h": F.greatest(F.lit(0), F.least("H_h", F.col(h))),
    })
    out = out.withColumns({"Width": F.col("W_g") - F.col("W_d"), "Height": F.col("H_h") - F.col("H_b")}).where((F.col("Width") >= least) & (F.col("Height") >= least))
    return out.withColumn("ratio", F.col("Height") / F.col("Width"))


def inside(df: DataFrame, w: str = "page_w", h: str = "page_h") -> DataFrame:
    return df.where((F.col("W_d") >= 0) & (F.col("H_b") >= 0) & (F.col("W_g") <= F.col(w)) & (F.col("H_h") <= F.col(h)))


def thin(df: DataFrame, p: float = 0.25, most: int = 500) -> DataFrame:
    """With probability p a document of more than most words loses its single characters."""
    counts = df.groupBy("filename").agg(F.sum(F.when(F.col("len_text") > 1, 1).otherwise(0)).alias("n_words"))
    chosen = counts.where((F.col("n_words") > most) & (uniform("filename", "thin") < p)).select("filename", F.lit(True).alias("thinned"))
    return df.join(chosen, "filename", "left").where("thinned IS NULL OR len_text > 1").drop("thinned")
