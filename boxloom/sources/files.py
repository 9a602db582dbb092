"""Readers and writers: images, OCR JSON, box tables, shards, group chunks, resumption maps, samples, configurations, quantisation tables."""

from __future__ import annotations

import ast
import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import uniform
from .rasters import write_files

#: Schema of a box table; never inferred, and texts are read as they are.
BOXES = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("filename", T.StringType()),
    *(T.StructField(c, T.IntegerType()) for c in ("W_d", "W_g", "H_h", "H_b", "Width", "Height")), T.StructField("ratio", T.DoubleType()),
    T.StructField("fg_color", T.StringType()), T.StructField("bg_color", T.StringType()), T.StructField("len_text", T.IntegerType()),
])
_SIDES = ("W_d", "W_g", "H_b", "H_h")
#: Of one OCR entry: a word or character and its box.
ENTRY = T.StructType([T.StructField("Word", T.StringType()), T.StructField("BoundingBox", T.StructType([T.StructField(c, T.IntegerType()) for c in _SIDES]))])


def images(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "tiff"), recursive: bool = True, any_case: bool = True) -> DataFrame:
    """path, length, modificationTime and content of image files; the content is read only where it is used."""
    suffix = F.regexp_extract("path", r"\.([^./]+)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.where((F.lower(suffix) if any_case else suffix).isin(*suffixes))


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "tiff", "webp")) -> DataFrame:
    """Image files of one folder, or the file itself, in order of path."""
    return images(spark, path, suffixes, recursive=False).orderBy("path")


def csv_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, stem and length of the CSV files of one folder, not of folders in it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("stem"), "length")


def ocr_entries(spark: SparkSession, path: str) -> DataFrame:
    """filename, position and box of the entries of OCR JSON files, one array a file; broken files give none."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("filename"), F.from_json("value", T.ArrayType(ENTRY)).alias("e"))
    e = raw.select("filename", F.posexplode("e").alias("position", "e"))
    return e.select("filename", "position", F.col("e.Word").alias("text"), *(F.col(f"e.BoundingBox.{c}").alias(c) for c in _SIDES))


def entries_json(boxes: DataFrame, order: str = "box_id", pretty: bool = False) -> DataFrame:
    """filename and the JSON array of its boxes in order. A document's boxes are one row."""
    entry = F.struct(F.col("text").alias("Word"), F.struct(*_SIDES).alias("BoundingBox"))
    rows = boxes.groupBy("filename").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))).alias("r"))
    return rows.select("filename", F.to_json(F.transform("r", lambda x: x["e"]), {"pretty": str(pretty).lower()}).alias("value"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Box tables of CSV files with a header and texts as they are; colours are arrays; what can't be read is null."""
    csv = spark.read.schema(BOXES).option("header", True).option("mode", "PERMISSIVE").option("nullValue", "\u0000").option("escape", '"').option("multiLine", True).csv(path)
    return csv.withColumns({c: F.from_json(c, "array<int>") for c in ("fg_color", "bg_color")})


def write_boxes(boxes: DataFrame, path: str, mode: str = "error") -> None:
    colours = {c: F.to_json(c) for c in ("fg_color", "bg_color")}
    boxes.withColumns(colours).select(*BOXES.names).write.mode(mode).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').csv(path)


def write_entries(boxes: DataFrame, root: str) -> int:
    """A JSON file stem.json for each document: its entries in order, indented, UTF-8."""
    rows = entries_json(boxes, pretty=True)
    return write_files(rows.select(F.concat(_stem("filename"), F.lit(".json")).alias("path"), F.col("value").alias("content")), root)


def _stem(filename: str) -> Column:
    return F.regexp_replace(F.regexp_extract(filename, r"([^/]*)$", 1), r"\.[^.]*$", "")


def write_box_files(boxes: DataFrame, root: str, overwrite: bool = False) -> int:
    """A CSV file stem.csv for each image with a box; one that is there stays, unless overwritten. An image's boxes are one row."""
    colours = {c: F.to_json(c) for c in ("fg_color", "bg_color")}
    options = {"escape": '"', "nullValue": "\u0000", "emptyValue": ""}
    line = F.to_csv(F.struct(*BOXES.names), options)
    rows = boxes.withColumns(colours).select("filename", F.struct("box_id", line.alias("line")).alias("l")).groupBy("filename").agg(F.array_sort(F.collect_list("l")).alias("l"))
    text = F.concat(F.lit(",".join(BOXES.names) + "\n"), F.array_join("l.line", "\n"), F.lit("\n"))
    return write_files(rows.select(F.concat(_stem("filename"), F.lit(".csv")).alias("path"), text.alias("content")), root, overwrite=overwrite)


def read_box_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The boxes of all CSV files, one below the other, with the file each is from; and the files that aren't box tables, which give no rows.

    A file is none if its header is another one or a row of it has no text or box. A warning tells how many there are and names some.
    """
    head = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), "value")
    wrong = head.groupBy("file").agg(F.count(F.when(F.col("value") == ",".join(BOXES.names), 1)).alias("n")).where("n <> 1").select("file")
    rows = read_boxes(spark, path).withColumn("file", F.col("_metadata.file_path"))
    broken = rows.where(" OR ".join(f"{c} IS NULL" for c in ("filename", *_SIDES))).select("file")
    bad = wrong.unionByName(broken).distinct()
    some = [r[0] for r in bad.limit(6).collect()]
    if some:
        warnings.warn(f"{bad.count()} files are no box tables: {', '.join(x.rpartition('/')[2] for x in some[:5])}", stacklevel=2)
    return rows.join(bad, "file", "left_anti"), bad


def write_shards(sharded: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet, a folder for each shard. Rows are dealt out by shard and place first, so that a task writes one or two shards and a shard has several tasks."""
    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [c for c in ("shard", "at") if c in sharded.columns]
    sharded.repartitionByRange(parts, *by).write.mode(mode).partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """One shard's rows; other folders aren't listed for reading."""
    return spark.read.parquet(path).where(F.col("shard") == shard).drop("shard")


def write_groups(chunked: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet by text length, so that a lookup reads one folder, sorted by size within it, so that it skips row groups."""
    parts = int(chunked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = chunked.repartitionByRange(parts, "len_text", "Width", "Height").sortWithinPartitions("len_text", "Width", "Height")
    dealt.write.mode(mode).partitionBy("len_text").parquet(path)


def read_group(spark: SparkSession, path: str, len_text: int, width: int, height: int) -> DataFrame:
    """A group's rows; the folder is pruned, the sizes are pushed down to the files."""
    return spark.read.parquet(path).where((F.col("len_text") == len_text) & (F.col("Width") == width) & (F.col("Height") == height))


def picked(grouped: DataFrame, keys: list[str], chunk: str = "chunk", salt: str = "pick") -> DataFrame:
    """Of each group the rows of one chunk, drawn by hash of the group's keys."""
    n = grouped.groupBy(*keys).agg((F.max(chunk) + 1).alias("n_chunks"))
    key = F.concat_ws(":", *(F.col(k).cast("string") for k in keys))
    draw = n.select(*keys, F.floor(uniform(key, salt) * F.col("n_chunks")).cast("int").alias(chunk))
    return grouped.join(draw, [*keys, chunk])


def write_samples(samples: DataFrame, path: str, crops: str = "crops", mode: str = "error") -> None:
    """Samples of more than one crop, as Parquet."""
    samples.where(F.size(crops) > 1).write.mode(mode).parquet(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """All samples; files that are broken are passed over."""
    return spark.read.option("ignoreCorruptFiles", True).parquet(path)


def read_config(spark: SparkSession, path: str, defaults: dict | None = None, overrides: dict[str, str] | None = None) -> dict:
    """A configuration file: lines "key: value", "- item" lists and one level of nested "key: value"; then defaults for what is missing, and overrides.

    Values are numbers, true, false, null, quoted or plain strings, or bracketed lists. Overrides are texts, as environments give them,
    read as values where they are literals.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    out: dict = {}
    parent = None
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        body = line.strip()
        if body.startswith("- ") and parent is not None:
            out[parent] = [*(out[parent] or []), _value(body[2:])]
            continue
        key, _, value = body.partition(":")
        key = str(_value(key))
        if line[0] in " \t" and parent is not None:
            out[parent] = {**(out[parent] or {}), key: _value(value)}
        else:
            out[key], parent = _value(value), key
    return {**(defaults or {}), **out, **{k: _value(v) for k, v in (overrides or {}).items()}}


def _value(text: str):
    text = text.strip()
    known = {"": None, "null": None, "~": None, "true": True, "false": False}
    if text.lower() in known:
        return known[text.lower()]
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def write_resume_map(resumed: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines of items and how many are left, in order of item."""
    resumed.where("left > 0").select("item", "left").orderBy("item").write.mode(mode).json(path)


def read_resume_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("item long, left int").json(path)


def of_split(path: Column, split: str) -> Column:
    """A training path as that of another split: every "train" in it becomes "test"."""
    return path if split == "train" else F.replace(path, F.lit("train"), F.lit("test"))


def pairs(spark: SparkSession, images_path: str, masks_path: str, fallback: tuple[str, str] = ("jpg", "png"), once: bool = False) -> DataFrame:
    """image and mask paths by name; a mask may have the second suffix where the image has the first.

    Which it is is decided for each image, or (once) for all of them by whether the first image in order of name has a mask of its own name.
    Images without a mask are left out.
    """
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    i = images(spark, images_path).select(F.col("path").alias("image"), name("path").alias("name"))
    m = images(spark, masks_path).select(F.col("path").alias("mask"), name("path").alias("mask_name"))
    other = F.regexp_replace("name", rf"\.{fallback[0]}$", f".{fallback[1]}")
    exact = i.join(m, F.col("name") == F.col("mask_name"))
    if once:
        first = i.agg(F.min("name").alias("name"))
        changed = first.join(m, F.col("name") == F.col("mask_name"), "left_anti").count() > 0
        return (i.join(m, other == F.col("mask_name")) if changed else exact).select("name", "image", "mask")
    rest = i.join(m.select("mask_name"), F.col("name") == F.col("mask_name"), "left_anti").join(m, other == F.col("mask_name"))
    return exact.unionByName(rest).select("name", "image", "mask")


def quantisation_table(content: Column) -> Column:
    """64 steps, in zigzag order, of a JPEG's first table of 8-bit steps; all 1 where there is none."""
    text = F.hex(content)
    found = F.regexp_extract(text, r"^(?:..)*?FFDB0043(0.)((?:..){64})", 2)
    steps = F.transform(F.regexp_extract_all(found, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.when(F.length(found) == 128, steps).otherwise(F.array_repeat(F.lit(1), 64))
