"""Queries that write files to the shared folder and read them again, and slots for what the library doesn't have."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.durable import durable, remove, shared_folder
from ..operators import frequency, groups, pages, planning, raster, workflow
from ..sources import files, lots, rasters
from ..sources.bridges import LAYOUT, boxes, table
from .base import query
from .box_queries import U
from .work_queries import RESUMED, resumed
from .pixel_queries import BLOCK, PIXELS, blocks


class Folder:
    """A folder of its own in the shared one, for one query; it goes once the query's rows are checkpointed."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_) -> None:
        remove(self.spark, self.path)


EXTENSIONS = ("png", "JPG", "jpeg", "bmp", "tiff", "webp", "PNG", "txt", "jpg")
NAMES = f"""
WITH e AS (SELECT page_id, ['{"', '".join(EXTENSIONS)}'][page_id % 9 + 1] AS ext, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'deep' || page_id % 4 || '/' END AS folder FROM pages),
f AS (SELECT folder || 'img' || page_id || '.' || ext AS name, ext, folder FROM e)
"""


@query("a1_a2_a3_scans_s3_names", NAMES + """
, l AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS place FROM f WHERE folder = '' AND lower(ext) IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff', 'webp'))
SELECT f.name, lower(ext) IN ('png', 'jpg', 'jpeg', 'bmp', 'tiff') AS recursive, ext IN ('jpeg', 'png', 'jpg') AS exact, l.place FROM f LEFT JOIN l USING (name)""")
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each page; every scan of them, and each name's place in the sorted list of one folder."""
    p = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("page_id") % 9 + 1).cast("int")).alias("ext"))
    folder = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.concat(F.lit("deep"), (F.col("page_id") % 4).cast("string"), F.lit("/")))
    made = p.select(F.concat(folder, F.lit("img"), F.col("page_id").cast("string"), F.lit("."), "ext").alias("name"))
    with Folder(spark) as root:
        rasters.write_files(made.withColumn("content", F.lit("x")), root, "name")
        name = F.regexp_extract("path", rf"/{root.rpartition('/')[2]}/(.*)$", 1).alias("name")
        found = lambda df, flag: df.select(name, F.lit(True).alias(flag))
        a, b = found(files.images(spark, root), "recursive"), found(files.images(spark, root, ("jpeg", "png", "jpg"), any_case=False), "exact")
        c = groups.ranked(files.listed(spark, root).select(name).distinct(), [], ["name"]).select("name", F.col("at").alias("place"))
        joined = made.join(a, "name", "left").join(b, "name", "left").join(c, "name", "left")
        return durable(joined.select("name", F.coalesce("recursive", F.lit(False)).alias("recursive"), F.coalesce("exact", F.lit(False)).alias("exact"), "place"))


@query("a4_a5_a6_a7_a10_box_csv", LAYOUT + """
, g AS (SELECT filename, count(*) AS n, CAST(sum(W_d) AS BIGINT) AS sum_left, round(sum(ratio), 2) AS ratios, max(text) AS last_text, CAST(sum(fg_color[2]) AS BIGINT) AS fg FROM boxes GROUP BY filename)
SELECT CAST(d.doc_id AS VARCHAR) AS filename, d.doc_id % 10 = 0 AS bad, CASE WHEN d.doc_id % 10 <> 0 THEN n ELSE 0 END AS n, CASE WHEN d.doc_id % 10 <> 0 THEN sum_left END AS sum_left, CASE WHEN d.doc_id % 10 <> 0 THEN ratios END AS ratios,
  CASE WHEN d.doc_id % 10 <> 0 THEN last_text END AS last_text, CASE WHEN d.doc_id % 10 <> 0 THEN fg END AS fg FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN g ON g.filename = CAST(d.doc_id AS VARCHAR) WHERE d.doc_id % 10 = 0 OR n > 0""")
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file for each document's boxes, where every tenth document has a file already, which is no box table: it stays and gives no rows.

    A lot of documents at a time: its files are written, then those of its folder are listed and read, and the folder goes.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    with Folder(spark) as root:
        return durable(pages.in_lots(docs, box_files(root), BOX_FILES).withColumn("ratios", F.round("ratios", 2)))


BOX_FILES = "filename string, bad boolean, n long, sum_left long, ratios double, last_text string, fg long"


def box_files(root: str) -> Callable[[list[str], list[list[str]]], pa.RecordBatch]:
    """Of some documents, whose files lie in a folder of their own below root, what the files read again hold."""

    def run(names: list[str], texts: list[list[str]]) -> pa.RecordBatch:
        with lots.Shelf(root) as shelf:
            shelf.write((f"{lots.stem(f)}.csv", b"no,box\n1,2\n") for f in names if int(f) % 10 == 0)
            shelf.write(lots.csv_files(names, *pages.with_words(texts)), overwrite=False)
            stems, contents = shelf.read(".csv")
        rows, _, bad = lots.read_csv_files(contents)
        sums = [("text", "count", pc.CountOptions(mode="all")), ("W_d", "sum"), ("ratio", "sum"), ("text", "max"), ("fg", "sum")]
        g = rows.append_column("fg", lots.channels(rows["fg_color"])[1]).group_by("filename", use_threads=False).aggregate(sums)
        own = g.take(pc.index_in(pa.array(stems, pa.string()), value_set=g["filename"].combine_chunks()))
        columns = [stems, bad, pc.fill_null(own["text_count"], 0), *(own[c] for c in ("W_d_sum", "ratio_sum", "text_max", "fg_sum"))]
        kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64())
        arrays = [(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c, k)).cast(k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BOX_FILES.split(", ")])

    return run


@query("a8_a9_ocr_json", LAYOUT + "SELECT filename, count(*) AS n, md5(string_agg(text, ' ' ORDER BY box_id)) AS texts, CAST(sum(W_g) AS BIGINT) AS sum_right, CAST(sum(H_b) AS BIGINT) AS sum_top FROM boxes GROUP BY filename")
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file of entries for each document, read again. A lot of documents at a time: its files are written, then those of its folder are listed and read, and the folder goes."""
    with Folder(spark) as root:
        return durable(pages.in_lots(table(spark, sf_dir, "documents"), entry_files(root), ENTRY_FILES))


ENTRY_FILES = "filename string, n long, texts string, sum_right long, sum_top long"


def entry_files(root: str) -> Callable[[list[str | None], list[list[str]]], pa.RecordBatch]:
    """Of some documents, whose files lie in a folder of their own below root, what the files read again hold. A file of no stem is that of the documents without a name."""

    def run(names: list[str | None], texts: list[list[str]]) -> pa.RecordBatch:
        with lots.Shelf(root) as shelf:
            shelf.write(lots.entry_files(names, *pages.with_words(texts)))
            stems, contents = shelf.read(".json")
        found = lots.read_entry_files(contents)
        keep = pc.greater(pc.fill_null(pc.list_value_length(found), 0), 0)
        stems, found = pa.array(stems, pa.string()).filter(keep), found.filter(keep)
        words, box = (pc.struct_field(found.flatten(), c) for c in ("Word", "BoundingBox"))
        file = pc.list_parent_indices(found)
        sums = pa.table([file, pc.struct_field(box, "W_g"), pc.struct_field(box, "H_b")], ["file", "W_g", "H_b"]).group_by("file", use_threads=False).aggregate([("W_g", "sum"), ("H_b", "sum")]).sort_by("file")
        some = pc.is_valid(words)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(file.filter(some).to_numpy(), minlength=len(found)))]).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(some)), " ")
        texts = [md5(x.as_buffer()).hexdigest() for x in joined]
        columns = [pc.if_else(pc.equal(stems, ""), pa.scalar(None, pa.string()), stems), pc.list_value_length(found).cast(pa.int64()), pa.array(texts, pa.string()), *(sums[c].combine_chunks().cast(pa.int64()) for c in ("W_g_sum", "H_b_sum"))]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ENTRY_FILES.split(", ")])

    return run


@query("a12_shard_scan", """
WITH r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, n_chars FROM r WHERE CASE WHEN pos < (n % 7) * (n // 7 + 1) THEN pos // (n // 7 + 1) ELSE n % 7 + (pos - (n % 7) * (n // 7 + 1)) // (n // 7) END = 3""")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth of seven shards, as written."""
    with Folder(spark) as root:
        files.write_shards(groups.array_split(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["doc_id"], 7), root)
        return durable(files.read_shard(spark, root, 3).select("doc_id", "n_chars"))


@query("a14_picked_chunks", LAYOUT + f"""
, c AS (SELECT *, row_number() OVER (PARTITION BY len_text, Width, Height ORDER BY filename, box_id) - 1 AS pos, count(*) OVER (PARTITION BY len_text, Width, Height) AS n FROM boxes),
k AS (SELECT *, CAST(least(pos // 100, greatest(CAST(ceil(n / 100.0::DOUBLE) AS BIGINT) - 2, 0)) AS INT) AS chunk FROM c),
g AS (SELECT len_text, Width, Height, CAST(floor({U("len_text || ':' || Width || ':' || Height", 'pick')} * (max(chunk) + 1)) AS INT) AS chunk FROM k GROUP BY 1, 2, 3)
SELECT len_text, Width, Height, chunk, count(*) AS n, min(filename) AS first, max(filename) AS last FROM k JOIN g USING (len_text, Width, Height, chunk) GROUP BY 1, 2, 3, 4""")
def a14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by shape in chunks of some 100 rows (of 2,000 hardly any group here has two), written and looked up, one chunk of each drawn."""
    with Folder(spark) as root:
        chunked = groups.chunks(boxes(spark, sf_dir).select("filename", "box_id", *groups.SHAPE), groups.SHAPE, ["filename", "box_id"], 100)
        files.write_groups(chunked, root)
        p = files.picked(spark.read.parquet(root), groups.SHAPE)
        return durable(p.groupBy(*groups.SHAPE, "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("filename").alias("first"), F.max("filename").alias("last")))


COLOURED = "CASE WHEN vec_id % 2 = 0 THEN v ELSE 255 - v END"


@query("a16_sinks_a17_grey_copies", PIXELS + f"""
, colours AS (SELECT vec_id, v, {COLOURED} AS g, (v * 19595 + (255 - v) * 38470 + v * 7471 + 32768) >> 16 AS l FROM p),
s AS (SELECT vec_id, CAST(sum(v + g + v) AS BIGINT) AS levels, CAST(sum(CASE WHEN v > 128 THEN 255 ELSE 0 END) AS BIGINT) AS mask, CAST(sum(l) AS BIGINT) AS grey, bool_or(v <> g) AS coloured FROM colours GROUP BY 1)
SELECT 'images/img' || label || '_' || vec_id || '.png' AS single, 'set' || label || '/img' || label || '_mask_' || vec_id || '.png' AS mask_path, levels, mask, CASE WHEN coloured THEN 'img' || label || '_' || vec_id || '_black.png' END AS black, CASE WHEN coloured THEN grey END AS grey
FROM s JOIN e USING (vec_id)""")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files of 8 x 8 rasters in both layouts, read again; grey copies of those of odd numbers, whose green is inverted."""
    idx, base = F.col("vec_id").cast("string"), F.concat(F.lit("img"), F.col("label").cast("string"))
    b = blocks(spark, sf_dir)
    colour = F.flatten(F.transform("b", lambda v: F.array(v, F.when(F.col("vec_id") % 2 == 0, v).otherwise(255 - v), v)))
    single, of_set = rasters.sample_names(base, idx), rasters.sample_names(base, idx, F.concat(F.lit("set"), F.col("label").cast("string")))
    made = b.select(
        rasters.png_of(colour, F.lit(8), F.lit(3)).alias("image"), rasters.png_of(F.transform("b", lambda v: F.when(v > 128, 255).otherwise(0)), F.lit(8), F.lit(1)).alias("mask"),
        F.struct(*(c.alias(k) for c, k in zip(single, ("image", "mask")))).alias("single"), F.struct(*(c.alias(k) for c, k in zip(of_set, ("image", "mask")))).alias("set"),
    )
    rows = made.select(F.inline(F.array(*(F.struct(F.col(f"{layout}.{k}").alias("path"), F.col(k).alias("content")) for layout in ("single", "set") for k in ("image", "mask")))))
    with Folder(spark) as root:
        rasters.write_files(rows, root)
        name = F.regexp_extract("path", rf"/{root.rpartition('/')[2]}/(.*)$", 1)
        read = durable(files.images(spark, root).select(name.alias("path"), rasters.decoded("content").alias("image")))
        levels = F.aggregate("image.pixels", F.lit(0), lambda s, x: s + x).cast("long")
        images = read.where("path LIKE 'images/%'").select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "image")
        copies = rasters.grey_copies(images)
        rasters.write_files(copies.select(F.concat(F.lit("grey/"), "copy").alias("path"), rasters.png_of("pixels", "width", F.lit(1)).alias("content")), root)
        grey = files.images(spark, f"{root}/grey").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("black"), rasters.decoded("content").alias("image")).select("black", levels.alias("grey"))
        masks = read.where("path LIKE 'set%mask%'").select(F.col("path").alias("mask_path"), levels.alias("mask"), F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), "_mask_", "_").alias("name"))
        out = images.select(F.col("path").alias("single"), "name", levels.alias("levels")).join(masks, "name").withColumn("black", F.regexp_replace("name", r"\.png$", "_black.png"))
        return durable(out.join(grey.withColumnRenamed("black", "b"), F.col("black") == F.col("b"), "left").select("single", "mask_path", "levels", "mask", F.col("b").alias("black"), "grey"))


@query("a19_samples", "SELECT conv_id, count(*) AS n FROM conversations WHERE turn % 3 <> 1 GROUP BY conv_id HAVING count(*) > 1")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation, but every third one, stand for a sample's crops; a broken file lies among the written ones."""
    s = table(spark, sf_dir, "conversations").where("turn % 3 <> 1").groupBy("conv_id").agg(F.collect_list("text").alias("crops"))
    with Folder(spark) as root:
        files.write_samples(s, root)
        rasters.write_files(spark.range(1).select(F.lit("part-broken.parquet").alias("path"), F.lit("PAR1 this is none").alias("content")), root)
        return durable(files.read_samples(spark, root).select("conv_id", F.size("crops").cast("long").alias("n")))


MASKED = """
WITH i AS (SELECT page_id, 'doc' || page_id || CASE WHEN page_id % 4 = 0 THEN '.png' ELSE '.jpg' END AS name FROM pages),
m AS (SELECT page_id, 'doc' || page_id || CASE WHEN page_id % 4 IN (0, 1) THEN '.png' ELSE '.jpg' END AS mask FROM pages WHERE page_id % 7 <> 3),
"""


@query("a20_a21_j16_mask_pairs", MASKED + """f AS (SELECT min(name) AS name FROM i), o AS (SELECT count(*) = 0 AS changed FROM f JOIN m ON f.name = m.mask),
e AS (SELECT i.name, a.mask FROM i JOIN m a ON a.page_id = i.page_id AND (a.mask = i.name OR a.mask = replace(i.name, '.jpg', '.png'))),
n AS (SELECT i.name, m.mask FROM i, o, m WHERE m.mask = CASE WHEN changed THEN replace(i.name, '.jpg', '.png') ELSE i.name END)
SELECT e.name, e.mask AS each, n.mask AS once FROM e LEFT JOIN n USING (name)""")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and masks of the test split, whose folders come from the training ones'; masks by each image's and by the first one's extension."""
    p = table(spark, sf_dir, "pages")
    name = lambda png: F.concat(F.lit("doc"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 4 <= png, ".png").otherwise(".jpg"))
    with Folder(spark) as root:
        folder = lambda kind: spark.range(1).select(files.of_split(F.lit(f"{kind}/train"), "test")).first()[0]
        for kind, rows in (("images", p.select(name(0).alias("n"))), ("masks", p.where("page_id % 7 <> 3").select(name(1).alias("n")))):
            rasters.write_files(rows.select(F.concat(F.lit(f"{folder(kind)}/"), "n").alias("path"), F.lit("x").alias("content")), root)
        paths = f"{root}/{folder('images')}", f"{root}/{folder('masks')}"
        last = F.regexp_extract("mask", r"([^/]+)$", 1)
        each, once = files.pairs(spark, *paths).select("name", last.alias("each")), files.pairs(spark, *paths, once=True).select("name", last.alias("once"))
        return durable(each.join(once, "name", "left"))


@query("a22_quantisation_tables", f"""
WITH q AS (SELECT CAST(unnest(range(0, 101)) AS INT) AS q), z AS (SELECT [{', '.join(map(str, frequency.zigzag()))}] AS z, [{', '.join(map(str, frequency.LUMINANCE))}] AS l),
s AS (SELECT q, CASE WHEN q < 50 THEN 5000 // greatest(q, 1) ELSE 200 - 2 * q END AS s FROM q), k AS (SELECT q, s, unnest(range(0, 64)) AS k FROM s)
SELECT 'q' || q || '.jpg' AS name, CAST(sum(CASE WHEN q = 0 THEN 1 ELSE least(255, greatest(1, (l[z[k + 1] + 1] * s + 50) // 100)) END * (k + 1)) AS BIGINT) AS weighted FROM k, z GROUP BY q""")
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the table of each quality, in zigzag order, behind a comment; the first has none, which counts as all ones."""
    steps = F.transform(frequency.in_zigzag(frequency.quality_table(F.col("id"))), lambda x: F.lpad(F.hex(F.least(F.lit(255), x)), 2, "0"))
    body = F.when(F.col("id") > 0, F.concat(F.lit("FFD8FFFE00040102FFDB004300"), F.array_join(steps, ""), F.lit("FFD9"))).otherwise("FFD8FFD9")
    made = spark.range(0, 101).select(F.concat(F.lit("q"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"), F.unhex(body).alias("content"))
    with Folder(spark) as root:
        rasters.write_files(made, root)
        t = files.images(spark, root).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.posexplode(files.quantisation_table(F.col("content"))).alias("k", "t"))
        return durable(t.groupBy("name").agg(F.sum(F.col("t") * (F.col("k") + 1)).cast("long").alias("weighted")))


CONFIG = """# made for the query
max_w: 1024
probability: 0.25   # a comment
datasets:
  scans: 0.5
  forms: 3
folders:
- /a/train
- "b c"
write_crops: false
name: 'plain'
"""


@query("a25_configuration", "SELECT * FROM (VALUES ('datasets', '{\"forms\": 3, \"scans\": 0.5}'), ('folders', '[\"x\"]'), ('max_w', '1024'), ('missing', '7'), ('name', '\"other\"'), ('probability', '0.25'), ('write_crops', 'false')) AS t(key, value)")
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration file with a default and two overrides."""
    import json

    with Folder(spark) as root:
        rasters.write_files(spark.range(1).select(F.lit("config.yaml").alias("path"), F.lit(CONFIG).alias("content")), root)
        c = files.read_config(spark, f"{root}/config.yaml", {"missing": 7, "max_w": 1}, {"name": "other", "folders": "['x']"})
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in c.items()], "key string, value string")


@query("a15_a23_backends", "SELECT doc_id, CAST(n AS INT) AS page, CAST(length(text) AS INT) AS n_chars FROM (SELECT doc_id, text, unnest([0, 1]) AS n FROM documents WHERE text IS NOT NULL)")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot for decoders and services: a backend that makes two pages of each text and tells their length."""

    def backend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.concat([pd.DataFrame({"doc_id": f["doc_id"], "page": np.int32(k), "n_chars": f["text"].str.len().astype("int32")}) for k in (0, 1)])

    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return rasters.with_backend(docs.select("doc_id", "text"), backend, "doc_id long, page int, n_chars int")


@query("a18_resume_map", RESUMED)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items with something left, written in order and read again."""
    with Folder(spark) as root:
        files.write_resume_map(resumed(spark, sf_dir), root)
        return durable(files.read_resume_map(spark, root).select("item", "left"))


CUT = PIXELS.replace("WITH", "WITH RECURSIVE", 1) + """
, box AS (SELECT vec_id, vec_id % 3 AS x1, vec_id % 3 + 5 AS x2, vec_id % 2 AS y1, vec_id % 2 + 4 AS y2 FROM e),
v AS (SELECT vec_id, 'page' AS part, x, y, v FROM p UNION ALL SELECT vec_id, 'crop', x - x1, y - y1, v FROM p JOIN box USING (vec_id) WHERE x >= x1 AND x < x2 AND y >= y1 AND y < y2),
h AS (SELECT vec_id, part, v AS t, count(*) AS n FROM v GROUP BY 1, 2, 3),
c AS (SELECT vec_id, part, t, sum(n) OVER o AS w0, sum(n * t) OVER o AS s0, sum(n) OVER (PARTITION BY vec_id, part) AS w, sum(n * t) OVER (PARTITION BY vec_id, part) AS s FROM h WINDOW o AS (PARTITION BY vec_id, part ORDER BY t ROWS UNBOUNDED PRECEDING)),
b AS (SELECT vec_id, part, t, round(coalesce(CAST(w0 AS DOUBLE) * (w - w0) * pow(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / nullif(w - w0, 0), 2), 0), 3) AS b FROM c),
otsu AS (SELECT vec_id, part, arg_max(t, (b, -t)) AS otsu FROM b GROUP BY 1, 2),
ink AS (SELECT vec_id, part, x, y, y * 8 + x AS pos FROM v JOIN otsu USING (vec_id, part) WHERE v <= otsu),
reach AS (SELECT vec_id, part, x, y, pos AS root FROM ink UNION SELECT i.vec_id, i.part, i.x, i.y, r.root FROM reach r JOIN ink i ON i.vec_id = r.vec_id AND i.part = r.part AND abs(i.x - r.x) <= 1 AND abs(i.y - r.y) <= 1 AND i.pos > r.root),
parts AS (SELECT vec_id, part, root, min(x) AS px1, max(x) + 1 AS px2, min(y) AS py1, max(y) + 1 AS py2 FROM (SELECT vec_id, part, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3 HAVING count(*) >= 4)
SELECT e.vec_id,
  coalesce(bool_or(part = 'crop' AND NOT (px1 >= 1 AND py1 >= 1 AND px2 <= 4 AND py2 <= 3)), false) AS cut_alone,
  coalesce(bool_or(part = 'crop' AND NOT (px1 >= 1 AND py1 >= 1 AND px2 <= 4 AND py2 <= 3) OR part = 'page' AND px1 <= x2 AND px2 >= x1 AND py1 <= y2 AND py2 >= y1 AND NOT (px1 >= x1 + 1 AND px2 <= x2 - 1 AND py1 >= y1 + 1 AND py2 <= y2 - 1)), false) AS cut
FROM e JOIN box USING (vec_id) LEFT JOIN parts USING (vec_id) GROUP BY e.vec_id
"""


@query("r5_c24_cut_with_context", CUT)
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of 5 x 4 in pages of 8 x 8, which the context covers as a whole."""
    b = blocks(spark, sf_dir).select("vec_id", "b", (F.col("vec_id") % 3).cast("int").alias("x"), (F.col("vec_id") % 2).cast("int").alias("y"))
    return b.select("vec_id", raster.cut_report("b", F.lit(8), "x", F.col("x") + 5, "y", F.col("y") + 4).alias("r")).select("vec_id", "r.*")


FILL = PIXELS.replace("WITH", "WITH RECURSIVE", 1) + """
, m AS (SELECT vec_id, x, y, CAST(v AS DOUBLE) AS v, x BETWEEN 2 AND 5 AND y BETWEEN 3 AND 5 AS hole FROM p),
f AS (SELECT m.vec_id, x, y, hole, CASE WHEN hole THEN mean ELSE v END AS v, 0 AS i FROM m JOIN (SELECT vec_id, avg(v) AS mean FROM m WHERE NOT hole GROUP BY 1) USING (vec_id)
  UNION ALL SELECT a.vec_id, a.x, a.y, a.hole, CASE WHEN a.hole THEN avg(b.v) ELSE any_value(a.v) END, a.i + 1 FROM f a JOIN f b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1 WHERE a.i < 20 GROUP BY a.vec_id, a.x, a.y, a.hole, a.i)
SELECT vec_id, CAST(y * 8 + x AS INT) AS place, round(v, 6) AS v FROM f WHERE i = 20 AND hole
"""


@query("r9_fill_a_hole", FILL)
def r9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hole of 4 x 3 in rasters of 8 x 8, filled in 20 rounds."""
    filled = raster.filled_in("b", F.lit(8), F.lit(2), F.lit(6), F.lit(3), F.lit(6), F.lit(20))
    p = blocks(spark, sf_dir).select("vec_id", F.posexplode(filled).alias("place", "v"))
    return p.where("place % 8 BETWEEN 2 AND 5 AND place div 8 BETWEEN 3 AND 5").withColumn("v", F.round("v", 6))


WEIGHTS = tuple((i * 7 % 13 - 6) / 10 for i in range(64))


@query("k1_k4_k7_scorers", f"""
WITH s AS (SELECT vec_id, list_dot_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [{', '.join(f'{w}::DOUBLE' for w in WEIGHTS)}]) AS s FROM embeddings)
SELECT vec_id, round(1 / (1 + exp(-s)), 6) AS probability, 1 / (1 + exp(-s)) > 0.5 AS ill_defined FROM s""")
def k1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot for networks, with a linear one of fixed weights in their place: two logits, their softmax, the verdict."""

    @F.pandas_udf("double")
    def scorer(embedding: pd.Series) -> pd.Series:
        s = np.array([float(np.dot(np.asarray(x, float), WEIGHTS)) for x in embedding])
        return pd.Series(1 / (1 + np.exp(-s)))

    e = planning.score_with(table(spark, sf_dir, "embeddings"), scorer, ["embedding"], "p")
    return e.select("vec_id", F.round("p", 6).alias("probability"), (F.col("p") > 0.5).alias("ill_defined"))


@query("m5_memory_bank", """
WITH b AS (SELECT label, vec_id // 40 AS step, vec_id, row_number() OVER (PARTITION BY label, vec_id // 40 ORDER BY md5(vec_id || ':bank'), vec_id) AS k FROM embeddings),
r AS (SELECT label, step, vec_id FROM b WHERE k <= 3),
s AS (SELECT DISTINCT vec_id // 40 AS step FROM embeddings)
SELECT label, s.step, count(*) AS n_held, min(r.step) AS oldest FROM r JOIN s ON s.step BETWEEN r.step AND r.step + 2 GROUP BY 1, 2""")
def m5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in steps of 40; a bank of each label, at most three samples a step, of the last three steps."""
    e = table(spark, sf_dir, "embeddings").select("label", F.expr("vec_id div 40").alias("step"), "vec_id")
    return workflow.memory_bank(e, "label", "step", "vec_id", steps=3, most=3).select("label", "step", "n_held", "oldest")


@query("m4_costs_i_json_maps_dates", """
WITH d AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS INT) AS k, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
c AS (SELECT *, greatest(0, CAST(floor(epoch(ts) - epoch(before)) AS BIGINT) % 10 - 1) AS cost FROM d)
SELECT event_id, k, strftime(ts, '%Y-%m-%d %H') AS hour, CAST(1 AS BIGINT) AS n_keys, CAST(sum(1 + coalesce(cost, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tries FROM c""")
def m4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tries of each user, where a try that took long counts for more, by recorded seconds (here the last digit of those since the event before)."""
    e = table(spark, sf_dir, "events")
    props = F.from_json("props", "map<string,int>")
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1000000.0
    before = e.withColumn("before", F.lag("ts").over(workflow.in_order("user_id", "ts", "event_id"))).withColumn("seconds", F.floor(second("ts") - second("before")) % 10)
    t = workflow.costly_tries(before, "user_id", ["ts", "event_id"], "seconds")
    return t.select("event_id", F.element_at(props, "k").alias("k"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.size(F.map_keys(props)).cast("long").alias("n_keys"), "tries")


@query("s4_seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {U('doc_id', '42')}, doc_id) - 1 AS place FROM documents")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffle that the seed fixes: places in order of a hash."""
    d = table(spark, sf_dir, "documents").select("doc_id").withColumn("u", uniform("doc_id", "42"))
    return groups.ranked(d, [], ["u", "doc_id"]).select("doc_id", F.col("at").alias("place"))
