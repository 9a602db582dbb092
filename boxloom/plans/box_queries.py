"""Queries of projections and filters."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, scalars
from ..operators import boxes as ops
from ..operators import nested, pages
from ..sources.bridges import LAYOUT, boxes, table
from .base import query

GEOMETRY = ["filename", "box_id", "W_d", "W_g", "H_b", "H_h"]
U = lambda key, salt: f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR) || ':{salt}'), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


@query("b1_bbox_and_b2_flatten", LAYOUT + r"""
, k AS (SELECT filename, 'word' AS kind, text, W_d, W_g, H_b, H_h FROM boxes
  UNION ALL SELECT filename, 'char', substr(text, CAST(i AS INT) + 1, 1), W_d + 8 * i, W_d + 8 * (i + 1), H_b, H_h FROM (SELECT *, unnest(range(0, len_text)) AS i FROM boxes))
SELECT filename, kind, count(*) AS n, count(DISTINCT text) AS n_texts, CAST(sum(W_d) AS BIGINT) AS sum_left, CAST(sum(W_g) AS BIGINT) AS sum_right, CAST(sum(H_b) AS BIGINT) AS sum_top, CAST(sum(H_h) AS BIGINT) AS sum_bottom
FROM k GROUP BY filename, kind""")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes nested as an annotation (one page, a block and paragraph a row of words), flattened again, some documents at a time where their texts lie."""
    return pages.in_lots(table(spark, sf_dir, "documents"), flat_sums, FLAT_SUMS)


FLAT_SUMS = "filename string, kind string, n long, n_texts long, sum_left long, sum_right long, sum_top long, sum_bottom long"


def flat_sums(names: list[str | None], texts: list[list[str]]) -> pa.RecordBatch:
    """Of some documents' annotations, flattened: counts and sums of words and of characters."""
    docs, annotations = nested.annotations(*pages.with_words(texts))
    parts = []
    for kind, found in nested.flattened(annotations).items():
        g = nested.summed(found, len(docs))
        columns = [pa.array(names, pa.string()).take(pa.array(docs[g["doc"]])), pa.array([kind] * len(g["n"]), pa.string()), *(pa.array(g[c], pa.int64()) for c in ("n", "n_texts", "W_d", "W_g", "H_b", "H_h"))]
        parts.append(pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FLAT_SUMS.split(", ")]))
    return pa.concat_batches(parts)


@query("b3_char_box_lines", LAYOUT + r"""
SELECT filename, box_id, substr(text, 1, 1) AS text, W_d, W_g, H_b, H_h FROM boxes WHERE box_id % 7 <> 0""")
def char_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a character box file; every seventh one is broken and dropped."""
    c = lambda x: F.col(x).cast("string")
    line = F.concat_ws(" ", F.substring("text", 1, 1), c("W_d"), (F.col("page_h") - F.col("H_h")).cast("string"), c("W_g"), (F.col("page_h") - F.col("H_b")).cast("string"), F.lit("0"))
    broken = F.when(F.col("box_id") % 7 == 0, F.when(F.col("box_id") % 2 == 0, F.lit("x 1 2")).otherwise(F.lit("x a b c d 0"))).otherwise(line)
    return ops.parse_char_boxes(boxes(spark, sf_dir).select("filename", "box_id", broken.alias("line"), F.col("page_h").alias("height"))).select("filename", "box_id", "text", "W_d", "W_g", "H_b", "H_h")


@query("a24_word_rows_c2", LAYOUT + """
SELECT filename, box_id, text, greatest(0, W_d - 4) AS W_d, W_g - 4 AS W_g, H_b, H_h FROM boxes WHERE box_id % 7 <> 0""")
def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a word table, four pixels to the left of the boxes; every seventh one is blank, flat or broken and dropped."""
    c = lambda x: F.col(x).cast("string")
    row = lambda width, text: F.concat_ws("\t", F.lit("5\t1\t1\t1\t1\t1"), (F.col("W_d") - 4).cast("string"), c("H_b"), width, c("Height"), F.lit("96.1"), text)
    broken = F.when(F.col("box_id") % 3 == 0, row(c("Width"), F.lit("  "))).when(F.col("box_id") % 3 == 1, row(F.lit("0"), F.col("text"))).otherwise(row(F.lit("x"), F.col("text")))
    line = F.when(F.col("box_id") % 7 == 0, broken).otherwise(row(c("Width"), F.concat(F.lit(" "), "text", F.lit(" "))))
    return ops.parse_word_rows(boxes(spark, sf_dir).select("filename", "box_id", line.alias("line"))).select("filename", "box_id", "text", "W_d", "W_g", "H_b", "H_h")


@query("b4_pad", LAYOUT + "SELECT filename, box_id, greatest(0, W_d - 3) AS W_d, least(page_w, W_g + 3) AS W_g, greatest(0, H_b - 3) AS H_b, least(page_h, H_h + 3) AS H_h FROM boxes")
def pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.pad(boxes(spark, sf_dir), 3).select(*GEOMETRY)


@query("b5_box_derive", LAYOUT + "SELECT filename, box_id, Width, Height, ratio, len_text FROM boxes")
def derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.derive(boxes(spark, sf_dir).drop("Width", "Height", "ratio", "len_text")).select("filename", "box_id", "Width", "Height", "ratio", "len_text")


@query("b6_colors_and_b14_distance", LAYOUT + """
SELECT filename, box_id, round((abs(fg_color[1] - bg_color[1]) + abs(fg_color[2] - bg_color[2]) + abs(fg_color[3] - bg_color[3])) / 3.0::DOUBLE, 6) AS distance FROM boxes""")
def colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written as text, parsed again, compared."""
    b = boxes(spark, sf_dir).select("filename", "box_id", F.col("fg_color").cast("string").alias("fg"), F.to_json("bg_color").alias("bg"))
    return b.select("filename", "box_id", F.round(scalars.color_distance(scalars.parse_color(F.col("fg")), scalars.parse_color(F.col("bg"))), 6).alias("distance"))


@query("b7_safe_round_and_b8_coerce", """
SELECT event_id, coalesce(CAST(round_even(value, 0) AS INT), -100) AS rounded, CAST(try_cast(CASE WHEN event_id % 5 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS DOUBLE) AS number FROM events""")
def rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("raw", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).otherwise(F.col("event_id").cast("string")))
    return e.select("event_id", scalars.safe_round(F.col("value")).alias("rounded"), F.expr("try_cast(raw AS double)").alias("number"))


@query("b9_expand_b10_jitter", LAYOUT + f"""
, e AS (SELECT filename, box_id, dataset IN ('src1', 'src3') AS x, {U('filename', 'jitter')} < 0.1 AS j, {', '.join(f"CAST(floor({U('filename', 'jitter-' + c)} * 3) AS INT) - 1 AS j_{c}" for c in ('W_d', 'W_g', 'H_b', 'H_h'))}, W_d, W_g, H_b, H_h FROM boxes)
SELECT filename, box_id, {', '.join(f"{c} {'-' if c in ('W_d', 'H_b') else '+'} CASE WHEN x THEN 1 ELSE 0 END + CASE WHEN j THEN j_{c} ELSE 0 END AS {c}" for c in ('W_d', 'W_g', 'H_b', 'H_h'))} FROM e""")
def expand_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.jitter(ops.expand_datasets(boxes(spark, sf_dir), ["src1", "src3"])).select(*GEOMETRY)


SHIFTED = "(SELECT *, W_d - 5 AS l, W_g + 40 AS r, H_b - 3 AS t, H_h + CASE WHEN box_id % 11 = 0 THEN -11 ELSE 4 END AS b FROM boxes)"


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = boxes(spark, sf_dir)
    return d.withColumns({"W_d": F.col("W_d") - 5, "W_g": F.col("W_g") + 40, "H_b": F.col("H_b") - 3, "H_h": F.col("H_h") + F.when(F.col("box_id") % 11 == 0, -11).otherwise(4)})


@query("b11_clamp_and_c5_least", LAYOUT + f"""
, k AS (SELECT filename, box_id, greatest(0, least(l, page_w - 1)) AS W_d, greatest(0, least(r, page_w)) AS W_g, greatest(0, least(t, page_h - 1)) AS H_b, greatest(0, least(b, page_h)) AS H_h FROM {SHIFTED})
SELECT *, CAST(H_h - H_b AS DOUBLE) / (W_g - W_d) AS ratio FROM k WHERE W_g - W_d >= 2 AND H_h - H_b >= 2""")
def clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clamp(shifted(spark, sf_dir)).select(*GEOMETRY, "ratio")


@query("c4_inside_image", LAYOUT + f"SELECT filename, count(*) AS n FROM {SHIFTED} WHERE l >= 0 AND t >= 0 AND r <= page_w AND b <= page_h GROUP BY filename")
def inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.inside(shifted(spark, sf_dir)).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@query("c1_positive_and_c6_kinds", LAYOUT + f"SELECT len_text = 1 AS is_char, count(*) AS n FROM {SHIFTED} WHERE t < b AND l < r GROUP BY 1")
def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.positive(shifted(spark, sf_dir)).groupBy((F.col("len_text") == 1).alias("is_char")).agg(F.count(F.lit(1)).alias("n"))


@query("c7_thin_documents", LAYOUT + f"""
, d AS (SELECT filename, count(*) FILTER (len_text > 1) > 500 AND {U('filename', 'thin')} < 0.25 AS thinned FROM boxes GROUP BY filename)
SELECT filename, count(*) AS n FROM boxes JOIN d USING (filename) WHERE NOT thinned OR len_text > 1 GROUP BY filename""")
def thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.thin(boxes(spark, sf_dir)).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@query("b12_resize_rule", LAYOUT + """
, s AS (SELECT *, CASE WHEN CAST(trunc(Width * (64.0::DOUBLE / Height)) AS INT) > 1024 THEN 1024.0::DOUBLE / Width ELSE 64.0::DOUBLE / Height END AS s FROM boxes)
SELECT filename, box_id, CAST(trunc(Width * s) AS INT) AS new_w, CAST(trunc(Height * s) AS INT) AS new_h, s > 1 AS cubic FROM s""")
def resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.resize_scale(F.col("Width"), F.col("Height"))
    return boxes(spark, sf_dir).select("filename", "box_id", (F.col("Width") * s).cast("int").alias("new_w"), (F.col("Height") * s).cast("int").alias("new_h"), (s > 1).alias("cubic"))


@query("b13_ratio_distance", LAYOUT + """
SELECT filename, box_id, round(greatest(greatest(ratio, 1e-5) / (0.5 + 1e-5), (0.5 + 1e-5) / greatest(ratio, 1e-5)), 6) AS distance FROM boxes""")
def ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select("filename", "box_id", F.round(scalars.ratio_distance(F.col("ratio"), F.lit(0.5)), 6).alias("distance"))


@query("b15_color_variants", LAYOUT + """
, c AS (SELECT DISTINCT list_transform(fg_color, lambda x: x // 16 * 16) AS c FROM boxes),
o AS (SELECT unnest([-4, -2, 0, 2, 4]) AS o),
v AS (SELECT DISTINCT c, [least(255, greatest(0, c[1] + a.o)), least(255, greatest(0, c[2] + b.o)), least(255, greatest(0, c[3] + d.o))] AS v FROM c, o a, o b, o d),
r AS (SELECT c, v, row_number() OVER (PARTITION BY c ORDER BY md5(c[1] || ',' || c[2] || ',' || c[3] || ':' || v[1] || ',' || v[2] || ',' || v[3])) AS k FROM v)
SELECT c[1] AS b, c[2] AS g, c[3] AS r, CAST(k AS INT) AS variant, v[1] AS vb, v[2] AS vg, v[3] AS vr FROM r WHERE k <= 9
UNION ALL SELECT c[1], c[2], c[3], 10, 0, 0, 0 FROM c""")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine variants of each colour by hash, and black; of colours to the next lower multiple of 16."""
    c = boxes(spark, sf_dir).select(F.transform("fg_color", lambda x: x - x % 16).alias("c")).distinct()
    steps = F.array(*map(F.lit, (-4, -2, 0, 2, 4)))
    clip = lambda x, o: F.least(F.lit(255), F.greatest(F.lit(0), x + o))
    grid = F.flatten(F.transform(steps, lambda i: F.flatten(F.transform(steps, lambda j: F.transform(steps, lambda k: F.array(clip(F.col("c")[0], i), clip(F.col("c")[1], j), clip(F.col("c")[2], k)))))))
    name = lambda x: F.concat_ws(",", x.cast("array<string>"))
    ranked = F.array_sort(F.transform(F.array_distinct(grid), lambda v: F.struct(F.md5(F.concat(name(F.col("c")), F.lit(":"), name(v)).cast("binary")).alias("h"), v.alias("v"))))
    some = F.concat(F.transform(F.slice(ranked, 1, 9), lambda x: x["v"]), F.array(F.array(*map(F.lit, (0, 0, 0)))))
    out = c.select("c", F.posexplode(some).alias("k", "v"))
    pick = lambda x, names: [F.col(x)[i].alias(n) for i, n in enumerate(names)]
    place = F.when(F.col("k") == F.size(some) - 1, 10).otherwise(F.col("k") + 1)
    return out.select(*pick("c", "bgr"), place.alias("variant"), *pick("v", ("vb", "vg", "vr")))


@query("b16_randomize_like", """
SELECT item_id, array_to_string(list_transform(string_split(text, ''), lambda c, i:
  CASE WHEN regexp_matches(c, '^[a-z]$') THEN substr('abcdefghijklmnopqrstuvwxyz', CAST('0x' || substr(md5(item_id || ':' || (i - 1)), 1, 4) AS INT) % 26 + 1, 1)
       WHEN regexp_matches(c, '^[A-Z]$') THEN substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST('0x' || substr(md5(item_id || ':' || (i - 1)), 1, 4) AS INT) % 26 + 1, 1)
       WHEN regexp_matches(c, '^[0-9]$') THEN substr('0123456789', CAST('0x' || substr(md5(item_id || ':' || (i - 1)), 1, 4) AS INT) % 10 + 1, 1) ELSE c END), '') AS text FROM benchmark""")
def randomised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", scalars.text_randomised(F.col("text"), F.col("item_id")).alias("text"))


@query("b17_renderable", LAYOUT + "SELECT filename, count(*) FILTER (regexp_matches(lower(text), '^[ -~]*$')) AS n_renderable, count(*) AS n FROM boxes GROUP BY filename")
def renderable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("filename").agg(F.count(F.when(scalars.renderable(F.col("text")), 1)).alias("n_renderable"), F.count(F.lit(1)).alias("n"))


@query("b20_names_b21_tags_b22_paths", r"""
SELECT page_id, nullif(regexp_extract(replace(url, '/', '_'), '^(.+)_[^_]*$', 1), '') AS base,
  lower(string_split(regexp_replace(trim(url), '^/+|/+$', '', 'g'), '/')[-1]) AS tag, regexp_replace(url, '/en/', '/merged/') AS path FROM pages""")
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalars.base_name(F.translate(url, "/", "_")).alias("base"), scalars.tag(url).alias("tag"), F.regexp_replace(url, "/en/", "/merged/").alias("path"))


@query("b23_normalise", LAYOUT + """
SELECT filename, box_id, round((bg_color[3] / 255.0::DOUBLE - 0.485) / 0.229, 6) AS r, round((bg_color[2] / 255.0::DOUBLE - 0.455) / 0.224, 6) AS g, round((bg_color[1] / 255.0::DOUBLE - 0.406) / 0.225, 6) AS b FROM boxes""")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BGR colours as RGB, less the mean, by the deviation."""
    c = ((2, "r", 0.485, 0.229), (1, "g", 0.455, 0.224), (0, "b", 0.406, 0.225))
    return boxes(spark, sf_dir).select("filename", "box_id", *(F.round((F.col("bg_color")[i] / 255.0 - m) / s, 6).alias(n) for i, n, m, s in c))


@query("b24_padding", LAYOUT + """
SELECT filename, box_id, greatest(16, Width) - Width AS pad_right, greatest(16, Height) - Height AS pad_bottom, CAST(floor((greatest(16, Width) - Width) / 2.0::DOUBLE) AS INT) AS centre_left,
  CAST(floor((greatest(16, Height) - Height) / 2.0::DOUBLE) AS INT) AS centre_top FROM boxes""")
def padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.greatest(F.lit(16), c) - F.col(c) for c in ("Width", "Height"))
    return boxes(spark, sf_dir).select("filename", "box_id", w.alias("pad_right"), h.alias("pad_bottom"), F.floor(w / 2).cast("int").alias("centre_left"), F.floor(h / 2).cast("int").alias("centre_top"))


@query("a27_deciles_and_a28_prediction", """
SELECT doc_id, n_chars % 256 AS level, CAST(least(20, greatest(1, ceil((n_chars % 256) / 255.0::DOUBLE * 20))) AS INT) AS bucket, n_chars % 256 > CAST(trunc(255 * 0.5) AS INT) AS hit FROM documents""")
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("n_chars") % 256) / 255.0
    level = F.rint(p * 255).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", level.alias("level"), F.least(F.lit(20), F.greatest(F.lit(1), F.ceil(p * 20))).cast("int").alias("bucket"), (level > int(255 * 0.5)).alias("hit"))


@query("x_hash_shards", """
WITH m AS (SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS d, sha1(CAST(o_orderkey AS VARCHAR)) AS s FROM orders)
SELECT o_orderkey, """ + ", ".join(
    f"list_reduce(list_concat([0::BIGINT], list_transform(range({k}), lambda i: CAST('0x' || substr({c}, CAST(i AS INT) * 8 + 1, 8) AS BIGINT))), lambda a, c: (a * 4294967296 + c) % {n}) AS {name}"
    for c, k, n, name in (("d", 4, 32, "md5_shard"), ("s", 5, 100003, "sha1_shard"))
) + " FROM m")
def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", draws.md5_shard(F.col("o_orderkey"), 32).alias("md5_shard"), draws.sha1_shard(F.col("o_orderkey"), 100003).alias("sha1_shard"))
