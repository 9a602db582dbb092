"""Queries of blocks, pixels, tiles and contrastive mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, frequency, lines, mining, raster
from ..sources.bridges import LAYOUT, boxes, table
from .base import query
from .box_queries import U
from .join_queries import CHAINED

BLOCK = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: least(255, greatest(0, CAST(floor(CAST(x AS DOUBLE) * 64 + 128) AS INT)))) AS b FROM embeddings),
k AS (SELECT unnest(range(0, 64)) AS k), n AS (SELECT unnest(range(0, 64)) AS n),
w AS (SELECT k, n, (CASE WHEN k // 8 = 0 THEN sqrt(0.125) ELSE 0.5 END) * (CASE WHEN k % 8 = 0 THEN sqrt(0.125) ELSE 0.5 END)
  * cos((2 * (n // 8) + 1) * (k // 8) * pi() / 16) * cos((2 * (n % 8) + 1) * (k % 8) * pi() / 16) AS w FROM k, n),
p AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS n, unnest(b) AS v FROM e),
d AS (SELECT vec_id, k, sum((v - 128) * w) AS c FROM p JOIN w USING (n) GROUP BY 1, 2)
"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", raster.levels(F.col("embedding")).alias("b"))


@query("r12_block_dct_and_r11", BLOCK + "SELECT vec_id, CAST(k AS INT) AS k, round(c, 6) + 0.0 AS c FROM d")
def r12(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = blocks(spark, sf_dir).select("vec_id", F.posexplode(frequency.dct(F.col("b"), 128.0)).alias("k", "c"))
    return d.select("vec_id", "k", (F.round("c", 6) + 0.0).alias("c"))


ZIGZAG = ", ".join(map(str, frequency.zigzag()))


@query("r13_zigzag", BLOCK.split("k AS")[0].rstrip().rstrip(",") + f" SELECT vec_id, list_transform([{ZIGZAG}], lambda i: b[i + 1]) AS z FROM e")
def r13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("vec_id", frequency.in_zigzag(F.col("b")).alias("z"))




@query("r14_quality_tables", "WITH t0 AS (SELECT q, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS s, CAST(unnest(range(0, 64)) AS INT) AS k FROM (SELECT CAST(unnest(range(1, 101)) AS INT) AS q))"
       f" SELECT q, k, CAST(greatest(1, ([{', '.join(map(str, frequency.LUMINANCE))}][k + 1] * s + 50) // 100) AS INT) AS t FROM t0")
def r14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1, 101).select(F.col("id").cast("int").alias("q"), F.posexplode(frequency.quality_table(F.col("id"))).alias("k", "t"))


QUANTISED = BLOCK + f""", l AS (SELECT [{', '.join(map(str, frequency.LUMINANCE))}] AS l),
s AS (SELECT vec_id, CAST(k AS INT) AS k, CAST(least(20, abs(round_even(round(c, 6) / greatest(1, (l[k + 1] * 60 + 50) // 100), 0))) AS INT) AS level FROM d, l)
"""


@query("r15_quantise", QUANTISED + "SELECT vec_id, k, level FROM s")
def r15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At quality 70."""
    c = F.transform(frequency.dct(F.col("b"), 128.0), lambda x: F.round(x, 6))
    return blocks(spark, sf_dir).select("vec_id", F.posexplode(frequency.quantise(c, frequency.quality_table(F.lit(70)))).alias("k", "level"))


@query("r16_volume", QUANTISED + "SELECT vec_id, CAST(t AS INT) AS t, CAST(count(*) FILTER (level = t) AS INT) AS n FROM s, (SELECT unnest(range(0, 21)) AS t) GROUP BY vec_id, t")
def r16(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.transform(frequency.dct(F.col("b"), 128.0), lambda x: F.round(x, 6))
    q = blocks(spark, sf_dir).select("vec_id", frequency.quantise(c, frequency.quality_table(F.lit(70))).alias("levels"))
    return q.select("vec_id", F.posexplode(frequency.volume(F.col("levels"))).alias("t", "n"))


@query("r19_haar", BLOCK.split("k AS")[0].rstrip().rstrip(",") + """
, i AS (SELECT vec_id, b, CAST(unnest(range(0, 16)) AS INT) AS i FROM e),
q AS (SELECT vec_id, i, b[(i // 4) * 16 + (i % 4) * 2 + 1] AS a, b[(i // 4) * 16 + (i % 4) * 2 + 2] AS c, b[(i // 4) * 16 + 8 + (i % 4) * 2 + 1] AS d, b[(i // 4) * 16 + 8 + (i % 4) * 2 + 2] AS f FROM i)
SELECT vec_id, i, (a + c + d + f) / 2.0::DOUBLE AS ll, (a - c + d - f) / 2.0::DOUBLE AS lh, (a + c - d - f) / 2.0::DOUBLE AS hl, (a - c - d + f) / 2.0::DOUBLE AS hh FROM q""")
def r19(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = frequency.haar(F.col("b"))
    z = blocks(spark, sf_dir).select("vec_id", *(v.alias(k) for k, v in h.items()))
    return z.select("vec_id", F.posexplode(F.arrays_zip("ll", "lh", "hl", "hh")).alias("i", "z")).select("vec_id", "i", "z.*")


PIXELS = BLOCK.split("k AS")[0] + "q AS (SELECT vec_id, CAST(unnest(range(0, 64)) AS INT) AS n, unnest(b) AS v FROM e), p AS (SELECT vec_id, n // 8 AS y, n % 8 AS x, v FROM q)\n"


@query("r20_box_filter", PIXELS + "SELECT a.vec_id, a.y, a.x, round(avg(b.v), 6) AS v FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 GROUP BY 1, 2, 3")
def r20(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frequency.box_filter(frequency.pixels(blocks(spark, sf_dir), "vec_id", "b"), "vec_id", 2)
    return f.select("vec_id", "y", "x", F.round("v", 6).alias("v"))


@query("r21_residual_filters", PIXELS + f""", f AS (SELECT * FROM (VALUES {', '.join(str((n, dy, dx, w / by)) for n, (ws, by) in frequency.RESIDUAL.items() for (dy, dx), w in ws.items())}) AS t(name, dy, dx, w))
SELECT name, a.vec_id, a.y, a.x, least(3.0, greatest(-3.0, sum(b.v * w)))::DOUBLE AS v FROM p a, f JOIN p b ON a.vec_id = b.vec_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4""")
def r21(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frequency.pixels(blocks(spark, sf_dir), "vec_id", "b")
    out = None
    for name in frequency.RESIDUAL:
        one = frequency.residual(p, "vec_id", name).select(F.lit(name).alias("name"), "vec_id", "y", "x", "v")
        out = one if out is None else out.unionByName(one)
    return out


@query("r22_band_energy_r23_coordinates", BLOCK + """
SELECT CAST(k AS INT) AS k, round(avg(abs(c)), 6) AS mean_abs, round(sqrt(sum(c * c)), 6) AS norm, round(-1 + 2 * (k % 8) / 7.0::DOUBLE, 9) AS xx, round(-1 + 2 * (k // 8) / 7.0::DOUBLE, 9) AS yy FROM d GROUP BY k""")
def r22(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = blocks(spark, sf_dir).select(F.posexplode(frequency.dct(F.col("b"), 128.0)).alias("k", "c"))
    d = d.groupBy("k").agg(F.round(F.avg(F.abs("c")), 6).alias("mean_abs"), F.round(F.sqrt(F.sum(F.col("c") * F.col("c"))), 6).alias("norm"))
    return d.select("k", "mean_abs", "norm", F.round(-1 + 2 * (F.col("k") % 8) / 7.0, 9).alias("xx"), F.round(-1 + 2 * F.floor(F.col("k") / 8) / 7.0, 9).alias("yy"))


@query("g25_otsu", PIXELS + """
, h AS (SELECT vec_id, v AS t, count(*) AS n FROM p GROUP BY 1, 2),
c AS (SELECT vec_id, t, sum(n) OVER o AS w0, sum(n * t) OVER o AS s0, sum(n) OVER (PARTITION BY vec_id) AS w, sum(n * t) OVER (PARTITION BY vec_id) AS s FROM h WINDOW o AS (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
b AS (SELECT vec_id, t, round(coalesce(CAST(w0 AS DOUBLE) * (w - w0) * pow(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / nullif(w - w0, 0), 2), 0), 3) AS b FROM c)
SELECT vec_id, arg_max(t, (b, -t)) AS threshold FROM b GROUP BY vec_id""")
def g25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.otsu(frequency.pixels(blocks(spark, sf_dir), "vec_id", "b"), "vec_id")


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query("r1_sauvola_r2_otsu_r3_components_r4_cut", PIXELS.replace("WITH", "WITH RECURSIVE", 1) + f"""
, h AS (SELECT vec_id, v AS t, count(*) AS n FROM p GROUP BY 1, 2),
c AS (SELECT vec_id, t, sum(n) OVER o AS w0, sum(n * t) OVER o AS s0, sum(n) OVER (PARTITION BY vec_id) AS w, sum(n * t) OVER (PARTITION BY vec_id) AS s FROM h WINDOW o AS (PARTITION BY vec_id ORDER BY t ROWS UNBOUNDED PRECEDING)),
b AS (SELECT vec_id, t, round(coalesce(CAST(w0 AS DOUBLE) * (w - w0) * pow(CAST(s0 AS DOUBLE) / w0 - CAST(s - s0 AS DOUBLE) / nullif(w - w0, 0), 2), 0), 3) AS b FROM c),
otsu AS (SELECT vec_id, arg_max(t, (b, -t)) AS otsu FROM b GROUP BY vec_id),
near AS (SELECT dy, dx FROM (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) b),
around AS (SELECT p.vec_id, p.x, p.y, p.v, {MIRROR.format('p.x + dx')} AS qx, {MIRROR.format('p.y + dy')} AS qy FROM p, near),
stats AS (SELECT a.vec_id, a.x, a.y, any_value(a.v) AS v, sum(q.v) / 25.0::DOUBLE AS m, sum(q.v * q.v) / 25.0::DOUBLE AS sq FROM around a JOIN p q ON q.vec_id = a.vec_id AND q.x = a.qx AND q.y = a.qy GROUP BY 1, 2, 3),
t AS (SELECT *, m * (1 + 0.5 * (sqrt(greatest(sq - m * m, 0)) / 128 - 1)) AS t FROM stats),
ink AS (SELECT vec_id, x, y, y * 8 + x AS pos FROM t WHERE v < t),
reach AS (SELECT vec_id, x, y, pos AS root FROM ink UNION SELECT i.vec_id, i.x, i.y, r.root FROM reach r JOIN ink i ON i.vec_id = r.vec_id AND abs(i.x - r.x) <= 1 AND abs(i.y - r.y) <= 1 AND i.pos > r.root),
parts AS (SELECT vec_id, root, count(*) AS area FROM (SELECT vec_id, x, y, min(root) AS root FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2),
sizes AS (SELECT vec_id, count(*) AS n, max(area) AS largest FROM parts GROUP BY 1),
cut AS (SELECT vec_id, any_value(otsu) AS otsu, count(*) FILTER (v <= otsu) BETWEEN 1 AND 63 AND bool_or(v <= otsu AND (x IN (0, 7) OR y IN (0, 7))) AS cut FROM p JOIN otsu USING (vec_id) GROUP BY 1)
SELECT t.vec_id, round(avg(t), 6) AS mean_threshold, CAST(count(*) FILTER (v < t) AS INT) AS n_ink, CAST(coalesce(any_value(sizes.n), 0) AS INT) AS n_components, CAST(coalesce(any_value(largest), 0) AS INT) AS largest, CAST(any_value(otsu) AS INT) AS otsu, any_value(cut) AS cut
FROM t JOIN cut USING (vec_id) LEFT JOIN sizes USING (vec_id) GROUP BY t.vec_id""")
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rasters of 8 x 8."""
    return blocks(spark, sf_dir).select("vec_id", raster.raster_report("b").alias("r")).select("vec_id", "r.*")


SIZES = "WITH s AS (SELECT p_partkey, CAST(p_size * 60 + 100 AS INT) AS h, CAST(p_partkey % 700 + 200 AS INT) AS w FROM part)\n"


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 60 + 100).cast("int").alias("h"), (F.col("p_partkey") % 700 + 200).cast("int").alias("w"))


@query("r25_tile_grid", SIZES + """
, t AS (SELECT *, unnest(range(0, h, 512)) AS t FROM s), u AS (SELECT *, unnest(range(0, w, 512)) AS l FROM t)
SELECT p_partkey, CAST(CASE WHEN h - t < 512 THEN greatest(h - 512, 0) ELSE t END AS INT) AS top, CAST(CASE WHEN w - l < 512 THEN greatest(w - 512, 0) ELSE l END AS INT) AS "left" FROM u""")
def r25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.tiles(sizes(spark, sf_dir), 512).select("p_partkey", "top", "left")


@query("r26_sliding_grid", SIZES + """
, t AS (SELECT *, unnest(range(0, greatest(h - 512 + 340, 0) // 341 + 1)) AS i FROM s), u AS (SELECT *, unnest(range(0, greatest(w - 512 + 340, 0) // 341 + 1)) AS j FROM t)
SELECT DISTINCT p_partkey, CAST(greatest(least(i * 341, h - 512), 0) AS INT) AS top, CAST(greatest(least(j * 341, w - 512), 0) AS INT) AS "left" FROM u""")
def r26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequency.sliding(sizes(spark, sf_dir), 512, 341).select("p_partkey", "top", "left")


@query("g22_tile_mean_g23_tile_max", PIXELS + """
, t AS (SELECT label, CASE WHEN vec_id % 2 = 0 THEN 0 ELSE 4 END + x AS x, y, v FROM p JOIN e USING (vec_id))
SELECT label, y, x, round(avg(v), 6) AS mean, max(v)::DOUBLE AS max, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def g22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as tiles of one image, odd ones four pixels to the right."""
    b = blocks(spark, sf_dir)
    p = frequency.pixels(b.select("vec_id", "b"), "vec_id", "b").join(b.select("vec_id", "label"), "vec_id")
    m = frequency.merged(p.withColumn("x", F.when(F.col("vec_id") % 2 == 0, 0).otherwise(4) + F.col("x")), ["label"])
    return m.select("label", "y", "x", F.round("mean", 6).alias("mean"), "max", "n")


UNIT = """
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
u AS (SELECT vec_id, label, a, sqrt(list_dot_product(a, a)) AS n FROM e),
s AS (SELECT q.vec_id, q.label AS label, c.vec_id AS other, c.label AS other_label, list_dot_product(q.a, c.a) / (q.n * c.n) / 0.1 AS s FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
"""


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, whose id is divisible by 50, against all vectors; cosine by a temperature of 0.1."""
    u = table(spark, sf_dir, "embeddings").select("vec_id", "label", candidates.unit(F.col("embedding")).alias("u"))
    pairs = candidates.against_all(u.where("vec_id % 50 = 0"), u, "vec_id")
    return pairs.select("q.vec_id", "q.label", F.col("c.vec_id").alias("other"), F.col("c.label").alias("other_label"), (candidates.dot(F.col("q.u"), F.col("c.u")) / 0.1).alias("s"))


@query("g18_infonce_g19_supcon", UNIT + """
, l AS (SELECT vec_id, ln(sum(exp(s))) AS z, avg(s) FILTER (label = other_label) AS pos, arg_min(s, other) FILTER (label = other_label) AS first, ln(sum(exp(s)) FILTER (label <> other_label)) AS neg FROM s GROUP BY vec_id)
SELECT vec_id, round(z - pos, 6) AS supcon, round(neg - pos, 6) AS decoupled, round(ln(exp(first) + exp(neg)) - first, 6) AS infonce FROM l WHERE pos IS NOT NULL""")
def g18(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = F.col("label") == F.col("other_label")
    e = F.exp("s")
    g = similar(spark, sf_dir).groupBy("vec_id").agg(
        F.log(F.sum(e)).alias("z"), F.avg(F.when(same, F.col("s"))).alias("pos"), F.min_by(F.when(same, F.col("s")), F.when(same, F.col("other"))).alias("first"), F.log(F.sum(F.when(~same, e))).alias("neg")
    )
    c = F.col
    return g.where("pos IS NOT NULL").select("vec_id", F.round(c("z") - c("pos"), 6).alias("supcon"), F.round(c("neg") - c("pos"), 6).alias("decoupled"), F.round(F.log(F.exp("first") + F.exp("neg")) - c("first"), 6).alias("infonce"))


@query("k8_softmax_g14_pools_g26_distance", """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
m AS (SELECT vec_id, a, list_max(a[1:10]) AS m, a[1:32] AS f, a[33:64] AS g FROM e)
SELECT vec_id, round(exp(a[1] - m) / list_sum(list_transform(a[1:10], lambda x: exp(x - m))), 9) AS p0, round(coalesce(list_avg(list_filter(a, lambda x: x > 0)), 0), 9) AS masked_mean, round(sqrt(list_sum(list_transform(range(1, 33), lambda i: pow(f[i] - g[i], 2))) / 32), 9) AS rms FROM m""")
def k8(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    head, over = F.slice(a, 1, 10), F.filter(a, lambda x: x > 0)
    m = F.array_max(head)
    d = F.zip_with(F.slice(a, 1, 32), F.slice(a, 33, 32), lambda x, y: (x - y) * (x - y))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.exp(a[0] - m) / total(F.transform(head, lambda x: F.exp(x - m))), 9).alias("p0"),
        F.round(F.coalesce(total(over) / F.nullif(F.size(over), F.lit(0)), F.lit(0.0)), 9).alias("masked_mean"), F.round(F.sqrt(total(d) / 32), 9).alias("rms"),
    )


@query("j11_positive_pairs", CHAINED + f"""
, p AS (SELECT a.filename, a.box_id AS anchor, count(*) AS n, min(b.box_id) AS first FROM lines a JOIN lines b ON a.filename = b.filename AND a.line_id = b.line_id AND a.len_text = b.len_text AND a.Height = b.Height AND a.Width = b.Width AND a.box_id <> b.box_id
  WHERE abs(a.H_b - b.H_b) <= 1 AND abs(a.W_d - b.W_d) < 600 AND (a.W_g <= b.W_d OR b.W_g <= a.W_d) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY {U("filename || ':' || anchor", 'anchor')}, anchor) AS place FROM p)
SELECT filename, anchor, CAST(place AS INT) AS place, CAST(n AS INT) AS n, first FROM r WHERE place <= 32""")
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mining.positive_pairs(lines.chained(boxes(spark, sf_dir)))
    return p.select("filename", "anchor", "place", F.size("positives").alias("n"), F.element_at("positives", 1).alias("first"))


@query("j12_negatives_and_w9", LAYOUT + f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY {U("filename || ':' || box_id", 'cap')}, box_id) AS k FROM boxes),
p AS (SELECT a.filename, a.box_id AS anchor, b.box_id AS negative, CASE WHEN b.ratio / a.ratio BETWEEN 0.9 AND 1.1 THEN 1 WHEN b.ratio / a.ratio BETWEEN 0.8 AND 1.25 THEN 2 ELSE 3 END AS tier, round(abs(b.ratio - a.ratio), 6) AS diff
  FROM r a JOIN boxes b ON a.k <= 8 AND a.filename = b.filename AND a.len_text = b.len_text AND abs(a.H_b - b.H_b) >= greatest(40, a.page_h // 4) AND abs(a.H_h - b.H_h) >= greatest(40, a.page_h // 4) AND a.box_id <> b.box_id),
o AS (SELECT *, row_number() OVER (PARTITION BY filename, anchor ORDER BY tier, diff, negative) AS place FROM p)
SELECT filename, anchor, negative, tier, CAST(place AS INT) AS place FROM o WHERE place <= 64""")
def j12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight anchors of each document by hash, 64 negatives of each."""
    b = boxes(spark, sf_dir)
    a = lines.capped(b, ["box_id"], 8).withColumns({"anchor": F.col("box_id"), "positives": F.array("box_id")})
    return mining.negatives(a, b, 64).select("filename", "anchor", "negative", "tier", "place")


@query("w7_width_bins", LAYOUT.replace("WITH w0", "WITH RECURSIVE w0") + f"""
, b AS (SELECT filename, box_id, CAST(least(Width // 64, 15) AS INT) AS bin FROM boxes),
n AS (SELECT filename, bin, count(*) AS n FROM b GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY n, bin) AS k, count(*) OVER (PARTITION BY filename) AS m FROM n),
q(filename, k, quota, rest) AS (
  SELECT filename, k, least(n, 60 // m), 60 - least(n, 60 // m) FROM k WHERE k = 1
  UNION ALL SELECT k.filename, k.k, least(k.n, q.rest // (k.m - k.k + 1)), q.rest - least(k.n, q.rest // (k.m - k.k + 1)) FROM q JOIN k ON q.filename = k.filename AND k.k = q.k + 1),
o AS (SELECT b.*, row_number() OVER (PARTITION BY filename, bin ORDER BY {U("filename || ':' || box_id", 'bin')}, box_id) AS place FROM b)
SELECT o.filename, o.box_id, o.bin FROM o JOIN k ON o.filename = k.filename AND o.bin = k.bin JOIN q ON q.filename = k.filename AND q.k = k.k WHERE place <= quota""")
def w7(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir).select("filename", "box_id", F.least(F.expr("cast(Width div 64 as int)"), F.lit(15)).alias("bin"))
    return mining.stratified(b, ["filename"], "bin", "box_id", 60).select("filename", "box_id", "bin")


@query("w8_bucket_quota", LAYOUT + f"""
SELECT filename, box_id, CAST(place AS INT) AS place FROM (SELECT filename, box_id, row_number() OVER (PARTITION BY filename, least(len_text, 25) ORDER BY {U('box_id', 'sample')}, box_id) AS place FROM boxes) WHERE place <= 3""")
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import sampling

    b = boxes(spark, sf_dir).withColumn("bucket", F.least("len_text", F.lit(25)))
    return sampling.sample(b, ["filename", "bucket"], "box_id", 3).select("filename", "box_id", "place")


KEY = "filename || ':' || box_id"


@query("r6_ill_defined_boxes", LAYOUT + f"""
, m AS (SELECT *, {', '.join(f"CAST(floor((CASE WHEN {U(KEY, 'alike')} < 0.5 THEN {U(KEY, 'move-all')} ELSE {U(KEY, 'move-' + c)} END) * 9) AS INT) - 4 AS m_{c}" for c in ('W_d', 'W_g', 'H_b', 'H_h'))} FROM boxes)
SELECT filename, box_id, W_d - m_W_d AS W_d, W_g + m_W_g AS W_g, H_b - m_H_b AS H_b, H_h + m_H_h AS H_h, CAST(least(m_W_d, m_W_g, m_H_b, m_H_h) < 0 AS INT) AS gt FROM m""")
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.ill_defined(boxes(spark, sf_dir)).select("filename", "box_id", "W_d", "W_g", "H_b", "H_h", "gt")


@query("c21_mask_domain_c23_gray_r31_luma", LAYOUT + """
SELECT filename, box_id, fg_color[1] = fg_color[2] AND fg_color[2] = fg_color[3] AS gray, round(0.2989::DOUBLE * bg_color[3] + 0.5870::DOUBLE * bg_color[2] + 0.1140::DOUBLE * bg_color[1] + 1e-9, 6) AS luma, len(list_filter(fg_color, lambda v: v NOT IN (0, 255))) = 0 AS binary FROM boxes""")
def c23(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, b = F.col("fg_color"), F.col("bg_color")
    return boxes(spark, sf_dir).select(
        "filename", "box_id", ((f[0] == f[1]) & (f[1] == f[2])).alias("gray"), F.round(0.2989 * b[2] + 0.5870 * b[1] + 0.1140 * b[0] + 1e-9, 6).alias("luma"), F.forall(f, lambda v: v.isin(0, 255)).alias("binary")
    )


@query("b19_render_grid", "SELECT font, ratio, margin, position, 20 * font + 5 * ratio + margin + position AS code FROM (SELECT unnest([0, 1, 2]) AS font), (SELECT unnest([1, 2, 3]) AS ratio), (SELECT unnest([0, 2, 4]) AS margin), (SELECT unnest([-1, 0, 1]) AS position)")
def b19(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = frequency.parameter_rows(spark, {"font": [0, 1, 2], "ratio": [1, 2, 3], "margin": [0, 2, 4], "position": [-1, 0, 1]})
    return g.withColumn("code", F.expr("20 * font + 5 * ratio + margin + position"))
