"""Queries of joins, lines and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, geometry, lines, pages
from ..sources.bridges import LAYOUT, boxes, table
from .base import query
from .box_queries import U

#: Boxes with a copy of every 13th one moved by (1, 1).
DOUBLED = LAYOUT + """, d AS (SELECT filename, box_id, text, W_d, W_g, H_b, H_h FROM boxes UNION ALL SELECT filename, box_id + 1000000, text, W_d + 1, W_g + 1, H_b + 1, H_h + 1 FROM boxes WHERE box_id % 13 = 0)
"""


def doubled(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    own = F.struct("filename", "box_id", "text", "W_d", "W_g", "H_b", "H_h")
    moved = F.struct("filename", (F.col("box_id") + 1000000).alias("box_id"), "text", *((F.col(c) + 1).alias(c) for c in ("W_d", "W_g", "H_b", "H_h")))
    return b.select(F.inline(F.array_compact(F.array(own, F.when(F.col("box_id") % 13 == 0, moved)))))


INTERSECTION = "(greatest(0, least(a.W_g, b.W_g) - greatest(a.W_d, b.W_d)) * greatest(0, least(a.H_h, b.H_h) - greatest(a.H_b, b.H_b)))"
AREA = "(({0}.W_g - {0}.W_d) * ({0}.H_h - {0}.H_b))"


@query("j1_dedup", DOUBLED + f"""SELECT filename, box_id FROM d a WHERE AND_ NOT EXISTS (SELECT 1 FROM d b WHERE a.filename = b.filename AND a.box_id <> b.box_id AND b.W_d < a.W_g AND b.W_g > a.W_d AND b.H_b // 20 BETWEEN a.H_b // 20 - 1 AND a.H_b // 20 + 1
  AND {INTERSECTION} >= 0.5 * {AREA.format('a')} AND {INTERSECTION} >= 0.5 * {AREA.format('b')})""".replace("WHERE AND_", "WHERE"))
def j1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.dedup(doubled(spark, sf_dir)).select("filename", "box_id")


@query("j2_signature_dedup", LAYOUT + """
, c AS (SELECT filename, box_id, substr(text, 1, 1) AS text, W_d, H_b, W_g, H_h FROM boxes UNION ALL SELECT filename, box_id + 1000000, substr(text, 1, 1), W_d, H_b, W_g, H_h FROM boxes WHERE box_id % 3 = 0)
SELECT filename, min(box_id) AS box_id FROM c WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.filename = c.filename AND b.text = c.text AND b.W_d = c.W_d AND b.H_b = c.H_b AND b.W_g = c.W_g AND b.H_h = c.H_h)
GROUP BY filename, text, W_d, H_b, W_g, H_h""")
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes(spark, sf_dir)
    c = b.withColumn("text", F.substring("text", 1, 1))
    c = c.unionByName(c.where("box_id % 3 = 0").withColumn("box_id", F.col("box_id") + 1000000))
    return geometry.without_words(c, b).select("filename", "box_id")


@query("j3_copy_move", LAYOUT + """
SELECT t.filename, t.box_id, count(*) AS n_candidates, min(c.box_id) AS first_candidate FROM boxes t JOIN boxes c ON t.filename = c.filename AND t.len_text = c.len_text
WHERE greatest(c.ratio / t.ratio, 1.0::DOUBLE / (c.ratio / t.ratio)) - 1 <= 0.1 AND trim(c.text) <> trim(t.text) AND NOT (t.W_d < c.W_g AND t.W_g > c.W_d AND t.H_b < c.H_h AND t.H_h > c.H_b) GROUP BY 1, 2""")
def j3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.by_document(table(spark, sf_dir, "documents"), pages.copy_move, "filename string, box_id int, n_candidates long, first_candidate int")


BUDGET = LAYOUT + f"""
, q AS (SELECT filename, count(*) FILTER (len_text > 1) AS n_words, count(*) AS n_boxes FROM boxes GROUP BY filename),
budgets AS (SELECT filename, n_words, n_boxes, CAST(least(CASE WHEN {U('filename', 'none')} < 0.2 THEN 0 ELSE 1 + floor({U('filename', 'n')} * 5) END, greatest(n_words // 5, n_boxes // 20)) AS INT) AS n_changes FROM q)
"""
TARGETS = BUDGET + f""", r AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY {U("filename || ':' || box_id", 'target')}, box_id) AS draw FROM boxes),
targets AS (SELECT r.* FROM r JOIN budgets USING (filename) WHERE draw <= n_changes)
"""


@query("m2_manipulation_budget", BUDGET + "SELECT * FROM budgets")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.budget(boxes(spark, sf_dir))


@query("m3_branches_and_s6_targets", TARGETS + f"""
, u AS (SELECT filename, box_id, CAST(draw AS INT) AS draw, {U("filename || ':' || box_id", 'branch')} AS u FROM targets)
SELECT filename, box_id, draw, CASE WHEN u >= 0.65 THEN 'splicing' WHEN u >= 0.55 THEN 'coverage' WHEN u >= 0.45 THEN 'inpaint' WHEN u >= 0.35 THEN 'blank' WHEN u >= 0.325 THEN 'insertion' ELSE 'copy_move' END AS kind FROM u""")
def m3(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = chosen(spark, sf_dir)
    return t.select("filename", "box_id", "draw", candidates.branch(t).alias("kind"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.budgeted(boxes(spark, sf_dir))


DISTANCE = "((abs(t.{0}[1] - c.{0}[1]) + abs(t.{0}[2] - c.{0}[2]) + abs(t.{0}[3] - c.{0}[3])) / 3.0::DOUBLE)"


SPLICED = TARGETS + f"""
, s AS (SELECT len_text, Width, Height, CAST(ceil(count(*) / 2000.0::DOUBLE) AS INT) AS n_chunks FROM boxes GROUP BY 1, 2, 3),
tc AS (SELECT t.*, CAST(floor({U("filename || ':' || box_id", 'look')} * n_chunks) AS INT) AS chunk FROM targets t JOIN s USING (len_text, Width, Height)),
bc AS (SELECT b.*, CAST(floor({U("filename || ':' || box_id", 'chunk')} * n_chunks) AS INT) AS chunk FROM boxes b JOIN s USING (len_text, Width, Height)),
p AS (SELECT t.filename, t.box_id, c.filename AS source, c.box_id AS source_box, greatest({DISTANCE.format('fg_color')}, {DISTANCE.format('bg_color')}) AS d, ({DISTANCE.format('fg_color')} + {DISTANCE.format('bg_color')}) / 2 AS mean_d
  FROM tc t JOIN bc c ON t.chunk = c.chunk AND t.len_text = c.len_text AND t.Width = c.Width AND t.Height = c.Height AND t.filename <> c.filename AND trim(t.text) <> trim(c.text)),
n AS (SELECT filename, box_id, {', '.join(f'count(*) FILTER (d <= {t}) AS n{t}' for t in range(1, 7))} FROM p GROUP BY 1, 2),
k AS (SELECT p.*, coalesce({', '.join(f'CASE WHEN n{t} <= 500 THEN {t} END' for t in range(6, 0, -1))}, 1) AS tau FROM p JOIN n USING (filename, box_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY filename, box_id ORDER BY {U("filename || ':' || box_id || ':' || source || ':' || source_box", 'splice')}, source, source_box) AS place FROM k WHERE d <= tau)
"""


@query("j4_splicing", SPLICED + """SELECT filename, box_id, CAST(tau AS INT) AS tau, count(*) AS n, min_by(source, place) AS source, min_by(source_box, place) AS source_box FROM o WHERE place <= 500 GROUP BY 1, 2, 3""")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500 candidates for each target, tolerances from 6 down, chunks of some 2,000 boxes."""
    s = candidates.within(pages.splicing_pairs(table(spark, sf_dir, "documents")))
    return s.groupBy("filename", "box_id", "tau").agg(F.count(F.lit(1)).alias("n"), F.min_by("source", "place").alias("source"), F.min_by("source_box", "place").alias("source_box"))


@query("j5_blank_cells_and_u4_difference", LAYOUT + """
, p AS (SELECT filename, max(page_w) AS w, max(page_h) AS h FROM boxes GROUP BY filename),
y AS (SELECT filename, w, h, unnest(range(0, (h + 19) // 20)) AS cy FROM p),
g AS (SELECT filename, w, h, cy, unnest(range(0, (w + 39) // 40)) AS cx FROM y),
t AS (SELECT DISTINCT filename, cx, unnest(range(H_b // 20, (H_h - 1) // 20 + 1)) AS cy FROM (SELECT filename, H_b, H_h, unnest(range(W_d // 40, (W_g - 1) // 40 + 1)) AS cx FROM boxes))
SELECT filename, CAST(count(*) AS BIGINT) AS n, CAST(sum((least((cx + 1) * 40, w) - cx * 40) * (least((cy + 1) * 20, h) - cy * 20)) AS BIGINT) AS area FROM g ANTI JOIN t USING (filename, cx, cy) GROUP BY filename""")
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geometry.blank_cells(boxes(spark, sf_dir))
    return c.groupBy("filename").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("W_g") - F.col("W_d")) * (F.col("H_h") - F.col("H_b"))).cast("long").alias("area"))


KEY = "filename || ':' || box_id || ':' || try"


@query("j6_blank_place", TARGETS + f"""
, c AS (SELECT *, CAST(floor({U(KEY, 'x')} * greatest(page_w - Width, 1)) AS INT) AS x, CAST(floor({U(KEY, 'y')} * greatest(page_h - Height, 1)) AS INT) AS y FROM (SELECT filename, box_id, Width, Height, page_w, page_h, unnest(range(1, 41)) AS try FROM targets)),
f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.filename = c.filename AND c.x <= b.W_g AND c.x + c.Width >= b.W_d AND c.y <= b.H_h AND c.y + c.Height >= b.H_b))
SELECT filename, box_id, CAST(min(try) AS INT) AS try, min_by(x, try) AS W_d, min_by(x + Width, try) AS W_g, min_by(y, try) AS H_b, min_by(y + Height, try) AS H_h FROM f GROUP BY 1, 2""")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.blank_place(chosen(spark, sf_dir), boxes(spark, sf_dir))


@query("j7_nearest_same_size", LAYOUT + """
, p AS (SELECT a.filename, a.box_id, b.box_id AS nearest, CAST((a.W_d + a.W_g - b.W_d - b.W_g) AS BIGINT) * (a.W_d + a.W_g - b.W_d - b.W_g) + CAST((a.H_b + a.H_h - b.H_b - b.H_h) AS BIGINT) * (a.H_b + a.H_h - b.H_b - b.H_h) AS distance
  FROM boxes a JOIN boxes b ON a.filename = b.filename AND a.Width = b.Width AND a.Height = b.Height AND a.box_id <> b.box_id)
SELECT filename, box_id, min_by(nearest, (distance, nearest)) AS nearest, min(distance) AS distance FROM p GROUP BY 1, 2""")
def j7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.by_document(table(spark, sf_dir, "documents"), pages.nearest_same_size, "filename string, box_id int, nearest int, distance long")


@query("j13_overlap_and_c11_collide", LAYOUT + """
SELECT a.filename, count(*) FILTER (a.W_d < b.W_g AND a.W_g > b.W_d AND a.H_b < b.H_h AND a.H_h > b.H_b) AS n_overlap, count(*) AS n_touch FROM boxes a JOIN boxes b ON a.filename = b.filename AND a.box_id < b.box_id AND b.box_id < a.box_id + 70
WHERE a.W_d <= b.W_g AND a.W_g >= b.W_d AND a.H_b <= b.H_h AND a.H_h >= b.H_b GROUP BY a.filename""")
def j13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.overlap_counts(boxes(spark, sf_dir))


CHAINED = LAYOUT + """
, f AS (SELECT *, CASE WHEN abs(H_b - lag(H_b) OVER o) > 1 OR abs(H_h - lag(H_h) OVER o) > 1 THEN 1 ELSE 0 END AS new FROM boxes WINDOW o AS (PARTITION BY filename ORDER BY H_b, W_d, box_id)),
lines AS (SELECT *, CAST(sum(new) OVER (PARTITION BY filename ORDER BY H_b, W_d, box_id) AS INT) AS line_id FROM f)
"""


@query("w1_lines_chained", CHAINED + "SELECT filename, box_id, line_id FROM lines")
def w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.chained(boxes(spark, sf_dir)).select("filename", "box_id", "line_id")


@query("w2_lines_anchored", LAYOUT + """
, g AS (SELECT filename, list({'id': box_id, 'top': H_b, 'bottom': H_h, 'line': -1, 'lines': CAST([] AS INT[])} ORDER BY H_b, W_d, box_id) AS l FROM boxes GROUP BY filename),
f AS (SELECT filename, list_transform(l, lambda x: x.id) AS ids,
  list_reduce(l, lambda a, x: CASE WHEN abs(x.top - a.top) > 2 OR abs(x.bottom - a.bottom) > 2 THEN {'id': x.id, 'top': x.top, 'bottom': x.bottom, 'line': a.line + 1, 'lines': list_append(a.lines, CAST(a.line + 1 AS INT))}
      ELSE {'id': x.id, 'top': a.top, 'bottom': a.bottom, 'line': a.line, 'lines': list_append(a.lines, a.line)} END,
    {'id': -1, 'top': -1000000, 'bottom': -1000000, 'line': -1, 'lines': CAST([] AS INT[])}).lines AS lines FROM g)
SELECT filename, unnest(ids) AS box_id, unnest(lines) AS line_id FROM f""")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.anchored_arrow(boxes(spark, sf_dir))


@query("w3_segments_and_g6", LAYOUT + """
, l AS (SELECT *, box_id // 30 AS line_id FROM boxes),
s AS (SELECT *, row_number() OVER (PARTITION BY filename, line_id ORDER BY W_d, box_id) AS first FROM l),
n AS (SELECT unnest([2, 3, 4, 5]) AS n),
g AS (SELECT a.filename, a.line_id, a.first, n, count(*) AS k, min(b.W_d) AS W_d, max(b.W_g) AS W_g, min(b.H_b) AS H_b, max(b.H_h) AS H_h, string_agg(b.text, ' ' ORDER BY b.first) AS text, sum(b.fg_color[1]) AS f1, sum(b.bg_color[2]) AS b2
  FROM s a, n JOIN s b ON a.filename = b.filename AND a.line_id = b.line_id AND b.first >= a.first AND b.first < a.first + n GROUP BY 1, 2, 3, 4)
SELECT filename, CAST(n AS INT) AS n, count(*) AS n_segments, CAST(sum(W_d) AS BIGINT) AS sum_left, CAST(sum(W_g) AS BIGINT) AS sum_right, CAST(sum(H_b) AS BIGINT) AS sum_top, CAST(sum(H_h) AS BIGINT) AS sum_bottom,
  CAST(sum(length(text)) AS BIGINT) AS chars, max(text) AS last_text, CAST(sum(CAST(round_even(CAST(f1 AS DOUBLE) / n, 0) AS INT)) AS BIGINT) AS fg, CAST(sum(CAST(round_even(CAST(b2 AS DOUBLE) / n, 0) AS INT)) AS BIGINT) AS bg FROM g WHERE k = n GROUP BY 1, 2""")
def w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of two to five boxes on each grid row, summed by document and length."""
    s = lines.segments(boxes(spark, sf_dir).withColumn("line_id", F.expr("cast(box_id div 30 as int)")))
    t = lambda c, name: F.sum(c).cast("long").alias(name)
    return s.groupBy("filename", "n").agg(
        F.count(F.lit(1)).alias("n_segments"), t("W_d", "sum_left"), t("W_g", "sum_right"), t("H_b", "sum_top"), t("H_h", "sum_bottom"), t(F.length("text"), "chars"), F.max("text").alias("last_text"), t(F.col("fg_color")[0], "fg"), t(F.col("bg_color")[1], "bg")
    )


@query("w4_cap_and_s5_sample", LAYOUT + f"""
SELECT filename, box_id FROM (SELECT filename, box_id, row_number() OVER (PARTITION BY filename ORDER BY {U("filename || ':' || box_id", 'cap')}, box_id) AS k FROM boxes) WHERE k <= 100""")
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of at most 100 boxes of each document, drawn by hash."""
    return lines.capped(boxes(spark, sf_dir), ["box_id"], 100).select("filename", "box_id")


VECTORS = """
WITH e AS (SELECT vec_id, label, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS a, list_transform(embedding[33:64], lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
h AS (SELECT vec_id, label, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb, a, b FROM e),
queries AS (SELECT * FROM h WHERE vec_id % 50 = 0),
pairs AS (SELECT q.vec_id, c.vec_id AS candidate, c.label, list_dot_product(q.a, c.a) / (q.na * c.na) AS s0, list_dot_product(q.b, c.b) / (q.nb * c.nb) AS s1 FROM queries q JOIN h c ON c.vec_id <> q.vec_id)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries, whose id is divisible by 50, against all vectors."""
    h = candidates.halves(table(spark, sf_dir, "embeddings"))
    pairs = candidates.against_all(h.where("vec_id % 50 = 0"), h, "vec_id")
    return pairs.select("q.vec_id", F.col("c.vec_id").alias("candidate"), F.col("c.label").alias("label"), candidates.similarity("q", "c").alias("score"), candidates.similarity("q", "c", F.lit(True)).alias("blank_score"))


@query("k2_similarity_and_j18", VECTORS + "SELECT vec_id, candidate, round((s0 + s1) / 2, 6) AS score, round(s0, 6) AS blank_score FROM pairs")
def k2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("vec_id", "candidate", F.round("score", 6).alias("score"), F.round("blank_score", 6).alias("blank_score"))


@query("k3_choose_crop_and_w5", VECTORS + f"""
, s AS (SELECT vec_id, candidate, round((s0 + s1) / 2, 9) AS score FROM pairs),
w AS (SELECT *, CASE WHEN score > 0.3 THEN ln(greatest({U("vec_id || ':' || candidate", 'choose')}, 1e-12)) / pow(10 * (score - 0.3) + 0.8, 2.5) END AS k FROM s)
SELECT vec_id, count(*) FILTER (score > 0.3) AS n_over, coalesce(arg_max(candidate, (k, -candidate)) FILTER (k IS NOT NULL), arg_max(candidate, (score, -candidate))) AS chosen, count(*) FILTER (score > 0.3) > 0 AS adequate FROM w GROUP BY vec_id""")
def k3(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).withColumn("score", F.round("score", 9))
    return candidates.choose(s, ["vec_id"], "candidate", threshold=0.3)
