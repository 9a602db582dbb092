"""Fixtures whose results follow from the operators' definitions."""

import itertools

import numpy as np
import pytest
from boxloom.functions import draws, scalars
from boxloom.operators import boxes, candidates, frequency, geometry, groups, lines, metrics, mining, raster, sampling, workflow
from boxloom.sources import bridges
from pyspark.sql import functions as F

from .conftest import SF

BOX = "filename string, box_id int, text string, W_d int, W_g int, H_b int, H_h int"


def made(spark, *rows, name="f"):
    return spark.createDataFrame([(name, i, "t", *r) for i, r in enumerate(rows)], BOX)


def test_mutual_duplicates_both_go(spark):
    d = made(spark, (0, 10, 0, 10), (1, 11, 0, 10), (50, 60, 0, 10))
    assert [r.box_id for r in geometry.dedup(d).collect()] == [2]
    assert geometry.dedup(made(spark, (0, 100, 0, 100), (0, 10, 0, 10))).count() == 2


def test_vertices_and_padding(spark):
    v = spark.createDataFrame([("f", [(5, None), (5, 9), (None, 9), (None, None)])], "filename string, vertices array<struct<x:int,y:int>>")
    assert boxes.bounding_box(v).select("W_d", "W_g", "H_b", "H_h").first() == (0, 5, 0, 9)
    p = made(spark, (0, 10, 0, 5)).withColumns({"page_w": F.lit(10), "page_h": F.lit(5)})
    assert boxes.pad(p).select("W_d", "W_g", "H_b", "H_h").first() == (0, 10, 0, 5)


def test_open_and_closed_boxes(spark):
    a, b = made(spark, (0, 10, 0, 10)).alias("a"), made(spark, (10, 20, 0, 10)).alias("b")
    r = a.crossJoin(b).select(scalars.overlaps("a", "b"), scalars.collides("a", "b")).first()
    assert tuple(r) == (False, True)


def test_one_blank_cell(spark):
    d = made(spark, (5, 12, 0, 3)).withColumns({"page_w": F.lit(25), "page_h": F.lit(10)})
    assert [tuple(r)[1:] for r in geometry.blank_cells(d, 10, 10).collect()] == [(20, 25, 0, 10)]


def test_lines(spark):
    d = made(spark, (0, 5, 0, 10), (10, 15, 1, 11), (20, 25, 2, 12), (30, 35, 3, 13))
    assert [r.line_id for r in lines.chained(d).orderBy("box_id").collect()] == [0, 0, 0, 0]
    for way in (lines.anchored, lines.anchored_arrow):
        assert [r.line_id for r in way(d).orderBy("box_id").collect()] == [0, 0, 0, 1]


def test_anchored_lines_against_brute_force(spark):
    d = bridges.boxes(spark, SF)
    rows = sorted((r.filename, r.H_b, r.W_d, r.box_id, r.H_h) for r in d.collect())
    want = {}
    for name, group in itertools.groupby(rows, key=lambda r: r[0]):
        line, top, bottom = -1, -99999, -99999
        for _, t, _, box, b in group:
            if abs(t - top) > 2 or abs(b - bottom) > 2:
                line, top, bottom = line + 1, t, b
            want[name, box] = line
    assert {(r[0], r[1]): r[2] for r in lines.anchored_arrow(d).collect()} == want


@pytest.mark.parametrize("least,most,n", [(2, 4, 6), (1, 4, 10)])
def test_segments_of_four(spark, least, most, n):
    d = made(spark, *[(10 * i, 10 * i + 5, 0, 5) for i in range(4)]).withColumns({"line_id": F.lit(0), "fg_color": F.array(*map(F.lit, (1, 2, 3))), "bg_color": F.array(*map(F.lit, (4, 5, 6)))})
    assert lines.segments(d, least, most).count() == n


def test_chunks_and_shards(spark):
    for n, sizes in ((5000, [2000, 3000]), (2500, [2500])):
        c = groups.chunks(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"])
        assert [r["count"] for r in c.groupBy("chunk").count().orderBy("chunk").collect()] == sizes
    s = groups.array_split(spark.range(10), ["id"], 4)
    assert [r["count"] for r in s.groupBy("shard").count().orderBy("shard").collect()] == [3, 3, 2, 2]


def test_budget(spark):
    rows = [("f", i, "word" if i < 12 else "c", 0, 1, 0, 1) for i in range(30)]
    d = spark.createDataFrame(rows, BOX).withColumn("len_text", F.length("text"))
    assert candidates.budget(d, none=0.0, most=5).first().n_changes <= 2


def test_scalars(spark):
    one = spark.range(1)
    assert one.select(*(scalars.resize_scale(F.lit(w), F.lit(h)) for w, h in ((100, 32), (2000, 64)))).first()[:] == (2.0, 0.512)
    assert one.select(scalars.color_distance(F.array(*map(F.lit, (0, 0, 0))), F.array(*map(F.lit, (3, 6, 9))))).first()[0] == 6.0
    assert one.select(scalars.color_distance(F.lit(None).cast("array<int>"), F.array(*map(F.lit, (3, 6, 9))))).first()[0] == float("inf")
    assert [one.select(scalars.base_name(F.lit(x))).first()[0] for x in ("a_b_12.png", "_1.png", "x.png")] == ["a_b", None, None]
    assert one.select(scalars.tag(F.lit(" /data/Some/ "))).first()[0] == "some"
    assert one.select(scalars.safe_round(F.lit(float("nan"))), scalars.safe_round(F.lit(2.5))).first()[:] == (-100, 2)
    import hashlib

    assert one.select(draws.md5_shard(F.lit("abc"), 97)).first()[0] == int(hashlib.md5(b"abc").hexdigest(), 16) % 97
    assert one.select(draws.sha1_shard(F.lit("abc"), 97)).first()[0] == int(hashlib.sha1(b"abc").hexdigest(), 16) % 97


def test_quality_tables_and_quantisation(spark):
    t = [spark.range(1).select(frequency.quality_table(F.lit(q))[0]).first()[0] for q in (50, 100, 10)]
    assert t == [16, 1, 80]
    q = frequency.quantise(F.array(*map(F.lit, (25.0, -25.0, 500.0))), F.array(*map(F.lit, (10, 10, 1))))
    assert spark.range(1).select(q).first()[0] == [2, 2, 20]


def test_transform_and_back(spark):
    rng = np.random.default_rng(0)
    b = [float(x) for x in rng.integers(0, 256, 64)]
    d = spark.createDataFrame([(b,)], "b array<double>").select(frequency.dct(F.col("b"), 128.0).alias("c"))
    c = np.array(d.first().c)
    assert np.isclose((c**2).sum(), ((np.array(b) - 128) ** 2).sum())
    back = d.select(frequency.inverse_dct(F.col("c"), 128.0)).first()[0]
    assert np.allclose(back, b)
    assert sorted(frequency.zigzag()) == list(range(64)) and frequency.zigzag()[:6] == [0, 1, 8, 16, 9, 2]


def test_sweep_equals_brute_force(spark):
    rows = [(v, bool(v % 3)) for v in range(0, 256, 5)]
    d = spark.createDataFrame(rows, "v int, gt boolean")
    got = {round(r.threshold * 100): (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_sweep(d, F.col("gt"), F.col("v")).collect()}
    for t in range(1, 100):
        hit = [v >= 255 * t // 100 + 1 for v, _ in rows]
        assert got[t] == tuple(sum(h == a and g == b for h, (_, g) in zip(hit, rows)) for a, b in ((True, True), (True, False), (False, True), (False, False)))
    d = spark.createDataFrame([(255, True), (128, True), (128, False), (0, False)], "v int, gt boolean")
    half = metrics.threshold_sweep(d, F.col("gt"), F.col("v")).where("threshold = 0.5").first()
    assert (half.tp, half.fp, half.fn, half.tn) == (2, 1, 0, 1)


def test_tiles(spark):
    s = spark.createDataFrame([(2500, 1000)], "h int, w int")
    assert [r.top for r in frequency.tiles(s, 1024).orderBy("top").collect()] == [0, 1024, 1476]
    cover = np.zeros((2500, 1000), bool)
    for r in frequency.sliding(s, 512, 341).collect():
        cover[r.top : r.top + 512, r.left : r.left + 512] = True
    assert cover.all()


def test_resumption_and_validation(spark):
    e = spark.createDataFrame([(1, "a", 3), (2, "a", 3), (3, "b", 1)], "item long, tag string, factor int")
    r = workflow.resume(e, spark.createDataFrame([(1,), *[(2,)] * 5], "item long"))
    assert {x.item: (x.left, x.over) for x in r.collect()} == {1: (2, 0), 2: (0, 2), 3: (1, 0)}
    assert sorted((x.item, x.idx) for x in workflow.expand(r).collect()) == [(1, 0), (1, 1), (3, 0)]
    i = spark.createDataFrame([("a", 2047, 5, 5), ("b", 4000, 5, 5), ("c", 4000, 5, 5), ("d", 4000, None, None)], "name string, bytes long, w int, h int")
    m = spark.createDataFrame([("a", 9, 5, 5), ("b", 9, 5, 6), ("e", 9, 5, 5), ("d", 9, 5, 5)], "name string, bytes long, w int, h int")
    assert {x.name: x.reason for x in workflow.validate(i, m).collect()} == {"a": "too_small_image", "b": "shape_mismatch", "c": "missing_mask", "d": "read_fail_image", "e": "missing_image"}


def test_groups_need_two_files(spark):
    d = spark.createDataFrame([("f", str(i), 1, 2, 3) for i in range(4)], "filename string, text string, len_text int, Width int, Height int")
    assert groups.valid_groups(d).count() == 0
    assert groups.valid_groups(d.unionByName(d.withColumn("filename", F.lit("g")))).count() == 1


def test_quotas_give_what_small_bins_lack(spark):
    s = spark.createDataFrame([("f", 0, 2), ("f", 1, 50), ("f", 2, 50)], "filename string, bin int, n int")
    assert {r.bin: r.quota for r in mining.quotas(s, ["filename"], "bin", "n", 32).collect()} == {0: 2, 1: 15, 2: 15}


def test_samples(spark):
    d = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert {r["count"] for r in sampling.sample(d, ["g"], "id", 10).groupBy("g").count().collect()} == {10}
    f = sampling.fill(d, ["g"], "id", 500)
    assert {r["count"] for r in f.groupBy("g").count().collect()} == {500}


def test_components_and_cuts():
    rng = np.random.default_rng(2)
    for _ in range(30):
        mask = rng.random((9, 11)) < 0.4
        seen, areas = set(), []
        for start in zip(*np.nonzero(mask)):
            if start in seen:
                continue
            todo, area = [start], 0
            seen.add(start)
            while todo:
                y, x = todo.pop()
                area += 1
                for n in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if n not in seen and 0 <= n[0] < 9 and 0 <= n[1] < 11 and mask[n]:
                        seen.add(n)
                        todo.append(n)
            areas.append(area)
        assert sorted(c[4] for c in raster.components(mask)) == sorted(areas)
    page = np.full((12, 12), 250.0)
    page[4:7, 4:7] = 10
    assert not raster.is_cut(page) and raster.is_cut(page[:, 5:])


def test_local_mean_is_brute_mean():
    a = np.random.default_rng(0).random((9, 9))
    m, s = raster.window_stats(a, 5)
    p = np.pad(a, 2, mode="reflect")
    w = [[p[y : y + 5, x : x + 5] for x in range(9)] for y in range(9)]
    assert np.allclose(m, [[v.mean() for v in r] for r in w]) and np.allclose(s, [[v.std() for v in r] for r in w])


def test_running_mean_over_blocks(spark):
    d = spark.range(500).select("id", (F.col("id") % 2).alias("g"), (F.col("id") * 7 % 101).cast("double").alias("v"))
    rows = sorted(d.collect())
    want = {}
    for g in (0, 1):
        v = [r.v for r in rows if r.g == g]
        ids = [r.id for r in rows if r.g == g]
        want |= {i: sum(v[max(0, k - 9) : k + 1]) / len(v[max(0, k - 9) : k + 1]) for k, i in enumerate(ids)}
    for block in (10, 64, 10**6):
        got = {r.id: r.running for r in metrics.running_mean(d, "g", ["id"], "v", 10, block).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_flagship(spark):
    assert {"filename", "box_id", "n_candidates", "first_candidate"} == set(candidates.copy_move(bridges.boxes(spark, SF)).columns)
