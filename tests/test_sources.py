"""Files written and read again, against SQL and by hand."""

import os

import duckdb
import numpy as np
import pytest
from boxloom.operators import raster, workflow
from boxloom.plans import registry
from boxloom.sources import files, rasters
from pyspark.sql import functions as F

from .conftest import SF

NAMES = [n for n in registry.QUERIES if n.split("_")[0] in {"a1", "a4", "a8", "a12", "a14", "a15", "a16", "a18", "a19", "a20", "a22", "a25", "r5", "k1", "m5", "m4", "s4", "r1", "w2"}]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    want = sql.execute(registry.ORACLE[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in columns]
    rows = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert sorted(got.columns) == columns and sorted(repr(tuple(r)) for r in got.select(*(got[c] for c in columns)).collect()) == rows and rows


def test_png():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 7), (4, 9, 3)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (rasters.read_png(rasters.png(a)) == a).all()
    whole = rasters.png(np.zeros((3, 3), np.uint8))
    for broken in (None, b"", b"GIF89a", whole[:20], whole[:45], whole.replace(b"IDAT", b"IDAX")):
        assert rasters.read_png(broken) is None


def test_named_files(spark, tmp_path):
    d = spark.createDataFrame([("a/b.txt", "one"), ("c.txt", "two")], "path string, content string")
    assert rasters.write_files(d, str(tmp_path)) == 2 and (tmp_path / "a" / "b.txt").read_text() == "one"
    assert rasters.write_files(d.withColumn("content", F.lit("new")), f"file://{tmp_path}", overwrite=False) == 0 and (tmp_path / "c.txt").read_text() == "two"
    assert rasters.write_files(d.withColumn("content", F.lit("new")), str(tmp_path)) == 2 and (tmp_path / "c.txt").read_text() == "new"
    assert rasters.write_files(d.limit(0), str(tmp_path)) == 0 and sorted(os.listdir(tmp_path)) == ["a", "c.txt"]


def test_broken_box_files_warn(spark, tmp_path):
    header = ",".join(files.BOXES.names)
    (tmp_path / "good.csv").write_text(f'{header}\n"a, ""b""",f,1,2,3,1,1,2,0.5,"[1,2,3]","[4,5,6]",6\n')
    (tmp_path / "short.csv").write_text(f"{header}\nx,f,oops,2\n")
    (tmp_path / "other.csv").write_text("q,r\n1,2\n")
    with pytest.warns(UserWarning, match="2 files are no box tables"):
        rows, bad = files.read_box_files(spark, str(tmp_path))
    assert [(r.text, r.fg_color, r.len_text) for r in rows.collect()] == [('a, "b"', [1, 2, 3], 6)] and bad.count() == 2
    assert sorted(r.stem for r in files.csv_files(spark, str(tmp_path)).collect()) == ["good", "other", "short"]


def test_masks_by_the_first_image(spark, tmp_path):
    for folder, names in (("i", ("a.jpg", "b.jpg", "c.png")), ("m", ("a.jpg", "b.png", "c.png"))):
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_bytes(b"x")
    names = lambda once: sorted(r.name for r in files.pairs(spark, str(tmp_path / "i"), str(tmp_path / "m"), once=once).collect())
    assert names(False) == ["a.jpg", "b.jpg", "c.png"] and names(True) == ["a.jpg", "c.png"]
    os.remove(tmp_path / "m" / "a.jpg")
    assert names(True) == ["b.jpg", "c.png"]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("a: 1\nb:\n  x: 2.5\n  y: true\nc:\n- p q\n- 3\nd: [1, 'z'] # note\ne:\n")
    got = files.read_config(spark, str(tmp_path / "c.yaml"), {"a": 9, "f": 8}, {"e": "('t', 1)", "g": "plain text"})
    assert got == {"a": 1, "b": {"x": 2.5, "y": True}, "c": ["p q", 3], "d": [1, "z"], "e": ("t", 1), "f": 8, "g": "plain text"}


def test_cuts():
    page = np.full((60, 60), 255.0)
    page[20:26, 20:40] = 0  # a word
    assert raster.cuts(page, 15, 45, 15, 31) == (False, False)  # whole
    assert raster.cuts(page, 15, 30, 15, 31) == (True, True)  # cut at the right
    assert raster.cuts(page, 42, 55, 15, 31)[0] is False  # beside it
    page[40:44, 20:22] = 0
    assert raster.cuts(page, 23, 50, 38, 48) == (False, False)
    assert raster.cuts(page, 22, 50, 38, 48)[1] is True  # touches what stands right beside the crop


def test_memory_bank(spark):
    rows = [(k, s, 100 * s + i) for k in "ab" for s in range(6) for i in range(s if k == "a" else 5 * (s == 1))]
    got = {(r.k, r.s): (r.n_held, r.oldest, len(r["items"])) for r in workflow.memory_bank(spark.createDataFrame(rows, "k string, s int, i int"), "k", "s", "i", steps=3, most=4).collect()}
    for k, s in [(k, s) for k in "ab" for s in range(1, 6)]:
        n = {t: min(4, t if k == "a" else 5 * (t == 1)) for t in range(s - 2, s + 1) if t > 0}
        held = {t: v for t, v in n.items() if v}
        assert got.get((k, s)) == ((sum(held.values()), min(held), sum(held.values())) if held else None), (k, s)


@pytest.mark.parametrize("block", [2000, 3])
def test_query_sets_in_blocks(spark, monkeypatch, block):
    from boxloom.operators import candidates

    monkeypatch.setattr(candidates, "BLOCK_QUERIES", block)
    d = spark.range(40).toDF("id")
    got = candidates.against_all(d.where("id % 4 = 0"), d, "id").select("q.id", F.col("c.id").alias("other")).collect()
    assert sorted(map(tuple, got)) == [(q, c) for q in range(0, 40, 4) for c in range(40) if c != q]


def test_nearest_boxes_of_lonely_ones(spark):
    from boxloom.operators import geometry

    rows = [("a", i, x, x + 10, y, y + 5, 10, 5) for i, (x, y) in enumerate([(0, 0), (3, 1), (900, 0), (5000, 4000), (-700, 20), (3, 1)])] + [("a", 90, 0, 11, 0, 5, 11, 5), ("b", 0, 0, 10, 0, 5, 10, 5), ("b", 1, 40000, 40010, 0, 5, 10, 5)]
    d = spark.createDataFrame(rows, "filename string, box_id int, W_d int, W_g int, H_b int, H_h int, Width int, Height int")
    got = {(r.filename, r.box_id): (r.nearest, r.distance) for r in geometry.nearest_same_size(d).collect()}
    want = {}
    for f, i, x1, x2, y1, y2, w, h in rows:
        found = [((x1 + x2 - a - b) ** 2 + (y1 + y2 - c - e) ** 2, j) for g, j, a, b, c, e, v, k in rows if (g, v, k) == (f, w, h) and j != i]
        if found:
            want[f, i] = min(found)[::-1]
    assert got == want and geometry.nearest_same_size(d.limit(0)).count() == 0


def test_filling():
    """Diffusion fills a hole in a plane exactly; without a hole, or with nothing else, nothing changes."""
    a = np.add.outer(3.0 * np.arange(9), 2.0 * np.arange(7))
    hole = np.zeros(a.shape, bool)
    hole[3:6, 2:5] = True
    assert np.abs(raster.filled(np.where(hole, 0, a), hole, 2000) - a).max() < 1e-6
    assert (raster.filled(a, np.zeros(a.shape, bool)) == a).all() and (raster.filled(a, np.ones(a.shape, bool)) == a).all()
    corner = np.zeros(a.shape, bool)
    corner[0, 0] = True
    assert abs(raster.filled(a, corner, 5)[0, 0] - (a[0, 1] + a[1, 0]) / 2) < 1e-9


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from boxloom.functions.durable import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master=master, setCheckpointDir=lambda _: None))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master, None))
        assert shared_folder(session(master, "s3://shared")) == "s3://shared"
    assert shared_folder(session("local[4]", None))
