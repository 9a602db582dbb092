"""What keeps queries within disk and time on larger tables, and odd rows of it."""

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from boxloom.functions import durable
from boxloom.operators import boxes, candidates, geometry, groups, nested, pages
from boxloom.plans import box_queries, file_queries, registry
from boxloom.sources import bridges, files, lots
from pyspark.sql import functions as F


def test_character_lines_are_split_once(spark):
    rows = [("a 1 2 3 4 0",), ("a b 1 2 3 4 0",), ("x 1 2",), ("x a b c d 0",), (" 1 2 3 4 0",), (None,), ("b -5 2 3 4",), ("c 3 2 3 4 0",)]
    d = spark.createDataFrame(rows, "text string").withColumn("height", F.lit(10))
    found = boxes.parse_char_boxes(d, line="text")
    assert sorted(tuple(r) for r in found.select("text", "W_d", "W_g", "H_b", "H_h").collect()) == [("a", 1, 3, 6, 8), ("b", 0, 3, 6, 8)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_rounds_take_every_row_once(spark):
    """Equal and null keys in one round; an empty round and an empty table are none the worse for it."""
    rows = [(None, "aa"), (None, None), *((k % 5, "word " * k) for k in range(20))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    calls = []

    def body(part):
        calls.append(part.count())
        return part.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))

    found = durable.in_rounds(d, "doc_id", "text", body, most=8, chars=50)
    assert sorted(found.collect(), key=str) == sorted(d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect(), key=str)
    assert len(calls) == 8 and sum(calls) == 22 and 0 in calls
    assert durable.in_rounds(d.limit(0), "doc_id", "text", body).count() == 0


def test_chunks_come_from_counts(spark):
    """a13: documents of one id, of none and without words; no box is laid out, and no row stands for a single word beyond the counting."""
    rows = [(k % 7, " ".join("ab" if i % 3 else "c" for i in range(5 * k % 23))) for k in range(30)] + [(None, "ab ab c"), (8, None), (9, " \t")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 4, 50, 1000):
        found = groups.chunk_ends(bridges.word_lengths(d), ["len_text"], "filename", size)
        got, want = {(r.len_text, r.chunk): (r.n, r["first"], r["last"]) for r in found.collect()}, {}
        for length in (1, 2):
            names = sorted((None if k is None else str(k) for k, t in rows for w in (t or "").split() if len(w) == length), key=lambda x: (x is None, x))
            for at, name in enumerate(names):
                want.setdefault((length, min(at // size, max(-(-len(names) // size) - 2, 0))), []).append(name)
        assert got == {k: (len(v), min((x for x in v if x), default=None), max((x for x in v if x), default=None)) for k, v in want.items()}
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()


def odd_documents(spark):
    """Documents of one id, of none, without words; long words over many cells, one word only, letters of more than a byte."""
    rng = random.Random(4)
    word = lambda: rng.choice("ab\u00e9") * rng.choice((1, 2, 3, 9, 9, 14)) + rng.choice("xyz")
    rows = [(k // 2 if k < 8 else k, " ".join(word() for _ in range(rng.choice((1, 40, 300, 700))))) for k in range(14)]
    rows += [(None, "aa bb cc dd"), (20, None), (21, " \n"), (22, "one " * 400), (23, "w" * 900 + " " + "v" * 900 + " v" * 40 + "z" * 5000), (24, "ab\u00a0c de\x00f " * 90)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))


@pytest.mark.parametrize("chars", [1, 1 << 20])
def test_boxes_of_a_document_are_not_shuffled(spark, chars):
    """j3 and j7: the rows of the operators on tables of boxes, by one exchange of whole texts."""
    d = odd_documents(spark)
    laid = bridges.layout(d)
    for body, schema, want in (
        (pages.copy_move, "filename string, box_id int, n_candidates long, first_candidate int", candidates.copy_move(laid)),
        (pages.nearest_same_size, "filename string, box_id int, nearest int, distance long", geometry.nearest_same_size(laid)),
    ):
        found = pages.by_document(d, body, schema, chars=chars)
        rows = lambda x: sorted(map(tuple, x.select(*found.columns).collect()))
        assert rows(found) == rows(want) and found.count() > 1000
        assert pages.by_document(d.limit(0), body, schema).count() == 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Generate" not in plan


@pytest.mark.parametrize("chunk", [3, 2000])
def test_splicing_deals_out_packed_boxes(spark, chunk):
    """j4 and w6: the rows of the operator on tables of boxes, of which none is shuffled as a row."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(("a", "b", "é")) * rng.choice((1, 2, 25)) for _ in range(rng.choice((3, 60, 400))))) for k in range(40)] + [(None, "a b a b"), (50, None), (51, " ")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    laid = bridges.layout(d)
    want = candidates.splicing(candidates.budgeted(laid), laid, cap=4, widest=30, chunk=chunk)
    for chars in (1, 1 << 20):
        pairs = pages.splicing_pairs(d, widest=30, chunk=chunk, chars=chars)
        found = candidates.within(pairs, 4, 30)
        columns = ["filename", "box_id", "source", "source_box", "tau", "place", "d", "mean_d"]
        rows = lambda x: sorted(map(tuple, x.select(*columns).collect()))
        assert rows(found) == rows(want) and found.count() > 20
        assert "Generate" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pages.splicing_pairs(d.limit(0)).count() == 0


def by_sql(spark, tmp_path, name, rows):
    """A query's rows of some documents, by its SQL and by its function."""
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    d.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = con.execute(registry.ORACLE[name]).fetchall()
    found = registry.QUERIES[name](spark, str(tmp_path))
    return [sorted(map(tuple, x), key=repr) for x in (want, found.collect())]


def awkward(rng, n):
    """Words that CSV and JSON quote or escape, of one byte to four, and texts without any."""
    words = ["a", "b,c", 'd"e', '"', '""', ",", "\\", "\\n", "\x00", "\x01f", "\u00a0", "\u00e9\u00e9", "\U0001f600", "NA", "null", "007", "'", "[1,2]", "{", "#g", "=1", "w" * 70]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 5, 200))))) for k in range(n)]


@pytest.mark.parametrize("chars", [1, 1 << 20])
def test_box_files_are_written_and_read_by_lots(spark, tmp_path, monkeypatch, chars):
    """a4: the rows of the SQL, those of a word that is a null byte too; no box is a row of Spark's, no file stays."""
    monkeypatch.setattr(pages.in_lots, "__defaults__", ("doc_id", "text", chars))
    rows = [*awkward(random.Random(6), 41), (5, "a b"), (7, "\x00 \x00"), (20, None), (43, " "), (44, None), (None, "a b c")]
    want, found = by_sql(spark, tmp_path, "a4_a5_a6_a7_a10_box_csv", rows)
    assert found == want and len(found) > 25
    (tmp_path / "files").mkdir()
    plan = pages.in_lots(spark.read.parquet(str(tmp_path / "documents.parquet")).where("doc_id > 0"), file_queries.box_files(str(tmp_path / "files")), file_queries.BOX_FILES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Generate" not in text and plan.count() > 25 and not list((tmp_path / "files").iterdir())


def test_odd_box_files_of_a_lot():
    """What isn't as it was written: as files.read_box_files takes it."""
    head = lots.HEAD.decode()
    good, other = 'x,f,1,2,3,1,1,2,0.5,"[1,2,3]","[4,5,6]",1\n', 'y,g,1,2,3,1,1,2,oops,"[1,2]",none,\n'
    contents = [head + good, "q,r\n1,2\n", head + good + "x,f,oops,2\n", head, head + other, head + '"two\nlines",h,1,2,3,1,1,2,0.5,"[1,2,3]","[4,5,6]",9', "", head + good + head]
    table, file, bad = lots.read_csv_files([c.encode() for c in contents])
    assert bad.tolist() == [False, True, True, False, False, False, True, True] and file.tolist() == [0, 4, 5]
    assert table["text"].to_pylist() == ["x", "y", "two\nlines"] and table["ratio"].to_pylist() == [0.5, None, 0.5] and table["len_text"].to_pylist() == [1, None, 9]
    assert [c.to_pylist() for c in lots.channels(table["fg_color"])] == [[1, 1, 1], [2, 2, 2], [3, None, 3]] and lots.channels(table["bg_color"])[1].to_pylist() == [5, None, 5]
    assert [len(x) for x in lots.read_csv_files([])] == [0, 0, 0]


@pytest.mark.parametrize("chars", [1, 1 << 20])
def test_entry_files_are_written_and_read_by_lots(spark, tmp_path, monkeypatch, chars):
    """a8: the rows of the SQL, that of documents without a key too; no box is a row of Spark's, no file stays."""
    monkeypatch.setattr(pages.in_lots, "__defaults__", ("doc_id", "text", chars))
    rows = [*awkward(random.Random(7), 41), (50, None), (51, " "), (52, "\u2028 \x7f \x1b"), (None, "a b\"c \u00e9")]
    want, found = by_sql(spark, tmp_path, "a8_a9_ocr_json", rows)
    assert found == want and len(found) > 25 and any(r[0] is None for r in found)
    (tmp_path / "files").mkdir()
    plan = pages.in_lots(spark.read.parquet(str(tmp_path / "documents.parquet")), file_queries.entry_files(str(tmp_path / "files")), file_queries.ENTRY_FILES)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Generate" not in text and plan.count() > 25 and not list((tmp_path / "files").iterdir())


def test_texts_of_one_document_in_one_file():
    """Boxes of several texts of a document: in order of box_id, then of words."""
    made = dict(lots.entry_files(["1", None], *pages.with_words([["b c", "a d e"], ["x"]])))
    assert sorted(made) == [".json", "1.json"]
    found = lots.read_entry_files([made["1.json"], made[".json"]]).to_pylist()
    assert [[e["Word"] for e in x] for x in found] == [["a", "b", "c", "d", "e"], ["x"]]


def test_odd_entry_files_of_a_lot(spark, tmp_path):
    """The entries that files.ocr_entries reads, of files as written and of others."""
    entry = '{"Word": "x", "BoundingBox": {"W_d": 1, "W_g": 2, "H_b": 3, "H_h": 4}}'
    contents = [f"[{entry}]", f"[{entry}, {entry}]", "[", "", "no", "[]", f'[{{"Word": "a\\nb", "more": [1], "BoundingBox": {{"W_d": 1}}}}]', f"[{entry}], [{entry}]", '[{"BoundingBox": null}]', '[{"Word": "y", "BoundingBox": {"W_d": "z", "W_g": 7}}]']
    for k, c in enumerate(contents):
        (tmp_path / f"{k}.json").write_text(c)
    columns = ["text", "W_d", "W_g", "H_b", "H_h"]
    want = [(int(r.filename.rpartition("/")[2][:-5]), *(r[c] for c in columns)) for r in files.ocr_entries(spark, str(tmp_path)).orderBy("filename", "position").collect()]
    flat = lambda found: [(k, e["Word"], *((e["BoundingBox"] or {}).get(c) for c in columns[1:])) for k, x in enumerate(found) for e in x or []]
    assert flat(lots.read_entry_files([c.encode() for c in contents]).to_pylist()) == want
    plain = [c.encode() for c in contents if c.startswith("[{") and c.count("[") < 3 and '"z"' not in c]
    assert flat(lots.read_entry_files(plain).to_pylist()) == flat([lots.entries(c) for c in plain])


@pytest.mark.parametrize("chars", [1, 1 << 20])
def test_annotations_are_flattened_by_lots(spark, tmp_path, monkeypatch, chars):
    """b1: the rows of the SQL, with characters of four bytes, several texts of one key and none; no box is a row of Spark's."""
    monkeypatch.setattr(pages.in_lots, "__defaults__", ("doc_id", "text", chars))
    rows = [*awkward(random.Random(8), 41), (5, "a b"), (50, None), (51, " "), (52, "one " * 95), (None, "a \U0001f600b"), (None, "c")]
    want, found = by_sql(spark, tmp_path, "b1_bbox_and_b2_flatten", rows)
    assert found == want and len(found) > 50
    plan = pages.in_lots(spark.read.parquet(str(tmp_path / "documents.parquet")), box_queries.flat_sums, box_queries.FLAT_SUMS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan


def test_odd_annotations(spark):
    """Missing corners, numbers and texts, empty and missing lists: as boxes.flatten_annotation takes them."""
    at = lambda *v: [{"x": x, "y": y} for x, y in v]
    symbol = lambda t, *v: {"text": t, "vertices": at(*v)}
    word = lambda symbols, *v: {"symbols": symbols, "vertices": at(*v)}
    page = lambda *paragraphs: {"blocks": [{"paragraphs": [{"words": w} for w in paragraphs]}]}
    good = word([symbol("a", (1, 2), (5, 9)), symbol("\u00e9", (5, None), (None, 9), (7, 3))], (1, 2), (7, 9))
    docs = [
        [page([good, good], [])], [], [page()], None,
        [page([word([symbol(None, (1, 1), (2, 2)), symbol("c", (1, 1), (1, 5))], (3, 3), (4, 9)), word([], (0, 0), (2, 2))], None), page([word(None, (1, 1), (8, 8)), word([symbol("d")])])],
        [page([word([{"text": "e", "vertices": None}], (None, None), (3, 4)), good])],
    ]
    corner = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))
    inner = pa.list_(pa.struct([("symbols", pa.list_(pa.struct([("text", pa.string()), ("vertices", corner)]))), ("vertices", corner)]))
    kind = pa.list_(pa.struct([("blocks", pa.list_(pa.struct([("paragraphs", pa.list_(pa.struct([("words", inner)])))])))]))
    rows = []
    for which, found in nested.flattened(pa.array(docs, kind)).items():
        columns = [found["doc"].tolist(), [which] * len(found["doc"]), found["text"].to_pylist(), *(found[c].tolist() for c in ("W_d", "W_g", "H_b", "H_h"))]
        rows += zip(*columns, strict=True)
        sums = nested.summed(found, len(docs))
        for k, doc in enumerate(sums["doc"].tolist()):
            own = [r for r in zip(*columns, strict=True) if r[0] == doc]
            assert [int(sums[c][k]) for c in ("n", "n_texts", "W_d", "H_h")] == [len(own), len({r[2] for r in own} - {None}), sum(r[3] for r in own), sum(r[6] for r in own)]
    nest = "array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<symbols:array<struct<text:string,vertices:array<struct<x:int,y:int>>>>,vertices:array<struct<x:int,y:int>>>>>>>>>>"
    d = spark.createDataFrame(list(enumerate(docs)), f"filename int, pages {nest}")
    want = boxes.flatten_annotation(d).select("filename", "kind", "text", "W_d", "W_g", "H_b", "H_h")
    assert sorted(rows, key=repr) == sorted(map(tuple, want.collect()), key=repr) and len(rows) > 12
    assert [len(x["doc"]) for x in nested.flattened(pa.array([], kind)).values()] == [0, 0]
    assert len(nested.summed({"doc": np.zeros(0, int), "text": pa.array([], pa.string()), **{c: np.zeros(0, int) for c in ("W_d", "W_g", "H_b", "H_h")}}, 0)["doc"]) == 0
