import struct

from boxloom.sources import bridges, files
from boxloom.streaming import running
from pyspark.sql import functions as F

from .conftest import SF


def test_boxes_survive_csv(spark, tmp_path):
    b = bridges.boxes(spark, SF).where("box_id < 5")
    odd = b.limit(1).withColumn("text", F.lit('NA, "007"\nnull'))
    b = b.unionByName(odd)
    files.write_boxes(b, str(tmp_path / "csv"))
    got = files.read_boxes(spark, str(tmp_path / "csv"))
    columns = ["text", "filename", "W_d", "ratio", "fg_color", "len_text"]
    assert sorted(map(repr, got.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def test_entries_survive_json(spark, tmp_path):
    b = bridges.boxes(spark, SF).where("filename IN ('1', '2')")
    files.entries_json(b).where("filename = '1'").select("value").coalesce(1).write.text(str(tmp_path / "json"))
    got = files.ocr_entries(spark, str(tmp_path / "json" / "*.txt"))
    want = b.where("filename = '1'").orderBy("box_id").select("text", "W_d", "W_g", "H_b", "H_h").collect()
    assert [tuple(r)[2:] for r in got.orderBy("position").collect()] == [tuple(r) for r in want]


def test_groups_are_pruned(spark, tmp_path):
    b = bridges.boxes(spark, SF)
    files.write_groups(b, str(tmp_path / "g"))
    r = b.groupBy("len_text", "Width", "Height").count().orderBy(F.desc("count"), "len_text", "Width", "Height").first()
    g = files.read_group(spark, str(tmp_path / "g"), r.len_text, r.Width, r.Height)
    assert g.count() == r["count"]
    plan = g._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(len_text" in plan and "EqualTo(Width" in plan


def test_resume_map(spark, tmp_path):
    d = spark.createDataFrame([(2, 1), (1, 3), (3, 0)], "item long, left int")
    files.write_resume_map(d, str(tmp_path / "r"))
    assert sorted(map(tuple, files.read_resume_map(spark, str(tmp_path / "r")).collect())) == [(1, 3), (2, 1)]


def test_images_and_tables(spark, tmp_path):
    for folder, names in (("images", ("a.PNG", "b.jpg", "c.txt", "d.jpg")), ("masks", ("a.PNG", "b.png"))):
        (tmp_path / folder / "deep").mkdir(parents=True)
        for n in names:
            (tmp_path / folder / "deep" / n).write_bytes(b"\xff\xd8" + b"\xff\xdb" + struct.pack(">H", 67) + b"\0" + bytes(range(1, 65)) + b"\xff\xd9")
    got = files.pairs(spark, str(tmp_path / "images"), str(tmp_path / "masks"))
    assert sorted(r.name for r in got.collect()) == ["a.PNG", "b.jpg"]
    i = files.images(spark, str(tmp_path / "images"))
    assert i.count() == 3 and i.select(files.quantisation_table(F.col("content")).alias("t")).first().t == list(range(1, 65))
    assert spark.range(1).select(files.quantisation_table(F.lit(b"none"))).first()[0] == [1] * 64


def test_streams(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(200)
        return spark.table(name)

    w = run(running.windowed_loss(stream, window="10000 days", late="10000 days"), "windowed", "complete")
    assert w.agg(F.sum("n")).first()[0] == events.count()
    last = run(running.last_mean(stream, width=10**6), "last", "update")
    final = {r.key: r.mean for r in last.groupBy("key").agg(F.max_by("mean", "n").alias("mean")).collect()}
    want = {r[0]: r[1] for r in events.groupBy("event_type").agg(F.avg("value")).collect()}
    assert final.keys() == want.keys() and all(abs(final[k] - want[k]) < 1e-9 for k in want)
    bank = run(running.memory_bank(stream.select("event_type", F.expr("event_id div 100").alias("step"), F.col("event_id").alias("vec_id")), by="event_type", most=20), "bank", "update")
    assert bank.agg(F.max("n")).first()[0] == 20
