"""Files, tables, samples, settings, pixels and streams."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumensift import vocab as V
from lumensift.operators import pixels, preference
from lumensift.sources import catalog
from lumensift.streaming import decisions


def png(path, rgb: np.ndarray) -> None:
    h, w, _ = rgb.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"".join(b"\0" + rgb[y].astype(np.uint8).tobytes() for y in range(h))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_scan_and_pixels(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    flat = np.full((90, 120, 3), (180, 185, 190))
    half = flat.copy()
    half[:, :60] = 0
    png(tmp_path / "a.png", flat), png(tmp_path / "b.PNG", half), png(tmp_path / "cache" / "c.png", flat)
    (tmp_path / "bad.png").write_bytes(b"no image")
    files = catalog.scan(spark, str(tmp_path), excluded=["cache"]).collect()
    assert sorted(r["filename"] for r in files) == ["a.png", "b.PNG", "bad.png"]
    got = {r["path"].rsplit("/", 1)[1]: r for r in pixels.features(catalog.images(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.png", "b.PNG", "c.png"} and all(r["error"] is None for r in got.values())
    a, b = got["a.png"], got["b.PNG"]
    assert (a["width"], a["height"], a["dominant_r"], a["dominant_b"]) == (120, 90, 180, 190)
    assert a["sharpness"] == 0 and a["contrast"] == 0 and a["hash"] == -1 and a["hash_above"] == 0
    assert b["sharpness"] > 0 and b["dark_clip"] == pytest.approx(0.5) and f"{b['hash'] & (1 << 64) - 1:064b}" == "00001111" * 8


def test_laplacian_by_hand():
    g = np.arange(25, dtype=np.uint8).reshape(5, 5) ** 2 % 251
    x = np.pad(g.astype(float), 1, mode="reflect")
    want = [x[i - 1, j] + x[i + 1, j] + x[i, j - 1] + x[i, j + 1] - 4 * x[i, j] for i in range(1, 6) for j in range(1, 6)]
    assert pixels.laplacian_variance(g) == pytest.approx(np.var(want))


def test_modules_run_in_order(spark):
    row = spark.createDataFrame([(2000, 3000, 40.0, 60.0, 20.0, 5.0, 50.0, [dict(x=10, y=900, w=400, h=400)], 40.0, 0, "d")], "width int, height int, sharpness double, brightness double, contrast double, noise double, edge_density double, face_boxes array<struct<x:int,y:int,w:int,h:int>>, face_clarity double, eye_count int, detector string")
    r = pixels.analyse(row).first()
    assert r["basic_problems"] == ["虚焦", "曝光问题", "色彩问题"] and r["face_problems"] == ["虚焦", "裁切风险", "闭眼"]
    assert r["pose_score"] == 46 and r["expression_score"] == 42 and r["composition_problems"] == ["裁切风险", "背景杂乱", "曝光问题"] and r["composition_score"] == 72 - 5 - 12 - 8 - 6


def test_person_metrics(spark):
    boxes = [dict(x1=10.0, y1=10.0, x2=60.0, y2=90.0, label=0, score=0.9), dict(x1=0.0, y1=0.0, x2=5.0, y2=5.0, label=0, score=0.1), dict(x1=0.0, y1=0.0, x2=99.0, y2=99.0, label=3, score=0.9)]
    df = spark.createDataFrame([(boxes,), ([],)], "b array<struct<x1:double,y1:double,x2:double,y2:double,label:int,score:double>>")
    some, none = (r[0] for r in df.select(pixels.person_metrics(F.col("b"), F.lit(100), F.lit(100))).collect())
    assert (some["detected_person_count"], some["main_subject_bbox"], some["edge_cutoff_risk"]) == (1, "10,10,60,90", 0.0)
    assert tuple(none) == (0, "", 0.0, 0.0, 0.0, 0.0, 0.0)


def test_migration_and_table(spark, tmp_path):
    old = spark.createDataFrame([("/a", "精选", None, "note", '["虚焦"]'), ("/b", None, "废片", "", "bad")], "path string, label string, manual_category string, user_note string, issue_tags string")
    rows = {r["path"]: r for r in catalog.migrated(old).collect()}
    assert rows["/a"]["manual_category"] == "精选" and rows["/b"]["manual_category"] == "废片" and rows["/a"]["issue_tags"] == ["虚焦"] and rows["/b"]["issue_tags"] == [] and rows["/a"]["review_note"] == "note" and rows["/a"]["review_status"] == V.UNREVIEWED
    path = str(tmp_path / "t")
    catalog.save(spark, catalog.migrated(old), path)
    catalog.save(spark, catalog.migrated(old).where("path = '/a'").withColumn("quality_rating", F.lit("S")), path)
    assert {r["path"]: r["quality_rating"] for r in catalog.load(spark, path).collect()} == {"/a": "S", "/b": ""}
    assert catalog.storage_rows(catalog.load(spark, path)).schema["issue_tags"].dataType.simpleString() == "string"


def test_rows_of_files_keep_state(spark):
    files = spark.createDataFrame([("/a", "a.jpg", 1.5), ("/b", "b.jpg", 2.5)], "path string, filename string, file_size_mb double")
    saved = spark.createDataFrame([("/a", "废片", True)], "path string, manual_category string, manual_override boolean")
    rows = {r["path"]: r for r in catalog.build_rows(files, saved).collect()}
    assert rows["/a"]["final_category"] == "废片" and rows["/b"]["final_category"] == "备选" and rows["/b"]["file_size_mb"] == 2.5


def test_samples_skip_bad_lines(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"path": "/a", "user_label": "精选", "features": [1, 2]}\n\nnot json\n{"path": "/b", "features": []}\n')
    s = catalog.samples(spark, str(tmp_path / "s.jsonl"))
    assert s.count() == 2 and [r["label"] for r in preference.centroids(s).collect()] == ["精选"]


def test_library(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"folders": ["/f"], "images": {"/x": ["我喜欢", "odd"], "/y": []}}')
    lib = catalog.library_images(spark, str(tmp_path / "l.json"))
    new = catalog.library_scanned(lib, spark.createDataFrame([("/x",), ("/z",)], "path string"))
    assert {r["image"]: r["tags"] for r in new.collect()} == {"/x": ["我喜欢"], "/y": [], "/z": []}


def test_settings(tmp_path):
    s = catalog.Settings(confidence_threshold=7, similarity_mode="odd", scoring_weights={"own": [1, 0, 0, 0]})
    assert s.confidence_threshold == 1.0 and s.similarity_mode == "standard" and set(s.scoring_weights) == {*V.PICK_WEIGHTS, "own"}
    catalog.write_settings(s, str(tmp_path / "c.json"))
    assert catalog.read_settings(str(tmp_path / "c.json")) == s and catalog.read_settings(str(tmp_path / "none")) == catalog.Settings()


def test_exif():
    text = b"2024:05:06 07:08:09\0"
    ifd = struct.pack("<HHHIII", 1, 306, 2, len(text), 26, 0)
    block = b"II*\0" + struct.pack("<I", 8) + ifd
    assert catalog.exif_text(b"\xff\xd8Exif\0\0" + block.ljust(26, b"\0") + text) == "2024:05:06 07:08:09" and catalog.exif_text(b"x") == ""


def test_stream_merge_protects(spark, tmp_path):
    schema = "path string, quality_rating string, review_status string, seq long"
    first = spark.createDataFrame([("/a", "S", V.CONFIRMED, 1), ("/b", "B", V.AI_REVIEWED, 1), ("/b", "C", V.AI_REVIEWED, 2)], schema)
    second = spark.createDataFrame([("/a", "X", V.AI_REVIEWED, 3), ("/b", "A", V.AI_REVIEWED, 3), ("/c", "A", V.AI_REVIEWED, 3)], schema)
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    for batch in (first, second):
        batch.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        decisions.merge_stream(stream, table, str(tmp_path / "ck")).awaitTermination()
    assert {r["path"]: r["quality_rating"] for r in catalog.load(spark, table).collect()} == {"/a": "S", "/b": "A", "/c": "A"}


def test_stream_windows_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = decisions.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert spark.table("tumbled").select("start", "event_type", "n").exceptAll(decisions.tumbling(events).select(F.col("start").cast("timestamp"), "event_type", "n")).count() == 0
    assert spark.table("tumbled").count() == decisions.tumbling(events).count()


def test_images_to_decisions(spark, tmp_path):
    from lumensift.operators import review
    from lumensift.plans import analysis

    rng = np.random.default_rng(1)
    png(tmp_path / "a.png", rng.integers(60, 200, (120, 160, 3)))
    png(tmp_path / "b.png", np.full((120, 160, 3), 20))
    images = catalog.images(spark, str(tmp_path))
    broken = images.limit(1).select(F.lit("/broken.png").alias("path"), F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in images.schema["image"].dataType.fields)).alias("image"))
    boxes = spark.createDataFrame([(images.where("path like '%a.png'").first()["path"], [dict(x=50, y=40, w=40, h=40)], 120.0, 2, 1, "d")], "path string, face_boxes array<struct<x:int,y:int,w:int,h:int>>, face_clarity double, eye_count int, person_count int, detector string")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in analysis.analyse(images.unionByName(broken), boxes).withColumn("status", review.suggestion_status(F.col("ai_suggestion"), F.col("path"))).collect()}
    assert all(r["status"] == "current" for r in rows.values())
    assert rows["a.png"]["face_score"] > 80 and rows["b.png"]["basic_problems"][:2] == ["虚焦", "曝光问题"] and rows["b.png"]["face_score"] == 50
    assert rows["broken.png"]["error"] and rows["broken.png"]["commercial_score"] == 0 and rows["broken.png"]["quality_rating"] == "X"
    assert analysis.analyse(images).count() == 2


def test_folders_and_tags(spark, tmp_path):
    from lumensift.operators import export

    r = spark.range(1).select(catalog.with_folder(F.array(F.lit("/a")), "/b").alias("x"), catalog.without_folder(F.array(F.lit("/a")), "/a").alias("y"), catalog.oriented(F.lit(4), F.lit(3), F.lit(6)).alias("z")).first()
    assert r["x"] == ["/a", "/b"] and r["y"] == [] and tuple(r["z"]) == (3, 4)
    known = spark.createDataFrame([("/x", ["废片"])], "image string, tags array<string>")
    out = catalog.tagged_images(known, spark.createDataFrame([("/x", ["我喜欢", "odd"])], "image string, tags array<string>"))
    assert [tuple(r) for r in out.collect()] == [("/x", ["我喜欢"])]
    (tmp_path / "o").mkdir()
    assert export.fresh_folder(str(tmp_path / "o"), "t") == str(tmp_path / "o")
    (tmp_path / "o" / "f").write_text("x")
    (tmp_path / "o_t").mkdir()
    assert export.fresh_folder(str(tmp_path / "o"), "t") == str(tmp_path / "o_t_01")
    assert export.options_from_mode(" 只生成报告").report_only and not export.options_from_mode("复制原图 + 生成报告").report_only
