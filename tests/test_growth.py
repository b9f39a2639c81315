"""Blocked matches, one file from many parts, and the photo source as a batch and a stream."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lumensift.operators import export, preference, report, vectors
from lumensift.plans import catalog_queries as Q
from lumensift.plans import growth_queries  # noqa: F401 (registers its queries)
from lumensift.sources import photo_source

ITEMS, LABELS = "idx long, vector array<double>", "label string, vector array<double>"


def _data(rng, n, m, dims=5):
    point = lambda: [rng.choice([0.0, 1.0, rng.gauss(0, 2)]) for _ in range(dims)]
    labels = [(f"l{rng.randrange(m)}" if i % 7 == 0 else f"m{i}", point()) for i in range(m)]
    labels += [(f"copy{i}", labels[i][1]) for i in range(0, m, 3)] + [("none", None), ("odd", [1.0]), ("nan", [float("nan")] * dims), ("gap", [None] * dims)]
    items = [(i, point()) for i in range(n)] + [(900, None), (901, []), (902, [1.0]), (903, [0.0] * dims)]
    return items, labels


def _usable(v, dims=5):
    return v is not None and len(v) == dims and all(x is not None and not math.isnan(x) for x in v)


@pytest.mark.parametrize("block,bytes_,k", [(512, 1 << 20, 3), (8, 1 << 20, 1), (8, 8 * 8 * 5, 4), (4, 8 * 8 * 5 * 2, 200)])
def test_nearest_in_blocks(spark, monkeypatch, block, bytes_, k):
    monkeypatch.setattr(vectors, "BLOCK", block), monkeypatch.setattr(vectors, "PASS_BYTES", bytes_), monkeypatch.setattr(vectors, "ROWS", 9)
    items, labels = _data(random.Random(k), 40, 45)
    got = vectors.matches(spark.createDataFrame(items, ITEMS), spark.createDataFrame(labels, LABELS).repartition(3), k).collect()
    want = []
    for i, v in items:
        if _usable(v):
            order = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), name) for name, w in labels if _usable(w))
            want += [(i, n + 1, name, round(d, 9)) for n, (d, name) in enumerate(order[:k])]
    assert sorted((r["idx"], r["place"], r["label"], round(r["distance"], 9)) for r in got) == sorted(want)


@pytest.mark.parametrize("bytes_", [1 << 20, 8 * 8 * 5])
def test_likeliest_in_blocks(spark, monkeypatch, bytes_):
    monkeypatch.setattr(vectors, "BLOCK", 8), monkeypatch.setattr(vectors, "PASS_BYTES", bytes_)
    rng = random.Random(8)
    items = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(30)]
    labels = [(f"m{i}", [rng.gauss(0, 1) for _ in range(5)]) for i in range(50)]
    frames = spark.createDataFrame(items, ITEMS), spark.createDataFrame(labels, LABELS)
    rows = lambda df: sorted((r["idx"], r["place"], r["label"], round(r["probability"], 9)) for r in df.collect())
    assert rows(preference.zero_shot(*frames, limit=10)) == rows(preference.zero_shot(*frames))


def test_nearest_centroid_beyond_the_limit(spark):
    rng = random.Random(2)
    items = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(25)] + [(99, None)], "idx long, features array<double>")
    centres = spark.createDataFrame([(f"c{i}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)], "label string, centroid array<double>")
    rows = lambda df: sorted((r["idx"], r["preference_label"], round(r["preference_score"], 9)) for r in df.collect())
    assert rows(preference.nearest(items, centres, limit=10)) == rows(preference.nearest(items, centres))


def test_far_blocks_are_not_multiplied(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 6))
    blocks = []
    for n in range(20):
        v = rng.normal(size=(30, 6)) * (1 + 5 * n)
        norms = np.linalg.norm(v, axis=1)
        blocks.append(vectors.Block(v, np.arange(30) + 30 * n, norms.min(), norms.max()))
    seen = []
    monkeypatch.setattr(np, "partition", lambda a, *r, f=np.partition: (seen.append(a.shape), f(a, *r))[1])
    vectors.nearest_in(x, blocks, 2)
    assert sum(rows for rows, _ in seen) < 0.4 * len(x) * len(blocks)


def test_one_file_of_many_parts(spark, tmp_path):
    rows = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("idx"), F.concat(F.lit('a, "x" é '), F.col("id").cast("string")).alias("one"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("two")).repartition(7)
    at = report._csv_file(rows, f"file://{tmp_path}/out", "r.csv")
    want = "﻿one,two\n" + "".join(f'"a, ""x"" é {i}",{i if i % 3 else ""}\n' for i in range(4999, -1, -1))
    assert open(at.removeprefix("file:"), encoding="utf-8", newline="").read() == want
    assert [x for x in os.listdir(tmp_path / "out") if not x.startswith(".")] == ["r.csv"]
    none = report._csv_file(rows.where("idx < 0"), f"file://{tmp_path}/none", "r.csv")
    assert open(none.removeprefix("file:"), encoding="utf-8").read() == "﻿one,two\n"


def test_photo_source(spark, tmp_path):
    photo_source.register(spark)
    jpg, png = b"\xff\xd8\xff\xe0 etc", b"\x89PNG\r\n\x1a\n etc"
    for name, content in {"a.jpg": jpg, "b/c.PNG": png, "b/d/e/f.jpeg": jpg, "b/skip/g.jpg": jpg, "h/i.webp": b"RIFF0000WEBP", "h/j.webp": b"RIFF0000WAVE", "h/k.png": b"", "h/l.jpg": png, "h/m.txt": b"x", "h/n.cr2": b"raw"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    read = lambda **o: spark.read.format("photo_folder").options(path=f"file://{tmp_path}", **o).load()
    for branches in ("1", "2", "64"):
        got = {r["filename"]: (r["branch"], r["error"]) for r in read(excluded="skip", branches=branches).collect()}
        assert got == {"a.jpg": ("", None), "c.PNG": ("b", None), "f.jpeg": ("b", None), "i.webp": ("h", None), "j.webp": ("h", "no picture"), "k.png": ("h", "empty"), "l.jpg": ("h", "no picture")}
    one = read().where("branch = 'h' AND extension IN ('png', 'webp')")
    assert sorted(r["filename"] for r in one.collect()) == ["i.webp", "j.webp", "k.png"]
    assert [r["filename"] for r in read(extensions=".CR2").collect()] == ["n.cr2"] and read(extensions="bmp").count() == 0
    walk = photo_source.Walk({"path": str(tmp_path)})
    rest = list(photo_source.FolderReader(walk).pushFilters([photo_source.EqualTo(("branch",), "b"), photo_source.EqualTo(("error",), "x")]))
    assert len(rest) == 1 and walk.only == {"b"} and all("/h" not in f for p in walk.dealt() for f in [*p.deep, *p.flat])


def test_photo_stream_gives_each_file_once(spark, tmp_path):
    import time

    photo_source.register(spark)
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")

    def put(name):
        (source / name).parent.mkdir(parents=True, exist_ok=True)
        (source / name).write_bytes(b"\xff\xd8\xff")
        past = time.time() - 5
        os.utime(source / name, (past, past))

    def run():
        stream = spark.readStream.format("photo_folder").option("path", str(source)).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["filename"] for r in spark.read.parquet(out).collect())

    put("a.jpg"), put("x/b.jpg")
    assert run() == ["a.jpg", "b.jpg"]
    time.sleep(6)
    put("x/y/c.jpg")
    assert run() == ["a.jpg", "b.jpg", "c.jpg"]


def test_a_store_learns_on(spark, tmp_path):
    at, rng = str(tmp_path / "store"), random.Random(3)
    rows = [(rng.choice("ab"), [rng.gauss(0, 1), float(i)]) for i in range(90)] + [("a", None), ("a", [])]
    frame = lambda x: spark.createDataFrame(x, "user_label string, features array<double>").withColumn("manual_category", F.lit(""))
    assert [preference.learn(frame(part), at) for part in (rows[:30], rows[30:31], rows[31:])] == [0, 1, 2] and preference.versions(spark, at) == [0, 1, 2]
    got = {r["label"]: (r["n"], [round(x, 9) for x in r["centroid"]], [round(x, 6) for x in r["deviation"]]) for r in preference.centroids_of(preference.learnt(spark, at)).collect()}
    whole = {r["label"]: [round(x, 9) for x in r["centroid"]] for r in preference.centroids(frame(rows)).collect()}
    assert {k: v[1] for k, v in got.items()} == whole and sum(v[0] for v in got.values()) == 90
    own = [r[1][1] for r in rows if r[0] == "b" and r[1]]
    mean = sum(own) / len(own)
    assert got["b"][2][1] == round(math.sqrt(sum((x - mean) ** 2 for x in own) / len(own)), 6)
    assert preference.learnt(spark, at, 0).agg(F.sum("n")).first()[0] == 60


def test_a_fitted_model_is_stored(spark, tmp_path):
    rng = random.Random(1)
    rows = [("ab"[i % 2], [rng.gauss(0, 1) + 6 * (i % 2), 1.0]) for i in range(60)]
    samples = spark.createDataFrame(rows, "user_label string, features array<double>").withColumn("manual_category", F.lit(""))
    fitted = preference.train_logistic(samples)[0]
    preference.store_fitted(fitted, str(tmp_path / "store"), 0)
    label = lambda m: [r["preference_label"] for r in preference.predict_logistic(m, samples.select("features").coalesce(1)).collect()]
    assert label(preference.stored_fitted(str(tmp_path / "store"), 0)) == label(fitted)


def test_copies_overwrite_nothing_and_leave_no_parts(spark, tmp_path):
    from lumensift.operators import export

    (tmp_path / "a.jpg").write_bytes(b"one"), (tmp_path / "b.jpg").write_bytes(b"two")
    p = spark.createDataFrame(
        [(1, f"file://{tmp_path}/a.jpg", "x.jpg", ["客户可选"], "A", "", "", ""), (2, str(tmp_path / "b.jpg"), "y.jpg", ["客户可选"], "A", "", "", ""), (3, str(tmp_path / "gone.jpg"), "z.jpg", ["客户可选"], "A", "", "", "")],
        "idx long, path string, filename string, delivery_use array<string>, quality_rating string, photo_type string, subtype string, similar_group_status string",
    )
    out = tmp_path / "out"
    (out / "01_客户可选").mkdir(parents=True)
    (out / "01_客户可选" / "x.jpg").write_bytes(b"oth")  # as long as the original, but another picture
    (out / "01_客户可选" / "y.jpg").write_bytes(b"two")  # left by an earlier try
    done = {r["path"].rsplit("/", 1)[1]: r for r in export.run(p, f"file://{out}", export.Options(by_type=False)).collect()}
    assert {k: r["export_status"] for k, r in done.items()} == {"a.jpg": "failed", "b.jpg": "exported", "gone.jpg": "failed"}
    assert (out / "01_客户可选" / "x.jpg").read_bytes() == b"oth" and done["b.jpg"]["exported_paths"] == [f"file://{out}/01_客户可选/y.jpg"]
    assert sorted(f.name for f in out.rglob("*")) == ["01_客户可选", "x.jpg", "y.jpg"]
    assert export.fresh_folder(f"file://{out}", "t") == f"file://{out}_t"


def test_contents_are_read_by_paths_and_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """Copies are read back by tasks that open their paths; the driver lists no folder, and few small rows are more than one task."""
    for n in range(12):
        (tmp_path / f"a b%{n}.jpg").write_bytes(b"photo %d" % n)
    monkeypatch.setattr(export, "FILES", 3)
    names = [(n, str(tmp_path / f"a b%{n}.jpg")) for n in range(12)] + [(12, str(tmp_path / "gone.jpg")), (13, None)]
    found = export.contents(spark.createDataFrame(names, "n long, at string").coalesce(1), "at")
    assert found.rdd.getNumPartitions() == 5 and not found.inputFiles()
    assert {r["n"]: r["content"] and bytes(r["content"]) for r in found.collect()} == {n: b"photo %d" % n for n in range(12)} | {12: None, 13: None}


def test_export_copies_lists_no_folder(spark):
    made = Q.QUERIES["q_export_copies"](spark, "/root/testdata/sf0.001")
    assert "binaryFile" not in made._jdf.queryExecution().executedPlan().toString()
