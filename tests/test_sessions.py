"""Trials, sessions, tables with several writers, imports, models and whole exports."""

import threading

import pytest
from pyspark.sql import functions as F

from lumensift import vocab as V
from lumensift.operators import export, panel, preference, tasks
from lumensift.sources import catalog, session


def test_trials(spark):
    photos = spark.range(30).withColumnRenamed("id", "idx")
    seen = []

    def run(few, batch):
        seen.append((batch, few.count()))
        if batch == 16:
            raise RuntimeError("CUDA out of memory")
        return few

    tried = tasks.trials(photos, "accurate", run)
    assert seen == [(4, 8), (8, 8), (12, 8), (16, 8)] and [r["error"] for r in tried.orderBy("trial").collect()][3] == "显存不足"
    assert tasks.tuned("accurate", tried)[1] in (4, 8, 12)
    slow = spark.createDataFrame([(0, 2, True, 900.0, ""), (1, 4, True, 700.0, "")], tried.schema)
    assert tasks.tuned("ultra", slow) == ("accurate", 4) and tasks.tuned("ultra", slow.where("false")) == ("ultra", None)


def test_modules_are_pluggable_and_isolated(spark):
    from lumensift.operators import pixels

    df = spark.createDataFrame([(120.0, 128.0, 50.0, 5.0, 4000, 3000)], "sharpness double, brightness double, contrast double, noise double, width int, height int")
    own = {"basic": pixels.basic_quality, "bad": lambda: {"bad_score": F.col("no such column")}, "mine": lambda: {"mine_score": F.lit(7.0)}}
    row = pixels.analyse(df, own).first()
    assert row["basic_score"] > 50 and row["bad_score"] == 0 and row["bad_confidence"] == 0 and row["bad_reason"] and row["mine_score"] == 7


def test_project_state(tmp_path):
    path = str(tmp_path / "logs" / "state.json")
    assert session.read_state(path) == session.ProjectState()
    state = session.ProjectState(project_folder="/p", sort_name="置信度", clean_shutdown=False)
    session.write_state(state, path)
    assert session.read_state(path) == state and state.to_restore() and not state.to_restore(False) and not session.ProjectState("/p").to_restore()
    (tmp_path / "bad").write_text("{")
    (tmp_path / "more").write_text('{"view_mode": "x", "unknown": 1}')
    assert session.read_state(str(tmp_path / "bad")) == session.ProjectState() and session.read_state(str(tmp_path / "more")).view_mode == "x"
    session.log_line(str(tmp_path / "a" / "log"), "hello")
    assert (tmp_path / "a" / "log").read_text().endswith("] hello\n")


def test_presets(spark, tmp_path):
    text = "# weights\n个人写真:\n  构图: 15\n  清晰度: 10\n  note: many\n\n  # more\n默认:\n  曝光: 20\n  曝光: -3 \n空:\nloose: 4\n  lost: 5\n"
    (tmp_path / "p.yaml").write_text(text)
    assert {(r["preset"], r["name"]): r["weight"] for r in catalog.presets(spark, str(tmp_path)).collect()} == {("个人写真", "构图"): 15, ("个人写真", "清晰度"): 10, ("默认", "曝光"): -3}
    whole = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(session.plain_presets(F.col("t"))).collect()
    assert whole[0][0]["空"] == {} and not whole[1][0] and not whole[2][0]


def test_names_of_modes():
    assert (session.mode_of("宽松"), session.mode_of("?"), session.strategy_of("作品集"), session.strategy_of("")) == ("loose", "standard", "portfolio", "delivery")


def test_marks_go_to_the_selection():
    assert panel.marked_targets("grid", [3, 4], [1], 7, 2) == [3, 4]
    assert panel.marked_targets("list", [], [1, 2], 7, 2) == [1, 2]
    assert panel.marked_targets("compare", [], [1, 2], 7, 2) == [7] and panel.marked_targets("list", [], [1], -1, 2) == [2]


def test_table_writes_deltas_and_no_commit_twice(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    row = lambda p, note: catalog.migrated(spark.createDataFrame([(p, note)], "path string, review_note string"))
    assert catalog.current(spark, path) is None
    monkeypatch.setattr(catalog, "COMPACT_AFTER", 3)
    for n in range(6):
        catalog.save(spark, row(f"/{n % 3}", f"v{n}"), path)
    state = lambda: {r["path"]: r["review_note"] for r in catalog.load(spark, path).collect()}
    assert state() == {"/0": "v3", "/1": "v4", "/2": "v5"}
    parts = catalog._committed(spark, path)
    assert parts[0][1] == "snapshot" and len(parts) < 6
    assert not catalog._commit(spark, path, parts[-1][0], "delta", "other")  # another writer's version
    before = state()
    assert catalog.vacuum(spark, path) > 0 and state() == before
    assert catalog.save(spark, row("/9", "x"), path) == parts[-1][0] + 1 and state()["/9"] == "x"


def test_two_writers_both_count(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda p: catalog.migrated(spark.createDataFrame([(p,)], "path string"))
    writers = [threading.Thread(target=catalog.save, args=(spark, row(f"/{n}"), path)) for n in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert {r["path"] for r in catalog.load(spark, path).collect()} == {"/0", "/1", "/2", "/3"}


def test_import_skips_bad_files(spark):
    files = spark.createDataFrame([(f"/{n:02d}.jpg", f"{n:02d}.jpg", 1.0) for n in range(10)], "path string, filename string, file_size_mb double")
    decoded = spark.createDataFrame([(f"/{n:02d}.jpg", 10, 20, "", "broken" if n == 3 else None) for n in range(9)], "path string, width int, height int, taken_at string, error string")
    rows, skipped = catalog.imported(files, decoded, None, 3)
    assert {r["path"]: r["reason"] for r in skipped.collect()} == {"/03.jpg": "broken", "/09.jpg": "unreadable"}
    got = {r["path"]: r["batch"] for r in rows.collect()}
    assert len(got) == 8 and [got[p] for p in sorted(got)] == [0, 0, 0, 1, 1, 1, 2, 2] and rows.where("width = 10").count() == 8


def test_models_fall_back_to_centroids(spark, tmp_path, monkeypatch):
    schema = "idx long, user_label string, manual_category string, features array<double>"
    data = [(n, "精选" if n % 2 else "废片", "", [float(n % 2), 0.1 * (n % 5)]) for n in range(60)]
    samples = spark.createDataFrame(data, schema)
    assert preference.train(samples.limit(20)) is None
    items = samples.select("idx", "features")
    by_regression = {r["idx"]: r["preference_label"] for r in preference.train(samples)(items).collect()}
    assert all(by_regression[n] == label for n, label, _, _ in data)

    def fails(_):
        raise RuntimeError("no regression here")

    monkeypatch.setattr(preference, "train_logistic", fails)
    by_centre = {r["idx"]: r["preference_label"] for r in preference.train(samples)(items).collect()}
    assert by_centre == by_regression
    one_label = spark.createDataFrame([(n, "精选", "", [1.0]) for n in range(60)], schema)
    monkeypatch.undo()
    assert {r["preference_label"] for r in preference.train(one_label)(one_label.select("idx", "features")).collect()} == {"精选"}
    preference.save_model(preference.centroids(samples), str(tmp_path / "m"))
    assert preference.clear_model(spark, str(tmp_path / "m")) and not preference.clear_model(spark, str(tmp_path / "m"))


def test_embeddings_are_normalised(spark):
    df = spark.createDataFrame([(1, b"ab"), (2, None), (3, b"zzz")], "idx long, content binary")
    got = {r["idx"]: r["embedding"] for r in preference.embedded(df, lambda contents: [[len(c), 4.0 if len(c) == 3 else 0.0] for c in contents]).collect()}
    assert got == {1: [1.0, 0.0], 2: None, 3: [0.6, 0.8]}


def test_whole_export(spark, tmp_path):
    from lumensift.sources import adapters

    photos = adapters.photos(spark, "/root/testdata/sf0.001").where("idx < 40").withColumns({"similar_group_rank": F.lit(0), "similarity_score": F.lit(0.0)})
    for n in (1, 2):
        (tmp_path / f"{n}.jpg").write_bytes(b"x" * n)
    photos = photos.withColumn("path", F.concat(F.lit(f"{tmp_path}/"), (F.col("idx") % 2 + 1).cast("string"), F.lit(".jpg"))).dropDuplicates(["path"])
    made = export.export(photos, str(tmp_path / "out"), "2026-01-01_0000", export.options_from_mode("复制原图 + 生成报告"))
    planned = export.plan(photos).count()
    assert made.folder.endswith("out") and sum(len(r["exported_paths"]) for r in made.done.collect()) == planned
    assert made.csv.endswith("review_report.csv") and spark.read.text(made.csv.removeprefix("file:")).count() == photos.count() + 1
    again = export.export_photos(photos, str(tmp_path / "out"), "2026-01-01_0000", export.Options(csv=False, markdown=False, report_only=True))
    assert again[0].endswith("out_2026-01-01_0000") and again[1] is None and {r["export_status"] for r in again[2].collect()} == {"report_only"}
    assert export.report_now(photos, str(tmp_path / "rep"), "t").endswith("review_report.csv")
    assert export.options_from_mode("复制 + 报告", csv=False).csv and not export.options_from_mode("复制", csv=False).csv


def test_details_of_a_current_suggestion_only():
    assert set(panel.STATUS_NAMES) == set(V.GROUP_STATUSES)
