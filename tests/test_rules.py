"""Rules on constructed rows: decisions, business types, suggestions, reviews, codecs and names."""

import json

from pyspark.sql import functions as F

from lumensift import vocab as V
from lumensift.functions import scalars as S
from lumensift.operators import business, decision, export, generations, report, review


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_thresholds_of_ratings(spark):
    rows = spark.createDataFrame([(90.0,), (89.99,), (75.0,), (60.0,), (40.0,), (39.9,)], "s double").select(decision.rating_from_score(F.col("s")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["S", "A", "A", "B", "C", "X"]


def _modules(spark, **over):
    base = dict(basic_score=80.0, face_score=80.0, pose_score=60.0, expression_score=70.0, composition_score=70.0, basic_confidence=0.9, face_confidence=0.7, pose_confidence=0.1, expression_confidence=0.2, composition_confidence=0.6, business_confidence=0.7)
    lists = dict.fromkeys([f"{m}_problems" for m in decision.MODULES], [])
    row = base | lists | dict(business_type="个人写真", business_subtype="半身", basic_reason="") | over
    kinds = {str: "string", float: "double", list: "array<string>", type(None): "double"}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in row.items()))


def test_closed_eyes_beat_a_low_score(spark):
    r = decision.decide(_modules(spark, basic_score=45.0, face_score=40.0, face_problems=["闭眼"])).first()
    assert r["commercial_score"] < 58 and r["quality_rating"] == "B"


def test_blur_rejects_but_not_landscapes(spark):
    low = dict(basic_score=10.0, basic_problems=["虚焦"])
    assert decision.decide(_modules(spark, **low)).first()["quality_rating"] == "X"
    assert decision.decide(_modules(spark, **low, business_type="风景/环境")).first()["quality_rating"] == "C"


def test_missing_module_and_failed_module_differ(spark):
    missing = decision.decide(_modules(spark, face_score=None)).first()["commercial_score"]
    failed = decision.decide(_modules(spark, face_score=0.0)).first()["commercial_score"]
    assert round(missing - failed, 1) == round(60 * 0.22, 1)


def test_repairable_is_added_once(spark):
    r = decision.decide(_modules(spark, basic_problems=["曝光问题", "技术可修"])).first()
    assert r["issue_tags"] == ["曝光问题", "技术可修"] and r["delivery_use"].count("修图练习") == 1


def test_portfolio_has_a_ceiling(spark):
    r = decision.decide(_modules(spark, basic_score=100.0, composition_score=100.0, expression_score=100.0, business_confidence=1.0)).first()
    assert r["portfolio_score"] == 89.6


def _evidence(spark, **over):
    row = dict(face_count=1, person_count=1, r=120, g=120, b=120, color_std=100.0, green_ratio=0.0, blue_ratio=0.0, white_ratio=0.0, lower_white_ratio=0.0, center_white_ratio=0.0, face_area_ratio=0.05) | over
    return business.classify(spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))).first()


def test_single_person_is_never_a_family(spark):
    r = _evidence(spark)
    assert (r["candidate_type"], r["type"]) == ("个人写真", V.UNKNOWN_TYPE)


def test_bride_passes_the_gate(spark):
    r = _evidence(spark, white_ratio=0.5, lower_white_ratio=0.5, color_std=80.0, face_area_ratio=0.01)
    assert r["type"] == "婚纱照" and r["type_subtype"] == "单人新娘" and r["type_confidence"] == 0.78


def test_three_people_stay_unsure(spark):
    r = _evidence(spark, face_count=3, person_count=3)
    assert (r["candidate_type"], r["type"]) == ("全家福", V.UNKNOWN_TYPE)


def test_person_count_zero_is_face_count(spark):
    assert _evidence(spark, face_count=2, person_count=0)["candidate_type"] == "情侣照"


def test_suggestion_status(spark):
    ok = json.dumps({"version": V.SUGGESTION_VERSION, "image_path": "/A/b.jpg"})
    cases = [("", "missing"), (None, "missing"), ("[1]", "invalid"), ("{}", "invalid"), ("{bad", "invalid"), (ok, "current"), (ok.replace("/A/b", "/A/c"), "mismatch"), ('{"version": "x"}', "stale"), ('{"image_path": "/a/B.jpg"}', "legacy"), ('{"image_path": "/a/b.jpg", "version": "old"}', "stale")]
    df = spark.createDataFrame([(t, "/a/b.jpg") for t, _ in cases], "t string, p string")
    assert [r[0] for r in df.select(review.suggestion_status(F.col("t"), F.col("p"))).collect()] == [s for _, s in cases]


def test_review_errors(spark):
    r = one(spark, e=review.review_errors(F.lit("个人写真"), F.lit("主纱"), F.lit("Q"), V.array_of(["精修候选", "未知用途"]), V.array_of(["虚焦", "未知问题"])))
    assert len(r["e"]) == 4
    assert one(spark, e=review.review_errors(F.lit(""), F.lit(None).cast("string"), F.lit(""), F.lit(None).cast("array<string>"), V.array_of([])))["e"] == []


def test_final_category_order(spark):
    rows = [("精选", True, "全家福", "", 0.9), ("备选", False, "全家福", "三口之家", 0.9), ("备选", False, "全家福", "", 0.1), ("what", False, "", "", 0.0)]
    df = spark.createDataFrame(rows, "manual_category string, manual_override boolean, ai_primary_category string, ai_secondary_category string, ai_confidence double")
    assert [r[0] for r in df.select(review.final_category()).collect()] == ["精修候选", "全家福/三口之家", "人工复核", "备选"]


def test_codecs(spark):
    r = one(spark, a=S.decode_tags(F.lit('["x", 1]')), b=S.decode_tags(F.lit("{}")), c=S.decode_tags(F.lit("no")), d=S.decode_choices(F.lit('["x", " "]')), e=S.encode_choices(V.array_of(["a", ""])))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (["x", "1"], [], [], ["x"], '["a"]')


def test_names_and_times(spark):
    r = one(spark, a=S.safe_name(F.lit(' a/b:c. . '), "d"), b=S.safe_name(F.lit("  "), "d"), c=S.exif_time(F.lit("2024:01:02 03:04:05")), d=S.exif_time(F.lit(" odd ")), e=S.minutes_seconds(F.lit(125)), f=S.suffix(F.lit("/x/Y.JPG")), g=S.stem(F.lit("/x/Y.b.JPG")))
    assert tuple(r) == ("a_b_c", "d", "2024-01-02 03:04:05", "odd", "02:05", "jpg", "Y.b")


def test_hash_codecs(spark):
    r = one(spark, a=S.hash_to_hex(F.lit(-1).cast("long")), b=S.hash_from_hex(F.lit("ffffffffffffffff")), c=S.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), d=S.hamming_hex(F.lit(""), F.lit("00")))
    assert tuple(r) == ("f" * 16, -1, 64, 64)


def test_toggle_and_append(spark):
    r = one(spark, a=S.toggled(V.array_of(["x"]), "x"), b=S.toggled(V.array_of(["x"]), "y"), c=S.append_once(V.array_of(["x"]), "x"))
    assert tuple(r) == ([], ["x", "y"], ["x"])


def _photo(spark, **over):
    row = dict(idx=1, path="/p/a.jpg", filename="a.jpg", delivery_use=[], quality_rating="S", similar_group_status="", photo_type="会议/活动照", subtype="") | over
    return spark.createDataFrame([tuple(row.values())], "idx int, path string, filename string, delivery_use array<string>, quality_rating string, similar_group_status string, photo_type string, subtype string")


def test_destinations(spark):
    where = lambda o=export.Options(), **k: _photo(spark, **k).select(export.destinations(o)).first()[0]
    assert where() == ["01_客户可选", "10_按类型整理/会议_活动照/未细分/S_强烈推荐"]
    assert where(quality_rating="X") == [] and where(similar_group_status="duplicate") == [] and where(delivery_use=["不导出"]) == []
    assert where(export.Options(include_rejects=True), quality_rating="X") == ["10_按类型整理/会议_活动照/未细分/X_废片"]
    assert where(export.Options(include_no_export=True), delivery_use=["不导出", "仅留档"]) == ["10_按类型整理/会议_活动照/未细分/S_强烈推荐"]
    assert where(export.Options(report_only=True)) == []


def test_export_copies_and_is_repeatable(spark, tmp_path):
    source = tmp_path / "a.jpg"
    source.write_bytes(b"x")
    p = _photo(spark, path=str(source)).unionByName(_photo(spark, idx=2, path=str(tmp_path / "gone.jpg")))
    for _ in range(2):
        done = {r["path"]: r for r in export.run(p, str(tmp_path / "out")).collect()}
        assert done[str(source)]["export_status"] == "exported" and len(done[str(source)]["exported_paths"]) == 2
        assert done[str(tmp_path / "gone.jpg")]["export_status"] == "failed"


def test_second_generation_category(spark):
    tags = V.array_of(["清晰", "推荐保留"])
    got = lambda people, shoot, look=(), sp="", ss="", tags=tags, n=1: one(spark, c=generations.category(F.lit(people), F.lit(shoot), V.array_of(list(look)), tags, F.lit(0.5), F.lit(0.2), F.lit(sp), F.lit(ss), F.lit(0.9), F.lit(0.0), F.lit(n)))["c"]
    assert tuple(got("single_person", "portrait", ["女性外观"]))[:2] == ("单人写真", "年轻女生")
    assert tuple(got("two_people", "portrait", sp="单人写真"))[:2] == ("双人写真", "情侣")
    assert tuple(got("group_people", "business", sp="商务会议合影", n=6))[:2] == ("商务会议合影", "大合影")
    assert tuple(got("none", "portrait", tags=V.array_of(["严重模糊", "明确废片"])))[:2] == ("废片疑似", "")
    assert round(got("none", "environment")["confidence"], 2) == 0.52


def _markdown(photos, folder):
    at = report.write_markdown_file(photos, f"file://{folder}")
    return open(at.removeprefix("file:"), encoding="utf-8").read()


def test_report_text(spark, tmp_path):
    from lumensift.sources import adapters

    text = _markdown(adapters.photos(spark, "/root/testdata/sf0.001"), tmp_path / "one")
    assert text.count("\n## ") == 12 and "1500" in text


def test_report_lists_are_whole(spark, tmp_path):
    import glob

    from lumensift.sources import adapters

    p = adapters.photos(spark, "/root/testdata/sf0.001")
    p = p.unionByName(p.withColumn("idx", F.col("idx") + 100_000)).unionByName(p.withColumn("idx", F.col("idx") + 200_000))
    text = _markdown(p, tmp_path / "one")
    wanted = [r["filename"] for r in p.where(review.not_exported()).orderBy("idx").select("filename").collect()]
    own = text.split("、不导出照片清单\n\n")[1].split("\n\n")[0].split("\n")
    assert len(wanted) > 1000 and [x.split(" | ")[0].removeprefix("| ") for x in own[2:]] == wanted
    changed = text.split("、AI 建议被人工修改的记录\n\n")[1].split("\n\n")[0].split("\n")
    assert len(changed) - 2 == report.overrides(p).count()
    report.write_markdown(p, f"{tmp_path}/report")
    parts = "".join(open(x, encoding="utf-8").read() for x in sorted(glob.glob(f"{tmp_path}/report/part-*")))
    assert parts.rstrip("\n") == text.rstrip("\n")


def test_summary_text(spark):
    payload = json.dumps({"decision": {"quality_rating": "A", "commercial_score": 80.5, "delivery_use": ["客户可选"], "issue_tags": []}})
    r = one(spark, a=review.summary_text(F.lit(payload)), b=review.summary_text(F.lit("{}")))
    assert r["a"].split("\n")[:2] == ["品质等级：A", "商业交付：80.5"] and "风险：-" in r["a"] and r["b"] == "未分析"


def test_reviews_are_written_and_reset(spark):
    from lumensift.sources import catalog

    p = catalog.migrated(spark.createDataFrame([("/a",), ("/b",)], "path string"))
    own = [("/a", "个人写真", "半身", "S", ["精修候选"], [], 90.0, 80.0, "n", V.CONFIRMED), ("/b", "odd", "", "S", [], [], 0.0, 0.0, "", V.CONFIRMED)]
    given = spark.createDataFrame(own, "path string, photo_type string, subtype string, quality_rating string, delivery_use array<string>, issue_tags array<string>, commercial_score double, portfolio_score double, review_note string, review_status string")
    out = review.write_reviews(p, given)
    rows = {r["path"]: r for r in out.collect()}
    assert rows["/a"]["quality_rating"] == "S" and json.loads(rows["/a"]["human_decision"])["review_status"] == V.CONFIRMED and rows["/b"]["review_status"] == V.UNREVIEWED
    back = {r["path"]: r for r in review.reset_reviews(out, given.select("path").where("path = '/a'")).collect()}
    assert back["/a"]["quality_rating"] == "" and back["/a"]["review_status"] == V.UNREVIEWED and back["/a"]["human_decision"] == ""


def test_best_trial_and_performance(spark):
    t = spark.createDataFrame([(1, 0.0), (2, 9.0), (3, 8.0)], "trial int, avg_ms double")
    assert report.best_trial(t).first()["trial"] == 3
    p = spark.createDataFrame([(10.0, True), (0.0, False), (30.0, False)], "ai_runtime_ms double, embedding_cached boolean")
    assert tuple(report.performance(p).first()) == (2, 1, 20.0)
