"""Further queries over the photo catalog, each with its SQL; registered beside those of ``catalog_queries``.

Thresholds and weights stand as numbers in the SQL here, so that a wrong constant shows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import shared_folder
from ..functions.ranks import placed
from ..operators import advice, business, decision, export, generations, panel, pixels, preference, report, review, similarity, tasks
from ..sources import adapters as A
from ..sources import catalog, session
from ..streaming import decisions
from . import analysis
from .catalog_queries import _FINAL, _SCORES, _SUGGEST, _advised, _case, _decided, _final, _list, _tagged, _TAGS2, _with, query

def _none() -> Column:
    """An empty list of texts."""
    return F.array().cast("array<string>")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _text(column: str, values: list[str]) -> str:
    """SQL for one of some texts by a number; Spark and DuckDB alike."""
    return f"CASE {column} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in enumerate(values)) + " END"


# -- scalars

_NAMES = ["a.JPG", "b:c?.png", "no suffix", "x. .", ".hidden", "two.dots.tif", "  "]


@query(
    "q_file_names",
    _with(f"""SELECT idx, n, CASE WHEN s = '' THEN '未命名' ELSE s END || CASE WHEN e = '' THEN '.jpg' ELSE e END AS safe, lower(replace(e, '.', '')) AS suffix
    FROM (SELECT idx, n, regexp_extract(n, '[^/.][^/]*(\\.[^./]+)$', 1) AS e, rtrim(regexp_replace(trim(regexp_replace(n, '^(.+)\\.[^./]*$', '\\1')), '[<>:"/\\\\|?*]', '_', 'g'), ' .') AS s
    FROM (SELECT idx, {_text('k % 7', _NAMES)} AS n FROM photos) x) y"""),
)
def file_names(spark, d):
    n = F.expr(_text("k % 7", _NAMES))
    return A.photos(spark, d).select("idx", n.alias("n"), S.safe_file_name(n).alias("safe"), S.suffix(n).alias("suffix"))


@query(
    "q_sizes",
    _with("""SELECT idx, CASE WHEN height >= width THEN '竖图' ELSE '横图' END AS orientation, CASE WHEN m > 2400 THEN greatest(1, floor(width * (2400 / m)))::INT ELSE width END AS w, CASE
  WHEN m > 2400 THEN greatest(1, floor(height * (2400 / m)))::INT ELSE height END AS h,
    CASE WHEN k % 250 <= 130 THEN 240 WHEN k % 250 <= 180 THEN 320 ELSE 440 END::INT AS tier_w, CASE WHEN k % 250 <= 130 THEN 180 WHEN k % 250 <= 180 THEN 240 ELSE 330 END::INT AS tier_h,
    CASE WHEN k % 9 >= 5 THEN height ELSE width END AS turned_w, CASE WHEN k % 9 >= 5 THEN width ELSE height END AS turned_h FROM (SELECT *, greatest(width, height) AS m FROM photos) x"""),
)
def sizes(spark, d):
    fit, tier = S.fit_size(F.col("width"), F.col("height"), 2400), S.thumbnail_tier(F.col("k") % 250)
    turned = catalog.oriented(F.col("width"), F.col("height"), F.col("k") % 9)
    return A.photos(spark, d).select("idx", S.orientation(F.col("width"), F.col("height")).alias("orientation"), fit["width"].alias("w"), fit["height"].alias("h"), tier["width"].alias("tier_w"), tier["height"].alias("tier_h"), turned["width"].alias("turned_w"), turned["height"].alias("turned_h"))


@query(
    "q_cache_keys",
    _with("""SELECT idx, sha1(path || ':' || (k * 7)::VARCHAR || ':' || (k % 1000)::VARCHAR || ':openclip') AS embedding_key,
    replace(split_part(path, '/', -1), '.jpg', '') || '_' || substr(sha1(path || ':' || (k % 1000)::VARCHAR || ':' || (k * 7)::VARCHAR || ':360:contain'), 1, 16) || '.jpg' AS thumbnail FROM photos"""),
)
def cache_keys(spark, d):
    size, mtime = F.col("k") * 7, F.col("k") % 1000
    return A.photos(spark, d).select("idx", S.cache_key(F.col("path"), size, mtime, F.lit("openclip")).alias("embedding_key"), S.thumbnail_name(F.col("path"), mtime, size, 360, "contain").alias("thumbnail"))


_HEX = "array_to_string(list_transform(range(0, 16), lambda i: substr('0123456789abcdef', 1 + 8 * bits[4 * i + 1]::INT + 4 * bits[4 * i + 2]::INT + 2 * bits[4 * i + 3]::INT + bits[4 * i + 4]::INT, 1)), '')"


@query("q_hash_text", f"""WITH {A.BURSTS_SQL} SELECT v.idx, {_HEX.replace('bits', 'v.bits')} AS hex, CASE WHEN v.idx % 5 = 0 THEN 64 ELSE hamming(v.bits, w.bits) END::INT AS distance FROM vectors v JOIN vectors w
  ON w.idx = v.idx - v.idx % 4""")
def hash_text(spark, d):
    """Hashes as text, and the distance of each to its burst's first; a blank hash is 64 away."""
    v = A.bursts(spark, d).select("idx", S.hash_to_hex(F.col("hash")).alias("hex"))
    first = v.select(F.col("idx").alias("base"), F.col("hex").alias("other"))
    met = v.withColumn("base", F.col("idx") - F.pmod("idx", F.lit(4))).join(first, "base")
    blank = F.when(F.col("idx") % 5 == 0, "").otherwise(F.col("hex"))
    return met.select("idx", "hex", S.hamming_hex(blank, F.col("other")).alias("distance"))


@query(
    "q_json_lists",
    _with("""SELECT idx, to_json([t1, t2])::VARCHAR AS kept, to_json(issue_tags)::VARCHAR AS chosen, array_to_string([t1, t2], '|') AS decoded, array_to_string(issue_tags, '|') AS decoded_chosen,
    array_to_string(CASE WHEN list_contains(delivery_use, '仅留档') THEN list_filter(delivery_use, lambda x: x <> '仅留档') ELSE list_append(delivery_use, '仅留档') END, '|') AS toggled,
    array_to_string(CASE WHEN list_contains(delivery_use, '不导出') THEN delivery_use ELSE list_append(delivery_use, '不导出') END, '|') AS once, CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN ''
  ELSE '1|x' END AS odd FROM photos"""),
)
def json_lists(spark, d):
    """Lists as JSON, with and without blanks, and back; what is no list is empty."""
    p = A.photos(spark, d)
    both = F.array("t1", "t2")
    odd = F.expr("CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN 'no json' WHEN 2 THEN '{\"a\": 1}' ELSE '[1, \"x\"]' END")
    shown = lambda c: F.array_join(c, "|")
    return p.select(
        "idx", S.encode_tags(both).alias("kept"), S.encode_choices(both).alias("chosen"), shown(S.decode_tags(S.encode_tags(both))).alias("decoded"), shown(S.decode_choices(S.encode_tags(both))).alias("decoded_chosen"),
        shown(S.toggled(F.col("delivery_use"), "仅留档")).alias("toggled"), shown(S.append_once(F.col("delivery_use"), V.NO_EXPORT)).alias("once"), shown(S.decode_tags(odd)).alias("odd"),
    )


@query(
    "q_times",
    _with("""SELECT idx, CASE k % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'last summer' END AS taken,
    lpad((k % 90000 // 60)::VARCHAR, greatest(2, length((k % 90000 // 60)::VARCHAR))::INT, '0') || ':' || lpad((k % 60)::VARCHAR, 2, '0') AS elapsed FROM photos"""),
)
def times(spark, d):
    """Capture times of both EXIF forms, other text as it is; and times between two texts."""
    at = F.col("ts").cast("timestamp")
    raw = F.when(F.col("k") % 3 == 0, F.date_format(at, "yyyy:MM:dd HH:mm:ss")).when(F.col("k") % 3 == 1, F.concat(F.lit(" "), F.date_format(at, "yyyy-MM-dd HH:mm:ss"), F.lit(" "))).otherwise(" last summer")
    seconds = F.floor(F.col("k") % 90000 / 60) * 60 + F.col("k") % 60
    return A.photos(spark, d).select("idx", S.exif_time(raw).alias("taken"), S.minutes_seconds(seconds).alias("elapsed"))


@query(
    "q_numbers",
    _with("""SELECT idx, CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 100 WHEN 2 THEN 0 WHEN 3 THEN (k % 100)::INT ELSE 0 END::INT AS score, CASE k % 5 WHEN 3 THEN 7 WHEN 1 THEN 250 ELSE 5 END::INT AS whole,
    CASE WHEN quality_rating = '' THEN '' ELSE quality_rating || '：' || CASE quality_rating WHEN 'S' THEN '强烈推荐' WHEN 'A' THEN '可交付' WHEN 'B' THEN '备选' WHEN 'C' THEN '留档/练习'
      ELSE '废片' END END AS rating,
    CASE WHEN photo_type = '' THEN '无法判断' ELSE photo_type END AS kind FROM photos"""),
)
def numbers(spark, d):
    k = F.col("k")
    text = F.when(k % 5 == 0, "abc").when(k % 5 == 1, "250").when(k % 5 == 2, "-3.5").when(k % 5 == 3, F.concat((k % 100).cast("string"), F.lit(".7"))).otherwise("")
    whole = F.when(k % 5 == 3, "7").when(k % 5 == 1, "250").otherwise("x")
    return A.photos(spark, d).select("idx", S.safe_score(text).alias("score"), S.safe_int(whole, 5).alias("whole"), S.rating_label(F.col("quality_rating")).alias("rating"), S.normal_type(F.col("photo_type")).alias("kind"))


_FOLDERS = ["/home/user/pictures/wedding", "/p", "", "/a/" + "n" * 50, "/" + "m" * 30 + "/" + "o" * 20]


@query(
    "q_project_text",
    _with(f"SELECT idx, {_text('k % 5', ['项目：pictures/wedding', '项目：p', '项目：-', '项目：.../' + 'n' * 36, '项目：.../' + 'o' * 20])} AS shown, k % 3 <> 2 AS same FROM photos"),
)
def project_text(spark, d):
    path = F.col("path")
    other = F.when(F.col("k") % 3 == 0, F.concat(F.lit("file://"), F.replace(path, F.lit("/photos/"), F.lit("/photos/./x/../")))).when(F.col("k") % 3 == 1, path).otherwise(F.concat(path, F.lit("x")))
    return A.photos(spark, d).select("idx", session.project_text(F.expr(_text("k % 5", _FOLDERS))).alias("shown"), session.same_path(path, other).alias("same"))


# -- categories, reviews and texts


@query("q_export_category", _with(f", {_FINAL} SELECT idx, CASE WHEN k % 3 = 0 THEN fin ELSE '已定/类' END AS category, CASE WHEN k % 3 = 0 THEN '' ELSE '已定' END AS head FROM finals"))
def export_category(spark, d):
    """The stored category, or the one that rules make; and the parts of the stored one."""
    p = A.photos(spark, d).withColumn("final_category", F.when(F.col("k") % 3 == 0, "").otherwise("已定/类"))
    return p.select("idx", review.export_category().alias("category"), F.when(F.col("k") % 3 == 0, "").otherwise(review.split_category(F.col("final_category"))["primary"]).alias("head"))


@query(
    "q_type_text",
    _with("""SELECT idx, CASE WHEN photo_type <> '' THEN photo_type || CASE WHEN subtype <> '' THEN ' / ' || subtype ELSE '' END
    WHEN ai_primary_category <> '' THEN 'AI建议：' || ai_primary_category || CASE WHEN ai_secondary_category <> '' THEN ' / ' || ai_secondary_category ELSE '' END ELSE '-' END AS type_text FROM photos"""),
)
def type_text(spark, d):
    return A.photos(spark, d).select("idx", review.type_text().alias("type_text"))


_PREVIEW = """filename || ' | ' || CASE WHEN photo_type <> '' THEN photo_type || CASE WHEN subtype <> '' THEN ' / ' || subtype ELSE '' END
  WHEN ai_primary_category <> '' THEN 'AI建议：' || ai_primary_category || CASE WHEN ai_secondary_category <> '' THEN ' / ' || ai_secondary_category ELSE '' END ELSE '-' END
  || ' | ' || CASE quality_rating WHEN 'S' THEN 'S：强烈推荐' WHEN 'A' THEN 'A：可交付' WHEN 'B' THEN 'B：备选' WHEN 'C' THEN 'C：留档/练习' WHEN 'X' THEN 'X：废片' ELSE '-' END
  || ' | ' || CASE WHEN len(delivery_use) = 0 THEN '-' ELSE array_to_string(delivery_use, '、') END || ' | ' || CASE WHEN review_status = '' THEN '未审' ELSE review_status END"""
_TILE = """filename || chr(10) || width || ' x ' || height || ' · ' || printf('%.2f MB', file_size_mb) || chr(10) || '手动：' || manual_category || '｜AI：'
  || CASE WHEN ai_primary_category = '' THEN '-' WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category ELSE ai_primary_category END
  || '｜置信度：' || CASE WHEN ai_primary_category = '' THEN '-' ELSE printf('%.2f', ai_confidence) END || chr(10) || '相似组：' || CASE WHEN similar_group_id = '' THEN '-' ELSE similar_group_id END
  || '｜质量：' || CASE WHEN len(issue_tags) = 0 THEN '-' ELSE array_to_string(issue_tags, ', ') END"""


@query("q_info_texts", _with(f"SELECT idx, {_PREVIEW} AS preview, {_TILE} AS tile FROM photos"))
def info_texts(spark, d):
    p = A.photos(spark, d).withColumn("ai_quality_tags", F.col("issue_tags"))
    return p.select("idx", panel.preview_text().alias("preview"), panel.tile_text().alias("tile"))


_DETAILED = {
    "ai_source": "CASE WHEN k % 2 = 0 THEN 'local' ELSE '' END", "retouch_suggestion": "CASE WHEN k % 3 = 0 THEN 'crop it' ELSE '' END", "crop_suggestion": "''", "style_label": "CASE WHEN k % 4 = 0 THEN 'calm' ELSE '' END", "portfolio_suggestion": "'p'",
    "delivery_suggestion": "''", "ai_reason": "CASE WHEN k % 5 = 0 THEN '' ELSE 'seen' END", "final_reason": "CASE WHEN k % 2 = 0 THEN 'final' ELSE '' END", "screening_reason": "''", "preference_reason": "''", "user_preference_reason": "CASE WHEN k % 3 = 1 THEN 'liked' ELSE '' END",
}
_SEEN = f"""seen AS (SELECT *, k % 7 = 3 AS fresh, {', '.join(f'{v} AS {c}' for c, v in _DETAILED.items())}, (k % 5)::INT AS similar_group_size, (k % 4)::INT AS group_rank, (k % 3)::INT AS group_size, (k % 3)::INT AS refs FROM finals)"""
_OPEN = "CASE WHEN fresh THEN {} ELSE '-' END"


def _or_dash(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '-')"


@query(
    "q_details",
    _with(f""", {_FINAL}, {_SEEN} SELECT idx,
    {_OPEN.format("CASE WHEN ai_primary_category = '' THEN '-' WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category ELSE ai_primary_category END")} AS ai_path,
      {_OPEN.format(_or_dash('ai_primary_category'))} AS primary_,
    {_OPEN.format("CASE WHEN ai_primary_category = '' THEN '-' ELSE printf('%.2f', ai_confidence) END")} AS confidence, {_OPEN.format(_or_dash('ai_source'))} AS source,
      {_OPEN.format("CASE WHEN final_pick_score = 0 THEN '-' ELSE printf('%.1f', final_pick_score) END")} AS final_pick_score,
    {_OPEN.format("CASE WHEN people = 0 THEN '-' ELSE people::VARCHAR END")} AS detected_people, {_OPEN.format("CASE WHEN retouch_suggestion <> '' THEN '是' ELSE '-' END")} AS retouchable,
    CASE WHEN similar_group_id = '' THEN '-' ELSE similar_group_id || '（本组共 ' || similar_group_size || ' 张，状态：' || CASE similar_group_status WHEN 'best' THEN '组内最佳' WHEN 'backup' THEN '组内备选'
      WHEN 'duplicate' THEN '重复淘汰' WHEN 'review' THEN '待复核' WHEN 'rejected' THEN '组内淘汰' ELSE '-' END
      || '，AI推荐：' || CASE WHEN ai_recommended_best THEN '是' ELSE '否' END || '）' END AS similar,
    CASE WHEN absolute_quality_score = 0 THEN '-' ELSE printf('%.1f', absolute_quality_score) END AS absolute_score, CASE WHEN group_rank = 0 OR group_size = 0 THEN '-'
      ELSE group_rank || '/' || group_size END AS group_rank, CASE WHEN best_in_group THEN '是' ELSE '否' END AS recommended,
    {_or_dash('preference_reason', 'user_preference_reason')} AS preference_reason, {_OPEN.format(_or_dash('final_reason', 'ai_reason'))} AS final_reason,
      {_OPEN.format(_or_dash('screening_reason', 'final_reason', 'ai_reason'))} AS screening_reason,
    {_OPEN.format(_or_dash('style_label'))} AS style_label, {_OPEN.format("'p'")} AS portfolio_suggestion, {_OPEN.format('fin')} AS final_recommendation, CASE WHEN refs = 0 THEN '-'
  ELSE printf('喜欢 %.2f / 不喜欢 %.2f / 参考 %d 张', 0.5e0, 0e0, refs) END AS history FROM seen"""),
)
def details(spark, d):
    """The detail panel, of which most is shown only beside a current suggestion (every seventh photo)."""
    zero, k = F.lit(0.0), F.col("k")
    refs = (k % 3).cast("int")
    p = _final(spark, d).withColumns(
        {c: F.expr(v) for c, v in _DETAILED.items()}
        | {
            "ai_suggestion": F.expr(_SUGGEST), "ai_quality_tags": F.col("issue_tags"), "top3_semantic_matches": _none(), "semantic_confidence": zero, "detected_person_count": F.col("people"), "people_count": F.lit(0), "detection_confidence": zero, "subject_area_ratio": zero, "subject_center_score": zero,
            "edge_cutoff_risk": zero, "similar_group_size": (k % 5).cast("int"), "group_rank": (k % 4).cast("int"), "group_size": refs, "recommended_keep": F.col("best_in_group"), "recommended_in_group": F.lit(False), "user_preference_score": zero,
            "similar_reference_count": refs, "aesthetic_like_similarity": F.when(refs > 0, 0.5).otherwise(0.0), "aesthetic_dislike_similarity": zero,
        }
    )
    shown = panel.details()
    wanted = ["ai_path", "confidence", "source", "final_pick_score", "detected_people", "retouchable", "similar", "absolute_score", "group_rank", "recommended", "preference_reason", "final_reason", "screening_reason", "style_label", "portfolio_suggestion", "final_recommendation", "history"]
    return p.select("idx", shown["primary"].alias("primary_"), *(shown[c].alias(c) for c in wanted))


@query("q_notes", _with("SELECT idx, CASE WHEN k % 3 = 0 THEN 'new ' || idx ELSE 'old' END AS user_note, CASE WHEN k % 3 = 0 AND review_note = '' THEN 'new ' || idx ELSE review_note END AS review_note FROM photos"))
def notes(spark, d):
    p = A.photos(spark, d).withColumn("user_note", F.lit("old"))
    edited = p.where(F.col("k") % 3 == 0).select("path", F.concat(F.lit("new "), F.col("idx").cast("string")).alias("note"))
    return panel.noted(p, edited).select("idx", "user_note", "review_note")


@query(
    "q_review_data",
    _with("""SELECT idx, to_json({photo_type: photo_type, subtype: CASE WHEN photo_type = '' THEN '' ELSE subtype END, quality_rating: quality_rating, delivery_use: delivery_use, issue_tags: issue_tags,
    commercial_score: (k % 101)::INT, portfolio_score: (k % 97)::INT, review_note: review_note, review_status: '人工已确认'})::VARCHAR AS human_decision FROM photos"""),
)
def review_data(spark, d):
    p = A.photos(spark, d).withColumns({"commercial_score": (F.col("k") % 101).cast("int"), "portfolio_score": (F.col("k") % 97).cast("int"), "photo_type": F.concat(F.lit(" "), F.col("photo_type"))})
    return p.select("idx", panel.review_data()["human_decision"].alias("human_decision"))


@query(
    "q_reset_reviews",
    _with("""SELECT idx, CASE WHEN k % 4 = 0 THEN '' ELSE photo_type END AS photo_type, CASE WHEN k % 4 = 0 THEN '' ELSE quality_rating END AS quality_rating, CASE WHEN k % 4 = 0 THEN 0
  ELSE len(delivery_use) END::INT AS n_uses, CASE WHEN k % 4 = 0 THEN '未审' ELSE review_status END AS review_status, CASE WHEN k % 4 = 0 THEN '' ELSE 'd' END AS human_decision FROM photos"""),
)
def reset_reviews(spark, d):
    p = A.photos(spark, d).withColumn("human_decision", F.lit("d"))
    out = review.reset_reviews(p, p.where(F.col("k") % 4 == 0).select("path"))
    return out.select("idx", "photo_type", "quality_rating", F.size("delivery_use").alias("n_uses"), "review_status", "human_decision")


_PAYLOAD = """'{"decision": {"quality_rating": "' || quality_rating || '", "commercial_score": ' || CAST(k % 90 AS STRING) || '.5, "portfolio_score": 0.0, "delivery_use": ["客户可选", "精修候选"], "issue_tags": [], "reason": "r"}}'"""


@query(
    "q_summary_text",
    _with("""SELECT idx, CASE WHEN k % 2 = 0 THEN '未分析' ELSE '品质等级：' || CASE WHEN quality_rating = '' THEN '-' ELSE quality_rating END || chr(10) || '商业交付：' || (k % 90) || '.5' || chr(10) || '作品集价值：-' || chr(10) || '建议用途：客户可选 / 精修候选' END AS head FROM photos"""),
)
def summary_text(spark, d):
    payload = F.when(F.col("k") % 2 == 0, "{}").otherwise(F.expr(_PAYLOAD))
    text = review.summary_text(payload)
    return A.photos(spark, d).select("idx", F.array_join(F.slice(F.split(text, "\n"), 1, 4), "\n").alias("head"))


@query(
    "q_apply_results",
    _with(f""", {_FINAL} SELECT idx, CASE WHEN k % 2 = 0 THEN '婚纱照' ELSE ai_primary_category END AS ai_primary_category, CASE WHEN k % 2 = 0 THEN 0.9e0 ELSE ai_confidence END AS ai_confidence,
    CASE WHEN k % 2 = 0 AND NOT manual_override THEN '婚纱照' WHEN k % 2 = 0 THEN mp ELSE fin END AS final_category, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'why' WHEN k % 3 = 0 THEN ''
  ELSE 'kept' END AS screening_reason FROM finals"""),
)
def apply_results(spark, d):
    """Results of every second photo, and one of a photo that the catalog hasn't."""
    p = _final(spark, d).withColumns({"screening_reason": F.when(F.col("k") % 3 == 0, "").otherwise("kept"), "ai_reason": F.lit("")})
    new = p.where(F.col("k") % 2 == 0).select("path", F.lit("婚纱照").alias("ai_primary_category"), F.lit("").alias("ai_secondary_category"), F.lit(0.9).alias("ai_confidence"), F.lit("why").alias("ai_reason"))
    new = new.unionByName(spark.createDataFrame([("/nowhere.jpg", "婚纱照", "", 0.9, "why")], new.schema))
    return advice.apply_results(p, new).select("idx", "ai_primary_category", "ai_confidence", "final_category", "screening_reason")


@query(
    "q_decision_reason",
    _with(f""", {_SCORES} SELECT idx, '综合建议为 ' || q || ' ' || CASE q WHEN 'S' THEN '强烈推荐' WHEN 'A' THEN '可交付' WHEN 'B' THEN '备选' WHEN 'C' THEN '留档/练习' ELSE '废片' END || '，商业交付分 ' || round_even(c,
  0)::BIGINT || '，作品集分 ' || round_even(p, 0)::BIGINT
    || CASE WHEN len(tags) > 0 THEN '；主要风险：' || array_to_string(tags, '、') ELSE '' END || CASE WHEN k % 2 = 0 THEN '；曝光较稳定' ELSE '' END || CASE WHEN p_composition <> '' THEN '；构图问题优先视为可修或可裁切风险，不直接判废'
  ELSE '' END || '。' AS reason FROM used"""),
)
def decision_reason(spark, d):
    return _decided(spark, d).select("idx", "reason")


@query("q_first_subtype", _with(f"SELECT idx, CASE WHEN list_contains(s, '全身') THEN '全身' ELSE s[1] END AS subtype FROM (SELECT idx, CASE photo_type " + " ".join(f"WHEN '{t}' THEN {_list(s)}" for t, s in V.SUBTYPES.items()) + " ELSE ['未细分'] END AS s FROM photos) x"))
def first_subtype(spark, d):
    """The wanted subtype where a type has it, else the type's first."""
    dim = spark.createDataFrame([(t, business.first_valid_subtype(t, "全身")) for t in V.PHOTO_TYPES], "photo_type string, subtype_ string")
    return A.photos(spark, d).join(F.broadcast(dim), "photo_type", "left").select("idx", F.coalesce("subtype_", F.lit(V.DEFAULT_SUBTYPE)).alias("subtype"))


# -- groups and lists


def _photo_bursts(spark: SparkSession, d: str) -> DataFrame:
    """Bursts with every column that grouping reads."""
    idx = F.col("idx")
    score = lambda n, by: (F.pmod(idx * n, F.lit(1009)) / by).cast("double")
    return A.bursts(spark, d).withColumns(
        {
            "path": F.concat(F.lit("/v/"), F.col("filename")), "clarity": score(31, 10.09), "exposure": score(37, 10.09), "contrast": score(41, 10.09), "absolute_quality_score": F.when(idx % 7 == 0, 0.0).otherwise(score(43, 10.09)), "commercial_score": F.when(idx % 7 == 0, 0.0).otherwise(score(47, 10.09)),
            "portfolio_score": score(53, 10.09), "semantic_score": score(59, 10.09), "final_pick_score": F.when(idx % 3 == 0, 0.0).otherwise(score(61, 10.09)), "basic_score": F.when(idx % 5 == 0, F.lit(None)).otherwise(score(67, 10.09)), "quality_rating": F.expr("substr('SABCX', cast(idx % 5 + 1 as int), 1)"),
            "issue_tags": F.when(idx % 4 == 1, F.array(F.lit("虚焦"))).otherwise(_none()), "ai_quality_tags": F.when(idx % 3 == 1, F.array(F.lit("清晰"))).when(idx % 3 == 2, F.array(F.lit("轻微模糊"))).otherwise(_none()), "best_in_group": idx % 11 == 0, "similar_group_note": F.lit(""),
            "human_group_decision": F.when(idx % 13 == 0, '{"decision_source": "human"}').otherwise(""), "similar_group_status": F.when(idx % 11 == 0, "best").otherwise(""), "review_status": F.lit(V.UNREVIEWED), "ai_primary_category": F.lit("单人写真"), "ai_secondary_category": F.lit("年轻女生"),
            "ai_confidence": score(71, 1009.0), "similar_group_id": F.lit(""), "delivery_use": _none(), "recommended_keep": F.lit(False),
        }
    )


def _grouped_sql(threshold: int) -> str:
    at = lambda n, by: f"(v.idx * {n} % 1009) / {by}::DOUBLE"
    return f"""WITH RECURSIVE {A.BURSTS_SQL}, pairs AS (SELECT a.idx AS i, b.idx AS j FROM vectors a JOIN vectors b ON a.idx < b.idx WHERE hamming(a.bits, b.bits) <= {threshold}),
both_ AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs), reach AS (SELECT i AS v, i AS r FROM both_ UNION SELECT reach.v, both_.j FROM reach JOIN both_ ON both_.i = reach.r),
roots AS (SELECT v AS idx, min(r) AS root FROM reach GROUP BY v), numbered AS (SELECT root, row_number() OVER (ORDER BY root) AS group_no FROM (SELECT DISTINCT root FROM roots) x),
p AS (
  SELECT v.idx, v.filename, v.bits, r.root, n.group_no, {at(31, 10.09)} AS clarity, {at(37, 10.09)} AS exposure, {at(41, 10.09)} AS contrast, CASE WHEN v.idx % 7 = 0 THEN 0
    ELSE {at(43, 10.09)} END AS absolute_quality_score, CASE WHEN v.idx % 7 = 0 THEN 0 ELSE {at(47, 10.09)} END AS commercial_score,
    {at(53, 10.09)} AS portfolio_score, {at(59, 10.09)} AS semantic_score, CASE WHEN v.idx % 3 = 0 THEN 0 ELSE {at(61, 10.09)} END AS final_pick_score, CASE WHEN v.idx % 5 = 0 THEN NULL
      ELSE {at(67, 10.09)} END AS basic_score, substr('SABCX', (v.idx % 5 + 1)::INT, 1) AS quality_rating,
    CASE WHEN v.idx % 4 = 1 THEN ['虚焦'] ELSE [] END AS issue_tags, CASE v.idx % 3 WHEN 1 THEN ['清晰'] WHEN 2 THEN ['轻微模糊'] ELSE []::VARCHAR[] END AS tags, {at(71, 1009.0)} AS ai_confidence
  FROM vectors v LEFT JOIN roots r USING (idx) LEFT JOIN numbered n ON n.root = r.root
)"""


@query(
    "q_first_groups",
    _grouped_sql(6) + """, s AS (SELECT *, clarity * 0.55e0 + exposure * 0.30e0 + contrast * 0.15e0 AS score FROM p), b AS (SELECT root, arg_max(idx, (score, -idx)) AS best FROM s WHERE root IS NOT NULL GROUP BY root)
    SELECT s.idx, group_no::INT AS similar_group_id, best IS NULL OR best = s.idx AS recommended_in_group, best IS NOT NULL AND best <> s.idx AS is_duplicate FROM s LEFT JOIN b ON b.root = s.root""",
)
def first_groups(spark, d):
    p = _photo_bursts(spark, d)
    return panel.first_groups(p, similarity.hamming_links(p, 6))


@query(
    "q_second_groups",
    _grouped_sql(6) + """, s AS (SELECT *, CASE WHEN final_pick_score <> 0 THEN final_pick_score ELSE absolute_quality_score END + CASE idx % 3 WHEN 1 THEN 6 WHEN 2 THEN -18 ELSE 0 END AS q FROM p WHERE root IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY q DESC, idx) AS rank, count(*) OVER (PARTITION BY root) AS size FROM s), t AS (SELECT *, round((size - rank + 1) / size * 100,
      2) AS relative FROM r)
    SELECT idx, lpad(group_no::VARCHAR, 3, '0') AS similar_group_id, size::INT AS group_size, rank::INT AS group_rank, relative::DOUBLE AS relative_quality_score,
      round(absolute_quality_score * 0.35e0 + semantic_score * 0.25e0 + relative * 0.25e0, 2)::DOUBLE AS final_pick_score, rank <= 1 AS recommended_keep,
    CASE WHEN rank <= 1 THEN '单人写真' ELSE '相似重复待选' END AS ai_primary_category, round(CASE WHEN rank <= 1 THEN ai_confidence ELSE greatest(ai_confidence, 0.82) END, 6)::DOUBLE AS ai_confidence,
    array_to_string(list_append(tags, CASE WHEN rank <= 1 THEN '推荐保留' ELSE '重复' END), ',') AS tags, CASE WHEN rank <= 1 THEN '相似组 ' || lpad(group_no::VARCHAR, 3,
      '0') || '，共 ' || size || ' 张，本图排名 ' || rank || '/' || size || '。清晰度、语义匹配和主体完整性在本组较好，建议保留复核。'
      ELSE '与同组照片高度相似，当前排名 ' || rank || '/' || size || '，建议作为相似重复待选，不自动删除。' END AS ai_reason, CASE WHEN rank <= 1 THEN '相似组推荐保留' ELSE '相似重复待选' END AS final_recommendation FROM t""",
)
def second_groups(spark, d):
    p = _photo_bursts(spark, d)
    out = panel.second_groups(p, similarity.hamming_links(p, 6))
    return out.select("idx", "similar_group_id", "group_size", "group_rank", "relative_quality_score", "final_pick_score", "recommended_keep", "ai_primary_category", F.round("ai_confidence", 6).alias("ai_confidence"), F.array_join("ai_quality_tags", ",").alias("tags"), "ai_reason", "final_recommendation")


_SCORED = """s AS (SELECT *, CASE WHEN absolute_quality_score <> 0 THEN absolute_quality_score * 0.35e0 ELSE 0 END + CASE WHEN commercial_score <> 0 THEN commercial_score * 0.35e0
  ELSE 0 END + portfolio_score * 0.15e0
  + CASE quality_rating WHEN 'S' THEN 18 WHEN 'A' THEN 14 WHEN 'B' THEN 8 WHEN 'C' THEN 2 ELSE -12 END - 16 * len(issue_tags) AS base, absolute_quality_score = 0 AND commercial_score = 0 AS lacking
    FROM p WHERE root IS NOT NULL),
q AS (SELECT *, base + CASE WHEN lacking THEN coalesce(basic_score * 0.45e0, 35) ELSE 0 END AS pick, base + CASE WHEN lacking THEN coalesce(basic_score * 0.35e0, 35) ELSE 0 END AS rank_score FROM s),
g AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY rank_score DESC, idx) AS rank, count(*) OVER (PARTITION BY root) AS size, first(idx) OVER w = idx AS best,
  first(filename) OVER w AS chosen, first(bits) OVER (PARTITION BY root ORDER BY idx) AS first_bits FROM q WINDOW w AS (PARTITION BY root ORDER BY pick DESC, idx))"""


@query(
    "q_group_recommendations",
    _grouped_sql(8) + f""", {_SCORED} SELECT p.idx, CASE WHEN g.idx IS NULL THEN '' ELSE '组' || lpad(g.group_no::VARCHAR, 3, '0') END AS similar_group_id, coalesce(size, 0)::INT AS similar_group_size, coalesce(rank,
  0)::INT AS similar_group_rank, coalesce(best, false) AS ai_recommended_best,
    CASE WHEN g.idx IS NULL THEN 0 ELSE round(1 - hamming(first_bits, p.bits) / 64.0, 4) END::DOUBLE AS similarity_score, CASE WHEN p.idx % 11 = 0 THEN 'best' WHEN g.idx IS NULL THEN ''
      WHEN p.idx % 13 = 0 THEN '' ELSE 'review' END AS similar_group_status,
    CASE WHEN g.idx IS NULL THEN '' WHEN best THEN '该照片在同组 ' || size || ' 张中综合评分较高，清晰度/交付评分更稳定' || CASE WHEN len(p.issue_tags) = 0 AND len(p.tags) = 0 THEN '，未发现明显虚焦或闭眼风险'
      WHEN len(p.issue_tags) = 0 THEN '，且主要风险较少' ELSE '，但仍需人工复核风险标签' END || '，推荐作为组内最佳。'
      ELSE '与同组照片高度相似，建议对比 ' || chosen || ' 后决定。' END AS reason FROM p LEFT JOIN g ON g.idx = p.idx""",
)
def group_recommendations(spark, d):
    """Hashes to groups, with ranks, the recommended photo and its reason; rows that a human has decided keep their status."""
    p = _photo_bursts(spark, d)
    out = similarity.assign_groups(p, similarity.hamming_links(p, V.HAMMING_BY_MODE["standard"]))
    return out.select("idx", "similar_group_id", "similar_group_size", F.col("similar_group_rank").cast("int").alias("similar_group_rank"), "ai_recommended_best", "similarity_score", "similar_group_status", F.col("ai_similarity_reason").alias("reason"))


_STATUS = """c AS (SELECT similar_group_id AS g, min(idx) AS target FROM photos WHERE similar_group_id <> '' GROUP BY 1),
j AS (SELECT p.*, c.target = p.idx AS is_target, c.target IS NOT NULL AND c.target % 3 = 0 AS best, c.target IS NOT NULL AND c.target % 3 = 1 AS twin FROM photos p LEFT JOIN c
  ON c.g = p.similar_group_id)"""


@query(
    "q_set_status",
    _with(f""", {_STATUS} SELECT idx, CASE WHEN is_target AND best THEN 'best' WHEN is_target AND twin THEN 'duplicate' WHEN is_target THEN 'backup' WHEN best AND similar_group_status NOT IN ('duplicate',
  'rejected') AND review_status <> '人工已确认' AND similar_group_status = '' THEN 'backup' ELSE similar_group_status END AS status,
    CASE WHEN best THEN is_target ELSE best_in_group END AS best_in_group, CASE WHEN is_target AND quality_rating = '' AND twin THEN 'C' WHEN is_target AND quality_rating = '' AND NOT best THEN 'B'
      ELSE quality_rating END AS rating, CASE WHEN is_target THEN '人工已确认' ELSE review_status END AS review_status,
    is_target AND twin AS marked FROM (SELECT * REPLACE (coalesce(is_target, false) AS is_target) FROM j) x"""),
)
def set_status(spark, d):
    """In each group the first photo is given a status: best, duplicate or backup."""
    p = A.photos(spark, d).withColumns({"similar_group_note": F.lit(""), "human_group_decision": F.lit(""), "recommended_keep": F.lit(False), "issue_tags": _none(), "delivery_use": _none()})
    first = p.where(F.col("similar_group_id") != "").groupBy("similar_group_id").agg(F.min("idx").alias("idx"))
    choices = p.select("idx", "path").join(first.select("idx"), "idx").select("path", F.when(F.col("idx") % 3 == 0, "best").when(F.col("idx") % 3 == 1, "duplicate").otherwise("backup").alias("status"))
    out = similarity.set_status(p, choices, F.lit("t"))
    return out.select("idx", F.col("similar_group_status").alias("status"), "best_in_group", F.col("quality_rating").alias("rating"), "review_status", (F.array_contains("issue_tags", "重复照片") & F.array_contains("delivery_use", V.NO_EXPORT)).alias("marked"))


@query("q_group_members", _with("SELECT row_number() OVER (ORDER BY CASE WHEN k % 6 = 0 THEN 999 ELSE k % 6 END, filename, idx)::INT AS place, idx FROM photos WHERE similar_group_id = '组100'"))
def group_members(spark, d):
    p = A.photos(spark, d).withColumn("similar_group_rank", (F.col("k") % 6).cast("int"))
    return placed(panel.members(p, "组100"), panel.panel_order(), "place").select(F.col("place").cast("int").alias("place"), "idx")


@query("q_drilled", _with("SELECT idx FROM photos WHERE similar_group_id <> '' AND similar_group_id = (SELECT similar_group_id FROM photos WHERE idx = (SELECT min(idx) FROM photos WHERE similar_group_id <> ''))"))
def drilled(spark, d):
    """The group of one photo, found by its path."""
    p = A.photos(spark, d)
    path = p.where("similar_group_id <> ''").agg(F.min_by("path", "idx")).first()[0]
    return panel.drilled(p, path).select("idx")


@query("q_zipped", _with("SELECT a.idx, b.idx AS right_idx FROM (SELECT idx, row_number() OVER (ORDER BY idx) AS n FROM photos) a JOIN (SELECT idx, row_number() OVER (ORDER BY idx) AS n FROM photos WHERE k % 2 = 0) b USING (n)"))
def zipped(spark, d):
    p = A.photos(spark, d).select("idx", "k")
    return panel.zipped(p.select("idx"), p.where(F.col("k") % 2 == 0).select("idx"))


@query("q_batches", _with("SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 40 AS batch FROM photos"))
def batches(spark, d):
    return panel.batches(A.photos(spark, d).select("idx"), 40)


@query("q_sample", _with("""SELECT 'selected' AS kind, idx FROM (SELECT idx FROM photos WHERE k % 3 = 1 ORDER BY idx LIMIT 10) a UNION ALL SELECT 'first', idx FROM (SELECT idx FROM photos ORDER BY idx LIMIT 8) b UNION ALL
  SELECT 'compared', idx FROM (SELECT idx FROM photos WHERE k % 3 = 0 ORDER BY idx LIMIT 4) c"""))
def samples(spark, d):
    """Samples of stated sizes: of a selection, without one, and the tiles of a comparison."""
    p = A.photos(spark, d).select("idx", "k")
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "idx")
    chosen, none = p.where("k % 3 = 1"), p.where("false")
    return kind(panel.sample(p, chosen), "selected").unionByName(kind(panel.sample(p, none, 8), "first")).unionByName(kind(panel.compared(p, p.where("k % 3 = 0")), "compared"))


_BOX = "{{'x': floor(abs(vector[{0}]) * 400)::INT, 'y': floor(abs(vector[{0} + 8]) * 400)::INT, 'w': floor(abs(vector[{0} + 16]) * 300)::INT + 1, 'h': floor(abs(vector[{0} + 24]) * 300)::INT + 1, 'n': {0}}}"
_BOXES = f"""boxes AS (SELECT idx, list_sort([{{'a': -(b.w * b.h), 'n': b.n, 'x': b.x, 'y': b.y, 'w': b.w, 'h': b.h}} for b in [{', '.join(_BOX.format(n) for n in range(1, 9))}]]) AS bs FROM vectors)"""


def _boxes():
    whole = lambda n, at: (F.abs(F.get("vector", F.lit(at))) * n).cast("int")
    return F.array(*(F.struct(whole(400, i).alias("x"), whole(400, i + 8).alias("y"), (whole(300, i + 16) + 1).alias("w"), (whole(300, i + 24) + 1).alias("h")) for i in range(8)))


@query("q_faces", f"WITH {A.VECTORS_SQL}, {_BOXES} SELECT idx, array_to_string([b.x || ',' || b.y || ',' || b.w || ',' || b.h for b in bs[1:5]], ' ') AS faces FROM boxes")
def faces(spark, d):
    """Boxes from the largest down, the first five of eight."""
    own = panel.faces_by_area(_boxes(), 5)
    return A.vectors(spark, d).select("idx", F.array_join(F.transform(own, lambda b: F.concat_ws(",", *(b[c].cast("string") for c in "xywh"))), " ").alias("faces"))


_IOU = """greatest(0, least({0}.x + {0}.w, {1}.x + {1}.w) - greatest({0}.x, {1}.x)) * greatest(0, least({0}.y + {0}.h, {1}.y + {1}.h) - greatest({0}.y, {1}.y))"""
_OVERLAP = f"CASE WHEN {{0}}.w * {{0}}.h + {{1}}.w * {{1}}.h - ({_IOU}) = 0 THEN 0 ELSE ({_IOU}) / ({{0}}.w * {{0}}.h + {{1}}.w * {{1}}.h - ({_IOU})) END"


@query(
    "q_iou_nms",
    f"""WITH RECURSIVE {A.VECTORS_SQL}, {_BOXES}, step AS (SELECT idx, bs, 1 AS n, [bs[1]] AS kept FROM boxes
    UNION ALL SELECT idx, bs, n + 1, CASE WHEN len(list_filter(kept, lambda k: {_OVERLAP.format('k', '(bs[n + 1])')} >= 0.35)) = 0 THEN list_append(kept, bs[n + 1]) ELSE kept END FROM step
      WHERE n < 8)
    SELECT idx, len(kept)::INT AS n_kept, array_to_string([k.x || ',' || k.y for k in kept], ' ') AS kept, round({_OVERLAP.format('(bs[1])', '(bs[2])')}, 9)::DOUBLE AS overlap FROM step WHERE n = 8""",
)
def iou_nms(spark, d):
    """Boxes that stay after overlaps go, of eight boxes a vector; and the overlap of the two largest."""
    kept, own = similarity.kept_boxes(_boxes()), panel.faces_by_area(_boxes())
    shown = F.array_join(F.transform(kept, lambda b: F.concat_ws(",", b["x"].cast("string"), b["y"].cast("string"))), " ")
    return A.vectors(spark, d).select("idx", F.size(kept).alias("n_kept"), shown.alias("kept"), F.round(S.box_iou(own[0], own[1]), 9).alias("overlap"))


# -- counts, reports and tasks


@query("q_analysis_counts", _with(f", {_FINAL} SELECT row_number() OVER (ORDER BY n DESC, value)::INT AS place, value, n FROM (SELECT CASE WHEN k % 3 = 0 THEN '推荐' ELSE fin END AS value, count(*) AS n FROM finals GROUP BY 1) x"))
def analysis_counts(spark, d):
    p = _final(spark, d).withColumn("final_recommendation", F.when(F.col("k") % 3 == 0, "推荐").otherwise(""))
    return panel.table_order(panel.analysis_counts(p)).select(F.col("place").cast("int").alias("place"), "value", "n")


@query("q_performance", _with("""SELECT count(*) FILTER (k % 4 > 0) AS n_timed, count(*) FILTER (k % 5 = 0) AS n_cached, round(avg(CASE WHEN k % 4 > 0 THEN (k % 400) * 1e0 END), 6) AS mean_ms FROM (SELECT * FROM photos
  WHERE k % 400 > 0 OR k % 4 = 0) x"""))
def performance(spark, d):
    p = A.photos(spark, d).where("k % 400 > 0 OR k % 4 = 0").withColumns({"ai_runtime_ms": F.when(F.col("k") % 4 > 0, (F.col("k") % 400).cast("double")).otherwise(0.0), "embedding_cached": F.col("k") % 5 == 0})
    return report.performance(p).withColumn("mean_ms", F.round("mean_ms", 6))


@query("q_best_trial", _with("SELECT idx AS trial, (k % 900)::DOUBLE AS avg_ms FROM photos ORDER BY CASE WHEN k % 900 = 0 THEN 1e9 ELSE k % 900 END, idx LIMIT 1"))
def best_trial(spark, d):
    return report.best_trial(A.photos(spark, d).select(F.col("idx").alias("trial"), (F.col("k") % 900).cast("double").alias("avg_ms")))


@query("q_progress", _with("SELECT count(*) AS total, count(*) FILTER (review_status = '人工已确认') AS done FROM photos"))
def progress(spark, d):
    return decisions.progress(A.photos(spark, d), F.col("review_status") == V.CONFIRMED)


@query(
    "q_tasks",
    _with("""SELECT 'preference' AS task, count(*) FILTER (manual_override OR review_status = '人工已确认') AS success, count(*) FILTER (NOT (manual_override OR review_status = '人工已确认')) AS skipped, '' AS note
  FROM photos
    UNION ALL SELECT 'similarity', count(*) FILTER (similar_group_id <> ''), count(*) FILTER (k % 11 = 0), '相似组 ' || count(DISTINCT nullif(similar_group_id,
      '')) || '，阈值 8，跳过 ' || count(*) FILTER (k % 11 = 0) || ' 张' FROM photos
    UNION ALL SELECT 'thumbnails', count(*) FILTER (NOT (k % 3 = 0)), count(*) FILTER (k % 3 = 0), '' FROM photos UNION ALL SELECT 'pose', 0, count(*), '模型未接入，已跳过' FROM photos
    UNION ALL SELECT 'export', count(*), 0, '总照片 ' || count(*) || '，客户可选 ' || coalesce(sum(len(list_filter(delivery_use, lambda x: x = '客户可选'))),
  0)::BIGINT || '，精修候选 ' || coalesce(sum(len(list_filter(delivery_use, lambda x: x = '精修候选'))), 0)::BIGINT || '，待复核 ' || count(*) FILTER (review_status = '待复核') FROM photos"""),
)
def task_counts(spark, d):
    """What five long jobs count."""
    p = A.photos(spark, d).withColumns({"user_label": F.lit(""), "thumbnail_path": F.concat(F.lit("/t/"), F.col("idx").cast("string")), "mtime": (F.col("k") % 100).cast("double") + 0.5})
    made = p.where("k % 3 < 2").select("thumbnail_path", (F.floor("mtime") - F.col("k") % 3).cast("double").alias("mtime"))  # some are older than their photo
    jobs = {"preference": tasks.preference_stats(p), "similarity": tasks.similarity_counts(p, p.where("k % 11 = 0"), 8), "thumbnails": tasks.thumbnail_counts(p, made), "pose": tasks.placeholder(p), "export": tasks.export_preview(p)}
    rows = [f.select(F.lit(name).alias("task"), F.col("success").cast("long").alias("success"), F.col("skipped").cast("long").alias("skipped"), "note") for name, f in jobs.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])


@query("q_preference_report", f"WITH {A.DOCUMENTS_SQL} SELECT row_number() OVER (ORDER BY label)::INT AS place, '- ' || label || ': ' || count(*) || ' 张' AS line FROM samples GROUP BY label")
def preference_report(spark, d):
    lines = preference.report_lines(A.documents(spark, d))
    return lines.where("part = 'counts'").select("place", "line")


@query(
    "q_export_modes",
    _with("""SELECT m.mode, m.report_only, count(*) FILTER (n > 0) AS exported, coalesce(sum(n), 0)::BIGINT AS copies FROM (VALUES ('复制原图 + 生成报告', false), ('只生成报告', true)) m(mode, report_only),
    (SELECT CASE WHEN quality_rating = 'X' OR list_contains(delivery_use, '不导出') OR similar_group_status = 'duplicate' THEN 0 ELSE 1 + CASE WHEN len(delivery_use) = 0 AND quality_rating IN ('S',
      'A') THEN 1 ELSE len(list_distinct(delivery_use)) END END AS n FROM photos) x
    WHERE NOT m.report_only GROUP BY 1, 2 UNION ALL SELECT '只生成报告', true, 0, 0"""),
)
def export_modes(spark, d):
    """What two modes copy: one copies nothing and only reports."""
    p = A.photos(spark, d)
    each = []
    for mode in ("复制原图 + 生成报告", "只生成报告"):
        options = export.options_from_mode(mode)
        n = F.size(export.destinations(options))
        each.append(p.agg(F.lit(mode).alias("mode"), F.lit(options.report_only).alias("report_only"), F.count_if(n > 0).alias("exported"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("copies")))
    return each[0].unionByName(each[1])


@query("q_first_export", _with("""SELECT idx, category AS destination, CASE WHEN n = 0 THEN filename ELSE replace(filename, '.jpg', '') || '_' || lpad(n::VARCHAR, 3, '0') || '.jpg' END AS target FROM (SELECT *,
  row_number() OVER (PARTITION BY category, filename ORDER BY idx) - 1 AS n FROM (SELECT *, CASE k % 4 WHEN 0 THEN '01_Strong_Select_强烈推荐' WHEN 1 THEN '05_Reject_废片'
  ELSE '03_Backup_备选' END AS category FROM photos) x) y"""))
def first_export(spark, d):
    """The first pipeline's copies: manual names stand for folders, and other names leave the machine's folder."""
    manual = F.when(F.col("k") % 4 == 0, "精修").when(F.col("k") % 4 == 1, "废片").otherwise("")
    return export.category_plan(A.photos(spark, d), generations.effective_category(manual, F.lit("03_Backup_备选"))).select("idx", "destination", "target")


@query(
    "q_first_report",
    _with("""SELECT filename AS "文件名", path AS "路径", basic_score AS "清晰度", CASE WHEN k % 2 = 0 THEN '是' ELSE '否' END AS "相似组推荐", width || ' x ' || height || ' (' || printf('%.1f',
  (width * height / 1e6)::DOUBLE) || ' MP)' AS "分辨率",
    CASE WHEN k % 3 = 0 THEN '' ELSE (k % 50)::VARCHAR END AS "相似组", taken_at AS "拍摄时间" FROM photos"""),
)
def first_report(spark, d):
    k = F.col("k")
    p = A.photos(spark, d).withColumns({"clarity_score": F.col("basic_score"), "exposure_score": F.lit(0.0), "contrast_score": F.lit(0.0), "total_score": F.lit(0.0), "auto_category": F.lit(""), "notes": F.lit(""), "similar_group_id": F.when(k % 3 > 0, (k % 50).cast("int")), "recommended_in_group": k % 2 == 0})
    return report.first_rows(p).select("文件名", "路径", "清晰度", "相似组推荐", "分辨率", "相似组", "拍摄时间")


# -- sources and sinks, written and read again


@query("q_storage_rows", _with("""SELECT path, CASE WHEN manual_override THEN 1 ELSE 0 END::INT AS manual_override, to_json(issue_tags)::VARCHAR AS issue_tags, '未审' AS review_status, 0 AS group_rank, round(ai_confidence,
  9)::DOUBLE AS ai_confidence FROM photos"""))
def storage_rows(spark, d):
    """Catalog rows as they are stored; missing columns have defaults."""
    p = catalog.migrated(A.photos(spark, d).select("path", "manual_override", "issue_tags", "ai_confidence"))
    return catalog.storage_rows(p).select("path", "manual_override", "issue_tags", "review_status", "group_rank", F.round("ai_confidence", 9).alias("ai_confidence"))


@query("q_first_storage", _with("SELECT path, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END::INT AS recommended_in_group, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END::INT AS is_duplicate, '' AS thumbnail_path, width FROM photos"))
def first_storage(spark, d):
    p = A.photos(spark, d).withColumns({"recommended_in_group": F.col("k") % 2 == 0, "is_duplicate": F.col("k") % 2 == 1, "thumbnail_path": F.lit(None).cast("string")})
    return catalog.first_storage_rows(p).select("path", "recommended_in_group", "is_duplicate", "thumbnail_path", "width")


@query(
    "q_build_rows",
    _with(f""", {_FINAL} SELECT path, filename, file_size_mb, CASE WHEN k % 3 = 0 THEN review_note ELSE '' END AS review_note, CASE WHEN k % 3 = 0 THEN manual_category ELSE '备选' END AS manual_category, CASE
  WHEN k % 3 = 0 THEN ai_confidence ELSE 0 END::DOUBLE AS ai_confidence,
    CASE WHEN k % 3 = 0 THEN fin ELSE '备选' END AS final_category FROM (SELECT * REPLACE (CASE WHEN manual_category = '' THEN '备选' ELSE manual_category END AS manual_category) FROM finals) x"""),
)
def build_rows(spark, d):
    """Files beside what is saved of every third one; final categories are made anew."""
    p = A.photos(spark, d)
    files = p.select("path", "filename", "file_size_mb")
    saved = p.where("k % 3 = 0").select("path", "review_note", "manual_category", "manual_override", "ai_primary_category", "ai_secondary_category", "ai_confidence", F.lit("old").alias("final_category"))
    return catalog.build_rows(files, saved).select("path", "filename", "file_size_mb", "review_note", "manual_category", "ai_confidence", "final_category")


@query("q_saved_table", _with("SELECT path, CASE WHEN k % 3 = 0 THEN 'second' ELSE 'first' END AS review_note, manual_override FROM photos"))
def saved_table(spark, d):
    """A catalog table written, upserted and loaded."""
    p = A.photos(spark, d)
    rows = lambda df, note: catalog.migrated(df.select("path", "manual_override", F.lit(note).alias("review_note")))
    at = _folder(spark)
    catalog.save(spark, rows(p, "first"), at)
    catalog.save(spark, rows(p.where("k % 3 = 0"), "second"), at)
    return catalog.load(spark, at).select("path", "review_note", "manual_override")


@query("q_sample_log", _with("""SELECT path, filename, manual_category, array_to_string(issue_tags, ',') AS tags FROM photos WHERE k % 5 = 0 UNION ALL SELECT path, filename, manual_category, array_to_string(issue_tags, ',')
  FROM photos WHERE k % 5 = 0 AND k % 2 = 0"""))
def sample_log(spark, d):
    """A log appended to twice and read again; a line that is no JSON is skipped."""
    p = A.photos(spark, d).where("k % 5 = 0").select("path", "filename", "manual_category", F.col("issue_tags").alias("ai_quality_tags"), "k")
    at = _folder(spark)
    catalog.append_samples(p.drop("k"), at)
    catalog.append_samples(p.where("k % 2 = 0").drop("k"), at)
    spark.createDataFrame([("not json",), ("",)], "value string").coalesce(1).write.mode("append").text(at)
    return catalog.samples(spark, at).select("path", "filename", "manual_category", F.array_join("ai_quality_tags", ",").alias("tags"))


@query("q_csv_sink", _with("SELECT filename AS file_name, path AS file_path, CASE WHEN quality_rating = '' THEN '未评级' ELSE quality_rating END AS quality_rating, CASE WHEN best_in_group THEN '是' ELSE '否' END AS best_in_group, 'a, \"x\" ' || review_note AS review_note FROM photos"))
def csv_sink(spark, d):
    """The review report as one CSV file with a byte order mark, read again."""
    p = A.photos(spark, d).withColumns({"similar_group_rank": F.lit(0), "similarity_score": F.lit(0.0), "review_note": F.concat(F.lit('a, "x" '), "review_note")})
    at = report.write_csv_file(p, _folder(spark))
    back = spark.read.option("header", True).option("escape", '"').csv(at)
    return back.select("file_name", "file_path", "quality_rating", "best_in_group", "review_note")


@query("q_no_export_sink", _with("SELECT '- ' || filename || ' | ' || path || ' | ' || review_note AS value FROM photos WHERE quality_rating = 'X' OR list_contains(delivery_use, '不导出') OR similar_group_status = 'duplicate'"))
def no_export_sink(spark, d):
    at = _folder(spark)
    report.write_no_export(A.photos(spark, d), at)
    return spark.read.text(at)


@query("q_library", f"SELECT '/i/' || doc_id AS image, array_to_string(CASE WHEN doc_id % 5 = 0 THEN ['构图好'] WHEN doc_id % 2 = 0 THEN [{_list(V.AESTHETIC_TAGS)}[doc_id % 11 + 1]] ELSE [] END, ',') AS tags FROM documents")
def library(spark, d):
    """A library written and read, scanned for new files, and tagged; tags that don't exist are dropped."""
    docs = A.table(spark, d, "documents").select(F.concat(F.lit("/i/"), F.col("doc_id").cast("string")).alias("image"), "doc_id")
    tag = F.get(V.array_of(V.AESTHETIC_TAGS), (F.col("doc_id") % 11).cast("int"))
    known = docs.where("doc_id % 2 = 0").select("image", F.array(tag, F.lit("no such tag")).alias("tags"))
    at = _folder(spark)
    catalog.write_library(known, ["/i"], at)
    scanned = catalog.library_scanned(catalog.library_images(spark, at), docs.select(F.col("image").alias("path")))
    tagged = catalog.tagged_images(scanned, docs.where("doc_id % 5 = 0").select("image", F.array(F.lit("构图好"), F.lit("?")).alias("tags")))
    return tagged.select("image", F.array_join("tags", ",").alias("tags"))


@query("q_canonical_json", _with("""SELECT idx, CASE k % 5 WHEN 0 THEN '{"b":[1,2.5,null],"a":"' || filename || '"}' WHEN 1 THEN 'no {json' WHEN 2 THEN '' WHEN 3 THEN '"é"' ELSE '[]' END AS text FROM photos"""))
def canonical_json(spark, d):
    """JSON written again without white space, keys in their order; other text as it is."""
    raw = F.expr("""CASE k % 5 WHEN 0 THEN '{ "b" : [1, 2.5, null],\n "a": "' || filename || '"}' WHEN 1 THEN 'no {json' WHEN 2 THEN '' WHEN 3 THEN '"\\u00e9"' ELSE ' [ ] ' END""")
    return A.photos(spark, d).select("idx", catalog.canonical_json(raw).alias("text"))


@query(
    "q_cached_rows",
    _with("SELECT idx, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 'cached' ELSE 'made' END AS origin, CASE WHEN k % 3 = 0 AND k % 2 = 0 THEN 1 ELSE 2 END::INT AS value FROM photos"),
)
def cached_rows(spark, d):
    """Hits of a cache, whose rows are too old for every second file, and the rest computed; then the cache holds all."""
    p = A.photos(spark, d).select("idx", "path", "k", (F.col("k") % 1000 + 0.25).alias("mtime"))
    at = _folder(spark)
    catalog.write_cache(p.where("k % 3 = 0").select("path", F.when(F.col("k") % 2 == 0, F.col("mtime") + 0.00005).otherwise(F.col("mtime") - 1).alias("mtime"), F.lit(1).alias("value")), at)
    hits, lacking = catalog.cached_by_time(p, catalog.read_cache(spark, at, ["path"], "mtime"), "value")
    made = lacking.withColumn("value", F.lit(2))
    catalog.write_cache(made.select("path", "mtime", "value"), at)
    now = catalog.read_cache(spark, at, ["path"], "mtime")
    both = hits.withColumn("origin", F.lit("cached")).unionByName(made.withColumn("origin", F.lit("made")))
    return both.join(now.select("path"), "path", "left_semi").select("idx", "origin", "value")


@query("q_capture_times", _with("SELECT idx, CASE k % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') ELSE '' END AS taken_at FROM photos"))
def capture_times(spark, d):
    """Times in EXIF blocks: of the plain tag, of the original's tag before it, and none."""
    text = lambda days: F.encode(F.date_format(F.col("ts").cast("timestamp") + F.make_dt_interval(F.lit(days)), "yyyy:MM:dd HH:mm:ss"), "US-ASCII")
    head = b"\xff\xd8\xff\xe1\x00\x40Exif\0\0II*\0\x08\0\0\0"
    one = head + b"\x01\0" + b"\x32\x01\x02\0\x14\0\0\0\x1a\0\0\0" + bytes(4)
    # the first directory has the plain tag and the place of the second one, which has the original's
    two = head + b"\x02\0" + b"\x32\x01\x02\0\x14\0\0\0\x38\0\0\0" + b"\x69\x87\x04\0\x01\0\0\0\x26\0\0\0" + bytes(4) + b"\x01\0" + b"\x03\x90\x02\0\x14\0\0\0\x4c\0\0\0" + bytes(4)
    k, end = F.col("k"), F.lit(b"\0")
    content = F.when(k % 3 == 0, F.concat(F.lit(one), text(0), end)).when(k % 3 == 1, F.concat(F.lit(two), text(0), end, text(1), end)).otherwise(F.lit(b"no picture"))
    p = A.photos(spark, d).select(F.col("idx").cast("string").alias("path"), content.alias("content"))
    return catalog.capture_times(p).select(F.col("path").cast("long").alias("idx"), "taken_at")


# -- preferences


@query("q_embedding_features", f"WITH {A.VECTORS_SQL} SELECT idx, 32 AS dims, round(CASE WHEN idx % 3 = 0 THEN 0 WHEN idx % 3 = 1 THEN list_sum(vector[1:20]) ELSE list_sum(vector[1:32]) END, 6)::DOUBLE AS total FROM vectors")
def embedding_features(spark, d):
    """32 numbers of an embedding: of none, of a short and of a long one."""
    own = F.when(F.col("idx") % 3 == 1, F.slice("vector", 1, 20)).when(F.col("idx") % 3 == 2, F.col("vector"))
    v = preference.embedding_features(own)
    return A.vectors(spark, d).select("idx", F.size(v).alias("dims"), F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(
    "q_preference_applied",
    _with("""SELECT idx, CASE WHEN k % 4 = 0 THEN '' ELSE 'local-preference-v1' END AS version, CASE WHEN k % 4 = 0 THEN 'why' WHEN k % 100 >= 60 THEN 'why；偏好模型建议：精选，偏好分 ' || printf('%.2f',
  (k % 100) / 100e0) || '。' ELSE 'why；偏好模型不确定，建议人工确认。' END AS final_reason,
    CASE WHEN k % 4 = 0 THEN '偏好模型暂无可用类别。' ELSE '根据你已标记的 70 张样本，本图更接近“精选”，偏好分 ' || printf('%.2f', (k % 100) / 100e0) || '。' END AS reason FROM photos"""),
)
def preference_applied(spark, d):
    k = F.col("k")
    p = A.photos(spark, d).withColumns({"preference_label": F.when(k % 4 == 0, "").otherwise("精选"), "preference_score": (k % 100) / 100.0, "ai_reason": F.lit("why"), "final_reason": F.lit("why")})
    return preference.applied(p, 70).select("idx", F.col("preference_model_version").alias("version"), "final_reason", F.col("preference_reason").alias("reason"))


@query("q_lr_preference", _with("SELECT idx, CASE k % 3 WHEN 0 THEN '精选' WHEN 1 THEN '废片' ELSE '可用待修' END AS preference_label FROM photos WHERE k % 5 > 0"))
def lr_preference(spark, d):
    """A logistic regression on samples that a plane separates, so each must get its own label back."""
    k = F.col("k")
    axis = lambda n: F.when(k % 3 == n, 4.0).otherwise(0.0) + (k % 7) / 20.0
    label = F.when(k % 3 == 0, "精选").when(k % 3 == 1, "废片").otherwise("可用待修")
    s = A.photos(spark, d).where("k % 5 > 0").select("idx", label.alias("user_label"), F.lit("").alias("manual_category"), F.array(axis(0), axis(1), axis(2)).alias("features"))
    return preference.train(s)(s).select("idx", "preference_label")


@query("q_smoke_test", f"""WITH {A.VECTORS_SQL}, one AS (SELECT vector AS a FROM vectors ORDER BY idx LIMIT 1), p AS (SELECT label, arg_min(vector, idx) AS b FROM vectors GROUP BY label) SELECT label, round(list_dot_product(a,
  b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 6)::DOUBLE AS cosine FROM one, p""")
def smoke_test(spark, d):
    """Cosines of one image with one prompt of each label."""
    v = A.vectors(spark, d)
    prompts = v.groupBy("label").agg(F.min_by("vector", "idx").alias("vector"))
    return preference.cosines(v.orderBy("idx").limit(1), prompts).select("label", F.round("cosine", 6).alias("cosine"))


# -- module scores from pixel features

_MODULES = """f AS (SELECT idx, (k % 400) / 2e0 AS s, (k % 256) * 1e0 AS e, (k % 60) * 1e0 AS c, (k % 40) * 1e0 AS n, width AS w, height AS h, (k % 53) * 1e0 AS edge, k % 3 AS faces, (k % 140) * 1e0 AS clarity,
  CASE WHEN k % 5 = 0 THEN 0 ELSE 2 END AS eyes, k % 7 > 0 AS seen,
  (k % 70)::INT AS bx, (k % 50)::INT AS by_ FROM photos)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    real = lambda n: (k % n).cast("double")
    box = F.struct((F.col("width") * (k % 70) / 100).cast("int").alias("x"), (F.col("height") * (k % 50) / 100).cast("int").alias("y"), F.lit(400).alias("w"), F.lit(300).alias("h"))
    boxes = F.when(k % 3 == 0, F.slice(F.array(box), 1, 0)).when(k % 3 == 1, F.array(box)).otherwise(F.array(box, box))
    return A.photos(spark, d).select(
        "idx", "width", "height", (k % 400 / 2.0).alias("sharpness"), real(256).alias("brightness"), real(60).alias("contrast"), real(40).alias("noise"), real(53).alias("edge_density"), boxes.alias("face_boxes"), real(140).alias("face_clarity"),
        F.when(k % 5 == 0, 0).otherwise(2).alias("eye_count"), F.when(k % 7 > 0, "any").alias("detector"),
    )


@query(
    "q_basic_quality",
    _with(f""", {_MODULES} SELECT idx, round(least(100, s / 2) * 0.34e0 + greatest(0, 100 - abs(e - 128) * 100 / 128) * 0.24e0 + least(100, c * 2.2e0) * 0.18e0 + least(100,
  w * h / 1e6 / 12 * 100) * 0.14e0 + greatest(0, 100 - n * 1.5e0) * 0.10e0, 6)::DOUBLE AS score,
    CASE WHEN s < 55 THEN '清晰度不足' ELSE '主体清晰度基本可用' END || '，' || CASE WHEN e < 95 OR e > 190 THEN '曝光存在可复核问题' ELSE '曝光较稳定' END || CASE WHEN c < 24 THEN '，画面对比度偏弱' ELSE '' END || '。' AS reason,
    s < 55 AS blurred, e < 95 OR e > 190 AS exposed, c < 24 AS pale, (s >= 55 AND s < 110) OR (e >= 72 AND e < 95) OR (e > 190 AND e <= 220) OR n > 28 AS fixable FROM f"""),
)
def basic_quality(spark, d):
    m = pixels.basic_quality()
    has = lambda t: F.array_contains(m["basic_problems"], t)
    return _features(spark, d).select("idx", F.round(m["basic_score"], 6).alias("score"), m["basic_reason"].alias("reason"), has("虚焦").alias("blurred"), has("曝光问题").alias("exposed"), has("色彩问题").alias("pale"), has("技术可修").alias("fixable"))


_FACE = """g AS (SELECT *, (w * bx / 100)::DOUBLE AS fx, (h * by_ / 100)::DOUBLE AS fy FROM f), c AS (SELECT *, floor(fx)::INT AS x, floor(fy)::INT AS y FROM g),
cc AS (SELECT *, (x + 200.0) / w AS cx, (y + 150.0) / h AS cy, faces > 0 AS faced FROM c)"""


@query(
    "q_face_quality",
    _with(f""", {_MODULES}, {_FACE} SELECT idx, round(CASE WHEN NOT seen THEN 50 WHEN faces = 0 THEN 58 ELSE least(100, 55 + least(30, clarity / 7) + greatest(0, 1 - (abs(cx - 0.5) + abs(cy - 0.45))) * 15) END,
  6)::DOUBLE AS score,
    CASE WHEN NOT seen THEN 0.1 WHEN faces = 0 THEN 0.35 ELSE 0.72 END::DOUBLE AS confidence, seen AND faced AND clarity <= 45 AS blurred, seen AND faced AND eyes = 0 AS shut,
    CASE WHEN seen AND faced AND (x < w * 0.04e0 OR y < h * 0.04e0 OR x + 400 > w * 0.96e0 OR y + 300 > h * 0.96e0) THEN 46 ELSE 52 END::DOUBLE AS pose, CASE WHEN faces = 0 THEN 50 WHEN seen
      AND eyes = 0 THEN 42 ELSE 62 END::DOUBLE AS expression,
    round(greatest(0, least(100, 72 - CASE WHEN w / h BETWEEN 0.72 AND 1.55 THEN 0 ELSE 5 END + CASE WHEN faced AND (cx < 0.18 OR cx > 0.82 OR cy < 0.12 OR cy > 0.82) THEN -12 WHEN faced THEN 8
  ELSE 0 END - CASE WHEN edge > 42 THEN 8 ELSE 0 END - CASE WHEN e < 80 OR e > 200 THEN 6 ELSE 0 END)), 6)::DOUBLE AS composition FROM cc"""),
)
def face_quality(spark, d):
    """Scores of faces, pose, expression and composition."""
    p = pixels.analyse(_features(spark, d))
    has = lambda t: F.array_contains("face_problems", t)
    return p.select("idx", F.round("face_score", 6).alias("score"), F.col("face_confidence").alias("confidence"), has("虚焦").alias("blurred"), has("闭眼").alias("shut"), F.col("pose_score").alias("pose"), F.col("expression_score").alias("expression"), F.round("composition_score", 6).alias("composition"))


@query(
    "q_person_metrics",
    f"""WITH {A.VECTORS_SQL}, {_BOXES}, b AS (SELECT idx, len(bs)::INT AS n, bs[1] AS m FROM (SELECT idx, list_filter(bs, lambda x: x.n % 3 > 0) AS bs FROM boxes) x)
    SELECT idx, n AS detected_person_count, m.x || ',' || m.y || ',' || (m.x + m.w) || ',' || (m.y + m.h) AS main_subject_bbox, round(m.w * m.h / 480000e0, 9)::DOUBLE AS subject_area_ratio,
    round(greatest(0, 1 - sqrt(((m.x + m.w / 2) / 800 - 0.5) * ((m.x + m.w / 2) / 800 - 0.5) + ((m.y + m.h / 2) / 600 - 0.5) * ((m.y + m.h / 2) / 600 - 0.5)) / 0.707),
      9)::DOUBLE AS subject_center_score,
    CASE WHEN m.x <= 20 OR m.y <= 15 OR m.x + m.w >= 780 OR m.y + m.h >= 585 THEN 0.72 ELSE 0 END::DOUBLE AS edge_cutoff_risk, round(least(1, n / 6), 9)::DOUBLE AS group_photo_score FROM b""",
)
def person_metrics(spark, d):
    """Metrics of detector boxes in a frame of 800 x 600; every third box isn't a person."""
    boxes = F.transform(_boxes(), lambda b, n: F.struct(b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"), F.when((n + 1) % 3 == 0, 7).otherwise(0).alias("label"), F.lit(0.5).alias("score")))
    m = pixels.person_metrics(boxes, F.lit(800), F.lit(600))
    return A.vectors(spark, d).select("idx", m["detected_person_count"].alias("detected_person_count"), m["main_subject_bbox"].alias("main_subject_bbox"), *(F.round(m[c], 9).alias(c) for c in ("subject_area_ratio", "subject_center_score", "edge_cutoff_risk", "group_photo_score")))


_PIXELS = f"""WITH {A.VECTORS_SQL}, px AS (SELECT idx, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(255, floor((vector[i] + 0.5) * 255)))::INT AS g FROM (SELECT idx, vector, unnest(range(1, 65)) AS i
  FROM vectors) t),
lap AS (SELECT p.idx, p.x, p.y, u.g + d.g + l.g + r.g - 4 * p.g AS v FROM px p JOIN px u ON u.idx = p.idx AND u.x = p.x AND u.y = abs(p.y - 1) JOIN px d ON d.idx = p.idx AND d.x = p.x
  AND d.y = 7 - abs(7 - (p.y + 1))
  JOIN px l ON l.idx = p.idx AND l.y = p.y AND l.x = abs(p.x - 1) JOIN px r ON r.idx = p.idx AND r.y = p.y AND r.x = 7 - abs(7 - (p.x + 1))),
gr AS (SELECT p.idx, (r.g - l.g) / (r.x - l.x) AS gx, (d.g - u.g) / (d.y - u.y) AS gy FROM px p JOIN px l ON l.idx = p.idx AND l.y = p.y AND l.x = greatest(p.x - 1, 0) JOIN px r ON r.idx = p.idx
  AND r.y = p.y AND r.x = least(p.x + 1, 7)
  JOIN px u ON u.idx = p.idx AND u.x = p.x AND u.y = greatest(p.y - 1, 0) JOIN px d ON d.idx = p.idx AND d.x = p.x AND d.y = least(p.y + 1, 7))"""


@query(
    "q_pixel_features",
    _PIXELS + """ SELECT idx, round(avg(g), 6) AS brightness, round(stddev_pop(g), 6) AS contrast, round(avg((g >= 250)::INT), 6) AS bright_clip, round(avg((g <= 5)::INT), 6) AS dark_clip,
    any_value(sharpness) AS sharpness_4096, any_value(edge) AS edge_density, any_value(flat) AS gradient_4096, 8 AS width FROM px JOIN (SELECT idx, round(var_pop(v) * 4096)::BIGINT AS sharpness
      FROM lap GROUP BY idx) l USING (idx)
    JOIN (SELECT idx, round(avg(sqrt(gx * gx + gy * gy)), 6) AS edge, round((var_pop(gx) + var_pop(gy)) * 4 * 4096)::BIGINT AS flat FROM gr GROUP BY idx) e USING (idx) GROUP BY idx""",
)
def pixel_features(spark, d):
    """Pixel aggregates of grey pictures of 8 x 8, made from vectors; variances over 64 whole numbers are shown times 4,096, which are whole numbers too."""
    v = export.dealt(A.vectors(spark, d))
    grey = F.transform("vector", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), data.alias("data"))
    got = pixels.features(v.select(F.col("idx").cast("string").alias("path"), image.alias("image")))
    return got.select(F.col("path").cast("long").alias("idx"), *(F.round(c, 6).alias(c) for c in ("brightness", "contrast", "bright_clip", "dark_clip", "edge_density")), F.round(F.col("sharpness") * 4096).cast("long").alias("sharpness_4096"), F.round(F.col("sharpness_gradient") * 4096).cast("long").alias("gradient_4096"), "width")


_OUTCOME = """CASE WHEN mean >= 78 AND NOT list_contains(tags, '明确废片') THEN 0 WHEN list_contains(tags, '明确废片') THEN 1 WHEN list_contains(tags, '可用待裁切') THEN 2
  WHEN list_contains(tags, '可用待修') THEN 3 ELSE 4 END"""


@query(
    "q_g2_more_texts",
    _with(f""", {_TAGS2}, o AS (SELECT *, {_OUTCOME} AS o, ai_primary_category = '相似重复待选' AS twin FROM tags)
    SELECT idx, ['有进入精选或社交媒体发布候选的潜力，建议复核表情和细节。', '不建议进入作品集。', '不建议直接进作品集，但可作为裁切后备选。', '需要修图后再判断是否进入作品集。', '画面可用，建议结合相似组对比决定是否精选。'][o + 1] AS portfolio_suggestion,
      CASE WHEN twin THEN '同组照片需对比后保留 1-3 张，不建议直接删除。' ELSE ['可作为客户交付候选。', '交付风险较高，建议人工复核后再决定。', '主体仍有交付价值，建议可用待裁切。', '可作为可用待修候选。', '可作为备选交付。'][o + 1] END AS delivery_suggestion,
      '建议：' || CASE WHEN twin THEN '相似重复待选' ELSE ['推荐保留', '废片疑似', '可用待裁切', '可用待修', '人工复核'][o + 1] END || '。分类倾向为“'
        || CASE WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category WHEN ai_primary_category = '' THEN '人工复核' ELSE ai_primary_category END
        || '”，最终分 ' || printf('%.1f', mean) || '。' || CASE WHEN k % 3 = 0 THEN '' ELSE ' 语义候选：a, b。' END AS screening_reason FROM o"""),
)
def g2_more_texts(spark, d):
    return advice.suggestions(_advised(spark, d)).select("idx", "portfolio_suggestion", "delivery_suggestion", "screening_reason")


@query(
    "q_first_analysis",
    _with("""SELECT idx, clarity_score, exposure_score, contrast_score, resolution_score, total AS total_score,
      CASE WHEN twin THEN '04_Duplicate_重复' WHEN total >= 90 THEN '01_Strong_Select_强烈推荐' WHEN total >= 75 THEN '02_Deliverable_可交付' WHEN total >= 60 THEN '03_Backup_备选' ELSE '05_Reject_废片' END AS auto_category FROM (
      SELECT *, printf('%.2f', clarity_score * 0.35e0 + exposure_score * 0.25e0 + contrast_score * 0.15e0 + resolution_score * 0.10e0 + CASE WHEN twin THEN 0 ELSE 100 END * 0.15e0)::DOUBLE AS total FROM (
      SELECT idx, k % 9 = 0 AS twin, round(least(100, ln(1 + lap) / ln(1201) * 100), 2)::DOUBLE AS clarity_score, round(greatest(0, least(100, 100 - abs(mean - 128) / 128 * 100 - least(60, (dark + bright) * 300))), 2)::DOUBLE AS exposure_score,
        round(greatest(0, least(100, (contrast - 15) / 60 * 100)), 2)::DOUBLE AS contrast_score,
        round(CASE WHEN mp >= 20 THEN 100 WHEN mp >= 12 THEN 85 + (mp - 12) / 8 * 15 WHEN mp >= 6 THEN 65 + (mp - 6) / 6 * 20 WHEN mp >= 2 THEN 40 + (mp - 2) / 4 * 25 ELSE mp / 2 * 40 END, 2)::DOUBLE AS resolution_score
      FROM (SELECT *, width * height / 1e6 AS mp FROM photos) a) b) c"""),
)
def first_analysis(spark, d):
    """The first pipeline from pixel features to category; every ninth photo is a duplicate."""
    f = A.photos(spark, d).select("idx", "k", "width", "height", "contrast", F.col("lap").alias("sharpness"), F.col("mean").alias("brightness"), F.col("dark").alias("dark_clip"), F.col("bright").alias("bright_clip"))
    out = generations.first_analysis(f, F.col("k") % 9 == 0)
    return out.select("idx", "clarity_score", "exposure_score", "contrast_score", "resolution_score", "total_score", "auto_category")


@query(
    "q_pixel_evidence",
    f"""WITH {A.VECTORS_SQL}, px AS (SELECT idx, (i - 1) // 8 AS y, (i - 1) % 8 AS x, greatest(0, least(254, floor((vector[i] + 0.5) * 127) * 2))::INT AS g FROM (SELECT idx, vector, unnest(range(1, 65)) AS i FROM vectors) t),
    m AS (SELECT *, avg(g) OVER (PARTITION BY idx) AS mean FROM px),
    k AS (SELECT [403726, 500145, 575239, 618041, 618041, 575239, 500145, 403726] AS k),
    across AS (SELECT idx, y, greatest(0, least(255, floor((sum(g * k[x + 1]) + 2097152) / 4194304))) AS g FROM px, k GROUP BY idx, y),
    one AS (SELECT idx, greatest(0, least(255, floor((sum(g * k[y + 1]) + 2097152) / 4194304)))::INT AS dominant FROM across, k GROUP BY idx)
    SELECT idx, any_value(dominant) AS dominant, round(stddev_pop(g), 6) AS color_std, round(avg((g > 185)::INT), 6) AS white, round(avg((g > 185)::INT) FILTER (y >= 4), 6) AS lower_white,
      round(sum((g > 185)::INT * CASE WHEN y = 7 THEN 4 ELSE 12 END) FILTER (y >= 2 AND x BETWEEN 2 AND 5) / (4 * 64.0), 6)::DOUBLE AS center_white, 0::DOUBLE AS green,
      string_agg(CASE WHEN g >= mean THEN '1' ELSE '0' END, '' ORDER BY y, x) AS from_mean, string_agg(CASE WHEN g > mean THEN '1' ELSE '0' END, '' ORDER BY y, x) AS above_mean,
      round(avg(g) / 255, 6) AS net_mean, round(stddev_pop(g) / 255, 6) AS net_std FROM m JOIN one USING (idx) GROUP BY idx""",
)
def pixel_evidence(spark, d):
    """Grey pictures with even values, once as 8 x 8 pixels (hashes bit for bit, the picture as one pixel, scaled mean and deviation), and once as 96 x 96 with blocks of 12 (colours and shares of white)."""
    v = export.dealt(A.vectors(spark, d))
    grey = F.transform("vector", lambda x: F.greatest(F.lit(0), F.least(F.lit(254), F.floor((x + 0.5) * 127) * 2)).cast("int"))

    def found(times: int) -> DataFrame:
        text = F.transform(grey, lambda g: F.repeat(F.lpad(F.hex(g), 2, "0"), F.lit(times)))
        rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda y: F.repeat(F.array_join(F.slice(text, y * 8 + 1, F.lit(8)), ""), F.lit(times)))
        image = F.struct(F.lit(8 * times).alias("height"), F.lit(8 * times).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(rows, "")).alias("data"))
        return pixels.features(v.select(F.col("idx").cast("string").alias("path"), image.alias("image")))

    bits = lambda c: F.lpad(F.bin(c), 64, "0")
    first = found(1).select("path", F.col("dominant_r").alias("dominant"), bits("hash").alias("from_mean"), bits("hash_above").alias("above_mean"), F.round(F.get("rgb_mean", F.lit(0)), 6).alias("net_mean"), F.round(F.get("rgb_std", F.lit(2)), 6).alias("net_std"))
    to = {"white_ratio": "white", "lower_white_ratio": "lower_white", "center_white_ratio": "center_white", "green_ratio": "green"}
    second = found(12).select("path", F.round("color_std", 6).alias("color_std"), *(F.round(c, 6).alias(n) for c, n in to.items()))
    return first.join(second, "path").withColumn("idx", F.col("path").cast("long")).drop("path")


@query(
    "q_analysis",
    _PIXELS + """, m AS (SELECT idx, avg(g) AS e FROM px GROUP BY idx), ed AS (SELECT idx, avg(sqrt(gx * gx + gy * gy)) AS edge FROM gr GROUP BY idx), j AS (SELECT *, idx % 10 = 0 AS broken FROM m JOIN ed USING (idx))
    SELECT idx, 'current' AS status, '无法判断' AS photo_type, CASE WHEN broken THEN 0 ELSE 50 END::DOUBLE AS face, CASE WHEN broken THEN 0 ELSE 52 END::DOUBLE AS pose, CASE WHEN broken THEN 0 ELSE 50 END::DOUBLE AS expression,
      CASE WHEN broken THEN 0 ELSE 72 - CASE WHEN edge > 42 THEN 8 ELSE 0 END - CASE WHEN e < 80 OR e > 200 THEN 6 ELSE 0 END END::DOUBLE AS composition, CASE WHEN broken THEN 0 ELSE 0.92 END::DOUBLE AS basic_confidence, broken AS failed FROM j""",
)
def analysis_run(spark, d):
    """Pictures to decisions and payloads, without a detector; every tenth picture can't be read, which costs no other."""
    v = export.dealt(A.vectors(spark, d))
    grey = F.transform("vector", lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 0.5) * 255))).cast("int"))
    data = F.unhex(F.array_join(F.transform(grey, lambda g: F.lpad(F.hex(g), 2, "0")), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.when(F.col("idx") % 10 > 0, data).otherwise(F.unhex(F.lit("00"))).alias("data"))
    out = analysis.analyse(v.select(F.concat(F.lit("/v/"), F.col("idx").cast("string")).alias("path"), image.alias("image")))
    said = lambda at: F.get_json_object("ai_suggestion", f"$.{at}").cast("double")
    failed = F.col("error").isNotNull() & (F.col("commercial_score") == 0) & (F.col("quality_rating") == "X")
    return out.select(
        F.substring("path", 4, 20).cast("long").alias("idx"), review.suggestion_status(F.col("ai_suggestion"), F.col("path")).alias("status"), "photo_type", said("face.score").alias("face"), said("pose.score").alias("pose"),
        said("expression.score").alias("expression"), said("composition.score").alias("composition"), said("basic.confidence").alias("basic_confidence"), failed.alias("failed"),
    )


# -- the second generation's categories

_FILES = ["IMG_1", "bride_1", "kid_2", "grand_3", "family_4", "team_5", "beach_6", "meeting_7", "girl_boy_8", "lady_9", "gentleman_10"]
_PEOPLE = "CASE WHEN people <= 0 THEN 'none' WHEN people = 1 THEN 'single_person' WHEN people = 2 THEN 'two_people' WHEN people = 3 THEN 'three_people' ELSE 'group_people' END"
_SHOT = """CASE sp WHEN '单人写真' THEN 'portrait' WHEN '双人写真' THEN 'portrait' WHEN '多人写真' THEN 'portrait' WHEN '婚纱照' THEN 'wedding' WHEN '全家福' THEN 'family' WHEN '亲子照' THEN 'parent_child'
  WHEN '商务会议合影' THEN 'business' WHEN '活动纪实' THEN 'event'
  WHEN '儿童写真' THEN 'child' WHEN '中老年写真' THEN 'elderly' WHEN '风景/环境' THEN 'environment' ELSE CASE n WHEN 1 THEN 'wedding' WHEN 4 THEN 'family' WHEN 5 THEN 'business' WHEN 6 THEN 'outdoor'
    WHEN 7 THEN 'event'
  ELSE CASE WHEN n = 2 AND people > 0 THEN 'child' WHEN n = 3 AND people > 0 THEN 'elderly' WHEN people <= 0 THEN 'environment' ELSE 'portrait' END END END"""


@query(
    "q_g2_category",
    _with(f""", {_TAGS2}, a AS (SELECT *, k % 11 AS n, ai_primary_category AS sp, CASE WHEN k % 2 = 0 THEN '' ELSE '年轻女生' END AS ss, {_PEOPLE} AS pl, people > 0 AND k % 11 IN (1, 8, 9) AS female, people > 0
  AND k % 11 IN (8, 10) AS male FROM tags),
    b AS (SELECT *, {_SHOT} AS shot, least(0.97, 0.40 + CASE WHEN pl <> 'none' THEN 0.15 ELSE 0 END + CASE WHEN {_SHOT} NOT IN ('portrait', 'environment') THEN 0.12 ELSE 0 END + CASE
      WHEN sp <> '' THEN least(0.22, ai_confidence * 0.28) ELSE 0 END + CASE WHEN centre > 0 THEN least(0.10, centre * 0.12) ELSE 0 END
      + CASE WHEN list_contains(tags, '清晰') THEN 0.05 ELSE 0 END + CASE WHEN list_contains(tags, '推荐保留') THEN 0.04 ELSE 0 END + CASE WHEN contrast / 255 BETWEEN 0.18 AND 0.42
        AND mean / 255 BETWEEN 0.24 AND 0.80 THEN 0.03 ELSE 0 END) AS c,
      list_contains(tags, '明确废片') AND list_has_any(tags, ['严重模糊', '严重过曝', '严重欠曝']) AS reject, pl IN ('three_people', 'group_people') AS many FROM a),
    r AS (SELECT idx, c, reject, CASE WHEN reject THEN ['废片疑似', '', 'high'] WHEN sp <> '' AND sp <> '废片疑似' THEN CASE WHEN sp = '单人写真' AND pl = 'two_people' THEN ['双人写真', '情侣', ''] WHEN sp = '双人写真'
      AND pl = 'single_person' THEN ['单人写真', CASE WHEN ss <> '' THEN ss ELSE '其他单人' END, '']
      WHEN sp = '婚纱照' AND pl = 'single_person' THEN ['婚纱照', '单人婚纱', ''] WHEN sp = '婚纱照' AND (many OR pl = 'two_people') THEN ['婚纱照', '双人婚纱', ''] WHEN sp = '全家福' AND people >= 3 THEN ['全家福', '多人家庭',
        ''] WHEN sp = '商务会议合影' AND people >= 6 THEN ['商务会议合影', '大合影', '']
      WHEN sp = '双人写真' AND ss = '' THEN ['双人写真', CASE WHEN female THEN '闺蜜姐妹' WHEN male THEN '兄弟朋友' ELSE '情侣' END, ''] ELSE [sp, ss, ''] END
      WHEN shot = 'wedding' THEN ['婚纱照', CASE WHEN pl = 'single_person' THEN '单人婚纱' ELSE '双人婚纱' END, ''] WHEN shot = 'family' THEN ['全家福', CASE WHEN many THEN '多人家庭' ELSE '其他家庭合影' END, '']
        WHEN shot = 'parent_child' THEN ['亲子照', '其他亲子', '']
      WHEN shot = 'business' THEN ['商务会议合影', CASE WHEN pl = 'group_people' THEN '大合影' ELSE '小组合影' END, ''] WHEN shot = 'event' THEN ['活动纪实', '', ''] WHEN shot = 'child' THEN ['儿童写真', '', '']
        WHEN shot = 'elderly' THEN ['中老年写真', '', '']
      WHEN shot = 'environment' OR pl = 'none' THEN ['风景/环境', '', 'low'] WHEN pl = 'single_person' AND female AND NOT male THEN ['单人写真', '年轻女生', ''] WHEN pl = 'single_person' AND male
        AND NOT female THEN ['单人写真', '年轻男生', ''] WHEN pl = 'single_person' THEN ['单人写真', '其他单人', 'low']
      WHEN pl = 'two_people' THEN ['双人写真', CASE WHEN female AND NOT male THEN '闺蜜姐妹' WHEN male AND NOT female THEN '兄弟朋友' ELSE '情侣' END, ''] ELSE ['多人写真', CASE WHEN pl = 'three_people' THEN '小组合影'
        ELSE '其他多人' END, ''] END AS g FROM b)
    SELECT idx, g[1] AS primary_category, g[2] AS secondary_category, round(CASE g[3] WHEN 'high' THEN greatest(c, 0.66) WHEN 'low' THEN least(c, 0.72) ELSE c END, 6)::DOUBLE AS confidence FROM r""".replace("CASE WHEN female THEN '闺蜜姐妹' WHEN male THEN", "CASE WHEN female AND NOT male THEN '闺蜜姐妹' WHEN male AND NOT female THEN")),
)
def g2_category(spark, d):
    """Categories by file name, people, tags and a semantic guess."""
    c = F.col
    name = F.concat(F.expr(_text("k % 11", _FILES)), F.lit(".jpg"))
    p = _tagged(spark, d).withColumns({"label_": S.people_label(c("people")), "look_": generations.appearance_tags(name, c("people")), "ss_": F.when(c("k") % 2 == 0, "").otherwise("年轻女生")})
    p = p.withColumn("shoot_", generations.shooting_type(name, c("label_"), c("look_"), c("ai_primary_category")))
    got = generations.category(c("label_"), c("shoot_"), c("look_"), c("tags"), c("mean") / 255, c("contrast") / 255, c("ai_primary_category"), c("ss_"), c("ai_confidence"), c("centre"), c("people"))
    return p.select("idx", got["primary"].alias("primary_category"), got["secondary"].alias("secondary_category"), F.round(got["confidence"], 6).alias("confidence"))


# -- events


@query("q_events_sliding", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS start FROM events) t GROUP BY 1, 2")
def events_sliding(spark, d):
    return decisions.sliding(A.table(spark, d, "events"))


@query("q_protected_merge", _with("""SELECT path, CASE WHEN k % 2 = 0 AND review_status <> '人工已确认' THEN 'new' ELSE review_note END AS review_note, CASE WHEN k % 2 = 0 AND review_status <> '人工已确认' THEN 'AI已审'
  ELSE review_status END AS review_status FROM photos UNION ALL SELECT '/new.jpg', 'new', 'AI已审'"""))
def protected_merge(spark, d):
    """Updates of every second row over a state, of which confirmed rows stay; and a row that is new."""
    p = A.photos(spark, d)
    new = p.where("k % 2 = 0").select("path", F.lit("new").alias("review_note"), F.lit(V.AI_REVIEWED).alias("review_status"))
    new = new.unionByName(spark.createDataFrame([("/new.jpg", "new", V.AI_REVIEWED)], new.schema))
    return decisions.protected_merge(p.select("path", "review_note", "review_status"), new)
