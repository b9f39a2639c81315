"""Queries over the photo catalog, and for each the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import written
from ..functions.ranks import neighbours
from ..operators import advice, business, decision, export, generations, preference, report, review, similarity
from ..sources import adapters as A
from ..sources import catalog
from ..streaming import decisions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _with(body: str) -> str:
    return f"WITH {A.PHOTOS_SQL} {body}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _case(expression: str, pairs: dict[str, str], default: str) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


# -- similarity over bursts of photos, at the threshold of the standard mode

NEAR = V.HAMMING_BY_MODE["standard"]
_PAIRS = f"""{A.BURSTS_SQL}, pairs AS (
  SELECT a.idx AS i, b.idx AS j, hamming(a.bits, b.bits) AS distance FROM vectors a JOIN vectors b ON a.idx < b.idx WHERE hamming(a.bits, b.bits) <= {NEAR}
)"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS}, both_ AS (SELECT i, j FROM pairs UNION ALL SELECT j, i FROM pairs),
reach AS (SELECT i AS v, i AS r FROM both_ UNION SELECT reach.v, both_.j FROM reach JOIN both_ ON both_.i = reach.r),
roots AS (SELECT v AS idx, min(r) AS root FROM reach GROUP BY v),
ranked AS (
  SELECT v.idx, root, '组' || lpad(dense_rank() OVER (ORDER BY root)::VARCHAR, 3, '0') AS group_id, count(*) OVER (PARTITION BY root) AS group_size,
    row_number() OVER (PARTITION BY root ORDER BY score DESC, v.idx)::INT AS group_rank,
    round(greatest(0, 1 - hamming(first(bits) OVER (PARTITION BY root ORDER BY v.idx), bits) / 64.0), 4)::DOUBLE AS similarity_score
  FROM vectors v JOIN roots USING (idx)
)"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grouped(_bursts(spark, sf_dir))


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What groups are made of, written once: they read it several times."""
    return written(A.bursts(spark, sf_dir).select("idx", "hash", "filename", "score"))


def _grouped(v: DataFrame) -> DataFrame:
    return similarity.ranked_groups(v, similarity.hamming_links(v, NEAR))


@query("q_similarity_groups", _GROUPS + " SELECT idx, root, group_id, group_size, group_rank, group_rank = 1 AS is_best, similarity_score FROM ranked")
def similarity_groups(spark, d):
    return _groups(spark, d)


for _t in V.HAMMING_BY_MODE.values():
    query("q_hash_pairs" if _t == NEAR else f"q_hash_pairs_{_t}", f"WITH {_PAIRS.replace(f'<= {NEAR}', f'<= {_t}')} SELECT i, j, distance::INT AS distance FROM pairs")(lambda spark, d, t=_t: similarity.hamming_pairs(A.bursts(spark, d), t))


@query("q_hash_classes", f"WITH {A.BURSTS_SQL} SELECT idx, min(idx) OVER (PARTITION BY bits) AS class FROM vectors")
def hash_classes(spark, d):
    return similarity.hash_classes(A.bursts(spark, d)).select("idx", "class")


_CLASS_PAIRS = f"""WITH {A.BURSTS_SQL}, classes AS (SELECT bits, min(idx) AS first, count(*) AS n FROM vectors GROUP BY bits)
SELECT a.first AS i, b.first AS j, hamming(a.bits, b.bits)::INT AS distance, a.n AS n_i, b.n AS n_j FROM classes a JOIN classes b ON a.first < b.first WHERE hamming(a.bits, b.bits) <= {{t}}"""
for _t in V.HAMMING_BY_MODE.values():
    query(f"q_hash_class_pairs_{_t}", _CLASS_PAIRS.format(t=_t))(lambda spark, d, t=_t: similarity.class_pairs(A.bursts(spark, d), t))


@query("q_incremental_groups", _GROUPS + " SELECT idx, coalesce(root, idx) AS root FROM vectors LEFT JOIN roots USING (idx)")
def incremental_groups(spark, d):
    """Photos arrive in three parts that cut bursts; the groups are those of one run over all."""
    v = written(A.bursts(spark, d).select("idx", "hash"))
    part = lambda n: v.where(F.pmod(F.col("idx") + F.floor(F.col("idx") / 4), F.lit(3)) == n)
    state = similarity.start_groups(part(0), NEAR)
    for n in (1, 2):
        state = written(similarity.grow_groups(state, part(n), NEAR))
    return state.select("idx", "root")


@query("q_average_hash", f"WITH {A.VECTORS_SQL} SELECT idx, bits, list_sum(list_transform(string_split(bits, ''), lambda x: (x = '1')::INT))::INT AS ones FROM vectors")
def hashes(spark, d):
    return A.vectors(spark, d).select("idx", F.lpad(F.bin("hash"), 64, "0").alias("bits"), F.bit_count("hash").alias("ones"))


_BLOCKED = f"""WITH {A.BURSTS_SQL} SELECT a.idx AS i, b.idx AS j, hamming(a.bits, b.bits)::INT AS distance FROM vectors a JOIN vectors b ON a.idx < b.idx
WHERE hamming(a.bits, b.bits) <= {{t}} AND (a.bits[1:8] = b.bits[1:8] OR ({{t}} >= 8 AND abs(a.area - b.area) < greatest(a.area, 1) * 0.35))"""
for _mode, _t in V.HAMMING_BY_MODE.items():
    query(f"q_hash_pairs_blocked_{_mode}", _BLOCKED.format(t=_t))(lambda spark, d, mode=_mode: similarity.blocked_pairs(A.bursts(spark, d), mode))


@query("q_relative_quality", _GROUPS + " SELECT idx, group_id, group_rank, round((group_size - group_rank + 1) / group_size * 100, 2)::DOUBLE AS relative_quality FROM ranked")
def relative_quality(spark, d):
    return similarity.relative_quality(_groups(spark, d)).select("idx", "group_id", "group_rank", "relative_quality")


@query("q_keep_topk", _GROUPS + " SELECT idx, group_id, group_rank <= 1 AS recommended_keep FROM ranked")
def keep_topk(spark, d):
    return similarity.keep_top(_groups(spark, d)).select("idx", "group_id", "recommended_keep")


@query("q_ungrouped", _GROUPS + " SELECT idx, filename FROM vectors WHERE idx NOT IN (SELECT idx FROM roots)")
def ungrouped(spark, d):
    v = _bursts(spark, d)
    return v.join(_grouped(v).select("idx"), "idx", "left_anti").select("idx", "filename")


_QUALITY = f"""(CASE WHEN absolute_quality_score <> 0 THEN absolute_quality_score * 0.35e0 ELSE 0 END + CASE WHEN commercial_score <> 0 THEN commercial_score * 0.35e0 ELSE 0 END + portfolio_score * 0.15e0
  + CASE quality_rating WHEN 'S' THEN 18 WHEN 'A' THEN 14 WHEN 'B' THEN 8 WHEN 'C' THEN 2 WHEN 'X' THEN -12 ELSE 6 END - 16 * len(list_filter(list_distinct(issue_tags),
    lambda x: list_contains({_list(V.GROUP_PENALTY_TAGS)}, x)))
  + CASE WHEN absolute_quality_score = 0 AND commercial_score = 0 THEN coalesce(basic_score * {{w}}, 35) ELSE 0 END)"""


@query("q_group_quality", _with(f"SELECT idx, round({_QUALITY.format(w='0.45e0')}, 6)::DOUBLE AS pick_score, round({_QUALITY.format(w='0.35e0')}, 6)::DOUBLE AS rank_score FROM photos"))
def group_quality(spark, d):
    p = A.photos(spark, d).withColumn("ai_quality_tags", F.array().cast("array<string>"))
    return p.select("idx", F.round(similarity.group_quality(0.45), 6).alias("pick_score"), F.round(similarity.group_quality(0.35), 6).alias("rank_score"))


@query("q_similarity_summary", _with("""SELECT similar_group_id AS group_id, count(*) AS n, coalesce(arg_min(filename, idx) FILTER (best_in_group OR ai_recommended_best), '') AS best_file,
  count(*) FILTER (similar_group_status = 'backup') AS backup_count, count(*) FILTER (similar_group_status = 'duplicate') AS duplicate_count,
  count(*) FILTER (similar_group_status = 'review') AS review_count FROM photos WHERE similar_group_id <> '' GROUP BY 1"""))
def similarity_summary(spark, d):
    return report.group_summary(A.photos(spark, d))


@query("q_group_states", _with("""SELECT group_id, ai_best, human_best, CASE WHEN human_best IS NOT NULL THEN 'decided' WHEN open THEN 'review' ELSE 'suggested' END AS state FROM (SELECT similar_group_id AS group_id, arg_min(filename,
  idx) FILTER (ai_recommended_best) AS ai_best, arg_min(filename, idx) FILTER (best_in_group) AS human_best, bool_or(similar_group_status = 'review') AS open FROM photos WHERE similar_group_id <> ''
  GROUP BY 1) g"""))
def group_states(spark, d):
    return report.group_states(A.photos(spark, d)).select("group_id", "ai_best", "human_best", "state")


@query("q_human_protected", _with(f"""SELECT idx, best_in_group OR review_note <> '' OR (similar_group_status IN ({', '.join(repr(s) for s in V.GROUP_STATUSES)}) AND review_status IN ('{V.CONFIRMED}', '{V.NEEDS_REVIEW}')) OR k % 9 IN (1,
  2, 3) AS protected FROM photos"""))
def human_protected(spark, d):
    text = F.when(F.col("k") % 9 == 1, '{"decision_source": "human"}').when(F.col("k") % 9 == 2, '{"similar_group_status": "backup"}').when(F.col("k") % 9 == 3, "broken").when(F.col("k") % 9 == 4, '{"decision_source": "ai"}').otherwise("")
    p = A.photos(spark, d).withColumns({"human_group_decision": text, "similar_group_note": F.col("review_note")})
    return p.select("idx", similarity.human_protected().alias("protected"))


# -- decision

_SCORES = """scored AS (SELECT *, coalesce(basic_score, 60) AS b, coalesce(face_score, 60) AS f, coalesce(expression_score, 55) AS e, coalesce(pose_score, 55) AS po, coalesce(composition_score, 60) AS co
  FROM photos),
two AS (SELECT *, greatest(0e0, least(100e0, b * 0.42e0 + f * 0.22e0 + e * 0.14e0 + po * 0.08e0 + co * 0.14e0)) AS c, greatest(0e0, least(100e0,
  b * 0.24e0 + co * 0.34e0 + e * 0.16e0 + business_confidence * 100 * 0.10e0 + greatest(0e0, b - 65) * 0.16e0)) AS p FROM scored),
raw AS (SELECT *, [x for x in [p_basic, p_face, p_expression, p_composition] if x <> '' AND x <> '未知问题'] AS r FROM two),
tagged AS (SELECT * REPLACE (CASE WHEN len(list_filter(r, lambda x: true)) > 0 THEN list_filter(r, lambda x, i: list_position(r, x) = i) ELSE [] END AS r) FROM raw),
rep AS (SELECT *, CASE WHEN len(r) > 0 AND c >= 55 AND NOT list_contains(r, '技术可修') THEN list_append(r, '技术可修') ELSE r END AS tags, CASE WHEN c >= 90 THEN 'S' WHEN c >= 75 THEN 'A'
  WHEN c >= 60 THEN 'B' WHEN c >= 40 THEN 'C' ELSE 'X' END AS q0, CASE WHEN photo_type = '' THEN '无法判断' ELSE photo_type END AS ty FROM tagged),
rated AS (SELECT *, CASE WHEN list_contains(tags, '虚焦') AND b < 30 AND ty NOT IN ('风景/环境', '产品/静物') THEN 'X' WHEN list_contains(tags, '虚焦') AND b < 58 THEN 'C' WHEN list_contains(tags, '闭眼')
  AND c < 58 THEN 'B' WHEN list_contains(tags, '技术可修') AND q0 = 'X' THEN 'C' ELSE q0 END AS q FROM rep),
used AS (SELECT *, list_concat(CASE q WHEN 'S' THEN ['精修候选', '客户可选'] WHEN 'A' THEN ['客户可选'] WHEN 'B' THEN [CASE WHEN c >= 70 THEN '客户可选' ELSE '仅留档' END] WHEN 'C' THEN ['修图练习', '仅留档'] ELSE ['不导出'] END,
  CASE WHEN p >= 78 AND q IN ('S', 'A', 'B') THEN ['作品集候选'] ELSE [] END, CASE WHEN list_contains(tags, '技术可修') AND q <> 'C' THEN ['修图练习'] ELSE [] END) AS uses FROM rated)"""


def _decided(spark: SparkSession, d: str) -> DataFrame:
    one = lambda c: F.filter(F.array(F.col(c)), lambda x: x != "")
    none = F.array().cast("array<string>")
    p = A.photos(spark, d).withColumns(
        {
            "business_type": F.col("photo_type"), "business_subtype": F.col("subtype"), "basic_problems": one("p_basic"), "face_problems": one("p_face"), "expression_problems": one("p_expression"), "composition_problems": one("p_composition"), "pose_problems": none, "business_problems": none,
            "basic_confidence": F.when(F.col("basic_score").isNotNull(), 0.92), "face_confidence": F.when(F.col("face_score").isNotNull(), 0.72), "pose_confidence": F.when(F.col("pose_score").isNotNull(), 0.12), "expression_confidence": F.when(F.col("expression_score").isNotNull(), 0.22),
            "composition_confidence": F.when(F.col("composition_score").isNotNull(), 0.62), "basic_reason": F.when(F.col("k") % 2 == 0, "曝光较稳定。").otherwise(""),
        }
    )
    return decision.decide(p)


@query("q_review_decision", _with(f""", {_SCORES} SELECT idx, ty AS photo_type, q AS quality_rating, round(c, 1)::DOUBLE AS commercial_score, round(p, 1)::DOUBLE AS portfolio_score, array_to_string(uses, ',') AS delivery_use,
  array_to_string(tags, ',') AS issue_tags FROM used"""))
def review_decision(spark, d):
    return _decided(spark, d).select("idx", "photo_type", "quality_rating", "commercial_score", "portfolio_score", F.array_join("delivery_use", ",").alias("delivery_use"), F.array_join("issue_tags", ",").alias("issue_tags"))


_CONFIDENCE = "round(CASE WHEN basic_score IS NULL THEN 0 ELSE 0.92e0 * 0.30e0 END + CASE WHEN face_score IS NULL THEN 0 ELSE 0.72e0 * 0.18e0 END + CASE WHEN composition_score IS NULL THEN 0 ELSE 0.62e0 * 0.16e0 END + business_confidence * 0.18e0 + CASE WHEN expression_score IS NULL THEN 0 ELSE 0.22e0 * 0.10e0 END + CASE WHEN pose_score IS NULL THEN 0 ELSE 0.12e0 * 0.08e0 END, 3)::DOUBLE"


@query("q_decision_confidence", _with(f"SELECT idx, {_CONFIDENCE} AS confidence FROM photos"))
def decision_confidence(spark, d):
    return _decided(spark, d).select("idx", "confidence")


@query("q_decision_preset", _with(f"SELECT idx, {_case('photo_type', {t: str(len(p)) + ':' + str(sum(p.values())) for t, p in V.PRESETS.items() if t in V.PHOTO_TYPES}, chr(39) + '5:100' + chr(39))} AS preset FROM photos"))
def decision_preset(spark, d):
    m = F.col("review_preset")
    return _decided(spark, d).select("idx", F.concat(F.size(m).cast("string"), F.lit(":"), F.aggregate(F.map_values(m), F.lit(0), lambda s, x: s + x).cast("string")).alias("preset"))


_EVIDENCE = """ev AS (SELECT idx, k % 9 AS face_count, k % 10 AS person_count, k % 256 AS r, k % 251 AS g, k % 241 AS b, (k % 131) * 1e0 AS color_std, (k % 41) / 100e0 AS green_ratio, (k % 43) / 100e0 AS blue_ratio, (k % 47) / 100e0 AS white_ratio, (k % 53) / 100e0 AS lower_white_ratio, (k % 59) / 100e0 AS center_white_ratio, (k % 17) / 100e0 AS face_area_ratio FROM photos)"""
_BUSINESS = f"""{_EVIDENCE}, p AS (SELECT *, face_count AS f, CASE WHEN person_count = 0 THEN face_count ELSE person_count END AS p, r > 185 AND g > 185 AND b > 185 AS white, b > 135 AND b > r + 25 AS blue, r > 145
  AND r > b + 25 AS red FROM ev),
h1 AS (SELECT *, CASE WHEN color_std < 58 AND white THEN '白底' WHEN color_std < 70 AND blue THEN '蓝底' WHEN color_std < 70 AND red THEN '红底' WHEN green_ratio > 0.22e0 OR blue_ratio > 0.28e0 THEN '户外'
  WHEN color_std < 95 THEN '棚拍背景' ELSE '未知' END AS bg FROM p),
h2 AS (SELECT *, CASE WHEN bg IN ('白底', '蓝底', '红底') AND color_std < 62 THEN '证件照服装' WHEN (lower_white_ratio > 0.30e0 OR center_white_ratio > 0.34e0) AND white_ratio > 0.16e0
  AND color_std >= 42 THEN '婚纱' WHEN white_ratio > 0.38e0 AND bg = '棚拍背景' AND color_std >= 35 THEN '婚纱' ELSE '未知' END AS cl,
  CASE WHEN bg IN ('白底', '蓝底', '红底', '棚拍背景') THEN '棚拍' WHEN green_ratio > 0.22e0 OR blue_ratio > 0.28e0 THEN '户外' WHEN color_std > 112 THEN '会议' ELSE '未知' END AS sc, CASE
    WHEN face_area_ratio <= 0 THEN '未知' WHEN face_area_ratio < 0.035e0 THEN '全身' WHEN face_area_ratio < 0.11e0 THEN '半身' ELSE '特写' END AS bo FROM h1),
c AS (SELECT *, CASE WHEN cl = '婚纱' AND (p BETWEEN 1 AND 2 OR f BETWEEN 1 AND 2) THEN 1 WHEN f <= 0 AND p <= 0 THEN 2 WHEN (f <= 1 OR p <= 1) AND color_std < 72 AND (white OR blue OR red)
  AND bo IN ('特写', '半身', '未知') THEN 3 WHEN f <= 1 OR p <= 1 THEN 4 WHEN f = 2 OR p = 2 THEN 5 WHEN (f >= 6 OR p >= 6) AND sc IN ('会议', '棚拍', '未知') THEN 6 WHEN f >= 6 OR p >= 6 THEN 7 WHEN f >= 3
  OR p >= 3 THEN 8 ELSE 9 END AS n, sc = '棚拍' AND bo IN ('全身', '半身', '未知') AS studio FROM h2),
t AS (SELECT *, CASE n WHEN 1 THEN '婚纱照' WHEN 2 THEN '风景/环境' WHEN 3 THEN '证件照' WHEN 4 THEN '个人写真' WHEN 5 THEN '情侣照' WHEN 6 THEN '会议/活动照' WHEN 7 THEN '全家福' WHEN 8 THEN '全家福'
  ELSE '无法判断' END AS candidate_type,
  CASE WHEN n = 1 AND (p <= 1 OR f <= 1) THEN '单人新娘' WHEN n = 1 AND studio THEN '棚内婚纱' WHEN n = 1 THEN '双人互动' WHEN n = 2 THEN '环境交代' WHEN n = 3 AND blue THEN '蓝底' WHEN n = 3 AND red THEN '红底'
    WHEN n = 3 THEN '白底' WHEN n = 4 AND sc = '棚拍' THEN '棚拍写真' WHEN n = 4 THEN '半身' WHEN n = 6 THEN '会议合影' WHEN n = 7 THEN '正式合影' WHEN n = 8 THEN '多人家庭' ELSE '未细分' END AS candidate_subtype,
  CASE WHEN n = 1 AND studio THEN 0.78e0 WHEN n = 1 THEN 0.70e0 WHEN n = 2 AND sc IN ('户外', '风景') THEN 0.50e0 WHEN n = 2 THEN 0.34e0 WHEN n = 3 THEN 0.68e0 WHEN n = 4 THEN 0.58e0
  WHEN n = 5 THEN 0.56e0 WHEN n = 6 THEN 0.66e0 WHEN n = 7 THEN 0.60e0 WHEN n = 8 THEN 0.58e0 ELSE 0.25e0 END AS type_confidence FROM c)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    share = lambda n, over=100.0: (k % n) / over
    return A.photos(spark, d).select("idx", (k % 9).alias("face_count"), (k % 10).alias("person_count"), (k % 256).alias("r"), (k % 251).alias("g"), (k % 241).alias("b"), (k % 131).cast("double").alias("color_std"), share(41).alias("green_ratio"), share(43).alias("blue_ratio"), share(47).alias("white_ratio"), share(53).alias("lower_white_ratio"), share(59).alias("center_white_ratio"), share(17).alias("face_area_ratio"))


@query("q_business_type", _with(f""", {_BUSINESS} SELECT idx, candidate_type, candidate_subtype, type_confidence, CASE WHEN type_confidence >= 0.65e0 THEN candidate_type ELSE '无法判断' END AS type, CASE
  WHEN type_confidence >= 0.65e0 THEN candidate_subtype ELSE '未细分' END AS type_subtype FROM t"""))
def business_type(spark, d):
    return business.classify(_evidence(spark, d)).select("idx", "candidate_type", "candidate_subtype", "type_confidence", "type", "type_subtype")


@query("q_hints", _with(f", {_BUSINESS} SELECT idx, bg AS background_hint, cl AS clothing_hint, sc AS scene_hint, bo AS body_scale FROM t"))
def hints(spark, d):
    return business.classify(_evidence(spark, d)).select("idx", "background_hint", "clothing_hint", "scene_hint", "body_scale")


# -- categories, filters, sorts

_MANUAL = f"CASE WHEN m IN ({', '.join(repr(c) for c in V.MANUAL_CATEGORIES)}) THEN m ELSE '备选' END"
_FINAL = f"finals AS (SELECT *, CASE WHEN manual_override THEN mp WHEN ai_primary_category <> '' THEN CASE WHEN ai_confidence < 0.65e0 THEN '人工复核' WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category ELSE ai_primary_category END ELSE mp END AS fin FROM (SELECT *, {_MANUAL} AS mp FROM (SELECT *, {_case('manual_category', V.LEGACY_MANUAL, 'manual_category')} AS m FROM photos) a) b)"


def _final(spark: SparkSession, d: str) -> DataFrame:
    return A.photos(spark, d).withColumn("final_category", review.final_category())


@query("q_final_category", _with(f", {_FINAL} SELECT idx, fin AS final_category FROM finals"))
def final_category(spark, d):
    return _final(spark, d).select("idx", "final_category")


@query("q_manual_path", _with(f""", {_FINAL} SELECT idx, mp AS manual_path, split_part(fin, '/', 1) AS primary_part, split_part(fin, '/', 2) AS secondary_part FROM finals WHERE fin <> '证件/形象照' AND fin NOT LIKE '%/%/%'
  AND fin NOT LIKE '风景/环境%'"""))
def manual_paths(spark, d):
    p = _final(spark, d)
    parts = review.split_category(F.col("final_category"))
    own = (F.col("final_category") != "证件/形象照") & ~F.col("final_category").like("%/%/%") & ~F.col("final_category").like("风景/环境%")
    return p.where(own).select("idx", review.manual_path(F.col("manual_category")).alias("manual_path"), parts["primary"].alias("primary_part"), parts["secondary"].alias("secondary_part"))


def _filter_sql(name: str) -> str:
    special = {
        "全部": "true", "重复": "manual_category = '重复' OR similar_group_id <> ''", "人工复核": "starts_with(fin, '人工复核') OR ai_primary_category = '人工复核'", "AI低置信度": "ai_primary_category <> '' AND ai_confidence < 0.65e0",
        "相似重复待选": "ai_primary_category = '相似重复待选' OR similar_group_id <> ''", "多人写真": "ai_primary_category = '多人写真'",
    }
    if name in special:
        return special[name]
    return f"manual_category = '{name}'" if name in V.MANUAL_CATEGORIES else f"ai_primary_category = '{name}' OR starts_with(fin, '{name}')"


@query("q_named_filters", _with(f", {_FINAL} SELECT filter, sum(n)::BIGINT AS n, sum(s)::BIGINT AS sum_idx, sum(n * (idx * 7919 % 1000003))::BIGINT AS sum_hash FROM (SELECT unnest([" + ", ".join(f"{{'f': '{f}', 'n': ({_filter_sql(f)})::INT}}" for f in review.FILTERS) + "]) AS u, idx FROM finals) x, LATERAL (SELECT u.f AS filter, u.n AS n, u.n * idx AS s) y GROUP BY filter"))
def named_filters(spark, d):
    """All 22 list filters in one pass: how many rows each keeps, with the sum of their ids and of a hash of them."""
    each = F.array(*(F.struct(F.lit(f).alias("filter"), review.named_filter(f).cast("long").alias("n")) for f in review.FILTERS))
    rows = _final(spark, d).select("idx", F.inline(each))
    return rows.groupBy("filter").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("idx")).alias("sum_idx"), F.sum(F.col("n") * (F.col("idx") * 7919 % 1000003)).alias("sum_hash"))


_SORT_SQL = {
    "文件名": "lower(filename)", "拍摄时间": "CASE WHEN taken_at = '' THEN filename ELSE taken_at END", "AI分类": "ai_primary_category, ai_secondary_category, filename", "手动分类": "manual_category, filename",
    "置信度": "-ai_confidence, filename", "相似组": "CASE WHEN similar_group_id = '' THEN '999' ELSE similar_group_id END, filename",
}
for _n, _sort in enumerate(review.SORTS):
    query(f"q_sort_{_n}", _with(f", {_FINAL} SELECT row_number() OVER (ORDER BY {_SORT_SQL[_sort]}, idx)::INT AS place, idx FROM finals WHERE starts_with(fin, '单人写真') OR ai_primary_category = '单人写真'"))(
        lambda spark, d, sort=_sort: _top_view(spark, d, sort)
    )


def _top_view(spark: SparkSession, d: str, sort: str) -> DataFrame:
    """The place of every photo of a filtered and sorted view."""
    return review.placed_view(_final(spark, d), "单人写真", sort).select(F.col("place").cast("int").alias("place"), "idx")


@query("q_prev_next", _with("SELECT idx, lag(idx) OVER (ORDER BY filename, idx) AS previous_idx, lead(idx) OVER (ORDER BY filename, idx) AS next_idx FROM photos"))
def prev_next(spark, d):
    return neighbours(A.photos(spark, d).select("idx", "filename"), ["filename", "idx"], "idx").select("idx", "previous_idx", "next_idx")


# -- suggestions and review

_SUGGEST = "CASE k % 7 WHEN 0 THEN '' WHEN 1 THEN 'not json' WHEN 2 THEN '{}' WHEN 3 THEN '{\"version\": \"business_classifier_v2\", \"image_path\": \"' || path || '\"}' WHEN 4 THEN '{\"image_path\": \"' || path || '\"}' WHEN 5 THEN '{\"version\": \"old\", \"image_path\": \"' || path || '\"}' ELSE '{\"version\": \"old\", \"image_path\": \"/other.jpg\"}' END"


@query("q_suggestion_status", _with("SELECT idx, ['missing', 'invalid', 'invalid', 'current', 'legacy', 'stale', 'mismatch'][k % 7 + 1] AS status FROM photos"))
def suggestion_status(spark, d):
    p = A.photos(spark, d).withColumn("ai_suggestion", F.expr(_SUGGEST))
    return p.select("idx", review.suggestion_status(F.col("ai_suggestion"), F.col("path")).alias("status"))


@query("q_clear_stale", _with("""SELECT idx, k % 7 IN (1, 2, 4, 5, 6) AS emptied, CASE WHEN k % 7 IN (1, 2, 4, 5, 6) THEN '' ELSE ai_primary_category END AS ai_primary_category, CASE WHEN k % 7 IN (1, 2, 4, 5, 6) THEN 0e0
  ELSE ai_confidence END AS ai_confidence, quality_rating FROM photos"""))
def clear_stale(spark, d):
    p = A.photos(spark, d).withColumn("ai_suggestion", F.expr(_SUGGEST))
    return review.clear_stale(p).select("idx", ((F.expr(_SUGGEST) != "") & (F.col("ai_suggestion") == "")).alias("emptied"), "ai_primary_category", "ai_confidence", "quality_rating")


@query("q_validate_fields", _with(f", v AS (SELECT idx, CASE WHEN photo_type NOT IN ('', {', '.join(repr(t) for t in V.PHOTO_TYPES)}) THEN 1 ELSE 0 END + CASE WHEN subtype <> '' AND NOT list_contains(CASE photo_type " + " ".join(f"WHEN '{t}' THEN {_list(s)}" for t, s in V.SUBTYPES.items()) + f" ELSE ['未细分'] END, subtype) THEN 1 ELSE 0 END + CASE WHEN p_basic <> '' AND NOT list_contains({_list(V.ISSUE_TAGS)}, p_basic) THEN 1 ELSE 0 END AS n FROM photos) SELECT idx, n::INT AS n_errors FROM v"))
def validate_fields(spark, d):
    p = A.photos(spark, d)
    tags = F.filter(F.array("p_basic"), lambda x: x != "")
    return p.select("idx", F.size(review.review_errors(F.col("photo_type"), F.col("subtype"), F.col("quality_rating"), F.col("delivery_use"), tags)).alias("n_errors"))


@query("q_overrides", _with("""SELECT idx, a AS ai_text, h AS human_text FROM (SELECT idx, array_to_string(list_filter([ai_primary_category, ai_secondary_category], lambda x: x <> ''), ' / ') AS a,
  array_to_string(list_filter([photo_type, subtype, quality_rating], lambda x: x <> ''), ' / ') AS h FROM photos) t WHERE a <> '' AND h <> '' AND NOT contains(h, a)"""))
def override_rows(spark, d):
    return report.overrides(A.photos(spark, d)).select("idx", "ai_text", "human_text")


@query("q_protected_update", _with(f"""SELECT idx, CASE WHEN k % 2 = 0 AND review_status <> '{V.CONFIRMED}' THEN 'A' ELSE quality_rating END AS quality_rating, CASE WHEN k % 2 = 0 AND review_status <> '{V.CONFIRMED}' THEN '{V.AI_REVIEWED}'
  ELSE review_status END AS review_status FROM photos"""))
def protected_update(spark, d):
    p = A.photos(spark, d).withColumn("ai_suggestion", F.lit(""))
    new = p.where(F.col("k") % 2 == 0).select("path", F.lit("{}").alias("ai_suggestion"), F.lit("个人写真").alias("photo_type"), F.lit("半身").alias("subtype"), F.lit("A").alias("quality_rating"), F.lit(80.0).alias("commercial_score"), F.lit(70.0).alias("portfolio_score"), "delivery_use", "issue_tags", F.lit(0.7).alias("confidence"), F.lit("r").alias("reason"))
    return review.apply_analysis(p, new).select("idx", "quality_rating", "review_status")


@query("q_mark", _with(f""", {_FINAL} SELECT idx, CASE WHEN k % 5 = 0 THEN '废片' ELSE manual_category END AS manual_category, k % 5 = 0 OR manual_override AS manual_override, CASE WHEN k % 5 = 0 THEN '废片'
  ELSE fin END AS final_category FROM finals"""))
def mark(spark, d):
    p = _final(spark, d).withColumns({"user_label": F.lit(""), "user_label_time": F.lit("")})
    marks = p.where(F.col("k") % 5 == 0).select("path", F.lit("废片").alias("category"))
    return review.mark(p, marks).select("idx", "manual_category", "manual_override", "final_category")


@query("q_reject_not_exported", _with("SELECT idx, array_to_string(CASE WHEN quality_rating = 'X' AND NOT list_contains(delivery_use, '不导出') THEN list_append(delivery_use, '不导出') ELSE delivery_use END, ',') AS delivery_use FROM photos"))
def reject_not_exported(spark, d):
    return review.reject_is_not_exported(A.photos(spark, d)).select("idx", F.array_join("delivery_use", ",").alias("delivery_use"))


@query("q_mark_review", _with(f"""SELECT idx, CASE WHEN m IN ('精修候选') THEN 'S' WHEN m = '可交付' THEN 'A' WHEN m = '废片' THEN 'X' WHEN quality_rating <> '' THEN quality_rating WHEN m = '备选' THEN 'B' WHEN m = '作品集候选' THEN 'S'
  WHEN m = '练习片' THEN 'C' ELSE '' END AS quality_rating, CASE WHEN m IN ('备选', '重复') THEN '{V.NEEDS_REVIEW}' ELSE '{V.CONFIRMED}' END AS review_status, len(delivery_use) + CASE WHEN u IS NOT NULL
  AND NOT list_contains(delivery_use, u) THEN 1 ELSE 0 END AS n_uses, len(issue_tags) + CASE WHEN m = '重复' AND NOT list_contains(issue_tags, '重复照片') THEN 1 ELSE 0 END AS n_tags FROM (SELECT *,
  manual_category AS m, CASE manual_category WHEN '精修候选' THEN '精修候选' WHEN '可交付' THEN '客户可选' WHEN '废片' THEN '不导出' WHEN '作品集候选' THEN '作品集候选' WHEN '练习片' THEN '修图练习' END AS u FROM photos) t"""))
def mark_review(spark, d):
    p = review.review_of_mark(A.photos(spark, d), F.col("manual_category"))
    return p.select("idx", "quality_rating", "review_status", F.size("delivery_use").cast("long").alias("n_uses"), F.size("issue_tags").cast("long").alias("n_tags"))


@query("q_badges", _with(f""", {_FINAL} SELECT idx, CASE manual_category WHEN '精修候选' THEN '精修' WHEN '可交付' THEN '交付' WHEN '重复' THEN '重复' WHEN '废片' THEN '废片' WHEN '作品集候选' THEN '作品' WHEN '练习片' THEN '练习' ELSE CASE
  WHEN similar_group_status = 'best' OR best_in_group THEN '最佳' WHEN similar_group_status = 'duplicate' THEN '重复' WHEN similar_group_status = 'review' OR starts_with(fin, '人工复核') THEN '复核'
  ELSE '备选' END END AS badge, CASE WHEN photo_type <> '' THEN CASE WHEN subtype <> '' THEN photo_type || ' / ' || subtype ELSE photo_type END WHEN ai_primary_category <> '' THEN 'AI建议：' || CASE
  WHEN ai_secondary_category <> '' THEN ai_primary_category || ' / ' || ai_secondary_category ELSE ai_primary_category END ELSE '-' END AS type_text FROM finals"""))
def badges(spark, d):
    return _final(spark, d).select("idx", review.badge().alias("badge"), review.type_text().alias("type_text"))


@query("q_write_reviews", _with("SELECT idx, CASE WHEN k % 4 = 0 THEN 'A' ELSE quality_rating END AS quality_rating, CASE WHEN k % 4 = 0 THEN '人工已确认' ELSE review_status END AS review_status, k % 4 = 0 AS decided FROM photos"))
def write_reviews(spark, d):
    """Every fourth photo is reviewed rightly; every fourth plus one has a rating that doesn't exist and is left alone."""
    p = A.photos(spark, d).withColumn("human_decision", F.lit(""))
    none = F.array().cast("array<string>")
    given = p.where(F.col("k") % 4 <= 1).select("path", F.lit("个人写真").alias("photo_type"), F.lit("半身").alias("subtype"), F.when(F.col("k") % 4 == 0, "A").otherwise("Q").alias("quality_rating"), none.alias("delivery_use"), none.alias("issue_tags"), F.lit(80.0).alias("commercial_score"), F.lit(70.0).alias("portfolio_score"), F.lit("").alias("review_note"), F.lit(V.CONFIRMED).alias("review_status"))
    return review.write_reviews(p, given).select("idx", "quality_rating", "review_status", (F.col("human_decision") != "").alias("decided"))


@query("q_workflow_guide", _with("""SELECT count(*) AS imported, count(*) FILTER (ai_primary_category <> '' OR ai_confidence <> 0) AS analysed, count(*) FILTER (manual_override) AS marked,
  count(*) FILTER (manual_category = '备选') AS pending, count(DISTINCT nullif(similar_group_id, '')) AS groups FROM photos"""))
def workflow_guide(spark, d):
    return report.workflow_guide(A.photos(spark, d))


# -- aggregates

_COUNTS = """c AS (SELECT 'photo_type' AS dimension, CASE WHEN photo_type = '' THEN '未分类' ELSE photo_type END AS value FROM photos UNION ALL SELECT 'subtype', CASE WHEN subtype = '' THEN '未细分' ELSE subtype END
  FROM photos
UNION ALL SELECT 'quality_rating', CASE WHEN quality_rating = '' THEN '未评级' ELSE quality_rating END FROM photos UNION ALL SELECT 'review_status', CASE WHEN review_status = '' THEN '未审'
  ELSE review_status END FROM photos
UNION ALL SELECT 'delivery_use', unnest(CASE WHEN len(delivery_use) = 0 THEN ['未设置'] ELSE delivery_use END) FROM photos UNION ALL SELECT 'issue_tags', unnest(issue_tags) FROM photos)"""


@query("q_export_counts", _with(f", {_COUNTS} SELECT dimension, value, count(*) AS n FROM c GROUP BY 1, 2"))
def export_counts(spark, d):
    return report.all_counts(A.photos(spark, d))


for _d in report.DIMENSIONS:
    query(f"q_count_{_d}", _with(f", {_COUNTS} SELECT value, count(*) AS n FROM c WHERE dimension = '{_d}' GROUP BY 1"))(lambda spark, d, dim=_d: report.counts(A.photos(spark, d), dim))

_TOTALS = f"""totals AS (SELECT count(*) AS total, count(*) FILTER (quality_rating = 'X') AS reject_count, coalesce(sum(len(list_filter(delivery_use, lambda x: x = '作品集候选'))),
  0)::BIGINT AS portfolio_candidate_count, coalesce(sum(len(list_filter(delivery_use, lambda x: x = '精修候选'))), 0)::BIGINT AS retouch_candidate_count,
coalesce(sum(len(list_filter(delivery_use, lambda x: x = '客户可选'))), 0)::BIGINT AS client_select_count, count(DISTINCT nullif(similar_group_id, '')) AS similar_group_count,
  count(*) FILTER (best_in_group) AS best_in_group_count, count(*) FILTER (similar_group_id <> '') AS photos_in_groups_count,
count(*) FILTER (similar_group_status = 'duplicate') AS duplicate_count, count(*) FILTER (similar_group_status = 'backup') AS backup_count,
  count(*) FILTER (similar_group_status = 'review') AS similar_review_count, count(*) FILTER (review_status = '{V.CONFIRMED}') AS manual_confirmed_count,
count(*) FILTER (review_status = '{V.NEEDS_REVIEW}') AS needs_review_count, count(*) FILTER (review_status IN ('', '{V.UNREVIEWED}')) AS unreviewed_count,
  count(*) FILTER (review_status = '{V.AI_REVIEWED}') AS ai_reviewed_count, count(*) FILTER (quality_rating IN ('S', 'A')) AS sa_count FROM photos)"""


@query("q_export_totals", _with(f", {_TOTALS} SELECT * FROM totals"))
def export_totals(spark, d):
    return report.totals(A.photos(spark, d))


@query("q_rates", _with(f""", {_TOTALS} SELECT reject_count / greatest(total, 1) AS reject_rate, sa_count / greatest(total, 1) AS sa_rate, portfolio_candidate_count / greatest(total, 1) AS portfolio_rate, printf('%.1f%%',
  sa_count / greatest(total, 1) * 100) AS sa_text FROM totals"""))
def rates(spark, d):
    return report.rates(report.totals(A.photos(spark, d)))


@query("q_rating_table", _with("""SELECT place::INT AS place, rating, coalesce(n, 0) AS n FROM (VALUES (0, 'S'), (1, 'A'), (2, 'B'), (3, 'C'), (4, 'X'), (5, '未评级')) o(place, rating) LEFT JOIN (SELECT CASE
  WHEN quality_rating = '' THEN '未评级' ELSE quality_rating END AS rating, count(*) AS n FROM photos GROUP BY 1) c USING (rating)"""))
def rating_table(spark, d):
    return report.rating_table(A.photos(spark, d))


@query("q_top3_tags", _with("""SELECT tag, n FROM (SELECT tag, count(*) AS n, min((idx, i)) AS first FROM (SELECT idx, unnest(issue_tags) AS tag, unnest(range(len(issue_tags))) AS i FROM photos) t GROUP BY tag ORDER BY n DESC,
  first LIMIT 3) x"""))
def top3_tags(spark, d):
    return report.top_tags(A.photos(spark, d))


_WORKFLOW = f"""w AS (SELECT CASE WHEN manual_category = '废片' OR contains(t, '废片') THEN '废片' WHEN manual_category = '重复' OR ai_primary_category = '相似重复待选' OR similar_group_id <> '' OR contains(t, '重复') THEN '重复'
  WHEN manual_category IN ('精修候选', '作品集候选') OR s >= 90 OR contains(t, '推荐保留') OR contains(t, '精修') THEN '强烈推荐' WHEN manual_category = '可交付' OR s >= 75 OR contains(t, '可用待修') OR contains(t,
    '可交付') THEN '可交付' ELSE '备选' END AS bucket
  FROM (SELECT *, manual_category || ' / ' || final_recommendation || ' / ' || fin || ' / ' || fin || ' / ' || ai_primary_category AS t, CASE WHEN final_pick_score <> 0 THEN final_pick_score
  WHEN absolute_quality_score <> 0 THEN absolute_quality_score ELSE relative_quality_score END AS s FROM finals) x)"""


@query("q_workflow_buckets", _with(f""", {_FINAL}, {_WORKFLOW} SELECT place::INT AS place, bucket, coalesce(n, 0) AS n FROM (VALUES (0, '强烈推荐'), (1, '可交付'), (2, '备选'), (3, '重复'), (4, '废片')) o(place, bucket) LEFT JOIN (SELECT bucket,
  count(*) AS n FROM w GROUP BY 1) c USING (bucket)"""))
def workflow_buckets(spark, d):
    return report.workflow_counts(_final(spark, d))


@query("q_pending_ratio", _with(f""", {_FINAL} SELECT count(*) AS total, count(*) FILTER (ai_primary_category <> '') AS analysed, avg(starts_with(fin, '人工复核')::INT) AS pending_ratio, avg(starts_with(fin, '人工复核')::INT) > 0.25 AS too_high
  FROM finals"""))
def pending_ratio(spark, d):
    return report.pending(_final(spark, d))


@query("q_csv_report", _with("""SELECT filename AS file_name, path AS file_path, '' AS exported_paths, CASE WHEN photo_type = '' THEN '未分类' ELSE photo_type END AS photo_type, CASE WHEN subtype = '' THEN '未细分'
  ELSE subtype END AS subtype, CASE WHEN quality_rating = '' THEN '未评级' ELSE quality_rating END AS quality_rating, array_to_string(delivery_use, '、') AS delivery_use, array_to_string(issue_tags,
  '、') AS issue_tags, commercial_score, portfolio_score, CASE WHEN review_status = '' THEN '未审' ELSE review_status END AS review_status, similar_group_id, CASE WHEN k % 4 = 0 THEN ''
  ELSE (k % 4)::VARCHAR END AS similar_group_rank, similar_group_status, CASE WHEN ai_confidence = 0 THEN '' ELSE printf('%.3f', ai_confidence) END AS similarity_score, CASE
  WHEN best_in_group THEN '是' ELSE '否' END AS best_in_group, CASE WHEN ai_recommended_best THEN '是' ELSE '否' END AS ai_recommended_best, review_note, 'report_only' AS export_status, '' AS export_error
  FROM photos"""))
def csv_report(spark, d):
    return report.csv_rows(A.photos(spark, d).withColumns({"similar_group_rank": (F.col("k") % 4).cast("int"), "similarity_score": F.col("ai_confidence")}))


# -- export

_DEST = f"""dest AS (SELECT idx, path, filename, CASE WHEN quality_rating = 'X' OR list_contains(delivery_use, '不导出') OR similar_group_status = 'duplicate' THEN [] ELSE list_concat(
  list_transform(CASE WHEN len(delivery_use) = 0 AND quality_rating IN ('S', 'A') THEN ['客户可选'] ELSE list_filter(delivery_use, lambda x, i: list_position(delivery_use, x) = i) END,
    lambda u: {_case('u', V.USE_FOLDERS, 'NULL')}),
  ['10_按类型整理/' || replace(CASE WHEN photo_type = '' THEN '未分类' ELSE photo_type END, '/', '_') || '/' || CASE WHEN subtype = '' THEN '未细分'
  ELSE subtype END || '/' || {_case('quality_rating', {c: c + '_' + v.replace('/', '') for c, v in V.RATINGS.items()}, chr(39) + '未评级' + chr(39))}]) END AS ds FROM photos)"""


@query("q_export_destinations", _with(f", {_DEST} SELECT idx, unnest(ds) AS destination FROM dest"))
def export_destinations(spark, d):
    return A.photos(spark, d).select("idx", F.explode(export.destinations()).alias("destination"))


@query("q_unique_names", _with(f""", {_DEST}, e AS (SELECT idx, filename, unnest(ds) AS destination FROM dest) SELECT idx, destination, CASE WHEN n = 0 THEN filename ELSE replace(filename, '.jpg', '') || '_' || lpad(n::VARCHAR, 3,
  '0') || '.jpg' END AS target FROM (SELECT *, row_number() OVER (PARTITION BY destination, filename ORDER BY idx) - 1 AS n FROM e) x"""))
def unique_names(spark, d):
    return export.plan(A.photos(spark, d)).select("idx", "destination", "target")


@query("q_export_status", _with(f", {_DEST} SELECT CASE WHEN len(ds) = 0 THEN 'skipped_no_export' ELSE 'planned' END AS export_status, count(*) AS n FROM dest GROUP BY 1"))
def export_status(spark, d):
    return export.status_counts(export.records(A.photos(spark, d)))


@query("q_no_export", _with("SELECT idx, filename FROM photos WHERE quality_rating = 'X' OR list_contains(delivery_use, '不导出') OR similar_group_status = 'duplicate'"))
def no_export(spark, d):
    return A.photos(spark, d).where(review.not_exported()).select("idx", "filename")


@query(
    "q_safe_name",
    r"""SELECT doc_id AS idx, CASE WHEN s = '' THEN '未命名' ELSE s END AS name
    FROM (SELECT doc_id, rtrim(regexp_replace(trim(replace(coalesce(text, ''), chr(10), ' ')), '[<>:"/\\|?*]', '_', 'g'), ' .') AS s FROM documents) t""",
)
def safe_names(spark, d):
    line = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    return A.table(spark, d, "documents").select(F.col("doc_id").alias("idx"), S.safe_name(line, "未命名").alias("name"))


# -- joins and state


@query("q_left_join_state", _with("SELECT f.idx, coalesce(s.review_note, '') AS review_note, s.idx IS NOT NULL AS saved FROM photos f LEFT JOIN (SELECT * FROM photos WHERE k % 3 = 0) s ON f.path = s.path"))
def left_join_state(spark, d):
    p = A.photos(spark, d)
    saved = p.where(F.col("k") % 3 == 0).select("path", "review_note", F.lit(True).alias("saved"))
    return p.select("idx", "path").join(saved, "path", "left").select("idx", F.coalesce("review_note", F.lit("")).alias("review_note"), F.coalesce("saved", F.lit(False)).alias("saved"))


@query("q_upsert", _with("SELECT path, idx, 'new' AS state FROM photos WHERE k % 3 = 0 UNION ALL SELECT path, idx, 'old' FROM photos WHERE k % 3 <> 0"))
def upsert(spark, d):
    p = A.photos(spark, d).select("path", "idx", "k")
    return catalog.upserted(p.select("path", "idx", F.lit("old").alias("state")), p.where(F.col("k") % 3 == 0).select("path", "idx", F.lit("new").alias("state")))


@query("q_latest_decision", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) t WHERE n = 1")
def latest_decision(spark, d):
    return decisions.latest(A.table(spark, d, "events")).select("user_id", "event_id", "event_type", "value")


@query("q_preset_lookup", _with(f"""SELECT photo_type, count(*) AS n, any_value({_case('photo_type', {t: '|'.join(sorted(p)) for t, p in V.PRESETS.items() if t in V.PHOTO_TYPES}, repr('|'.join(sorted(V.PRESETS[V.DEFAULT_PRESET]))))}) AS keys
  FROM photos GROUP BY 1"""))
def preset_lookup(spark, d):
    dim = V.rows_of(spark, [(t, "|".join(sorted(p))) for t, p in V.PRESETS.items()], ["photo_type", "keys"])
    joined = A.photos(spark, d).select("photo_type").join(F.broadcast(dim), "photo_type", "left")
    return joined.groupBy("photo_type").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.first("keys"), F.lit("|".join(sorted(V.PRESETS[V.DEFAULT_PRESET])))).alias("keys"))


# -- preference

_CENTRES = f"WITH {A.DOCUMENTS_SQL}, centres AS (SELECT label, list(m ORDER BY pos) AS c FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(features) AS x, unnest(range(len(features))) AS pos FROM samples) u GROUP BY 1, 2) v GROUP BY 1)"


@query("q_label_centroids", _CENTRES + " SELECT label, round(c[1], 6)::DOUBLE AS c0, round(c[2], 6)::DOUBLE AS c1, round(c[3], 6)::DOUBLE AS c2 FROM centres")
def label_centroids(spark, d):
    c = preference.centroids(A.documents(spark, d))
    return c.select("label", *(F.round(F.get("centroid", F.lit(n)), 6).alias(f"c{n}") for n in range(3)))


@query("q_nearest_centroid", _CENTRES + " SELECT idx, arg_min(label, (d, label)) AS preference_label, round(1 / (1 + min(d)), 5)::DOUBLE AS preference_score FROM (SELECT idx, c.label, sqrt(list_sum(list_transform(list_zip(features, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS d FROM samples s, centres c) t GROUP BY idx")
def nearest_centroid(spark, d):
    s = A.documents(spark, d)
    return preference.nearest(s, preference.centroids(s)).select("idx", "preference_label", F.round("preference_score", 5).alias("preference_score"))


@query("q_preference_summary", f"WITH {A.DOCUMENTS_SQL} SELECT label, count(*) AS n FROM samples GROUP BY 1")
def preference_summary(spark, d):
    return preference.label_counts(A.documents(spark, d))


@query("q_trainable", f"""WITH {A.DOCUMENTS_SQL} SELECT count(*) AS total, count(DISTINCT label) AS labels, count(*) >= 50 AND count(DISTINCT label) >= 2 AS can_train, (CASE WHEN count(*) FILTER (label = '精选') < 5 THEN 1
  ELSE 0 END + CASE WHEN count(*) FILTER (label = '废片') < 5 THEN 1 ELSE 0 END + CASE WHEN count(*) FILTER (label = '可用待修') < 5 THEN 1 ELSE 0 END + 2 + CASE WHEN count(*) < 50 THEN 1
  ELSE 0 END)::INT AS n_warnings FROM samples""")
def trainable(spark, d):
    return preference.trainable(A.documents(spark, d)).select("total", "labels", "can_train", F.size("warnings").alias("n_warnings"))


_LABELS = f"""WITH {A.VECTORS_SQL}, unit AS (SELECT idx, label, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS v, vector FROM vectors),
means AS (SELECT label, list(m ORDER BY pos) AS m FROM (SELECT label, pos, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(64)) AS pos FROM unit) a GROUP BY 1, 2) b GROUP BY 1),
lv AS (SELECT label, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS l FROM means)"""


@query("q_zero_shot_top3", _LABELS + ", z AS (SELECT idx, lv.label, 100 * list_dot_product(v, l) AS z FROM unit, lv), p AS (SELECT idx, label, exp(z - max(z) OVER w) / sum(exp(z)) OVER w * exp(max(z) OVER w) AS p, row_number() OVER (PARTITION BY idx ORDER BY z DESC, label)::INT AS place FROM z WINDOW w AS (PARTITION BY idx)) SELECT idx, place, label, round(p, 6)::DOUBLE AS probability FROM p WHERE place <= 3")
def zero_shot_top3(spark, d):
    v = A.vectors(spark, d)
    return preference.zero_shot(v, preference.label_vectors(v)).select("idx", "place", "label", F.round("probability", 6).alias("probability"))


@query("q_feature_vector", _with("""SELECT idx, round(width / 10000 + height / 10000 + file_size_mb / 100 + ai_confidence + absolute_quality_score / 100 + relative_quality_score / 100 + semantic_score / 100 + final_pick_score / 100 + CASE
  WHEN similar_group_id = '' THEN 0 ELSE 1 END + CASE WHEN best_in_group THEN 1 ELSE 0 END + len(issue_tags) / 20, 6)::DOUBLE AS total, 47 AS dims FROM photos"""))
def feature_vector(spark, d):
    zero = F.lit(0.0)
    p = A.photos(spark, d).withColumns({"subject_area_ratio": zero, "subject_center_score": zero, "edge_cutoff_risk": zero, "detection_confidence": zero, "recommended_keep": F.col("best_in_group"), "recommended_in_group": F.lit(False), "ai_quality_tags": F.col("issue_tags"), "embedding": F.array().cast("array<double>")})
    v = preference.features()
    return p.select("idx", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(v).alias("dims"))


@query("q_aesthetic_tags", f"""SELECT tag, count(*) AS n FROM (SELECT {_list(V.AESTHETIC_TAGS)}[doc_id % 11 + 1] AS tag FROM documents UNION ALL SELECT {_list(V.AESTHETIC_TAGS)}[n_chars % 13 + 1] FROM documents
  WHERE n_chars % 13 < 11 AND n_chars % 13 <> doc_id % 11) t GROUP BY 1""")
def aesthetic_tags(spark, d):
    tag = lambda c: F.get(V.array_of(V.AESTHETIC_TAGS), c.cast("int"))
    docs = A.table(spark, d, "documents").select(F.array_distinct(F.array_compact(F.array(tag(F.col("doc_id") % 11), tag(F.col("n_chars") % 13)))).alias("tags"))
    return catalog.tag_counts(docs)


# -- earlier generations


@query("q_g1_total", _with("""SELECT idx, total, CASE WHEN similar_group_status = 'duplicate' THEN '04_Duplicate_重复' WHEN total >= 90 THEN '01_Strong_Select_强烈推荐' WHEN total >= 75 THEN '02_Deliverable_可交付'
  WHEN total >= 60 THEN '03_Backup_备选' ELSE '05_Reject_废片' END AS category FROM (SELECT *,
  printf('%.2f', relative_quality_score * 0.35e0 + semantic_score * 0.25e0 + portfolio_score * 0.15e0 + commercial_score * 0.10e0
    + CASE WHEN similar_group_status = 'duplicate' THEN 0 ELSE 100 END * 0.15e0)::DOUBLE AS total FROM photos) t"""))
def g1_total(spark, d):
    twin = F.col("similar_group_status") == "duplicate"
    p = A.photos(spark, d).withColumn("total", generations.total_score(F.col("relative_quality_score"), F.col("semantic_score"), F.col("portfolio_score"), F.col("commercial_score"), F.when(twin, 0.0).otherwise(100.0)))
    return p.select("idx", "total", generations.category_from_score(F.col("total"), twin).alias("category"))


@query("q_g1_resolution", _with("""SELECT idx, round(CASE WHEN mp >= 20 THEN 100 WHEN mp >= 12 THEN 85 + (mp - 12) / 8 * 15 WHEN mp >= 6 THEN 65 + (mp - 6) / 6 * 20 WHEN mp >= 2 THEN 40 + (mp - 2) / 4 * 25 ELSE mp / 2 * 40 END,
  6)::DOUBLE AS score FROM (SELECT idx, width * height / 1e6 AS mp FROM photos) t"""))
def g1_resolution(spark, d):
    return A.photos(spark, d).select("idx", F.round(generations.resolution_score(F.col("width"), F.col("height")), 6).alias("score"))


@query("q_g1_pixel_scores", _with("""SELECT idx, round(least(100, ln(1 + lap) / ln(1201) * 100), 6)::DOUBLE AS clarity, round(greatest(0, least(100, 100 - abs(mean - 128) / 128 * 100 - least(60, (dark + bright) * 300))),
  6)::DOUBLE AS exposure, round(greatest(0, least(100, (contrast - 15) / 60 * 100)), 6)::DOUBLE AS contrast FROM photos"""))
def g1_pixel_scores(spark, d):
    c = F.col
    return A.photos(spark, d).select("idx", F.round(generations.clarity_score(c("lap")), 6).alias("clarity"), F.round(generations.exposure_score(c("mean"), c("dark"), c("bright")), 6).alias("exposure"), F.round(generations.contrast_score(c("contrast")), 6).alias("contrast"))


_TAGS2 = """tg AS (SELECT *, list_filter([CASE WHEN lap < 18 THEN '严重模糊' END, CASE WHEN lap < 18 THEN '明确废片' END, CASE WHEN lap >= 18 AND lap < 85 THEN '轻微模糊' END, CASE WHEN lap >= 18
  AND lap < 85 THEN '可用待修' END, CASE WHEN lap >= 85 THEN '清晰' END,
  CASE WHEN mean > 238 OR bright > 0.42e0 THEN '严重过曝' END, CASE WHEN mean > 238 OR bright > 0.42e0 THEN '明确废片' WHEN mean > 198 OR bright > 0.16e0 THEN '轻微过曝' END, CASE WHEN NOT (mean > 238
    OR bright > 0.42e0) AND (mean > 198 OR bright > 0.16e0) THEN '可用待修' END,
  CASE WHEN mean < 28 OR dark > 0.45e0 THEN '严重欠曝' END, CASE WHEN mean < 28 OR dark > 0.45e0 THEN '明确废片' WHEN mean < 62 OR dark > 0.20e0 THEN '轻微欠曝' END, CASE WHEN NOT (mean < 28 OR dark > 0.45e0)
    AND (mean < 62 OR dark > 0.20e0) THEN '可用待修' END,
  CASE WHEN edge >= 0.55e0 THEN '边缘穿帮' END, CASE WHEN edge >= 0.55e0 OR (centre <> 0 AND centre < 0.35e0) THEN '可二次裁切' END, CASE WHEN edge >= 0.55e0 OR (centre <> 0
    AND centre < 0.35e0) THEN '可用待裁切' END, CASE WHEN people > 0 AND eyes < people THEN '疑似闭眼' END,
  CASE WHEN NOT (lap < 18 OR mean > 238 OR bright > 0.42e0 OR mean < 28 OR dark > 0.45e0) THEN CASE WHEN lap >= 85 THEN '推荐保留' ELSE '可用待修' END END], lambda x: x IS NOT NULL) AS raw FROM photos),
tags AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS tags FROM tg)"""


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return A.photos(spark, d).withColumn("tags", generations.quality_tags(c("lap"), c("mean"), c("bright"), c("dark"), c("edge"), c("centre"), c("people"), c("eyes")))


@query("q_g2_quality_tags", _with(f", {_TAGS2} SELECT idx, array_to_string(tags, ',') AS tags FROM tags"))
def g2_quality_tags(spark, d):
    return _tagged(spark, d).select("idx", F.array_join("tags", ",").alias("tags"))


@query("q_g2_absolute_score", _with(f""", {_TAGS2} SELECT idx, round(greatest(0, least(100, 66 + least(22, lap / 900 * 22) + least(8, contrast / 64 * 8) + centre * 6 - CASE WHEN list_contains(tags, '明确废片') THEN 42 ELSE 0 END - CASE
  WHEN list_contains(tags, '可用待修') THEN 10 ELSE 0 END - CASE WHEN list_contains(tags, '可用待裁切') THEN 7 ELSE 0 END + CASE WHEN list_contains(tags, '推荐保留') THEN 6 ELSE 0 END)), 6)::DOUBLE AS score
  FROM tags"""))
def g2_absolute_score(spark, d):
    return _tagged(spark, d).select("idx", F.round(generations.absolute_score(F.col("lap"), F.col("contrast"), F.col("centre"), F.col("tags")), 6).alias("score"))


@query("q_final_pick_score", _with("SELECT idx, round(relative_quality_score * w[1] + semantic_score * w[2] + portfolio_score * w[3] + preference * 100 * w[4], 6)::DOUBLE AS score FROM (SELECT *, CASE strategy " + " ".join(f"WHEN '{s}' THEN {list(w)}" for s, w in V.PICK_WEIGHTS.items()) + f" ELSE {list(V.PICK_WEIGHTS['delivery'])} END::DOUBLE[] AS w FROM photos) t"))
def final_pick_score(spark, d):
    c = F.col
    return A.photos(spark, d).select("idx", F.round(generations.final_pick_score(c("strategy"), c("relative_quality_score"), c("semantic_score"), c("portfolio_score"), c("preference")), 6).alias("score"))


@query("q_combined_confidence", _with("""SELECT idx, round(CASE WHEN s <= 0 AND t <= 0 THEN greatest(0, least(0.96, ai_confidence)) ELSE greatest(0, least(0.98, ai_confidence * 0.35e0 + CASE WHEN s <> 0 THEN s
  ELSE ai_confidence END * 0.45e0 + CASE WHEN t <> 0 THEN t ELSE ai_confidence END * 0.20e0)) END, 6)::DOUBLE AS confidence FROM (SELECT *, (k % 3) / 3e0 AS s, (k % 4) / 4e0 AS t FROM photos) x"""))
def combined_confidence(spark, d):
    k = F.col("k")
    return A.photos(spark, d).select("idx", F.round(generations.combined_confidence(F.col("ai_confidence"), (k % 3) / 3.0, (k % 4) / 4.0), 6).alias("confidence"))


@query("q_people_label", _with("""SELECT idx, CASE WHEN people <= 0 THEN 'none' WHEN people = 1 THEN 'single_person' WHEN people = 2 THEN 'two_people' WHEN people = 3 THEN 'three_people' ELSE 'group_people' END AS people, CASE
  WHEN width > height THEN '横幅' WHEN height > width THEN '竖幅' ELSE '方图' END AS orientation FROM photos"""))
def people_label(spark, d):
    return A.photos(spark, d).select("idx", S.people_label(F.col("people")).alias("people"), S.orientation3(F.col("width"), F.col("height")).alias("orientation"))


def _advised(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _tagged(spark, d).withColumns({"ai_quality_tags": c("tags"), "subject_area_ratio": c("bright"), "subject_center_score": c("centre"), "edge_cutoff_risk": c("edge"), "detected_person_count": c("people"), "detection_confidence": (c("k") % 4) / 4.0, "top3": F.when(c("k") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b"))), "absolute_quality_score": c("lap"), "final_pick_score": c("mean"), "ai_confidence": (c("k") % 4) / 4.0})


_OUTCOME = "CASE WHEN mean >= 78 AND NOT list_contains(tags, '明确废片') THEN 'good' WHEN list_contains(tags, '明确废片') THEN 'reject' WHEN list_contains(tags, '可用待裁切') THEN 'crop' WHEN list_contains(tags, '可用待修') THEN 'retouch' ELSE 'rest' END"


@query("q_g2_suggestions", _with(f", {_TAGS2}, o AS (SELECT *, {_OUTCOME} AS o FROM tags) SELECT idx, CASE ai_primary_category WHEN '婚纱照' THEN '偏婚纱正式照' WHEN '商务会议合影' THEN '偏商业形象照' WHEN '活动纪实' THEN '偏纪实风' WHEN '风景/环境' THEN '偏风景环境' ELSE CASE WHEN ai_primary_category IN ('单人写真', '双人写真', '儿童写真', '中老年写真') AND bright >= 0.18e0 THEN '偏棚拍写真' ELSE '偏生活感' END END AS style_label, " + "CASE " + " ".join(f"WHEN list_contains(tags, '{t}') THEN '{x}'" for t, x in advice.RETOUCH.items()) + f" ELSE '{advice.RETOUCH_NONE}' END AS retouch_suggestion, CASE WHEN list_contains(tags, '可用待裁切') OR edge >= 0.55e0 THEN '{advice.CROP_EDGE}' WHEN centre <> 0 AND centre < 0.45e0 THEN '{advice.CROP_ASIDE}' WHEN ai_primary_category = '风景/环境' THEN '{advice.CROP_WIDE}' ELSE '{advice.CROP_NONE}' END AS crop_suggestion, CASE WHEN ai_primary_category = '相似重复待选' THEN '相似重复待选' ELSE {_case('o', {k: v[2] for k, v in advice.OUTCOMES.items()}, 'NULL')} END AS final_recommendation FROM o"))
def g2_suggestions(spark, d):
    return advice.suggestions(_advised(spark, d)).select("idx", "style_label", "retouch_suggestion", "crop_suggestion", "final_recommendation")


@query("q_g2_reason", _with(f""", {_TAGS2} SELECT idx, printf('绝对质量分 %.1f，最终分 %.1f，', lap, mean) || CASE WHEN list_contains(tags, '明确废片') THEN '存在严重不可修复风险，建议进入“' || cat || '”。' WHEN list_contains(tags,
  '可用待裁切') THEN '主体仍有交付价值，但边缘或构图存在风险，建议可用待裁切 / 人工复核。' WHEN list_contains(tags, '可用待修') THEN '画面存在轻微模糊或曝光问题，但不直接判废，建议可用待修。' ELSE printf('置信度 %.2f，建议分类为“', (k % 4) / 4) || cat || '”。' END || CASE
  WHEN k % 3 <> 0 THEN '；OpenCLIP候选：a，b' ELSE '；语义模型未加载，使用轻量fallback' END || CASE WHEN k % 4 <> 0 THEN printf('；YOLO检测人数 %d，主体面积 %.2f，居中分 %.2f', people, bright, centre)
  ELSE '；检测模型未加载或未检测到可靠人物' END AS reason FROM (SELECT *, CASE WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category WHEN ai_primary_category = '' THEN '人工复核'
  ELSE ai_primary_category END AS cat FROM tags) t"""))
def g2_reason(spark, d):
    return _advised(spark, d).select("idx", advice.ai_reason().alias("reason"))


@query("q_rescored", _with(f""", {_FINAL}, hi AS (SELECT *, CASE WHEN manual_override THEN mp WHEN ai_primary_category <> '' THEN CASE WHEN ai_confidence < 0.8e0 THEN '人工复核'
  WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category ELSE ai_primary_category END ELSE mp END AS f2 FROM finals) SELECT path, fin AS final_before,
  f2 AS final_after FROM hi WHERE f2 <> fin OR ai_primary_category <> ''"""))
def rescored(spark, d):
    return advice.rescored(_final(spark, d), 0.8)


@query("q_list_texts", _with("""SELECT idx, CASE WHEN ai_primary_category = '' THEN '-' ELSE printf('%.2f', ai_confidence) END AS confidence_text, CASE WHEN ai_primary_category = '' THEN ''
  WHEN ai_secondary_category <> '' THEN ai_primary_category || '/' || ai_secondary_category ELSE ai_primary_category END AS category_text, width || ' x ' || height AS resolution_text FROM photos"""))
def list_texts(spark, d):
    return A.photos(spark, d).select("idx", *(c.alias(n) for n, c in advice.shown().items()))


# -- additions over events, with streaming forms


@query("q_events_tumbling", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4)::DOUBLE AS value FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    return decisions.tumbling(A.table(spark, d, "events")).withColumn("value", F.round("value", 4))


@query("q_events_session", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *,
  sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s.n""")
def events_session(spark, d):
    return decisions.sessions(A.table(spark, d, "events"))
