"""Rules of the two earlier pipelines, which use other thresholds and stay apart: weighted totals (first) and tag-based categories (second)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S

# -- first

# Manual names and the folders they stand for.
FIRST_CATEGORIES = {"精修": "01_Strong_Select_强烈推荐", "可交付": "02_Deliverable_可交付", "备选": "03_Backup_备选", "重复": "04_Duplicate_重复", "废片": "05_Reject_废片"}


def effective_category(manual: Column, auto: Column) -> Column:
    return F.coalesce(V.lookup(FIRST_CATEGORIES, F.coalesce(manual, F.lit(""))), auto)


def resolution_text(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit(" x "), height.cast("string"), F.lit(" ("), S.fixed(S.megapixels(width, height), 1), F.lit(" MP)"))



def total_score(clarity: Column, exposure: Column, contrast: Column, resolution: Column, uniqueness: Column) -> Column:
    return S.rounded(clarity * 0.35 + exposure * 0.25 + contrast * 0.15 + resolution * 0.10 + uniqueness * 0.15, 2)


def category_from_score(score: Column, duplicate: Column) -> Column:
    return F.when(duplicate, FIRST_CATEGORIES["重复"]).when(score >= 90, FIRST_CATEGORIES["精修"]).when(score >= 75, FIRST_CATEGORIES["可交付"]).when(score >= 60, FIRST_CATEGORIES["备选"]).otherwise(FIRST_CATEGORIES["废片"])


def resolution_score(width: Column, height: Column) -> Column:
    """Piecewise linear in megapixels, with knots at 2, 6, 12 and 20."""
    mp = S.megapixels(width, height)
    line = lambda lo, hi, a, b: a + (mp - lo) / (hi - lo) * (b - a)
    return F.when(mp >= 20, 100.0).when(mp >= 12, line(12, 20, 85.0, 100.0)).when(mp >= 6, line(6, 12, 65.0, 85.0)).when(mp >= 2, line(2, 6, 40.0, 65.0)).otherwise(F.greatest(F.lit(0.0), mp / 2 * 40.0))


def clarity_score(laplacian: Column) -> Column:
    return S.clamp(F.log1p(laplacian) / F.log1p(F.lit(1200.0)) * 100)


def exposure_score(mean: Column, dark: Column, bright: Column) -> Column:
    return S.clamp(100.0 - F.abs(mean - 128.0) / 128.0 * 100.0 - F.least(F.lit(60.0), (dark + bright) * 300.0))


def contrast_score(std: Column) -> Column:
    return S.clamp((std - 15) / 60 * 100)


def group_score(clarity: Column, exposure: Column, contrast: Column) -> Column:
    return clarity * 0.55 + exposure * 0.30 + contrast * 0.15


def first_analysis(features: DataFrame, duplicate: Column | None = None) -> DataFrame:
    """The first pipeline over pixel features: four scores, total and category; a duplicate loses the share of uniqueness."""
    twin = F.coalesce(duplicate, F.lit(False)) if duplicate is not None else F.lit(False)
    scored = features.withColumns(
        {
            "clarity_score": F.round(clarity_score(F.col("sharpness")), 2), "exposure_score": F.round(exposure_score(F.col("brightness"), F.col("dark_clip"), F.col("bright_clip")), 2),
            "contrast_score": F.round(contrast_score(F.col("contrast")), 2), "resolution_score": F.round(resolution_score(F.col("width"), F.col("height")), 2), "similarity_bonus": F.when(twin, 0.0).otherwise(100.0),
        }
    )
    total = total_score(*(F.col(c) for c in ("clarity_score", "exposure_score", "contrast_score", "resolution_score", "similarity_bonus")))
    return scored.withColumn("total_score", total).withColumns({"auto_category": category_from_score(F.col("total_score"), twin), "orientation": S.orientation3(F.col("width"), F.col("height")), "resolution_text": resolution_text(F.col("width"), F.col("height"))})


# -- second

SEVERE = ["严重模糊", "严重过曝", "严重欠曝"]


def quality_tags(lap: Column, mean: Column, bright: Column, dark: Column, edge: Column, centre: Column, faces: Column, eyes: Column) -> Column:
    """Tags in order of the rules, once each; the last two rules see the earlier ones."""
    blurred = F.when(lap < 18, F.lit(2)).when(lap < 85, 1).otherwise(0)
    over = F.when((mean > 238) | (bright > 0.42), F.lit(2)).when((mean > 198) | (bright > 0.16), 1).otherwise(0)
    under = F.when((mean < 28) | (dark > 0.45), F.lit(2)).when((mean < 62) | (dark > 0.20), 1).otherwise(0)
    off = (centre != 0) & (centre < 0.35)
    severe = (blurred == 2) | (over == 2) | (under == 2)
    return S.keep_if(
        (blurred == 2, "严重模糊"), (blurred == 2, "明确废片"), (blurred == 1, "轻微模糊"), (blurred == 1, "可用待修"), (blurred == 0, "清晰"),
        (over == 2, "严重过曝"), (over == 2, "明确废片"), (over == 1, "轻微过曝"), (over == 1, "可用待修"),
        (under == 2, "严重欠曝"), (under == 2, "明确废片"), (under == 1, "轻微欠曝"), (under == 1, "可用待修"),
        (edge >= 0.55, "边缘穿帮"), ((edge >= 0.55) | off, "可二次裁切"), ((edge >= 0.55) | off, "可用待裁切"),
        ((faces > 0) & (eyes < faces), "疑似闭眼"), (~severe & (blurred == 0), "推荐保留"), (~severe & (blurred != 0), "可用待修"),
    )


def absolute_score(lap: Column, contrast: Column, centre: Column, tags: Column) -> Column:
    has = lambda t: F.array_contains(tags, t)
    score = 66.0 + F.least(F.lit(22.0), F.greatest(F.lit(0.0), lap / 900.0 * 22.0)) + F.least(F.lit(8.0), contrast / 64.0 * 8.0) + centre * 6.0
    return S.clamp(score - F.when(has("明确废片"), 42.0).otherwise(0.0) - F.when(has("可用待修"), 10.0).otherwise(0.0) - F.when(has("可用待裁切"), 7.0).otherwise(0.0) + F.when(has("推荐保留"), 6.0).otherwise(0.0))


def group_quality(pick: Column, absolute: Column, tags: Column) -> Column:
    any_ = lambda *t: F.arrays_overlap(tags, V.array_of(list(t)))
    base = F.coalesce(F.nullif(pick, F.lit(0.0)), absolute)
    return base + F.when(any_("清晰"), 6.0).otherwise(0.0) - F.when(any_("轻微模糊", "严重模糊"), 18.0).otherwise(0.0) - F.when(any_("严重过曝", "严重欠曝"), 14.0).otherwise(0.0)


def final_pick_score(strategy: Column | str, visual: Column, semantic: Column, relative: Column, preference: Column) -> Column:
    """Weighted score of a strategy; unknown strategies take ``delivery``."""
    name = F.lit(strategy) if isinstance(strategy, str) else strategy
    weight = lambda n: F.coalesce(V.lookup({k: w[n] for k, w in V.PICK_WEIGHTS.items()}, name), F.lit(V.PICK_WEIGHTS["delivery"][n]))
    return visual * weight(0) + semantic * weight(1) + relative * weight(2) + preference * 100.0 * weight(3)


def combined_confidence(rule: Column, semantic: Column, detection: Column) -> Column:
    mixed = rule * 0.35 + F.when(semantic != 0, semantic).otherwise(rule) * 0.45 + F.when(detection != 0, detection).otherwise(rule) * 0.20
    return F.when((semantic <= 0) & (detection <= 0), S.clamp(rule, 0.0, 0.96)).otherwise(S.clamp(mixed, 0.0, 0.98))


def appearance_tags(name: Column, people: Column) -> Column:
    own = F.lower(S.stem(name))
    child, elder = S.has_keyword(own, ["child", "kid", "baby", "儿童", "宝宝", "孩子", "亲子"]), S.has_keyword(own, ["elder", "senior", "grand", "老人", "爷爷", "奶奶", "长辈"])
    female = S.has_keyword(own, ["female", "girl", "woman", "lady", "bride", "女生", "女孩", "女士", "新娘", "闺蜜", "姐妹"])
    male = S.has_keyword(own, ["male", "boy", "man", "groom", "男生", "男士", "新郎", "兄弟"])
    tags = S.keep_if((child, "儿童外观"), (~child & elder, "中老年外观"), (~child & ~elder, "年轻成人外观"), (female & male, "混合性别外观"), (female & ~male, "女性外观"), (male & ~female, "男性外观"))
    return F.when(people <= 0, F.array().cast("array<string>")).otherwise(tags)


SEMANTIC_SHOOTING = {"单人写真": "portrait", "双人写真": "portrait", "多人写真": "portrait", "婚纱照": "wedding", "全家福": "family", "亲子照": "parent_child", "商务会议合影": "business", "活动纪实": "event", "儿童写真": "child", "中老年写真": "elderly", "风景/环境": "environment"}


def shooting_type(name: Column, people: Column, appearance: Column, semantic: Column) -> Column:
    own = F.lower(S.stem(name))
    has = lambda *w: S.has_keyword(own, list(w))
    by_name = (
        F.when(has("wedding", "bridal", "bride", "groom", "婚纱", "婚礼", "新娘", "新郎"), "wedding").when(has("family", "全家福", "家庭"), "family")
        .when(has("parent", "亲子", "母子", "母女", "父子", "父女"), "parent_child").when(has("meeting", "conference", "event", "会议", "活动", "纪实"), "event")
        .when(has("business", "company", "team", "商务", "公司", "团队", "合影"), "business")
        .when(has("travel", "outdoor", "park", "beach", "street", "landscape", "外景", "旅行", "旅拍", "户外", "风景"), "outdoor")
        .when(F.array_contains(appearance, "儿童外观"), "child").when(F.array_contains(appearance, "中老年外观"), "elderly").when(people == "none", "environment").otherwise("portrait")
    )
    return F.coalesce(V.lookup(SEMANTIC_SHOOTING, F.coalesce(semantic, F.lit(""))), by_name)


def category(people: Column, shooting: Column, appearance: Column, tags: Column, mean: Column, contrast: Column, semantic_primary: Column, semantic_secondary: Column, semantic_confidence: Column, detection_confidence: Column, persons: Column) -> Column:
    """A struct of primary, secondary and confidence."""
    has = lambda a, t: F.array_contains(a, t)
    sp = F.coalesce(semantic_primary, F.lit(""))
    c = 0.40 + F.when(people != "none", 0.15).otherwise(0.0) + F.when(~shooting.isin("portrait", "environment"), 0.12).otherwise(0.0)
    c = c + F.when(sp != "", F.least(F.lit(0.22), semantic_confidence * 0.28)).otherwise(0.0) + F.when(detection_confidence > 0, F.least(F.lit(0.10), detection_confidence * 0.12)).otherwise(0.0)
    c = c + F.when(has(tags, "清晰"), 0.05).otherwise(0.0) + F.when(has(tags, "推荐保留"), 0.04).otherwise(0.0) + F.when(contrast.between(0.18, 0.42) & mean.between(0.24, 0.80), 0.03).otherwise(0.0)
    c = F.least(c, F.lit(0.97))
    reject = has(tags, "明确废片") & F.arrays_overlap(tags, V.array_of(SEVERE))
    many, female, male = people.isin("three_people", "group_people"), has(appearance, "女性外观"), has(appearance, "男性外观")
    of = lambda p, s, conf=c: F.struct((F.lit(p) if isinstance(p, str) else p).alias("primary"), (F.lit(s) if isinstance(s, str) else s).alias("secondary"), conf.alias("confidence"))
    low = F.least(c, F.lit(0.72))
    ss = F.coalesce(semantic_secondary, F.lit(""))
    pair = F.when(female, "闺蜜姐妹").when(male, "兄弟朋友").otherwise("情侣")
    refined = (
        F.when((sp == "单人写真") & (people == "two_people"), of("双人写真", "情侣")).when((sp == "双人写真") & (people == "single_person"), of("单人写真", F.when(ss.isin("年轻女生", "年轻男生"), ss).otherwise("其他单人")))
        .when((sp == "婚纱照") & (people == "single_person"), of("婚纱照", "单人婚纱")).when((sp == "婚纱照") & (many | (people == "two_people")), of("婚纱照", "双人婚纱"))
        .when((sp == "全家福") & (persons >= 3), of("全家福", "多人家庭")).when((sp == "商务会议合影") & (persons >= 6), of("商务会议合影", "大合影")).when((sp == "双人写真") & (ss == ""), of("双人写真", pair)).otherwise(of(sp, ss))
    )
    by_rule = (
        F.when(shooting == "wedding", of("婚纱照", F.when(people == "single_person", "单人婚纱").otherwise("双人婚纱"))).when(shooting == "family", of("全家福", F.when(many, "多人家庭").otherwise("其他家庭合影")))
        .when(shooting == "parent_child", of("亲子照", "其他亲子")).when(shooting == "business", of("商务会议合影", F.when(people == "group_people", "大合影").otherwise("小组合影"))).when(shooting == "event", of("活动纪实", ""))
        .when(shooting == "child", of("儿童写真", "")).when(shooting == "elderly", of("中老年写真", "")).when((shooting == "environment") | (people == "none"), of("风景/环境", "", low))
        .when((people == "single_person") & female, of("单人写真", "年轻女生")).when((people == "single_person") & male, of("单人写真", "年轻男生")).when(people == "single_person", of("单人写真", "其他单人", low))
        .when(people == "two_people", of("双人写真", pair)).when(many, of("多人写真", F.when(people == "three_people", "小组合影").otherwise("其他多人"))).otherwise(of("人工复核", "", F.least(c, F.lit(0.5))))
    )
    return F.when(reject, of("废片疑似", "", F.greatest(c, F.lit(0.66)))).when((sp != "") & (sp != "废片疑似"), refined).otherwise(by_rule)
