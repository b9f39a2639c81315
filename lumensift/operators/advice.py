"""Texts of the second pipeline: reasons and suggestions, chosen by tags and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from . import review

# Texts that results must equal, by rule.
STYLES = {"婚纱照": "偏婚纱正式照", "商务会议合影": "偏商业形象照", "活动纪实": "偏纪实风", "风景/环境": "偏风景环境"}
PORTRAIT_TYPES = ["单人写真", "双人写真", "儿童写真", "中老年写真"]
STUDIO, LIFE = "偏棚拍写真", "偏生活感"
RETOUCH = {
    "严重过曝": "高光损失较重，建议人工判断是否仍可恢复；可尝试降低高光和压暗背景。",
    "严重欠曝": "暗部损失较重，建议提升人物面部亮度并检查噪点。",
    "可用待修": "建议基础修图：校正曝光、色温和面部亮度，必要时弱化背景杂物。",
}
RETOUCH_NONE = "画面基础质量较稳定，可做常规肤色、对比度和细节微调。"
CROP_EDGE = "边缘存在裁切或穿帮风险，建议二次裁切；优先尝试 4:5 竖版或收紧边缘。"
CROP_ASIDE = "主体偏离中心，建议调整裁切让人物视觉重心更稳定。"
CROP_WIDE = "可尝试 16:9 横版，突出环境层次。"
CROP_NONE = "构图基本成立，保持原比例或按交付尺寸轻微裁切即可。"
#: Outcome: portfolio, delivery, recommendation.
OUTCOMES = {
    "good": ("有进入精选或社交媒体发布候选的潜力，建议复核表情和细节。", "可作为客户交付候选。", "推荐保留"),
    "reject": ("不建议进入作品集。", "交付风险较高，建议人工复核后再决定。", "废片疑似"),
    "crop": ("不建议直接进作品集，但可作为裁切后备选。", "主体仍有交付价值，建议可用待裁切。", "可用待裁切"),
    "retouch": ("需要修图后再判断是否进入作品集。", "可作为可用待修候选。", "可用待修"),
    "rest": ("画面可用，建议结合相似组对比决定是否精选。", "可作为备选交付。", "人工复核"),
}
DUPLICATE_DELIVERY = "同组照片需对比后保留 1-3 张，不建议直接删除。"
# End of fixed values.


def suggestions(photos: DataFrame) -> DataFrame:
    """Adds seven texts. photos has primary, secondary, tags, top3 (arrays of text), person area, centre and edge scores, and final_pick_score."""
    primary, tags, score = F.col("ai_primary_category"), F.col("ai_quality_tags"), F.col("final_pick_score")
    has = lambda t: F.array_contains(tags, t)
    style = F.coalesce(V.lookup(STYLES, primary), F.when(primary.isin(PORTRAIT_TYPES) & (F.col("subject_area_ratio") >= 0.18), STUDIO).otherwise(LIFE))
    retouch = F.coalesce(*(F.when(has(t), text) for t, text in RETOUCH.items()), F.lit(RETOUCH_NONE))
    centre = F.col("subject_center_score")
    crop = F.when(has("可用待裁切") | (F.col("edge_cutoff_risk") >= 0.55), CROP_EDGE).when((centre != 0) & (centre < 0.45), CROP_ASIDE).when(primary == "风景/环境", CROP_WIDE).otherwise(CROP_NONE)
    outcome = F.when((score >= 78) & ~has("明确废片"), "good").when(has("明确废片"), "reject").when(has("可用待裁切"), "crop").when(has("可用待修"), "retouch").otherwise("rest")
    text = lambda n: V.lookup({k: v[n] for k, v in OUTCOMES.items()}, F.col("outcome_"))
    twin = primary == V.PRIMARY_DUPLICATE
    said = photos.withColumn("outcome_", outcome).withColumns(
        {
            "style_label": style, "retouch_suggestion": retouch, "crop_suggestion": crop, "portfolio_suggestion": text(0),
            "delivery_suggestion": F.when(twin, DUPLICATE_DELIVERY).otherwise(text(1)), "final_recommendation": F.when(twin, V.PRIMARY_DUPLICATE).otherwise(text(2)),
        }
    )
    head = F.concat(F.lit("建议："), F.col("final_recommendation"), F.lit("。分类倾向为“"), review.category_path(primary, F.col("ai_secondary_category")), F.lit("”，最终分 "), F.format_string("%.1f", score), F.lit("。"))
    top = F.when(F.size("top3") > 0, F.concat(F.lit(" 语义候选："), F.array_join(F.slice("top3", 1, 3), ", "), F.lit("。"))).otherwise("")
    return said.withColumn("screening_reason", F.concat(head, top)).drop("outcome_")


def ai_reason() -> Column:
    """Why a category is proposed, by the worst tag, with what the semantic model and the detector saw."""
    tags = F.col("ai_quality_tags")
    has = lambda t: F.array_contains(tags, t)
    where = review.category_path(F.col("ai_primary_category"), F.col("ai_secondary_category"))
    scores = F.format_string("绝对质量分 %.1f，最终分 %.1f，", F.col("absolute_quality_score"), F.col("final_pick_score"))
    semantic = F.when(F.size("top3") > 0, F.concat(F.lit("；OpenCLIP候选："), F.array_join("top3", "，"))).otherwise("；语义模型未加载，使用轻量fallback")
    seen = F.format_string("；YOLO检测人数 %d，主体面积 %.2f，居中分 %.2f", F.col("detected_person_count"), F.col("subject_area_ratio"), F.col("subject_center_score"))
    detected = F.when(F.col("detection_confidence") != 0, seen).otherwise("；检测模型未加载或未检测到可靠人物")
    middle = (
        F.when(has("明确废片"), F.concat(F.lit("存在严重不可修复风险，建议进入“"), where, F.lit("”。"))).when(has("可用待裁切"), "主体仍有交付价值，但边缘或构图存在风险，建议可用待裁切 / 人工复核。")
        .when(has("可用待修"), "画面存在轻微模糊或曝光问题，但不直接判废，建议可用待修。").otherwise(F.concat(F.format_string("置信度 %.2f，建议分类为“", F.col("ai_confidence")), where, F.lit("”。")))
    )
    return F.concat(scores, middle, semantic, detected)


def apply_results(photos: DataFrame, results: DataFrame, threshold: float = review.THRESHOLD) -> DataFrame:
    """Takes over every result column that the catalog has (by path; unmatched results are dropped), and makes final categories anew."""
    own = [c for c in results.columns if c != "path" and c in photos.columns]
    new = results.select("path", F.lit(True).alias("found_"), *(F.col(c).alias(f"new_{c}") for c in own))
    out = photos.join(new, "path", "left").withColumns({c: F.when(F.col("found_"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in own})
    if "screening_reason" in photos.columns and "ai_reason" in own:
        out = out.withColumn("screening_reason", F.when(F.col("found_"), S.filled(F.col("screening_reason"), F.col("ai_reason"))).otherwise(F.col("screening_reason")))
    return out.withColumn("final_category", F.when(F.col("found_"), review.final_category(threshold)).otherwise(F.col("final_category"))).select(*photos.columns)


def rescored(photos: DataFrame, threshold: float) -> DataFrame:
    """path, and final category before and after, of rows that a new threshold changes or that have a machine result."""
    now = photos.withColumn("final_after", review.final_category(threshold))
    return now.where((F.col("final_after") != F.col("final_category")) | ~S.blank(F.col("ai_primary_category"))).select("path", F.col("final_category").alias("final_before"), "final_after")


def shown() -> dict[str, Column]:
    """confidence_text, category_text and resolution_text for lists."""
    some = ~S.blank(F.col("ai_primary_category"))
    return {
        "confidence_text": F.when(some, F.format_string("%.2f", F.col("ai_confidence"))).otherwise("-"),
        "category_text": F.when(some, review.category_path(F.col("ai_primary_category"), F.col("ai_secondary_category"))).otherwise(""),
        "resolution_text": F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string")),
    }
