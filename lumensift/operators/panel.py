"""What a reviewer looks at: groups and their members, selections and samples, batches, and the texts of a photo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import written
from ..functions.ranks import numbered, placed
from . import generations, graph, review, similarity

# -- groups


def panel_order() -> list[Column]:
    """The order of a group's members: by rank, with none last, then file name, then input order."""
    return [F.coalesce(F.nullif(F.col("similar_group_rank"), F.lit(0)), F.lit(999)), F.col("filename"), F.col("idx")]


def members(photos: DataFrame, group_id: str) -> DataFrame:
    """The members of a group in panel order; none for a blank id."""
    return photos.where((F.col("similar_group_id") == group_id) & F.lit(group_id != "")).orderBy(*panel_order())


def by_path(photos: DataFrame, path: str) -> DataFrame:
    return photos.where(F.col("path") == path).limit(1)


def drilled(photos: DataFrame, path: str) -> DataFrame:
    """All members of the group of the photo at a path."""
    own = by_path(photos, path).where(~S.blank(F.col("similar_group_id"))).select("similar_group_id")
    return photos.join(F.broadcast(own), "similar_group_id", "left_semi")  # one row


def grouped(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """photos that are in a pair (i, j), with root and group_no, which counts groups by their first member."""
    roots = graph.components(pairs.select(F.col("i").alias("u"), F.col("j").alias("v"))).withColumnRenamed("v", "idx")
    numbers = numbered(roots.select("root").distinct(), "root", "group_no")
    return photos.join(roots, "idx").join(numbers, "root")


def first_groups(photos: DataFrame, pairs: DataFrame) -> DataFrame:
    """The first pipeline's groups: idx, similar_group_id (from 1, NULL alone), recommended_in_group and is_duplicate.

    The best of a group has the highest score (photos have clarity, exposure and contrast); of equal ones, the first.
    """
    scored = grouped(photos, pairs).withColumn("score_", generations.group_score(F.col("clarity"), F.col("exposure"), F.col("contrast")))
    best = scored.groupBy("root").agg(F.max(F.struct("score_", -F.col("idx"))).alias("best_"))
    found = scored.join(best, "root").select("idx", F.col("group_no").cast("int").alias("similar_group_id"), (-F.col("best_.col2") == F.col("idx")).alias("best_"))
    out = photos.select("idx").join(found, "idx", "left")
    is_best = F.coalesce("best_", F.lit(True))
    return out.select("idx", "similar_group_id", is_best.alias("recommended_in_group"), (~is_best).alias("is_duplicate"))


def second_groups(photos: DataFrame, pairs: DataFrame, strategy: str = "delivery", least: int = 1, most: int = 3) -> DataFrame:
    """The second pipeline's groups: ids of three digits, ranks by tag-adjusted score, and what the ranks decide. Photos in no group are left out."""
    quality = generations.group_quality(F.col("final_pick_score"), F.col("absolute_quality_score"), F.col("ai_quality_tags"))
    members = written(grouped(photos, pairs).withColumn("q_", quality))
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("group_size"))
    ranked = similarity.ranked_members(members, "q_", "group_rank").join(sizes, "root")
    keep = F.col("group_rank") <= min(most, max(least, 1))
    relative = F.round((F.col("group_size") - F.col("group_rank") + 1) / F.col("group_size") * 100, 2)
    pick = generations.final_pick_score(strategy, F.col("absolute_quality_score"), F.col("semantic_score"), relative, F.lit(0.0))
    place = F.concat(F.col("group_rank").cast("string"), F.lit("/"), F.col("group_size").cast("string"))
    group_id = F.format_string("%03d", F.col("group_no"))
    kept_text = F.concat(F.lit("相似组 "), group_id, F.lit("，共 "), F.col("group_size").cast("string"), F.lit(" 张，本图排名 "), place, F.lit("。清晰度、语义匹配和主体完整性在本组较好，建议保留复核。"))
    other_text = F.concat(F.lit("与同组照片高度相似，当前排名 "), place, F.lit("，建议作为相似重复待选，不自动删除。"))
    return ranked.select(
        "idx", group_id.alias("similar_group_id"), "group_size", "group_rank", relative.alias("relative_quality_score"), F.round(pick, 2).alias("final_pick_score"), keep.alias("recommended_keep"),
        F.when(keep, F.col("ai_primary_category")).otherwise(V.PRIMARY_DUPLICATE).alias("ai_primary_category"), F.when(keep, F.col("ai_secondary_category")).otherwise("").alias("ai_secondary_category"),
        F.when(keep, F.col("ai_confidence")).otherwise(F.greatest("ai_confidence", F.lit(0.82))).alias("ai_confidence"),
        S.append_once(F.col("ai_quality_tags"), F.when(keep, "推荐保留").otherwise("重复")).alias("ai_quality_tags"),
        F.when(keep, kept_text).otherwise(other_text).alias("ai_reason"), F.when(keep, "相似组推荐保留").otherwise("相似重复待选").alias("final_recommendation"),
    )


# -- selections, samples and batches


def sample(photos: DataFrame, selected: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """The first photos of the selection (column idx), or of all where nothing is selected: a sample of a stated size."""
    chosen = photos.join(selected.select("idx").distinct(), "idx", "left_semi").orderBy("idx").limit(limit) if selected is not None else None
    if chosen is not None and chosen.limit(1).count():
        return chosen
    return photos.orderBy("idx").limit(limit)


def compared(photos: DataFrame, selected: DataFrame, most: int = 4) -> DataFrame:
    """The photos of a comparison, at most as many as tiles."""
    return photos.join(selected.select("idx").distinct(), "idx", "left_semi").orderBy("idx").limit(most)


def marked_targets(view: str, grid: list[int], listed: list[int], focus: int, current: int) -> list[int]:
    """Which photos a mark goes to: the selection of the grid, several selected in the list (but in the comparison), or the focused or current one."""
    if view == "grid" and grid:
        return grid
    if len(listed) > 1 and view != "compare":
        return listed
    return [focus if focus >= 0 else current]


def batches(photos: DataFrame, size: int) -> DataFrame:
    """Adds batch, from 0, of size photos each in input order; no photo waits for another, as the numbers come from counts of ranges."""
    return placed(photos, [F.col("idx")], "place_").withColumn("batch", F.floor((F.col("place_") - 1) / size).cast("long")).drop("place_")


def zipped(left: DataFrame, right: DataFrame, key: str = "idx") -> DataFrame:
    """Rows of two tables side by side, by their places in the order of key, as far as the shorter goes."""
    a, b = placed(left, [F.col(key)], "place_"), placed(right.select(*(F.col(c).alias(f"right_{c}") for c in right.columns)), [F.col(f"right_{key}")], "place_")
    return a.join(b, "place_").drop("place_")


def faces_by_area(boxes: Column, most: int | None = None) -> Column:
    """Boxes (x, y, w, h), largest first, equal ones in their order; the first is the main face."""
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b, n: F.struct((-(b["w"] * b["h"])).alias("a"), n.alias("n"), b.alias("b")))), lambda x: x["b"])
    return ordered if most is None else F.slice(ordered, 1, most)


# -- texts


def analysis_key() -> Column:
    return S.filled(F.col("final_recommendation"), review.export_category(), F.col("final_category"), "未分类")


def analysis_counts(photos: DataFrame) -> DataFrame:
    return photos.groupBy(analysis_key().alias("value")).agg(F.count(F.lit(1)).alias("n"))


def table_order(counted: DataFrame) -> DataFrame:
    """Counts in the order of a report's table: most first, then by name."""
    return placed(counted, [F.desc("n"), F.col("value")], "place")


def preview_text() -> Column:
    """One line about a photo."""
    return F.concat_ws(
        " | ", "filename", review.type_text(), F.coalesce(V.lookup({k: f"{k}：{v}" for k, v in V.RATINGS.items()}, F.coalesce("quality_rating", F.lit(""))), F.lit("-")), S.filled(S.joined(F.col("delivery_use")), "-"), S.filled(F.col("review_status"), V.UNREVIEWED)
    )


def tile_text() -> Column:
    """Four facts in three lines under a compared photo."""
    some = ~S.blank(F.col("ai_primary_category"))
    path = F.when(some, review.category_path(F.col("ai_primary_category"), F.col("ai_secondary_category"))).otherwise("-")
    sure = F.when(some, F.format_string("%.2f", "ai_confidence")).otherwise("-")
    size = F.concat(F.col("width").cast("string"), F.lit(" x "), F.col("height").cast("string"), F.lit(" · "), F.format_string("%.2f MB", "file_size_mb"))
    third = F.concat(F.lit("手动："), "manual_category", F.lit("｜AI："), path, F.lit("｜置信度："), sure)
    fourth = F.concat(F.lit("相似组："), S.filled(F.col("similar_group_id"), "-"), F.lit("｜质量："), S.filled(F.array_join("ai_quality_tags", ", "), "-"))
    return F.concat_ws("\n", "filename", size, third, fourth)


# Shown names of group statuses.
STATUS_NAMES = {"best": "组内最佳", "backup": "组内备选", "duplicate": "重复淘汰", "review": "待复核", "rejected": "组内淘汰"}


def details() -> dict[str, Column]:
    """The texts of the detail panel. What comes from a suggestion is shown only while that is current (column ai_suggestion)."""
    current = review.suggestion_status(F.col("ai_suggestion"), F.col("path")) == "current"
    c, dash = F.col, F.lit("-")
    text = lambda *names: S.filled(*(F.coalesce(c(n), F.lit("")) for n in names), "-")
    gated = lambda x: F.when(F.coalesce(current, F.lit(False)), x).otherwise(dash)
    number = lambda name, form: F.when(F.coalesce(c(name), F.lit(0.0)) != 0, F.format_string(form, c(name))).otherwise(dash)
    yes = lambda x: F.when(F.coalesce(x, F.lit(False)), "是").otherwise("否")
    some = ~S.blank(c("ai_primary_category"))
    status = F.coalesce(V.lookup(STATUS_NAMES, F.coalesce("similar_group_status", F.lit(""))), S.filled(c("similar_group_status"), "-"))
    group = F.concat("similar_group_id", F.lit("（本组共 "), c("similar_group_size").cast("string"), F.lit(" 张，状态："), status, F.lit("，AI推荐："), yes(c("ai_recommended_best")), F.lit("）"))
    people = F.coalesce(F.nullif("detected_person_count", F.lit(0)), F.nullif("people_count", F.lit(0))).cast("string")
    whole = (c("subject_area_ratio") != 0) | (c("subject_center_score") != 0) | (c("edge_cutoff_risk") != 0)
    parts = F.format_string("主体面积：%.2f · 居中：%.2f · 边缘风险：%.2f", "subject_area_ratio", "subject_center_score", "edge_cutoff_risk")
    history = F.format_string("喜欢 %.2f / 不喜欢 %.2f / 参考 %d 张", "aesthetic_like_similarity", "aesthetic_dislike_similarity", "similar_reference_count")
    known = (c("similar_reference_count") != 0) | (c("aesthetic_like_similarity") != 0) | (c("aesthetic_dislike_similarity") != 0)
    semantic = F.format_string("%.1f / 置信度 %.2f", "semantic_score", "semantic_confidence")
    return {
        "ai_path": gated(F.when(some, review.category_path(c("ai_primary_category"), c("ai_secondary_category"))).otherwise(dash)), "primary": gated(text("ai_primary_category")), "secondary": gated(text("ai_secondary_category")),
        "quality": gated(S.filled(F.array_join("ai_quality_tags", ", "), "-")), "confidence": gated(F.when(some, F.format_string("%.2f", "ai_confidence")).otherwise(dash)), "source": gated(text("ai_source")), "top3": gated(S.filled(F.array_join("top3_semantic_matches", ", "), "-")),
        "semantic_score": gated(F.when((c("semantic_score") != 0) | (c("semantic_confidence") != 0), semantic).otherwise(dash)), "final_pick_score": gated(number("final_pick_score", "%.1f")), "detected_people": gated(F.coalesce(people, dash)),
        "detection": gated(number("detection_confidence", "%.2f")), "subject": gated(F.when(whole, parts).otherwise(dash)), "retouchable": gated(F.when(~S.blank(c("retouch_suggestion")), "是").otherwise(dash)), "croppable": gated(F.when(~S.blank(c("crop_suggestion")), "是").otherwise(dash)),
        "similar": F.when(S.blank(c("similar_group_id")), dash).otherwise(group), "absolute_score": number("absolute_quality_score", "%.1f"), "relative_score": number("relative_quality_score", "%.1f"),
        "group_rank": F.when((c("group_rank") != 0) & (c("group_size") != 0), F.concat_ws("/", c("group_rank").cast("string"), c("group_size").cast("string"))).otherwise(dash), "recommended": yes(c("recommended_keep") | c("recommended_in_group")),
        "ai_reason": gated(text("ai_reason")), "preference_score": number("user_preference_score", "%.2f"), "preference_reason": text("preference_reason", "user_preference_reason"), "final_reason": gated(text("final_reason", "ai_reason")),
        "screening_reason": gated(text("screening_reason", "final_reason", "ai_reason")), "style_label": gated(text("style_label")), "retouch_suggestion": gated(text("retouch_suggestion")), "crop_suggestion": gated(text("crop_suggestion")),
        "portfolio_suggestion": gated(text("portfolio_suggestion")), "delivery_suggestion": gated(text("delivery_suggestion")), "final_recommendation": gated(S.filled(c("final_recommendation"), review.export_category())), "history": F.when(known, history).otherwise(dash),
    }


def noted(photos: DataFrame, notes: DataFrame) -> DataFrame:
    """Takes over edited notes (path, note) as user_note; a review note that is blank becomes it too."""
    both = photos.join(notes.select("path", F.col("note").alias("note_")), "path", "left")
    given = F.col("note_").isNotNull()
    note = F.when(given, F.col("note_")).otherwise(F.col("user_note"))
    return both.withColumns({"user_note": note, "review_note": F.when(given, S.filled(F.col("review_note"), F.col("note_"))).otherwise(F.col("review_note"))}).select(*photos.columns)


REVIEW_FIELDS = ("photo_type", "subtype", "quality_rating", "delivery_use", "issue_tags", "commercial_score", "portfolio_score", "review_note")


def review_data(status: str = V.CONFIRMED) -> dict[str, Column]:
    """The fields of a review with their decision as JSON; without a type there is no subtype."""
    kind = F.trim(F.coalesce("photo_type", F.lit("")))
    own = {c: F.col(c) for c in REVIEW_FIELDS} | {"photo_type": kind, "subtype": F.when(kind == "", "").otherwise(F.trim(F.coalesce("subtype", F.lit("")))), "review_status": F.lit(status)}
    return own | {"human_decision": F.to_json(F.struct(*(x.alias(n) for n, x in own.items())))}
