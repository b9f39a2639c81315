"""Category, review and suggestion rules over catalog columns; human decisions outrank machine results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.ranks import placed

THRESHOLD = 0.65


def manual_path(category: Column) -> Column:
    """Legacy names become current ones; unknown and blank ones the default."""
    now = V.lookup(V.LEGACY_MANUAL, category)
    name = F.coalesce(now, category)
    return F.when(name.isin(V.MANUAL_CATEGORIES), name).otherwise(V.DEFAULT_MANUAL)


def category_path(primary: Column, secondary: Column) -> Column:
    return F.when(~S.blank(secondary), F.concat_ws("/", primary, secondary)).otherwise(S.filled(primary, V.PRIMARY_REVIEW))


def split_category(value: Column) -> Column:
    parts = F.filter(F.split(F.coalesce(value, F.lit("")), "/"), lambda x: x != "")
    return F.struct(F.coalesce(F.get(parts, F.lit(0)), F.lit(V.PRIMARY_REVIEW)).alias("primary"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("secondary"))


def final_category(threshold: float = THRESHOLD) -> Column:
    manual = manual_path(F.col("manual_category"))
    own = F.when(F.col("ai_confidence") < threshold, V.PRIMARY_REVIEW).otherwise(category_path(F.col("ai_primary_category"), F.col("ai_secondary_category")))
    return F.when(F.col("manual_override"), manual).when(~S.blank(F.col("ai_primary_category")), own).otherwise(manual)


def export_category(threshold: float = THRESHOLD) -> Column:
    return S.filled(F.col("final_category"), final_category(threshold))


def named_filter(name: str) -> Column:
    """The predicate of a list filter by its name."""
    manual, primary, final = F.col("manual_category"), F.coalesce(F.col("ai_primary_category"), F.lit("")), F.coalesce(F.col("final_category"), F.lit(""))
    grouped = ~S.blank(F.col("similar_group_id"))
    special = {
        "全部": F.lit(True),
        "重复": (manual == "重复") | grouped,
        "人工复核": F.startswith(final, F.lit(V.PRIMARY_REVIEW)) | (primary == V.PRIMARY_REVIEW),
        "AI低置信度": (primary != "") & (F.col("ai_confidence") < 0.65),
        V.PRIMARY_DUPLICATE: (primary == V.PRIMARY_DUPLICATE) | grouped,
        "多人写真": primary == "多人写真",
    }
    if name in special:
        return special[name]
    if name in V.MANUAL_CATEGORIES:
        return manual == name
    return (primary == name) | F.startswith(final, F.lit(name))


FILTERS = ["全部", *V.MANUAL_CATEGORIES, "AI低置信度", *[c for c in V.PRIMARY_CATEGORIES if c != "人工复核"]]


def sort_keys(name: str) -> list[Column]:
    """Keys of a named sort, with the input order last, since sorts are stable."""
    file = F.col("filename")
    keys = {
        "拍摄时间": [S.filled(F.col("taken_at"), file)],
        "AI分类": [F.col("ai_primary_category"), F.col("ai_secondary_category"), file],
        "手动分类": [F.col("manual_category"), file],
        "置信度": [-F.col("ai_confidence"), file],
        "相似组": [S.filled(F.col("similar_group_id"), "999"), file],
    }.get(name, [F.lower(file)])
    return [*keys, F.col("idx")]


SORTS = ["文件名", "拍摄时间", "AI分类", "手动分类", "置信度", "相似组"]


def view(photos: DataFrame, filter_name: str, sort_name: str) -> DataFrame:
    return photos.where(named_filter(filter_name)).orderBy(*sort_keys(sort_name))


def placed_view(photos: DataFrame, filter_name: str, sort_name: str) -> DataFrame:
    """Every photo of a filtered view with its place (from 1) in a sort."""
    return placed(photos.where(named_filter(filter_name)), sort_keys(sort_name), "place")


# -- suggestions

SUGGESTION = "struct<version:string,image_path:string,decision:struct<photo_type:string,subtype:string,quality_rating:string,commercial_score:double,portfolio_score:double,delivery_use:array<string>,issue_tags:array<string>,confidence:double,reason:string>>"


def _plain_path(path: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(path, r"^file:/*", "/"), r"[\\/]+", "/"))


def suggestion_status(text: Column, path: Column | None = None) -> Column:
    """missing, invalid, stale, mismatch, legacy or current, by the first rule that holds."""
    object_ = F.from_json(F.when(F.trim(text).rlike(r"^\{"), text), "map<string,string>")
    bad = object_.isNull() | (F.size(object_) <= 0)
    own = F.coalesce(F.try_element_at(object_, F.lit("image_path")), F.lit(""))
    version = F.coalesce(F.try_element_at(object_, F.lit("version")), F.lit(""))
    out = F.when(S.blank(text), "missing").when(F.coalesce(bad, F.lit(True)), "invalid")
    if path is not None:
        out = out.when(own == "", "stale").when(_plain_path(own) != _plain_path(path), "mismatch")
    return out.when(version == "", "legacy").when(version != V.SUGGESTION_VERSION, "stale").otherwise("current")


#: What a suggestion left on a row, and what it is without one. Human fields aren't among them.
SUGGESTED = {"ai_suggestion": "", "ai_primary_category": "", "ai_secondary_category": "", "ai_quality_tags": [], "ai_confidence": 0.0, "ai_source": "", "ai_reason": ""}


def clear_stale(photos: DataFrame) -> DataFrame:
    """Empties what suggestions left that are invalid, legacy, stale or of another photo."""
    stale = suggestion_status(F.col("ai_suggestion"), F.col("path")).isin("invalid", "legacy", "stale", "mismatch")
    plain = lambda v: F.array().cast("array<string>") if v == [] else F.lit(v)
    marked = photos.withColumn("stale_", stale)
    return marked.withColumns({c: F.when(F.col("stale_"), plain(v)).otherwise(F.col(c)) for c, v in SUGGESTED.items() if c in photos.columns}).drop("stale_")


#: Columns of a decision that a row takes over, and the columns that repeat them.
APPLIED = ("photo_type", "subtype", "quality_rating", "commercial_score", "portfolio_score", "delivery_use", "issue_tags")
REPEATED = {"ai_primary_category": "photo_type", "ai_secondary_category": "subtype", "ai_confidence": "confidence", "ai_quality_tags": "issue_tags", "ai_reason": "reason", "screening_reason": "reason", "final_reason": "reason", "final_recommendation": "quality_rating"}


def apply_analysis(photos: DataFrame, analyses: DataFrame) -> DataFrame:
    """Left-joins new results (path, ai_suggestion, and a decision's columns with confidence and reason); a confirmed row takes the suggestion alone."""
    new = analyses.select("path", F.lit(True).alias("found_"), *(F.col(c).alias(f"new_{c}") for c in ("ai_suggestion", *APPLIED, "confidence", "reason")))
    both = photos.join(new, "path", "left")
    free = F.col("found_") & (F.coalesce(F.col("review_status"), F.lit("")) != V.CONFIRMED)
    changed = {c: F.when(free, F.col(f"new_{c}")).otherwise(F.col(c)) for c in APPLIED}
    changed |= {c: F.when(free, F.col(f"new_{of}")).otherwise(F.col(c)) for c, of in REPEATED.items() if c in photos.columns}
    changed["ai_suggestion"] = F.when(F.col("found_"), F.col("new_ai_suggestion")).otherwise(F.col("ai_suggestion"))
    changed["review_status"] = F.when(free, V.AI_REVIEWED).otherwise(F.col("review_status"))
    return both.withColumns(changed).select(*photos.columns)


def summary_text(payload: Column) -> Column:
    """The decision of a payload (SUGGESTION text) in lines; ``未分析`` without one."""
    d = F.from_json(payload, SUGGESTION)["decision"]
    shown = lambda c: F.when(c.isNull() | (c.cast("string") == "") | (c.cast("string") == "0.0"), "-").otherwise(c.cast("string"))
    listed = lambda c, by: F.coalesce(F.nullif(F.array_join(c, by), F.lit("")), F.lit("-"))
    lines = [("品质等级：", shown(d["quality_rating"])), ("商业交付：", shown(d["commercial_score"])), ("作品集价值：", shown(d["portfolio_score"])), ("建议用途：", listed(d["delivery_use"], " / ")), ("风险：", listed(d["issue_tags"], "、")), ("原因：", shown(d["reason"]))]
    return F.when(d.isNull(), "未分析").otherwise(F.concat_ws("\n", *(F.concat(F.lit(head), c) for head, c in lines)))


# -- human review


def review_errors(photo_type: Column, subtype: Column, rating: Column, uses: Column, tags: Column) -> Column:
    """Messages for values that aren't in the vocabulary; blank ones are no error."""
    none = F.array().cast("array<string>")
    subtypes = F.coalesce(*(F.when(photo_type == t, V.array_of(s)) for t, s in V.SUBTYPES.items()), V.array_of([V.DEFAULT_SUBTYPE]))
    bad_uses = F.array_except(F.coalesce(uses, none), V.array_of(V.DELIVERY_USES))
    bad_tags = F.array_except(F.coalesce(tags, none), V.array_of(V.ISSUE_TAGS))
    one = [
        F.when(~S.blank(photo_type) & ~photo_type.isin(V.PHOTO_TYPES), F.concat(F.lit("照片类型不合法："), photo_type)),
        F.when(~S.blank(subtype) & ~F.array_contains(subtypes, subtype), F.concat(F.lit("细分类别不合法："), subtype)),
        F.when(~S.blank(rating) & ~rating.isin(list(V.RATINGS)), F.concat(F.lit("品质等级不合法："), rating)),
    ]
    return F.array_compact(F.concat(F.array(*one), F.transform(bad_uses, lambda u: F.concat(F.lit("交付用途不合法："), u)), F.transform(bad_tags, lambda t: F.concat(F.lit("问题标签不合法："), t))))


def reject_is_not_exported(photos: DataFrame) -> DataFrame:
    return photos.withColumn("delivery_use", F.when(F.col("quality_rating") == "X", S.append_once(F.col("delivery_use"), V.NO_EXPORT)).otherwise(F.col("delivery_use")))


def mark(photos: DataFrame, marks: DataFrame, when_: Column | None = None) -> DataFrame:
    """Sets the manual category of the paths in marks (path, category): override, label and time follow, and the final category is made anew."""
    at = when_ if when_ is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    both = photos.join(marks.select("path", F.col("category").alias("mark_")), "path", "left")
    given = F.col("mark_").isNotNull()
    out = both.withColumns({"manual_category": F.when(given, F.col("mark_")).otherwise(F.col("manual_category")), "manual_override": given | F.col("manual_override"), "user_label": F.when(given, F.col("mark_")).otherwise(F.col("user_label")), "user_label_time": F.when(given, at).otherwise(F.col("user_label_time"))})
    return out.withColumn("final_category", F.when(given, final_category()).otherwise(F.col("final_category"))).select(*photos.columns)


#: What a mark makes of the review fields: rating (always, or if blank), use to add, tag to add, and status.
MARKED = {
    "精修候选": ("S", True, "精修候选", None, V.CONFIRMED), "可交付": ("A", True, "客户可选", None, V.CONFIRMED), "备选": ("B", False, None, None, V.NEEDS_REVIEW), "重复": (None, False, None, "重复照片", V.NEEDS_REVIEW),
    "废片": ("X", True, V.NO_EXPORT, None, V.CONFIRMED), "作品集候选": ("S", False, "作品集候选", None, V.CONFIRMED), "练习片": ("C", False, "修图练习", None, V.CONFIRMED),
}


def review_of_mark(photos: DataFrame, category: Column) -> DataFrame:
    """The review fields that a mark of each row implies (NULL: no mark); other categories only confirm."""
    rating, uses, tags, status = F.col("quality_rating"), F.col("delivery_use"), F.col("issue_tags"), F.when(category.isNotNull(), V.CONFIRMED).otherwise(F.col("review_status"))
    for name, (code, always, use, tag, state) in MARKED.items():
        own = F.coalesce(category == name, F.lit(False))
        if code:
            rating = F.when(own if always else own & S.blank(F.col("quality_rating")), code).otherwise(rating)
        if use:
            uses = F.when(own, S.append_once(F.col("delivery_use"), use)).otherwise(uses)
        if tag:
            tags = F.when(own, S.append_once(F.col("issue_tags"), tag)).otherwise(tags)
        status = F.when(own, state).otherwise(status)
    return photos.withColumns({"quality_rating": rating, "delivery_use": uses, "issue_tags": tags, "review_status": status})


REVIEWED = ("photo_type", "subtype", "quality_rating", "delivery_use", "issue_tags", "commercial_score", "portfolio_score", "review_note", "review_status")


def write_reviews(photos: DataFrame, reviews: DataFrame) -> DataFrame:
    """Takes over human reviews (path and REVIEWED) without errors, with the decision as JSON; the rest stays."""
    faults = review_errors(F.col("photo_type"), F.col("subtype"), F.col("quality_rating"), F.col("delivery_use"), F.col("issue_tags"))
    good = reviews.where(F.size(faults) == 0).select("path", F.lit(True).alias("found_"), F.to_json(F.struct(*REVIEWED)).alias("decision_"), *(F.col(c).alias(f"new_{c}") for c in REVIEWED))
    both = photos.join(good, "path", "left")
    found = F.coalesce(F.col("found_"), F.lit(False))
    return both.withColumns({c: F.when(found, F.col(f"new_{c}")).otherwise(F.col(c)) for c in REVIEWED} | {"human_decision": F.when(found, F.col("decision_")).otherwise(F.col("human_decision"))}).select(*photos.columns)


def reset_reviews(photos: DataFrame, paths: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    blank = paths.select("path").distinct().select("path", *(F.lit("").alias(c) for c in ("photo_type", "subtype", "quality_rating", "review_note")), none.alias("delivery_use"), none.alias("issue_tags"), F.lit(0.0).alias("commercial_score"), F.lit(0.0).alias("portfolio_score"), F.lit(V.UNREVIEWED).alias("review_status"))
    out = write_reviews(photos, blank)
    return out.join(paths.select("path", F.lit(True).alias("reset_")).distinct(), "path", "left").withColumn("human_decision", F.when(F.col("reset_"), "").otherwise(F.col("human_decision"))).select(*photos.columns)


BADGES = {"精修候选": "精修", "可交付": "交付", "重复": "重复", "废片": "废片", "作品集候选": "作品", "练习片": "练习"}


def badge() -> Column:
    own, status = V.lookup(BADGES, F.coalesce(F.col("manual_category"), F.lit(""))), F.coalesce(F.col("similar_group_status"), F.lit(""))
    rest = F.when((status == "best") | F.coalesce(F.col("best_in_group"), F.lit(False)), "最佳").when(status == "duplicate", "重复").when((status == "review") | F.startswith(F.coalesce(F.col("final_category"), F.lit("")), F.lit(V.PRIMARY_REVIEW)), "复核").otherwise("备选")
    return F.coalesce(own, rest)


def type_text() -> Column:
    both = lambda a, b: F.concat_ws(" / ", F.nullif(F.col(a), F.lit("")), F.nullif(F.col(b), F.lit("")))
    return F.when(~S.blank(F.col("photo_type")), both("photo_type", "subtype")).when(~S.blank(F.col("ai_primary_category")), F.concat(F.lit("AI建议："), both("ai_primary_category", "ai_secondary_category"))).otherwise("-")


def not_exported() -> Column:
    return F.array_contains(F.col("delivery_use"), V.NO_EXPORT) | (F.coalesce(F.col("quality_rating"), F.lit("")) == "X") | (F.coalesce(F.col("similar_group_status"), F.lit("")) == "duplicate")


def overridden() -> tuple[Column, Column, Column]:
    """AI text, human text, and whether the human result doesn't contain the AI's."""
    text = lambda *cs: F.concat_ws(" / ", *(F.nullif(F.col(c), F.lit("")) for c in cs))
    ai, human = text("ai_primary_category", "ai_secondary_category"), text("photo_type", "subtype", "quality_rating")
    return ai, human, (ai != "") & (human != "") & ~F.contains(human, ai)


def workflow_bucket() -> Column:
    """One of five buckets by the first rule that holds."""
    blankless = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat_ws(" / ", blankless("manual_category"), blankless("final_recommendation"), export_category(), blankless("final_category"), blankless("ai_primary_category"))
    score = F.coalesce(*(F.nullif(F.col(c), F.lit(0.0)) for c in ("final_pick_score", "absolute_quality_score", "relative_quality_score")), F.lit(0.0))
    manual, has = F.col("manual_category"), lambda *w: S.has_keyword(text, list(w))
    return (
        F.when((manual == "废片") | has("废片"), "废片")
        .when((manual == "重复") | (F.col("ai_primary_category") == V.PRIMARY_DUPLICATE) | ~S.blank(F.col("similar_group_id")) | has("重复"), "重复")
        .when(manual.isin("精修候选", "作品集候选") | (score >= 90) | has("推荐保留", "精修"), "强烈推荐")
        .when((manual == "可交付") | (score >= 75) | has("可用待修", "可交付"), "可交付")
        .otherwise("备选")
    )


WORKFLOW_BUCKETS = ["强烈推荐", "可交付", "备选", "重复", "废片"]
