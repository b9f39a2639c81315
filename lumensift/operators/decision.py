"""Review decision: module results to scores, rating, uses and reason, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S

MODULES = ("basic", "face", "pose", "expression", "composition", "business")

#: Score of a module without a result; a failed module has score 0 instead.
MISSING = {"basic": 60.0, "face": 60.0, "pose": 55.0, "expression": 55.0, "composition": 60.0}
COMMERCIAL = {"basic": 0.42, "face": 0.22, "expression": 0.14, "pose": 0.08, "composition": 0.14}
CONFIDENCE = {"basic": 0.30, "face": 0.18, "composition": 0.16, "business": 0.18, "expression": 0.10, "pose": 0.08}


def score_of(module: str) -> Column:
    return F.coalesce(F.col(f"{module}_score"), F.lit(MISSING[module]))


def confidence_of(module: str) -> Column:
    return F.coalesce(F.col(f"{module}_confidence"), F.lit(0.0))


def weighted(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def commercial_score() -> Column:
    return S.clamp(weighted([score_of(m) * w for m, w in COMMERCIAL.items()]))


def portfolio_score() -> Column:
    basic = score_of("basic")
    return S.clamp(basic * 0.24 + score_of("composition") * 0.34 + score_of("expression") * 0.16 + confidence_of("business") * 100 * 0.10 + F.greatest(F.lit(0.0), basic - 65) * 0.16)


def issue_tags(problems: Column) -> Column:
    """Known problems in order of modules, once each."""
    return F.array_intersect(F.array_distinct(problems), V.array_of(V.ISSUE_TAGS))


def with_repairable(tags: Column, commercial: Column) -> Column:
    wants = (F.size(tags) > 0) & (commercial >= 55) & ~F.array_contains(tags, V.REPAIRABLE)
    return F.when(wants, F.array_append(tags, V.REPAIRABLE)).otherwise(tags)


def rating_from_score(score: Column) -> Column:
    out = F.when(score >= V.RATING_BOUNDS[0][1], V.RATING_BOUNDS[0][0])
    for code, bound in V.RATING_BOUNDS[1:]:
        out = out.when(score >= bound, code)
    return out.otherwise("X")


def rating(commercial: Column, basic: Column, tags: Column, photo_type: Column) -> Column:
    """The score's rating, unless the first of these holds: out of focus (twice), eyes closed, repairable."""
    base = rating_from_score(commercial)
    blurred = F.array_contains(tags, "虚焦")
    return (
        F.when(blurred & (basic < 30) & ~photo_type.isin("风景/环境", "产品/静物"), "X")
        .when(blurred & (basic < 58), "C")
        .when(F.array_contains(tags, "闭眼") & (commercial < 58), "B")
        .when(F.array_contains(tags, V.REPAIRABLE) & (base == "X"), "C")
        .otherwise(base)
    )


def delivery_uses(code: Column, commercial: Column, portfolio: Column, tags: Column) -> Column:
    return S.keep_if(
        (code == "S", "精修候选"),
        (code.isin("S", "A") | ((code == "B") & (commercial >= 70)), "客户可选"),
        (code == "C", "修图练习"),
        ((code == "C") | ((code == "B") & (commercial < 70)), "仅留档"),
        (code == "X", V.NO_EXPORT),
        ((portfolio >= 78) & code.isin("S", "A", "B"), "作品集候选"),
        (F.array_contains(tags, V.REPAIRABLE), "修图练习"),
    )


def reason(code: Column, commercial: Column, portfolio: Column, tags: Column, basic_reason: Column, composition_problems: Column) -> Column:
    """Scores are shown as whole numbers, ties to even."""
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    head = F.concat(F.lit("综合建议为 "), code, F.lit(" "), V.lookup(V.RATINGS, code), F.lit("，商业交付分 "), whole(commercial), F.lit("，作品集分 "), whole(portfolio))
    risks = F.when(F.size(tags) > 0, F.concat(F.lit("主要风险："), F.array_join(tags, "、")))
    own = F.when(~S.blank(basic_reason), F.regexp_replace(basic_reason, "。+$", ""))
    crop = F.when(F.size(F.coalesce(composition_problems, F.array().cast("array<string>"))) > 0, F.lit("构图问题优先视为可修或可裁切风险，不直接判废"))
    return F.concat(F.concat_ws("；", head, risks, own, crop), F.lit("。"))


def decide(modules: DataFrame) -> DataFrame:
    """Adds photo_type, subtype, quality_rating, the two scores, uses, tags, confidence, reason and preset.

    modules has ``<module>_score``, ``<module>_confidence`` and ``<module>_problems`` for
    each module (NULL: no result), ``basic_reason``, and the business module's type and subtype.
    """
    none = F.array().cast("array<string>")
    problems = F.concat(*(F.coalesce(F.col(f"{m}_problems"), none) for m in MODULES))
    scored = modules.withColumns({"c_": commercial_score(), "p_": portfolio_score(), "b_": score_of("basic")})
    tagged = scored.withColumns({"photo_type": S.filled(F.col("business_type"), V.UNKNOWN_TYPE), "subtype": S.filled(F.col("business_subtype"), V.DEFAULT_SUBTYPE), "issue_tags": with_repairable(issue_tags(problems), F.col("c_"))})
    rated = tagged.withColumn("quality_rating", rating(F.col("c_"), F.col("b_"), F.col("issue_tags"), F.col("photo_type")))
    used = rated.withColumn("delivery_use", delivery_uses(F.col("quality_rating"), F.col("c_"), F.col("p_"), F.col("issue_tags")))
    preset = F.coalesce(*(F.when(F.col("photo_type") == n, F.create_map(*(F.lit(x) for p in v.items() for x in p))) for n, v in V.PRESETS.items() if n != V.DEFAULT_PRESET), F.create_map(*(F.lit(x) for p in V.PRESETS[V.DEFAULT_PRESET].items() for x in p)))
    return used.withColumns(
        {
            "confidence": F.round(S.clamp(weighted([confidence_of(m) * w for m, w in CONFIDENCE.items()]), 0.0, 1.0), 3),
            "reason": reason(F.col("quality_rating"), F.col("c_"), F.col("p_"), F.col("issue_tags"), F.col("basic_reason"), F.col("composition_problems")),
            "commercial_score": F.round("c_", 1),
            "portfolio_score": F.round("p_", 1),
            "review_preset": preset,
        }
    ).drop("c_", "p_", "b_")
