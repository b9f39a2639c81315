"""Business type of a photo from its visual evidence: hints, an ordered decision tree, and a gate on confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S

GATE = 0.65
UNKNOWN = "未知"


def _blue(r: Column, g: Column, b: Column) -> Column:
    return (b > 135) & (b > r + 25)


def _red(r: Column, g: Column, b: Column) -> Column:
    return (r > 145) & (r > b + 25)


def _white(r: Column, g: Column, b: Column) -> Column:
    return (r > 185) & (g > 185) & (b > 185)


def id_background(rgb: tuple[Column, Column, Column], std: Column) -> Column:
    return (std < 72) & (_white(*rgb) | _blue(*rgb) | _red(*rgb))


def background_hint(rgb: tuple[Column, Column, Column], std: Column, green: Column, blue: Column) -> Column:
    return (
        F.when((std < 58) & _white(*rgb), "白底")
        .when((std < 70) & _blue(*rgb), "蓝底")
        .when((std < 70) & _red(*rgb), "红底")
        .when((green > 0.22) | (blue > 0.28), "户外")
        .when(std < 95, "棚拍背景")
        .otherwise(UNKNOWN)
    )


def clothing_hint(white: Column, lower: Column, centre: Column, std: Column, background: Column) -> Column:
    return (
        F.when(background.isin("白底", "蓝底", "红底") & (std < 62), "证件照服装")
        .when(((lower > 0.30) | (centre > 0.34)) & (white > 0.16) & (std >= 42), "婚纱")
        .when((white > 0.38) & (background == "棚拍背景") & (std >= 35), "婚纱")
        .otherwise(UNKNOWN)
    )


def scene_hint(background: Column, std: Column, green: Column, blue: Column) -> Column:
    return F.when(background.isin("白底", "蓝底", "红底", "棚拍背景"), "棚拍").when((green > 0.22) | (blue > 0.28), "户外").when(std > 112, "会议").otherwise(UNKNOWN)


def body_scale(face_area: Column) -> Column:
    return F.when(face_area <= 0, UNKNOWN).when(face_area < 0.035, "全身").when(face_area < 0.11, "半身").otherwise("特写")


def id_subtype(rgb: tuple[Column, Column, Column]) -> Column:
    return F.when(_blue(*rgb), "蓝底").when(_red(*rgb), "红底").otherwise("白底")


def first_valid_subtype(photo_type: str, preferred: str) -> str:
    valid = V.SUBTYPES.get(photo_type, [V.DEFAULT_SUBTYPE])
    return preferred if preferred in valid else valid[0]


def classify(evidence: DataFrame) -> DataFrame:
    """Adds candidate_type, candidate_subtype, type_confidence, and type and subtype behind the gate.

    evidence has face_count, person_count, r, g, b (dominant colour), color_std, green_ratio,
    blue_ratio, white_ratio, lower_white_ratio, center_white_ratio and face_area_ratio; a person
    count of 0 or NULL is the face count.
    """
    f = F.coalesce(F.col("face_count"), F.lit(0))
    p = F.coalesce(F.nullif(F.col("person_count"), F.lit(0)), f)
    rgb = F.col("r"), F.col("g"), F.col("b")
    std, green, blue = F.col("color_std"), F.col("green_ratio"), F.col("blue_ratio")
    hinted = evidence.withColumn("background_hint", background_hint(rgb, std, green, blue)).withColumns(
        {"clothing_hint": clothing_hint(F.col("white_ratio"), F.col("lower_white_ratio"), F.col("center_white_ratio"), std, F.col("background_hint")), "scene_hint": scene_hint(F.col("background_hint"), std, green, blue), "body_scale": body_scale(F.col("face_area_ratio"))}
    )
    scene, body = F.col("scene_hint"), F.col("body_scale")
    studio = (scene == "棚拍") & body.isin("全身", "半身", UNKNOWN)
    bride = (F.col("clothing_hint") == "婚纱") & (p.between(1, 2) | f.between(1, 2))
    single = (f <= 1) | (p <= 1)
    meeting = (f >= 6) | (p >= 6)
    branch = (
        F.when(bride, 1).when((f <= 0) & (p <= 0), 2).when(single & id_background(rgb, std) & body.isin("特写", "半身", UNKNOWN), 3).when(single, 4)
        .when((f == 2) | (p == 2), 5).when(meeting & scene.isin("会议", "棚拍", UNKNOWN), 6).when(meeting, 7).when((f >= 3) | (p >= 3), 8).otherwise(9)
    )
    types = {1: "婚纱照", 2: "风景/环境", 3: "证件照", 4: "个人写真", 5: "情侣照", 6: "会议/活动照", 7: "全家福", 8: "全家福", 9: V.UNKNOWN_TYPE}
    n = F.col("branch_")
    subtype = (
        F.when((n == 1) & ((p <= 1) | (f <= 1)), "单人新娘").when((n == 1) & studio, "棚内婚纱").when(n == 1, "双人互动").when(n == 2, "环境交代").when(n == 3, id_subtype(rgb))
        .when((n == 4) & (scene == "棚拍"), "棚拍写真").when(n == 4, "半身").when(n == 6, "会议合影").when(n == 7, "正式合影").when(n == 8, "多人家庭").otherwise(V.DEFAULT_SUBTYPE)
    )
    confidence = (
        F.when((n == 1) & studio, 0.78).when(n == 1, 0.70).when((n == 2) & scene.isin("户外", "风景"), 0.50).when(n == 2, 0.34).when(n == 3, 0.68).when(n == 4, 0.58)
        .when(n == 5, 0.56).when(n == 6, 0.66).when(n == 7, 0.60).when(n == 8, 0.58).otherwise(0.25)
    )
    out = hinted.withColumn("branch_", branch).withColumns({"candidate_type": V.lookup(types, n), "candidate_subtype": subtype, "type_confidence": confidence})
    sure = F.col("type_confidence") >= GATE
    return out.withColumns({"type": F.when(sure, F.col("candidate_type")).otherwise(V.UNKNOWN_TYPE), "type_subtype": F.when(sure, F.col("candidate_subtype")).otherwise(V.DEFAULT_SUBTYPE), "orientation": S.orientation(F.col("width"), F.col("height")) if "width" in evidence.columns else F.lit(None).cast("string")}).drop("branch_")
