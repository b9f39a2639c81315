"""From images to decisions: pixel features, modules, business type, decision, and the payload that is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..operators import business, decision, pixels


BOXES = "array<struct<x:int,y:int,w:int,h:int>>"


def analyse(images: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """One row an image (path, image): every module's columns, the decision, and ai_suggestion, its JSON payload.

    detections, from any detector, has path, face_boxes (largest first), face_clarity,
    eye_count, person_count and detector; images without a row there have none. An image
    that can't be read is a row with an error whose modules failed: scores and confidences are 0.
    """
    none = F.array().cast("array<string>")
    boxes = F.array().cast(BOXES)
    seen = pixels.features(images)
    found = seen.join(detections, "path", "left") if detections is not None else seen.withColumns({"face_boxes": F.lit(None).cast(BOXES), "face_clarity": F.lit(None).cast("double"), "eye_count": F.lit(-1), "person_count": F.lit(None).cast("int"), "detector": F.lit(None).cast("string")})
    rated = pixels.analyse(found.withColumn("face_boxes", F.coalesce("face_boxes", boxes)))
    box = F.get("face_boxes", F.lit(0))
    hinted = rated.withColumns(
        {
            "face_count": F.size("face_boxes"), "r": F.col("dominant_r"), "g": F.col("dominant_g"), "b": F.col("dominant_b"),
            "face_area_ratio": F.coalesce(box["w"] * box["h"] / F.greatest(F.lit(1), F.col("width") * F.col("height")), F.lit(0.0)),
        }
    )
    typed = business.classify(hinted)
    broken = F.col("error").isNotNull()
    unsure = F.when(F.col("candidate_type") == V.UNKNOWN_TYPE, F.array(F.lit("建议人工确认"))).otherwise(none)
    ready = typed.withColumns({"business_type": F.col("type"), "business_subtype": F.col("type_subtype"), "business_confidence": F.col("type_confidence"), "business_problems": unsure})
    failed = {f"{m}_{k}": F.when(broken, F.lit(0.0)).otherwise(F.col(f"{m}_{k}")) for m in decision.MODULES for k in ("score", "confidence") if f"{m}_{k}" in ready.columns}
    failed |= {f"{m}_problems": F.when(broken, none).otherwise(F.col(f"{m}_problems")) for m in decision.MODULES}
    decided = decision.decide(ready.withColumns(failed))
    payload = F.struct(
        F.lit(V.SUGGESTION_VERSION).alias("version"), F.col("path").alias("image_path"),
        *(F.struct(F.round(f"{m}_score", 2).alias("score"), F.round(f"{m}_confidence", 3).alias("confidence"), F.col(f"{m}_tags").alias("tags"), F.col(f"{m}_problems").alias("problems"), F.col(f"{m}_reason").alias("reason")).alias(m) for m in ("basic", "face", "pose", "expression", "composition")),
        F.struct("photo_type", "subtype", "quality_rating", "commercial_score", "portfolio_score", "delivery_use", "issue_tags", "confidence", "reason").alias("decision"),
    )
    return decided.withColumn("ai_suggestion", F.to_json(payload))
