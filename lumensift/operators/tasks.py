"""What long jobs count: each a frame of one row (success, skipped, failed, note), and trials of batch sizes."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from . import report


def preference_stats(photos: DataFrame) -> DataFrame:
    """Photos that a human has labelled, marked or confirmed are a success; the others are skipped."""
    own = ~S.blank(F.col("user_label")) | F.coalesce(F.col("manual_override"), F.lit(False)) | (F.col("review_status") == V.CONFIRMED)
    seen = F.count_if(F.coalesce(own, F.lit(False)))
    return photos.agg(seen.alias("success"), (F.count(F.lit(1)) - seen).alias("skipped"), F.lit(0).cast("long").alias("failed"), F.lit("").alias("note"))


def similarity_counts(photos: DataFrame, failed: DataFrame, threshold: int) -> DataFrame:
    """After grouping: photos in groups, files whose hash failed, and a note with the number of groups."""
    groups = F.count_distinct(F.nullif("similar_group_id", F.lit("")))
    done = photos.agg(F.count_if(~S.blank(F.col("similar_group_id"))).alias("success"), groups.alias("groups"))
    bad = failed.agg(F.count(F.lit(1)).alias("skipped"))
    note = F.concat(F.lit("相似组 "), F.col("groups").cast("string"), F.lit(f"，阈值 {threshold}，跳过 "), F.col("skipped").cast("string"), F.lit(" 张"))
    return done.crossJoin(bad).select("success", "skipped", F.lit(0).cast("long").alias("failed"), note.alias("note"))  # one row each


def export_preview(photos: DataFrame) -> DataFrame:
    """A note about what an export would hold."""
    part = lambda c: F.col(c).cast("string")
    note = F.concat(F.lit("总照片 "), part("total"), F.lit("，客户可选 "), part("client_select_count"), F.lit("，精修候选 "), part("retouch_candidate_count"), F.lit("，待复核 "), part("needs_review_count"))
    return report.totals(photos).select(F.col("total").alias("success"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("failed"), note.alias("note"))


def missing_thumbnails(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """Photos without a thumbnail among existing ones (thumbnail_path, mtime) that is as new as the photo; the others are skipped by the thumbnail task."""
    have = existing.select("thumbnail_path", F.col("mtime").alias("made_"))
    return photos.join(have, "thumbnail_path", "left").where(F.col("made_").isNull() | (F.floor("made_") < F.floor("mtime"))).select(*photos.columns)


def thumbnail_counts(photos: DataFrame, existing: DataFrame) -> DataFrame:
    """Photos whose thumbnail is to be made, and those that are skipped."""
    lacking = missing_thumbnails(photos, existing).agg(F.count(F.lit(1)).alias("success"))
    every = photos.agg(F.count(F.lit(1)).alias("n"))
    return every.crossJoin(lacking).select("success", (F.col("n") - F.col("success")).alias("skipped"), F.lit(0).cast("long").alias("failed"), F.lit("").alias("note"))  # one row each


def placeholder(photos: DataFrame, note: str = "模型未接入，已跳过") -> DataFrame:
    """For kinds whose model isn't plugged in: all photos are skipped."""
    return photos.agg(F.lit(0).cast("long").alias("success"), F.count(F.lit(1)).alias("skipped"), F.lit(0).cast("long").alias("failed"), F.lit(note).alias("note"))


# -- trials

# Batch sizes to try by profile, and limits of the advice.
CANDIDATES = {"fast": [8, 16, 32], "balanced": [4, 8, 16, 32], "accurate": [4, 8, 12, 16]}
OTHER_CANDIDATES = [2, 4, 6, 8]
POOR_MS, POOR_BATCH = 650.0, 8
TRIAL_PHOTOS = 8


def trials(photos: DataFrame, profile: str, run: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """trial, batch, success, avg_ms and error of a model run (photos, batch size) over the first TRIAL_PHOTOS photos with each batch size of a profile. A trial that fails costs no other."""
    few = photos.orderBy("idx").limit(TRIAL_PHOTOS)
    n = max(1, few.count())
    rows = []
    for number, batch in enumerate(CANDIDATES.get(profile, OTHER_CANDIDATES)):
        began = time.perf_counter()
        try:
            run(few, batch).write.format("noop").mode("overwrite").save()
            rows.append((number, batch, True, (time.perf_counter() - began) * 1000 / n, ""))
        except Exception as e:
            text = str(e)
            rows.append((number, batch, False, 0.0, "显存不足" if "out of memory" in text.lower() else text.splitlines()[0]))
    return photos.sparkSession.createDataFrame(rows, "trial int, batch int, success boolean, avg_ms double, error string")


def tuned(profile: str, tried: DataFrame) -> tuple[str, int | None]:
    """The profile and batch size that trials speak for: the fastest that succeeded; a slow ultra gives way to accurate."""
    best = report.best_trial(tried.where("success")).first()
    if best["batch"] is None:
        return profile, None
    poor = profile == "ultra" and (best["batch"] < POOR_BATCH or best["avg_ms"] > POOR_MS)
    return ("accurate" if poor else profile), best["batch"]
