"""Learned preference: feature vectors, label centroids, nearest centroid, and a logistic regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import written
from ..functions.ranks import placed
from . import vectors as vectors_

EMBEDDING_DIMS = 32
LEAST_SAMPLES = 50
HOLDOUT_FROM = 80

#: Column: divisor, of the scalar features in order.
SCALARS = (
    ("width", 10000.0), ("height", 10000.0), ("file_size_mb", 100.0), ("ai_confidence", 1.0), ("absolute_quality_score", 100.0), ("relative_quality_score", 100.0), ("semantic_score", 100.0), ("final_pick_score", 100.0),
    ("subject_area_ratio", 1.0), ("subject_center_score", 1.0), ("edge_cutoff_risk", 1.0), ("detection_confidence", 1.0),
)


def features() -> Column:
    """12 scaled scalars, grouped, recommended, tag count, and the first 32 dimensions of the embedding, padded with zeros."""
    own = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / d for c, d in SCALARS]
    grouped = F.when(S.blank(F.col("similar_group_id")), 0.0).otherwise(1.0)
    kept = F.when(F.coalesce(F.col("recommended_keep"), F.lit(False)) | F.coalesce(F.col("recommended_in_group"), F.lit(False)), 1.0).otherwise(0.0)
    tags = F.size(F.coalesce(F.col("ai_quality_tags"), F.array().cast("array<string>"))) / 20.0
    return F.concat(F.array(*own, grouped, kept, tags), embedding_features(F.col("embedding")))


def embedding_features(embedding: Column, size: int = EMBEDDING_DIMS) -> Column:
    values = F.coalesce(embedding.cast("array<double>"), F.array().cast("array<double>"))
    return F.slice(F.concat(values, F.array_repeat(F.lit(0.0), size)), 1, size)


def label_of() -> Column:
    return F.coalesce(F.nullif(F.col("user_label"), F.lit("")), F.nullif(F.col("manual_category"), F.lit("")), F.lit("待定"))


def label_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy(label_of().alias("label")).agg(F.count(F.lit(1)).alias("n"))


def trainable(samples: DataFrame) -> DataFrame:
    """total, labels, can_train and warnings about rare labels."""
    rare = ["精选", "废片", "可用待修", "可用待裁切", "人工复核"]
    counted = samples.withColumn("l_", label_of()).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("l_").alias("labels"), *(F.count_if(F.col("l_") == r).alias(f"n_{i}") for i, r in enumerate(rare)))
    few = F.when(F.col("total") < LEAST_SAMPLES, F.concat(F.lit("样本太少：还差 "), (LEAST_SAMPLES - F.col("total")).cast("string"), F.lit(" 张可训练。")))
    one = F.when((F.col("labels") < 2) & (F.col("total") > 0), F.lit("样本类别不均衡：至少需要两个以上类别。"))
    warnings = F.array_compact(F.array(few, one, *(F.when(F.col(f"n_{i}") < 5, F.lit(f"{r}样本偏少。")) for i, r in enumerate(rare))))
    return counted.select("total", "labels", ((F.col("total") >= LEAST_SAMPLES) & (F.col("labels") >= 2)).alias("can_train"), warnings.alias("warnings"))


def centroids(samples: DataFrame) -> DataFrame:
    """label and the mean vector of its samples that have features."""
    each = samples.where(F.size(F.coalesce("features", F.array().cast("array<double>"))) > 0).select(label_of().alias("label"), F.posexplode("features").alias("pos", "x"))
    means = each.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias("centroid"))


def nearest(items: DataFrame, centres: DataFrame, vector: str = "features", limit: int = 10_000) -> DataFrame:
    """Adds label, distance and score 1 / (1 + distance) of the nearest centroid, ties by label.

    Centroids, one a label, become one broadcast row with an array; beyond ``limit``
    labels they are compared in blocks.
    """
    if centres.limit(limit + 1).count() > limit:
        keyed = written(items.withColumn("row_", F.monotonically_increasing_id()))
        found = vectors_.matches(keyed, centres.withColumnRenamed("centroid", vector), 1, "row_", vector).select("row_", F.col("label").alias("near_"), F.col("distance").alias("distance_"))
        d = F.col("distance_")
        out = keyed.join(found, "row_", "left")
        return out.withColumns({"preference_label": F.coalesce("near_", F.lit("")), "distance": d, "preference_score": _closeness(d)}).drop("row_", "near_", "distance_")
    one = centres.agg(F.sort_array(F.collect_list(F.struct("label", "centroid"))).alias("centres_"))
    found = F.array_min(F.transform("centres_", lambda c: F.struct(S.euclidean(F.col(vector), c["centroid"]).alias("distance"), c["label"].alias("label"))))
    out = items.crossJoin(F.broadcast(one)).withColumn("near_", found).drop("centres_")  # one row against all: no product
    d = F.col("near_.distance")
    return out.withColumns({"preference_label": F.when(d.isNull(), "").otherwise(F.col("near_.label")), "distance": d, "preference_score": _closeness(d)}).drop("near_")


def _closeness(distance: Column) -> Column:
    """1 / (1 + distance); what has no vector, and so no distance, isn't close to anything."""
    return F.when(distance.isNull(), 0.0).otherwise(S.clamp(1.0 / (1.0 + distance), 0.0, 1.0))


def report_lines(samples: DataFrame) -> DataFrame:
    """The report on what has been learnt, as lines: part, place (in its part) and line. Counts are in order of their labels."""
    # The lines of the report.
    state = trainable(samples)
    yes = F.when(F.col("can_train"), "是").otherwise("否")
    head = F.array(F.lit("我的筛片风格报告"), F.concat(F.lit("样本数量："), F.col("total").cast("string")), F.concat(F.lit("是否达到训练条件："), yes), F.lit(f"模型版本：{V.PREFERENCE_VERSION}"), F.lit("样本分布："))
    none = F.array(F.lit("样本质量提示：分布基本可用。"))
    notes = F.when(F.size("warnings") == 0, none).otherwise(F.concat(F.array(F.lit("样本质量提示：")), F.transform("warnings", lambda w: F.concat(F.lit("- "), w))))
    tail = F.array(F.lit("当前学习方式：本地轻量偏好模型，不训练大模型。"), F.lit("偏好模型只提供建议，不覆盖人工分类。"))
    listed = lambda part, lines: state.select(F.lit(part).alias("part"), F.posexplode(lines).alias("place", "line")).withColumn("place", F.col("place") + 1)
    counted = placed(label_counts(samples), [F.col("label")], "place_").select(F.lit("counts").alias("part"), F.col("place_").cast("int").alias("place"), F.concat(F.lit("- "), "label", F.lit(": "), F.col("n").cast("string"), F.lit(" 张")).alias("line"))
    return listed("head", head).unionByName(counted).unionByName(listed("notes", notes)).unionByName(listed("tail", tail))


def reason_text(samples: Column | int, label: Column, score: Column | None = None) -> Column:
    n = F.lit(samples) if isinstance(samples, int) else samples
    tail = F.lit("”。") if score is None else F.concat(F.lit("”，偏好分 "), F.format_string("%.2f", score), F.lit("。"))
    return F.when(label == "", F.lit("偏好模型暂无可用类别。")).otherwise(F.concat(F.lit("根据你已标记的 "), n.cast("string"), F.lit(" 张样本，本图更接近“"), label, tail))


def applied(photos: DataFrame, samples: int) -> DataFrame:
    """Takes over predictions (preference_label and preference_score): score, version and reasons; from 0.60 on, the final reason names the label."""
    label, score = F.col("preference_label"), F.col("preference_score")
    why = F.coalesce("ai_reason", F.lit(""))
    sure = F.concat(why, F.lit("；偏好模型建议："), label, F.lit("，偏好分 "), S.fixed(score, 2), F.lit("。"))
    final = F.when(label == "", F.col("final_reason")).when(score >= 0.60, sure).otherwise(F.concat(why, F.lit("；偏好模型不确定，建议人工确认。")))
    reason = reason_text(samples, label, score)
    return photos.withColumns({"user_preference_score": score, "user_preference_reason": reason, "preference_reason": reason, "preference_model_version": F.when(label == "", "").otherwise(V.PREFERENCE_VERSION), "final_reason": final})


def train(samples: DataFrame):
    """A function that predicts for rows with features: a logistic regression, or the nearest centroid where that can't be fitted; None with too few samples."""
    if not trainable(samples).first()["total"] >= LEAST_SAMPLES:
        return None
    try:
        fitted = train_logistic(samples)
    except Exception:  # what can't be fitted falls back to centroids, as the report tells by the model's kind
        fitted = None
    if fitted is not None:
        return lambda items: predict_logistic(fitted[0], items)
    centres = centroids(samples)
    return lambda items: nearest(items, centres)


# -- statistics that learn on: of each label and component the number, sum and sum of squares


def statistics(samples: DataFrame) -> DataFrame:
    """label, pos, n, total and squares of samples with features; what ``merged`` adds up."""
    each = samples.where(F.size(F.coalesce("features", F.array().cast("array<double>"))) > 0).select(label_of().alias("label"), F.posexplode("features").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    return each.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def merged(*parts: DataFrame) -> DataFrame:
    """Statistics of all samples of the parts together."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("label", "pos").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))


def centroids_of(learnt: DataFrame) -> DataFrame:
    """label, n, centroid and deviation (of each component, over the population)."""
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - mean * mean))
    listed = F.array_sort(F.collect_list(F.struct("pos", mean.alias("mean"), spread.alias("spread"))))
    return learnt.groupBy("label").agg(F.max("n").alias("n"), listed.alias("l")).select("label", "n", F.transform("l", lambda s: s["mean"]).alias("centroid"), F.transform("l", lambda s: s["spread"]).alias("deviation"))


def versions(spark, path: str) -> list[int]:
    """The versions of a model store, oldest first."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/statistics")
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(s.getPath().getName()) for s in files.listStatus(at) if files.exists(done(s.getPath(), "_SUCCESS"))) if files.exists(at) else []


def learn(samples: DataFrame, path: str) -> int:
    """Adds new samples to the statistics of a store, reading none of the earlier samples, as a new version; returns it. One writer at a time."""
    spark = samples.sparkSession
    known = versions(spark, path)
    new = statistics(samples)
    whole = merged(spark.read.parquet(f"{path}/statistics/{known[-1]:012d}"), new) if known else new
    version = known[-1] + 1 if known else 0
    whole.coalesce(1 + whole.sparkSession.sparkContext.defaultParallelism // 4).write.mode("overwrite").parquet(f"{path}/statistics/{version:012d}")
    return version


def learnt(spark, path: str, version: int | None = None) -> DataFrame:
    """The statistics of a version, the last one by default."""
    known = versions(spark, path)
    return spark.read.parquet(f"{path}/statistics/{known[-1] if version is None else version:012d}")


def store_fitted(fitted, path: str, version: int) -> None:
    """Keeps a fitted pipeline (of ``train_logistic``) beside the statistics of the version that it was fitted at."""
    fitted.write().overwrite().save(f"{path}/fitted/{version:012d}")


def stored_fitted(path: str, version: int):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/fitted/{version:012d}")


def save_model(centres: DataFrame, path: str) -> None:
    centres.write.mode("overwrite").parquet(path)


def clear_model(spark, path: str) -> bool:
    """Removes a stored model; whether there was one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


def embedded(items: DataFrame, embed, content: str = "content") -> DataFrame:
    """Adds embedding, normalised, by any back-end: embed maps a list of contents to vectors, in batches; what fails has none."""

    @F.pandas_udf("array<double>")
    def run(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        found = iter(np.asarray(v, float) for v in embed([v for v, k in zip(values, known) if k]))
        units = [(v / (np.linalg.norm(v) or 1.0)).tolist() if k else None for k in known for v in ([next(found)] if k else [None])]
        return pd.Series(units, dtype=object)

    return items.withColumn("embedding", run(F.col(content)))


def cosines(vectors: DataFrame, prompts: DataFrame) -> DataFrame:
    """label and cosine of one vector (a frame of one row) with each prompt."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    v, w = F.col("one_").cast("array<double>"), F.col("vector").cast("array<double>")
    one = vectors.select(F.col("vector").alias("one_")).limit(1)
    return prompts.crossJoin(F.broadcast(one)).select("label", (dot(v, w) / F.sqrt(dot(v, v)) / F.sqrt(dot(w, w))).alias("cosine"))  # one row against all


def train_logistic(samples: DataFrame):
    """A fitted pipeline with balanced class weights, and its hold-out accuracy (-1 under HOLDOUT_FROM samples); None where training isn't possible."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    state = trainable(samples).first()
    if not state["can_train"]:
        return None
    weights = label_counts(samples).select("label", (F.lit(float(state["total"])) / (state["labels"] * F.col("n"))).alias("weight"))
    ready = samples.select(label_of().alias("label"), array_to_vector(F.col("features").cast("array<double>")).alias("vector"), F.xxhash64("features").alias("h")).join(F.broadcast(weights), "label")
    accuracy = -1.0
    steps = Pipeline(stages=[StringIndexer(inputCol="label", outputCol="index"), LogisticRegression(featuresCol="vector", labelCol="index", weightCol="weight", maxIter=800, regParam=1.0 / state["total"])])
    if state["total"] >= HOLDOUT_FROM:
        held = F.pmod(F.col("h"), F.lit(5)) == 0
        first = steps.fit(ready.where(~held))
        seen = ready.where(held & F.col("label").isin(first.stages[0].labels))
        accuracy = first.transform(seen).agg(F.avg((F.col("prediction") == F.col("index")).cast("double"))).first()[0] or 0.0
    return steps.fit(ready), accuracy


def predict_logistic(model, items: DataFrame, vector: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector, vector_to_array

    labels = model.stages[0].labels
    out = model.stages[1].transform(items.withColumn("vector", array_to_vector(F.col(vector).cast("array<double>"))))
    name = F.get(V.array_of(list(labels)), F.col("prediction").cast("int"))
    return out.withColumns({"preference_label": name, "preference_score": F.array_max(vector_to_array("probability"))}).drop("vector", "rawPrediction", "probability", "prediction")


def zero_shot(vectors: DataFrame, labels: DataFrame, k: int = 3, scale: float = 100.0, limit: int = 10_000) -> DataFrame:
    """idx, place, label and probability: softmax of scaled cosines to label vectors, the k highest; beyond ``limit`` labels in blocks."""
    if labels.limit(limit + 1).count() > limit:
        return vectors_.matches(vectors, labels, k, scale=scale)
    one = labels.agg(F.sort_array(F.collect_list(F.struct("label", F.col("vector").cast("array<double>").alias("vector")))).alias("labels_"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda a: F.sqrt(dot(a, a))
    v = F.col("vector").cast("array<double>")
    logits = F.transform("labels_", lambda c: F.struct((F.lit(scale) * dot(v, c["vector"]) / (norm(v) * norm(c["vector"]))).alias("z"), c["label"].alias("label")))
    shown = vectors.crossJoin(F.broadcast(one)).select("idx", logits.alias("l"))  # one row against all
    top = F.array_max("l")["z"]
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + F.exp(x["z"] - top))
    ordered = F.array_sort(F.transform("l", lambda x: F.struct((-x["z"]).alias("n"), x["label"].alias("label"), (F.exp(x["z"] - top) / total).alias("p"))))
    return shown.select("idx", F.posexplode(F.slice(ordered, 1, k)).alias("pos", "x")).select("idx", (F.col("pos") + 1).alias("place"), F.col("x.label").alias("label"), F.col("x.p").alias("probability"))


def label_vectors(prompts: DataFrame) -> DataFrame:
    """label and the normalised mean of its normalised prompt vectors."""
    dot = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    v = F.col("vector").cast("array<double>")
    unit = prompts.select("label", F.transform(v, lambda x: x / dot(v)).alias("v"))
    means = unit.select("label", F.posexplode("v").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("m"))
    return means.select("label", F.transform("m", lambda x: x / dot(F.col("m"))).alias("vector"))
