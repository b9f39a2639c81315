"""Counts, rates and group summaries of a catalog, and the report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab as V
from ..functions import scalars as S
from . import generations, review

NO_TYPE, NO_RATING, NO_USE = "未分类", "未评级", "未设置"


def safe_type() -> Column:
    return S.filled(F.col("photo_type"), NO_TYPE)


def safe_subtype() -> Column:
    return S.filled(F.col("subtype"), V.DEFAULT_SUBTYPE)


def safe_rating() -> Column:
    return S.filled(F.col("quality_rating"), NO_RATING)


def _listed(column: str, empty: str | None) -> Column:
    values = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.explode(values if empty is None else F.when(F.size(values) == 0, F.array(F.lit(empty))).otherwise(values))


DIMENSIONS = {
    "photo_type": lambda p: p.select(safe_type().alias("value")),
    "subtype": lambda p: p.select(safe_subtype().alias("value")),
    "quality_rating": lambda p: p.select(safe_rating().alias("value")),
    "delivery_use": lambda p: p.select(_listed("delivery_use", NO_USE).alias("value")),
    "issue_tags": lambda p: p.select(_listed("issue_tags", None).alias("value")),
    "review_status": lambda p: p.select(S.filled(F.col("review_status"), V.UNREVIEWED).alias("value")),
}


def counts(photos: DataFrame, dimension: str) -> DataFrame:
    """value and n of one dimension."""
    return DIMENSIONS[dimension](photos).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def all_counts(photos: DataFrame) -> DataFrame:
    """dimension, value and n of all six dimensions in one pass over photos.

    A row becomes its (dimension, value) pairs, which are aggregated together, so the
    catalog is read once and not once a dimension.
    """
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("dimension"), value.alias("value")))
    none = F.array().cast("array<string>")
    uses, tags = F.coalesce(F.col("delivery_use"), none), F.coalesce(F.col("issue_tags"), none)
    many = lambda name, values: F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value")))
    pairs = F.concat(
        one("photo_type", safe_type()), one("subtype", safe_subtype()), one("quality_rating", safe_rating()), one("review_status", S.filled(F.col("review_status"), V.UNREVIEWED)),
        many("delivery_use", F.when(F.size(uses) == 0, F.array(F.lit(NO_USE))).otherwise(uses)), many("issue_tags", tags),
    )
    return photos.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def totals(photos: DataFrame) -> DataFrame:
    """The scalar counts of the export summary, in one aggregation."""
    none = F.array().cast("array<string>")
    uses = F.coalesce(F.col("delivery_use"), none)
    status, group = F.coalesce(F.col("similar_group_status"), F.lit("")), S.filled(F.col("review_status"), V.UNREVIEWED)
    grouped = F.nullif(F.col("similar_group_id"), F.lit(""))
    used = lambda u: F.coalesce(F.sum(F.size(F.filter(uses, lambda x: x == u))), F.lit(0)).cast("long")
    return photos.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("quality_rating") == "X").alias("reject_count"), used("作品集候选").alias("portfolio_candidate_count"), used("精修候选").alias("retouch_candidate_count"),
        used("客户可选").alias("client_select_count"), F.count_distinct(grouped).alias("similar_group_count"), F.count_if("best_in_group").alias("best_in_group_count"), F.count(grouped).alias("photos_in_groups_count"),
        F.count_if(status == "duplicate").alias("duplicate_count"), F.count_if(status == "backup").alias("backup_count"), F.count_if(status == "review").alias("similar_review_count"),
        F.count_if(group == V.CONFIRMED).alias("manual_confirmed_count"), F.count_if(group == V.NEEDS_REVIEW).alias("needs_review_count"), F.count_if(group == V.UNREVIEWED).alias("unreviewed_count"),
        F.count_if(group == V.AI_REVIEWED).alias("ai_reviewed_count"), F.count_if(F.col("quality_rating").isin("S", "A")).alias("sa_count"),
    )


def rates(summary: DataFrame) -> DataFrame:
    of = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    return summary.select(of("reject_count").alias("reject_rate"), of("sa_count").alias("sa_rate"), of("portfolio_candidate_count").alias("portfolio_rate"), S.percent(of("sa_count")).alias("sa_text"))


def rating_table(photos: DataFrame) -> DataFrame:
    """place, rating and n of all ratings in fixed order, zeros included."""
    order = photos.sparkSession.createDataFrame([(n, c) for n, c in enumerate([*V.RATINGS, NO_RATING])], "place int, value string")
    return order.join(counts(photos, "quality_rating"), "value", "left").select("place", F.col("value").alias("rating"), F.coalesce("n", F.lit(0)).alias("n"))


def workflow_counts(photos: DataFrame) -> DataFrame:
    order = photos.sparkSession.createDataFrame([(n, c) for n, c in enumerate(review.WORKFLOW_BUCKETS)], "place int, bucket string")
    found = photos.groupBy(review.workflow_bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return order.join(found, "bucket", "left").select("place", "bucket", F.coalesce("n", F.lit(0)).alias("n"))


def top_tags(photos: DataFrame, k: int = 3) -> DataFrame:
    """The k most frequent issue tags; ties by first appearance in input order."""
    seen = photos.select("idx", F.posexplode("issue_tags").alias("pos", "tag"))
    return seen.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("idx", "pos")).alias("first")).orderBy(F.desc("n"), "first").limit(k).select("tag", "n")


def workflow_guide(photos: DataFrame) -> DataFrame:
    return photos.agg(
        F.count(F.lit(1)).alias("imported"), F.count_if(~S.blank(F.col("ai_primary_category")) | (F.coalesce(F.col("ai_confidence"), F.lit(0.0)) != 0)).alias("analysed"), F.count_if(F.coalesce(F.col("manual_override"), F.lit(False))).alias("marked"),
        F.count_if(F.col("manual_category") == V.DEFAULT_MANUAL).alias("pending"), F.count_distinct(F.nullif(F.col("similar_group_id"), F.lit(""))).alias("groups"),
    )


def performance(photos: DataFrame) -> DataFrame:
    """n_timed, n_cached and mean_ms of rows that a model has run on."""
    timed = F.coalesce(F.col("ai_runtime_ms"), F.lit(0.0)) > 0
    return photos.agg(F.count_if(timed).alias("n_timed"), F.count_if(F.coalesce(F.col("embedding_cached"), F.lit(False))).alias("n_cached"), F.avg(F.when(timed, F.col("ai_runtime_ms"))).alias("mean_ms"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the smallest avg_ms; no time (0) counts as the longest. Ties go to the first trial."""
    order = F.struct(F.when(F.col("avg_ms") == 0, F.lit(float("inf"))).otherwise(F.col("avg_ms")), "trial")
    return trials.agg(F.min_by(F.struct(*trials.columns), order).alias("t")).select("t.*")


def group_summary(photos: DataFrame) -> DataFrame:
    """One row a group: size, file of the first human or AI best in input order, and counts of statuses."""
    best = F.coalesce(F.col("best_in_group"), F.lit(False)) | F.coalesce(F.col("ai_recommended_best"), F.lit(False))
    status = F.col("similar_group_status")
    return (
        photos.where(~S.blank(F.col("similar_group_id"))).groupBy(F.col("similar_group_id").alias("group_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min_by(F.when(best, F.col("filename")), F.when(best, F.col("idx"))), F.lit("")).alias("best_file"), F.count_if(status == "backup").alias("backup_count"), F.count_if(status == "duplicate").alias("duplicate_count"), F.count_if(status == "review").alias("review_count"))
    )


def group_states(photos: DataFrame) -> DataFrame:
    """group_id, first AI best, first human best, and whether the group is decided."""
    human, ai = F.coalesce(F.col("best_in_group"), F.lit(False)), F.coalesce(F.col("ai_recommended_best"), F.lit(False))
    first = lambda c: F.min_by(F.when(c, F.col("filename")), F.when(c, F.col("idx")))
    out = photos.where(~S.blank(F.col("similar_group_id"))).groupBy(F.col("similar_group_id").alias("group_id")).agg(first(ai).alias("ai_best"), first(human).alias("human_best"), F.bool_or(F.col("similar_group_status") == "review").alias("open"))
    return out.withColumn("state", F.when(F.col("human_best").isNotNull(), "decided").when(F.col("open"), "review").otherwise("suggested"))


def pending(photos: DataFrame, limit: float = 0.25) -> DataFrame:
    """Share of photos that wait for a human, and whether it is over a limit."""
    waits = F.startswith(review.export_category(), F.lit(V.PRIMARY_REVIEW))
    return photos.agg(F.count(F.lit(1)).alias("total"), F.count_if(~S.blank(F.col("ai_primary_category"))).alias("analysed"), F.avg(waits.cast("double")).alias("pending_ratio")).withColumn("too_high", F.col("pending_ratio") > limit)


def overrides(photos: DataFrame) -> DataFrame:
    ai, human, differs = review.overridden()
    return photos.where(differs).select("idx", "filename", ai.alias("ai_text"), human.alias("human_text"))


def csv_rows(photos: DataFrame, records: DataFrame | None = None, *more: str) -> DataFrame:
    """The columns of the review report (and more of the catalog's); photos without an export record are ``report_only``."""
    none = F.array().cast("array<string>")
    if records is None:
        both = photos.withColumns({"exported_paths": none, "export_status": F.lit(None).cast("string"), "export_error": F.lit(None).cast("string")})
    else:
        both = photos.join(records.select("path", "exported_paths", "export_status", "export_error"), "path", "left")
    yes = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "是").otherwise("否")
    return both.select(
        F.col("filename").alias("file_name"), F.col("path").alias("file_path"), F.array_join(F.coalesce("exported_paths", none), ";").alias("exported_paths"), safe_type().alias("photo_type"), safe_subtype().alias("subtype"), safe_rating().alias("quality_rating"),
        S.joined(F.col("delivery_use")).alias("delivery_use"), S.joined(F.col("issue_tags")).alias("issue_tags"), "commercial_score", "portfolio_score", S.filled(F.col("review_status"), V.UNREVIEWED).alias("review_status"), "similar_group_id",
        F.when(F.coalesce(F.col("similar_group_rank"), F.lit(0)) != 0, F.col("similar_group_rank").cast("string")).otherwise("").alias("similar_group_rank"), "similar_group_status",
        F.when(F.coalesce(F.col("similarity_score"), F.lit(0.0)) != 0, F.format_string("%.3f", F.col("similarity_score"))).otherwise("").alias("similarity_score"), yes("best_in_group").alias("best_in_group"), yes("ai_recommended_best").alias("ai_recommended_best"),
        F.coalesce("review_note", F.lit("")).alias("review_note"), F.coalesce("export_status", F.lit("report_only")).alias("export_status"), F.coalesce("export_error", F.lit("")).alias("export_error"), *more,
    )


def write_csv(photos: DataFrame, path: str, records: DataFrame | None = None) -> None:
    """A folder of CSV parts with a header; readers that need a byte order mark get it from ``encoding``."""
    csv_rows(photos, records).write.mode("overwrite").option("header", True).csv(path)


def _text_file(lines: DataFrame, order: list[str], head: str | None, folder: str, name: str) -> str:
    """Writes lines (column value, in an order without ties) as one named file after a head, and returns its path.

    Ranges of lines are written as parts by as many tasks, and the parts, whose names are in
    order, are put together by the file system: by its concat where it has one, else part by
    part through a buffer. No task and no driver holds more than a part, or a buffer.
    """
    spark = lines.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("value")
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    dealt.write.mode("overwrite").text(f"{folder}/parts")
    found = sorted((s.getPath() for s in files.listStatus(at(f"{folder}/parts")) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda p: p.getName())
    target = at(f"{folder}/{name}")
    out = files.create(target, True)
    if head is not None:
        out.write(bytearray(f"{head}\n".encode()))
    if head is not None and _joined(spark, files, out, target, found):
        pass
    else:
        for part in found:
            stream = files.open(part)
            spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            stream.close()
        out.close()
    files.delete(at(f"{folder}/parts"), True)
    return target.toString()


def _joined(spark, files, out, target, found: list) -> bool:
    """Whether the file system has put the parts behind what is in the target; if so, out is closed."""
    if not found or files.getScheme() not in CONCAT:
        return False
    out.close()
    array = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(found))
    for n, part in enumerate(found):
        array[n] = part
    files.concat(target, array)
    return True


#: File systems with a concat.
CONCAT = ("hdfs",)


def write_csv_file(photos: DataFrame, folder: str, records: DataFrame | None = None, name: str = "review_report.csv") -> str:
    """The review report as one CSV file that begins with a byte order mark, in input order; returns its path."""
    return _csv_file(csv_rows(photos, records, "idx"), folder, name)


def _csv_file(rows: DataFrame, folder: str, name: str) -> str:
    """rows (with idx, their order) as a file with a header."""
    names = [c for c in rows.columns if c != "idx"]
    line = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in names)), {"escape": "\"", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}).alias("value")
    return _text_file(rows.select(F.col("idx").cast("long").alias("idx"), line), ["idx"], "\ufeff" + ",".join(names), folder, name)


def first_rows(photos: DataFrame, *more: str) -> DataFrame:
    """The 14 columns of the first pipeline's report (and more of the catalog's)."""
    c = F.col
    # The headings.
    return photos.select(
        c("filename").alias("文件名"), c("path").alias("路径"), c("clarity_score").alias("清晰度"), c("exposure_score").alias("曝光"), c("contrast_score").alias("对比度"), c("total_score").alias("综合评分"), c("auto_category").alias("自动分类"),
        c("manual_category").alias("手动分类"), c("notes").alias("备注"), F.coalesce(c("similar_group_id").cast("string"), F.lit("")).alias("相似组"), F.when(c("recommended_in_group"), "是").otherwise("否").alias("相似组推荐"),
        generations.resolution_text(c("width"), c("height")).alias("分辨率"), c("file_size_mb").alias("文件大小MB"), c("taken_at").alias("拍摄时间"), *more,
    )


def write_first_report(photos: DataFrame, folder: str) -> str:
    return _csv_file(first_rows(photos, "idx"), folder, "photo_report.csv")


def write_no_export(photos: DataFrame, path: str) -> None:
    line = F.concat(F.lit("- "), F.col("filename"), F.lit(" | "), F.col("path"), F.lit(" | "), F.coalesce(F.col("review_note"), F.lit("")))
    photos.where(review.not_exported()).orderBy("idx").select(line.alias("value")).write.mode("overwrite").text(path)


def markdown_lines(photos: DataFrame, title: str = "筛片复盘报告") -> DataFrame:
    """The report as lines: section, part, at (the order in a part), id and value. Counts are collected; the lists of photos and groups are whole and stay distributed."""
    total = totals(photos).first()
    n = max(1, total["total"])
    found: dict[str, list] = {}
    for r in all_counts(photos).collect():  # one row a value of the vocabulary
        found.setdefault(r["dimension"], []).append((r["value"], r["n"]))

    def table(name: str, head: str) -> list[str]:
        rows = sorted(found.get(name, []), key=lambda x: (-x[1], x[0]))
        return [f"| {head} | 数量 |", "|---|---:|", *(f"| {v} | {c} |" for v, c in rows)] if rows else ["暂无记录。"]

    def line(*cells: Column) -> Column:
        return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(c.cast("string"), F.lit("None")) for c in cells)), F.lit(" |"))

    def listed(rows: DataFrame, at: str, value: Column) -> DataFrame:
        number = F.col(at).cast("long") if at == "idx" else F.lit(0).cast("long")
        return rows.select(number.alias("at"), F.col(at).cast("string").alias("id"), value.alias("value"))

    def photo_list(condition: Column) -> tuple[list[str], str, DataFrame]:
        rows = photos.where(condition)
        return ["| 文件名 | 类型 | 品质 | 备注 |", "|---|---|---|---|"], "暂无照片。", listed(rows, "idx", line(F.col("filename"), F.concat_ws(" / ", safe_type(), safe_subtype()), safe_rating(), S.filled(F.col("review_note"), "-")))

    ratings = dict(found.get("quality_rating", []))
    groups = listed(group_summary(photos), "group_id", line(F.col("group_id"), F.col("n"), S.filled(F.col("best_file"), "-")))
    changed = listed(overrides(photos), "idx", line(F.col("filename"), F.col("ai_text"), F.col("human_text")))
    tags = "、".join(r["tag"] for r in top_tags(photos).collect()) or "暂无集中问题标签"
    sections = [
        ("项目概览", [f"- 照片总数：{total['total']}", f"- 已人工确认：{total['manual_confirmed_count']}", f"- 待复核：{total['needs_review_count']}", f"- 未审：{total['unreviewed_count']}", f"- AI已审：{total['ai_reviewed_count']}"]),
        ("照片类型统计", table("photo_type", "照片类型")),
        ("品质等级统计", ["| 品质等级 | 数量 |", "|---|---:|", *(f"| {V.RATINGS.get(c, c)} | {ratings.get(c, 0)} |" for c in [*V.RATINGS, NO_RATING])]),
        ("交付用途统计", table("delivery_use", "交付用途")),
        ("问题标签统计", table("issue_tags", "问题标签")),
        ("关键指标", [f"- 废片率：{total['reject_count'] / n:.1%}", f"- S/A 级占比：{total['sa_count'] / n:.1%}", f"- 作品集候选率：{total['portfolio_candidate_count'] / n:.1%}"]),
        ("相似组统计", [f"- 相似组数量：{total['similar_group_count']}", f"- 相似组内照片数量：{total['photos_in_groups_count']}", f"- 重复淘汰数量：{total['duplicate_count']}"]),
        ("相似组明细", (["| 组ID | 数量 | 组内最佳 |", "|---|---:|---|"], "暂无相似组记录。", groups)),
        ("AI 建议被人工修改的记录", (["| 文件名 | AI建议 | 人工结果 |", "|---|---|---|"], "暂无明显人工覆盖记录。", changed)),
        ("待复核照片", photo_list(F.coalesce(F.col("review_status"), F.lit("")) == V.NEEDS_REVIEW)),
        ("不导出照片清单", photo_list(review.not_exported())),
        ("本次筛片总结", [f"本次共处理 {total['total']} 张照片，其中 A 级以上照片 {total['sa_count']} 张，废片 {total['reject_count']} 张。主要问题集中在 {tags}。"]),
    ]
    numerals = "一二三四五六七八九十"
    schema = "section int, part int, at long, id string, value string"
    fixed, lists = [(0, 0, 0, "", f"# {title}"), (0, 0, 1, "", "")], []
    for k, (head, lines) in enumerate(sections, 1):
        number = numerals[k - 1] if k <= 10 else "十" + numerals[k - 11]
        own = lines
        if isinstance(lines, tuple):
            own, none, rows = lines
            some = bool(rows.limit(1).count())
            own = own if some else [none]
            if some:
                lists.append(rows.select(F.lit(k).alias("section"), F.lit(1).alias("part"), "at", "id", "value"))
        fixed += [(k, 0, at, "", x) for at, x in enumerate([f"## {number}、{head}", "", *own])]
        fixed.append((k, 2, 0, "", ""))
    out = photos.sparkSession.createDataFrame(fixed, schema)
    for rows in lists:
        out = out.unionByName(rows)
    return out


_LINE_ORDER = ("section", "part", "at", "id")


def write_markdown_file(photos: DataFrame, folder: str, title: str = "筛片复盘报告", name: str = "review_report.md") -> str:
    """The whole report as one file; returns its path."""
    return _text_file(markdown_lines(photos, title), list(_LINE_ORDER), None, folder, name)


def write_markdown(photos: DataFrame, path: str, title: str = "筛片复盘报告") -> None:
    """A folder of text parts, whose lines in the order of the parts are the report."""
    markdown_lines(photos, title).orderBy(*_LINE_ORDER).select("value").write.mode("overwrite").text(path)
