"""Export plan: which photo goes to which folders under which name, and what became of it."""

from __future__ import annotations

import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .. import vocab as V
from ..functions import scalars as S
from ..functions.durable import written


@dataclass(frozen=True)
class Options:
    by_use: bool = True
    by_type: bool = True
    include_rejects: bool = False
    include_no_export: bool = False
    report_only: bool = False
    csv: bool = True
    markdown: bool = True


def options_from_mode(mode: str, **switches: bool) -> Options:
    """Options of a mode's text; one that begins with 只生成报告 copies nothing, and one that names reports makes both."""
    reports = {"csv": switches.pop("csv", True) or "报告" in mode, "markdown": switches.pop("markdown", True) or "报告" in mode}
    return Options(report_only=mode.strip().startswith("只生成报告"), **switches, **reports)


def fresh_folder(base: str, now: str) -> str:
    """base if it is missing or empty; otherwise base_now, or the first base_now_NN that is free."""
    store, at = store_of(base)
    if not store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
        return base
    found, n = f"{base}_{now}", 0
    while store.get_file_info(store_of(found)[1]).type != fs.FileType.NotFound:
        n += 1
        found = f"{base}_{now}_{n:02d}"
    return found


def category_plan(photos: DataFrame, category: Column) -> DataFrame:
    """The first pipeline's copies: one a photo, into the folder of its category."""
    return photos.select("idx", "path", "filename", category.alias("destination")).withColumn("target", unique_name(["destination"], "filename")).select("idx", "path", "destination", "target")


def rating_folder(code: Column) -> Column:
    known = V.lookup({k: f"{k}_{v.replace('/', '')}" for k, v in V.RATINGS.items()}, F.coalesce(code, F.lit("")))
    return F.coalesce(known, F.lit("未评级"))


def destinations(options: Options = Options()) -> Column:
    """Folders of a row, each once, in order; none if it isn't exported."""
    none = F.array().cast("array<string>")
    uses, code = F.coalesce(F.col("delivery_use"), none), F.coalesce(F.col("quality_rating"), F.lit(""))
    barred, reject, duplicate = F.array_contains(uses, V.NO_EXPORT), code == "X", F.coalesce(F.col("similar_group_status"), F.lit("")) == "duplicate"
    stop = (reject & F.lit(not options.include_rejects)) | ((barred | duplicate) & F.lit(not options.include_no_export))
    own = F.array_remove(uses, V.NO_EXPORT)
    picked = F.when((F.size(own) == 0) & code.isin("S", "A"), F.array(F.lit("客户可选"))).otherwise(own)
    folders = F.array_compact(F.transform(picked, lambda u: V.lookup(V.USE_FOLDERS, u)))
    by_use = F.when(F.lit(options.by_use) & ~barred, folders).otherwise(none)
    path = F.concat_ws("/", F.lit(V.TYPE_FOLDER), S.safe_name(F.col("photo_type"), "未分类"), S.safe_name(F.col("subtype"), "未细分"), rating_folder(F.col("quality_rating")))
    by_type = F.array(path) if options.by_type else none
    return F.when(stop | F.lit(options.report_only), none).otherwise(F.array_distinct(F.concat(by_use, by_type)))


def plan(photos: DataFrame, options: Options = Options()) -> DataFrame:
    """idx, path, destination and target name of every copy; equal names in a folder get _001, _002 and so on, in input order."""
    out = photos.select("idx", "path", "filename", F.explode(destinations(options)).alias("destination"))
    return out.withColumn("target", unique_name(["destination"], "filename")).select("idx", "path", "destination", "target")


def unique_name(within: list[str], name: str) -> Column:
    nth = F.row_number().over(Window.partitionBy(*within, name).orderBy("idx")) - 1
    extension = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    return F.when(nth == 0, F.col(name)).otherwise(F.concat(F.regexp_replace(F.col(name), r"\.[^.]*$", ""), F.format_string("_%03d", nth), extension))


def records(photos: DataFrame, options: Options = Options()) -> DataFrame:
    """path, destinations, and the status before any file is copied."""
    where = destinations(options)
    status = F.when(F.lit(options.report_only), "report_only").when(F.size(where) == 0, "skipped_no_export").otherwise("planned")
    return photos.select("path", where.alias("destinations"), status.alias("export_status"))


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path or URI names, and the path in it, in which any letters may stand."""
    found = re.fullmatch(r"([A-Za-z][\w+.-]*:)(//[^/]*)?(/.*)", path, re.DOTALL)
    if not found:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(f"{found[1]}{found[2] or '//'}/")[0], found[3]


def _same(a: tuple[fs.FileSystem, str], b: tuple[fs.FileSystem, str], block: int = 1 << 20) -> bool:
    if a[0].get_file_info(a[1]).size != b[0].get_file_info(b[1]).size:
        return False
    with a[0].open_input_stream(a[1]) as x, b[0].open_input_stream(b[1]) as y:
        while own := x.read(block):
            if own != y.read(block):
                return False
    return True


def copy_file(source: str, target: str, staging: str) -> None:
    """Copies a file by way of a staging folder, from which it is moved once it is whole. A target that holds the same bytes counts as copied by an earlier try of the task; one that holds others is an error and stays."""
    (own, at), (store, to), (_, part) = store_of(source), store_of(target), store_of(f"{staging}/{uuid.uuid4().hex}")
    if store.get_file_info(to).type != fs.FileType.NotFound:
        if not _same((own, at), (store, to)):
            raise FileExistsError(target)
        return
    with own.open_input_stream(at) as x:
        store.create_dir(part.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(part) as y:
            shutil.copyfileobj(x, y, 1 << 20)
    if isinstance(own, fs.LocalFileSystem) and isinstance(store, fs.LocalFileSystem):
        shutil.copystat(at, part)
    store.create_dir(to.rsplit("/", 1)[0], recursive=True)
    store.move(part, to)


#: Files that a task copies, writes or reads, on average: their rows are small, but each costs the file system a round trip.
FILES = 5_000


def dealt(files: DataFrame) -> DataFrame:
    """files over as many tasks as their number asks for, however small their rows are."""
    return files.repartition(files.count() // FILES + 1)


def contents(files: DataFrame, path: str) -> DataFrame:
    """Adds content (binary) of the file that a path or URI names, NULL where there is none. Tasks open the files by their paths, so no folder is listed in the driver."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(path).to_pylist():
                try:
                    if name is not None:
                        store, at = store_of(name)
                        with store.open_input_stream(at) as f:
                            found.append(f.read())
                    else:
                        found.append(None)
                except FileNotFoundError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, "content"])

    return dealt(files).mapInArrow(read, StructType([*files.schema.fields, StructField("content", BinaryType())]))


def run(photos: DataFrame, root: str, options: Options = Options()) -> DataFrame:
    """Copies originals by executors to a shared root (a path or URI) and returns path, exported_paths, export_status and export_error.

    Nothing is overwritten, and a row with one good copy is exported. What tasks have seen is written once, so reading the
    result copies nothing again; then the staging folder goes, with whatever lost executors have left in it.
    """
    staging = f"{root}/.staging-{uuid.uuid4().hex}"

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            done, errors = [], []
            for source, folder, name in zip(frame["path"], frame["destination"], frame["target"]):
                target = f"{root}/{folder}/{name}"
                try:
                    copy_file(source, target, staging)
                    done.append(target), errors.append(None)
                except (OSError, pa.ArrowException) as e:
                    done.append(None), errors.append(f"{folder}: {e}")
            yield frame.assign(done=done, error=errors)[["path", "done", "error"]]

    copies = dealt(written(plan(photos, options).select("path", "destination", "target"))).mapInPandas(copied, "path string, done string, error string")
    each = written(copies.groupBy("path").agg(F.array_sort(F.array_compact(F.collect_list("done"))).alias("exported_paths"), F.array_join(F.array_sort(F.array_compact(F.collect_list("error"))), "；").alias("export_error")))
    store, at = store_of(staging)
    if store.get_file_info(at).type == fs.FileType.Directory:
        store.delete_dir(at)
    none = F.array().cast("array<string>")
    status = F.when(F.col("export_status") != "planned", F.col("export_status")).when(F.size("exported_paths") > 0, "exported").otherwise("failed")
    return records(photos, options).join(each, "path", "left").select("path", F.coalesce("exported_paths", none).alias("exported_paths"), status.alias("export_status"), F.coalesce("export_error", F.lit("")).alias("export_error"))


def status_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("export_status").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Result:
    folder: str
    done: DataFrame  # path, exported_paths, export_status and export_error
    csv: str | None
    markdown: str | None


def export(photos: DataFrame, base: str, now: str, options: Options = Options()) -> Result:
    """A whole export into a fresh folder: copies, then the reports that the options ask for, below 00_报告."""
    from . import report

    folder = fresh_folder(base, now)
    done = written(records(photos, options).withColumns({"exported_paths": F.array().cast("array<string>"), "export_error": F.lit("")}).drop("destinations") if options.report_only else run(photos, folder, options))
    reports = f"{folder}/00_报告"
    csv = report.write_csv_file(photos, f"{reports}/csv", done) if options.csv else None
    markdown = None
    if options.markdown:
        markdown = f"{reports}/markdown"
        report.write_markdown(photos, markdown)
    return Result(folder, done, csv, markdown)


def export_photos(photos: DataFrame, base: str, now: str, options: Options = Options()) -> tuple[str, str | None, DataFrame]:
    """The folder, the path of a report, and what became of each photo."""
    result = export(photos, base, now, options)
    return result.folder, result.csv or result.markdown, result.done


def report_now(photos: DataFrame, base: str, now: str) -> str | None:
    """Only the reports."""
    result = export(photos, base, now, options_from_mode("只生成报告", by_use=False, by_type=False))
    return result.csv or result.markdown
