"""Photo files, the catalog table, sample logs, the aesthetic library and settings."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import vocab as V
from ..functions import scalars as S

_TEXT = "filename thumbnail_path taken_at manual_category final_category user_note ai_primary_category ai_secondary_category ai_source people_label shooting_type similar_group_id user_label user_label_time user_preference_reason preference_model_version scene_group_id outfit_group_id pose_sequence_id ai_reason preference_reason final_reason embedding_path ai_device main_subject_bbox embedding_model embedding_created_at image_feature_hash screening_reason style_label retouch_suggestion crop_suggestion portfolio_suggestion delivery_suggestion final_recommendation photo_type subtype quality_rating ai_suggestion human_decision review_status review_note similar_group_status similar_group_note ai_similarity_reason human_group_decision similarity_hash".split()
_REAL = "file_size_mb ai_confidence user_preference_score absolute_quality_score relative_quality_score ai_runtime_ms semantic_score semantic_confidence final_pick_score subject_area_ratio subject_center_score edge_cutoff_risk group_photo_score detection_confidence aesthetic_like_similarity aesthetic_dislike_similarity commercial_score portfolio_score similarity_score similarity_hash_mtime".split()
_WHOLE = "width height people_count similar_group_size group_rank group_size ai_batch_size detected_person_count similar_reference_count similar_group_rank".split()
_FLAG = "manual_override recommended_keep recommended_in_group embedding_cached best_in_group ai_recommended_best".split()
_LIST = "ai_quality_tags appearance_tags top3_semantic_matches delivery_use issue_tags".split()
_DEFAULTS = {"manual_category": V.DEFAULT_MANUAL, "review_status": V.UNREVIEWED}

PHOTO_SCHEMA = T.StructType(
    [T.StructField("path", T.StringType(), False)]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
    + [T.StructField(c, T.DoubleType()) for c in _REAL]
    + [T.StructField(c, T.IntegerType()) for c in _WHOLE]
    + [T.StructField(c, T.BooleanType()) for c in _FLAG]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in _LIST]
    + [T.StructField("updated_at", T.StringType())]
)

#: Present name: the names it had before, in order of preference.
LEGACY = {"manual_category": ["label"], "user_note": ["notes"], "final_category": ["ai_recommended_category"], "ai_source": ["ai_device", "ai_backend"], "review_note": ["user_note", "notes"]}


def default_of(column: str) -> Column:
    kind = PHOTO_SCHEMA[column].dataType
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    plain = {T.StringType: _DEFAULTS.get(column, ""), T.DoubleType: 0.0, T.IntegerType: 0, T.BooleanType: False}[type(kind)]
    return F.lit(plain).cast(kind)


def migrated(saved: DataFrame) -> DataFrame:
    """Any older table as PHOTO_SCHEMA: missing columns get defaults, lists are read from JSON text, renamed columns fill blank ones."""
    out = []
    for f in PHOTO_SCHEMA.fields:
        c = F.col(f.name) if f.name in saved.columns else F.lit(None)
        if isinstance(f.dataType, T.ArrayType):
            typed = S.decode_tags(c) if f.name in saved.columns and isinstance(saved.schema[f.name].dataType, T.StringType) else c.cast(f.dataType)
        else:
            typed = c.cast(f.dataType)
        old = [F.col(o).cast("string") for o in LEGACY.get(f.name, []) if o in saved.columns]
        if f.name == "manual_category" and old:  # an old label replaces the default only
            typed = F.when(S.filled(typed, V.DEFAULT_MANUAL) == V.DEFAULT_MANUAL, S.filled(*old, typed)).otherwise(typed)
        elif old:
            typed = S.filled(typed, *old)
        if f.name == "path":
            out.append(typed.alias("path"))
        elif isinstance(f.dataType, T.StringType) and _DEFAULTS.get(f.name):
            out.append(S.filled(typed, _DEFAULTS[f.name]).alias(f.name))
        else:
            out.append(F.coalesce(typed, default_of(f.name)).alias(f.name))
    return saved.select(*out)


def storage_rows(photos: DataFrame) -> DataFrame:
    """Flags as 0 or 1 and lists as JSON text."""
    one = lambda f: F.col(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else S.encode_tags(F.col(f.name)) if isinstance(f.dataType, T.ArrayType) else F.col(f.name)
    return photos.select(*(one(f).alias(f.name) for f in photos.schema.fields))


FIRST_STORED = (
    "path", "filename", "thumbnail_path", "width", "height", "file_size_mb", "taken_at", "orientation", "clarity_score", "exposure_score", "contrast_score", "resolution_score", "perceptual_hash", "similarity_bonus", "total_score",
    "auto_category", "manual_category", "notes", "similar_group_id", "recommended_in_group", "is_duplicate",
)


def first_storage_rows(photos: DataFrame) -> DataFrame:
    """The first pipeline's stored columns, as far as photos have them; flags as 0 or 1, and no thumbnail as blank."""
    flags = {"recommended_in_group", "is_duplicate"}
    one = lambda c: F.col(c).cast("int") if c in flags else F.coalesce(c, F.lit("")) if c == "thumbnail_path" else F.col(c)
    return photos.select(*(one(c).alias(c) for c in FIRST_STORED if c in photos.columns))


# -- scans


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """path, filename, file_size_mb and mtime of photos below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    out = files.where(S.suffix(F.col("path")).isin(extensions or V.PHOTO_EXTENSIONS))
    if excluded:
        out = out.where(~F.arrays_overlap(F.split("path", "/"), V.array_of(excluded)))
    return out.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), F.round(F.col("length") / 1048576, 2).alias("file_size_mb"), F.col("modificationTime").cast("double").alias("mtime"))


def scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark, folder, V.RAW_EXTENSIONS)


def images(spark: SparkSession, folder: str) -> DataFrame:
    """path and decoded image; files that are none are dropped."""
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", True).load(folder).select(F.col("image.origin").alias("path"), "image")


def capture_times(files: DataFrame) -> DataFrame:
    """path and taken_at of JPEG contents (column content): the first of three EXIF tags that isn't empty."""

    @F.pandas_udf("string")
    def read(content: pd.Series) -> pd.Series:
        return content.map(exif_text)

    return files.select("path", S.exif_time(read("content")).alias("taken_at"))


def exif_text(content: bytes) -> str:
    """The raw text of the capture time in a JPEG's EXIF block, or nothing."""
    import struct

    at = content.find(b"Exif\0\0") if content else -1
    if at < 0 or len(content) < at + 14:
        return ""
    base = at + 6
    order = "<" if content[base : base + 2] == b"II" else ">"
    found: dict[int, str] = {}

    def walk(offset: int, depth: int) -> None:
        n = struct.unpack_from(order + "H", content, base + offset)[0]
        for i in range(n):
            tag, kind, count, value = struct.unpack_from(order + "HHII", content, base + offset + 2 + 12 * i)
            if tag == 0x8769 and depth == 0:
                walk(value, 1)
            elif tag in (36867, 36868, 306) and kind == 2 and count > 4:
                found[tag] = content[base + value : base + value + count].split(b"\0")[0].decode("ascii", "replace")

    try:
        walk(struct.unpack_from(order + "I", content, base + 4)[0], 0)
    except struct.error:
        pass
    return next((found[t] for t in (36867, 36868, 306) if found.get(t, "").strip()), "")


def build_rows(files: DataFrame, saved: DataFrame | None, threshold: float = 0.65) -> DataFrame:
    """One catalog row a file: what is saved under its path, or defaults; final categories are made anew."""
    from ..operators import review

    if saved is None:
        saved = files.sparkSession.createDataFrame([], PHOTO_SCHEMA)
    own = [c for c in files.columns if c in PHOTO_SCHEMA.names and c != "path"]
    left = files.select("path", *(F.col(c).alias(f"file_{c}") for c in own)).join(migrated(saved), "path", "left")
    out = left.select("path", *(F.coalesce(F.col(f"file_{c}") if c in own else F.lit(None), F.col(c), default_of(c)).alias(c) for c in PHOTO_SCHEMA.names if c != "path"))
    return out.withColumn("final_category", review.final_category(threshold))


def imported(files: DataFrame, decoded: DataFrame, saved: DataFrame | None = None, batch: int = 40) -> tuple[DataFrame, DataFrame]:
    """Catalog rows of files whose pictures could be read, with their batch, and the skipped files with the reason.

    decoded has path, width, height, taken_at and error (NULL: read); a file that it lacks is skipped too. One bad file costs no other.
    """
    from ..operators.panel import batches

    both = files.join(decoded, "path", "left")
    bad = F.col("error").isNotNull() | F.col("width").isNull()
    rows = build_rows(both.where(~bad).drop("error"), saved)
    numbered = batches(rows.withColumn("idx", F.col("path")), batch).drop("idx")
    return numbered, both.where(bad).select("path", F.coalesce("error", F.lit("unreadable")).alias("reason"))


# -- table


def upserted(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """new rows, and old ones whose key isn't among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key with the greatest value of some columns, as one aggregation without a sort."""
    rest = [c for c in rows.columns if c != key]
    first = F.max_by(F.struct(*rest), F.struct(*order))
    return rows.groupBy(key).agg(first.alias("row_")).select(key, *(F.col(f"row_.{c}").alias(c) for c in rest))


#: For ``save``: whatever has been committed before.
ANY = -1

#: Deltas after which a table is written anew as one snapshot.
COMPACT_AFTER = 20


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _committed(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """version, kind (delta or snapshot) and name of what the table consists of, oldest first: the last snapshot and the deltas after it."""
    files, at = _files(spark, path)
    if not files.exists(at(f"{path}/commits")):
        return []
    found = []
    for status in files.listStatus(at(f"{path}/commits")):
        name = status.getPath().getName()
        if name.isdigit():
            stream = files.open(status.getPath())
            kind, _, data = bytes(stream.readAllBytes()).decode().partition(" ")
            stream.close()
            found.append((int(name), kind, data))
    found.sort()
    last = max((n for n, (_, kind, _) in enumerate(found) if kind == "snapshot"), default=0)
    return found[last:]


def _commit(spark: SparkSession, path: str, version: int, kind: str, name: str) -> bool:
    """Makes the commit file of a version, which must not exist yet; whether that was so."""
    files, at = _files(spark, path)
    where = at(f"{path}/commits/{version:012d}")
    try:
        stream = files.create(where, False)
    except Exception as e:
        if files.exists(where):
            return False
        raise e
    stream.write(bytearray(f"{kind} {name}".encode()))
    stream.close()
    return True


def save(spark: SparkSession, new: DataFrame, path: str, after: int | None = ANY) -> int | None:
    """Upserts new rows into a table by path; returns the version. With after (a version, None: no table yet), only if no other has been committed since: else nothing is, and the result is None.

    Only the new rows are written, as a delta that counts once its commit file exists. Two
    writers can't make the same commit file: the second one takes the next version. After
    COMPACT_AFTER deltas the table is written as one snapshot; files that no commit before the last snapshot's is needed for stay until ``vacuum``.
    """
    stamped = new.withColumn("updated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    name = uuid.uuid4().hex
    stamped.write.parquet(f"{path}/data/{name}")
    while True:
        parts = _committed(spark, path)
        version = parts[-1][0] + 1 if parts else 0
        if after != ANY and version != (0 if after is None else after + 1):
            return None  # the delta stays for vacuum
        if _commit(spark, path, version, "delta", name):
            break
    if len(parts) >= COMPACT_AFTER:
        whole = uuid.uuid4().hex
        load(spark, path, version).write.parquet(f"{path}/data/{whole}")
        _commit(spark, path, version + 1, "snapshot", whole)  # if another delta came first, the next save tries again
    return version


def current(spark: SparkSession, path: str) -> int | None:
    """The last version of a table; None if there is no table."""
    parts = _committed(spark, path)
    return parts[-1][0] if parts else None


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a table, up to a version: of each path the newest, as one aggregation."""
    parts = [p for p in _committed(spark, path) if version is None or p[0] <= version]
    own = [migrated(spark.read.parquet(f"{path}/data/{name}")).withColumn("version_", F.lit(v)) for v, _, name in parts]
    if len(own) == 1:
        return own[0].drop("version_")
    rows = own[0]
    for o in own[1:]:
        rows = rows.unionByName(o)
    return latest(rows, "path", F.col("version_")).drop("version_")


def vacuum(spark: SparkSession, path: str) -> int:
    """Removes the data of commits before the last snapshot, and data that was never committed; returns how many folders went. Not while others write."""
    files, at = _files(spark, path)
    used = {name for _, _, name in _committed(spark, path)}
    gone = [s.getPath() for s in files.listStatus(at(f"{path}/data")) if s.getPath().getName() not in used]
    for g in gone:
        files.delete(g, True)
    return len(gone)


# -- sample log and library

SAMPLE_SCHEMA = "time string, path string, filename string, user_label string, reason string, features array<double>, ai_primary_category string, ai_secondary_category string, ai_quality_tags array<string>, manual_category string, final_category string, similar_group_id string"


def append_samples(samples: DataFrame, path: str) -> None:
    samples.write.mode("append").json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """The sample log; lines that are no JSON are skipped."""
    return spark.read.schema(SAMPLE_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def library_images(spark: SparkSession, path: str) -> DataFrame:
    """image and tags of a library file ({folders, images: {path: [tag]}}); unknown tags are dropped."""
    raw = spark.read.schema("folders array<string>, images map<string,array<string>>").option("multiLine", True).json(path)
    return raw.select(F.explode("images").alias("image", "tags")).withColumn("tags", F.array_intersect("tags", V.array_of(V.AESTHETIC_TAGS)))


def write_library(known: DataFrame, folders: list[str], path: str, images_per_file: int = 10_000) -> None:
    """A library (image and tags) as JSON documents of at most about images_per_file images each, one a file."""
    files = max(1, -(-known.count() // images_per_file))
    part = F.pmod(F.xxhash64("image"), F.lit(files))
    images = F.map_from_entries(F.collect_list(F.struct("image", "tags"))).alias("images")
    documents = known.groupBy(part.alias("part")).agg(images).select(F.array(*map(F.lit, folders)).alias("folders"), "images")
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def library_scanned(known: DataFrame, files: DataFrame) -> DataFrame:
    """Known images with their tags, and new files with none."""
    new = files.select(F.col("path").alias("image")).join(known.select("image"), "image", "left_anti")
    return known.select("image", "tags").unionByName(new.withColumn("tags", F.array().cast("array<string>")))


def with_folder(folders: Column, folder: str) -> Column:
    return F.array_union(folders, F.array(F.lit(folder)))


def without_folder(folders: Column, folder: str) -> Column:
    return F.array_remove(folders, folder)


def tagged_images(known: DataFrame, tags: DataFrame) -> DataFrame:
    """Sets the tags of the images in tags (image, tags), without those that aren't in the vocabulary."""
    new = tags.select("image", F.array_intersect("tags", V.array_of(V.AESTHETIC_TAGS)).alias("tags"))
    return upserted(known.select("image", "tags"), new, "image")


def oriented(width: Column, height: Column, orientation: Column) -> Column:
    """Width and height after the EXIF orientation: 5 to 8 swap them."""
    turned = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    """n_files and size_mb below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("length")
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.round(F.coalesce(F.sum("length"), F.lit(0)) / 1048576, 2).alias("size_mb"))


def tag_counts(library: DataFrame) -> DataFrame:
    return library.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def cached(items: DataFrame, cache: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Items whose value is in a cache under equal keys, and those to be computed."""
    both = items.join(cache.select(*keys, value), keys, "left")
    return both.where(F.col(value).isNotNull()), both.where(F.col(value).isNull()).drop(value)


def cached_by_time(items: DataFrame, cache: DataFrame, value: str, tolerance: float = 0.0001) -> tuple[DataFrame, DataFrame]:
    """Items (path, mtime) whose value is in a cache made at the same time of the file, and those to be computed."""
    kept = cache.select("path", F.col("mtime").alias("cached_at_"), value)
    both = items.join(kept, "path", "left")
    fresh = F.coalesce(F.abs(F.col("cached_at_") - F.col("mtime")) < tolerance, F.lit(False))
    return both.where(fresh).drop("cached_at_"), both.where(~fresh).drop("cached_at_", value)


def write_cache(rows: DataFrame, path: str) -> None:
    """Appends rows to a cache; nothing is overwritten, so readers and writers don't meet."""
    rows.write.mode("append").parquet(path)


def read_cache(spark: SparkSession, path: str, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of a cache, as one aggregation."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row_")).select(*keys, *(F.col(f"row_.{c}").alias(c) for c in rest))


def canonical_json(text: Column) -> Column:
    """JSON without white space, with keys in their order and letters as they are; other text unchanged. In Arrow batches, as the JVM's JSON sorts or drops."""

    def plain(value: str | None) -> str:
        if not value:
            return ""
        try:
            return json.dumps(json.loads(value), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return value

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(plain)

    return run(text)


# -- settings (driver side)


@dataclass
class Settings:
    confidence_threshold: float = 0.58
    similarity_hamming_threshold: int = 6
    similarity_mode: str = "standard"
    screening_strategy: str = "delivery"
    model_profile: str = "balanced"
    batch_size: int = 16
    min_keep_per_group: int = 1
    max_keep_per_group: int = 3
    max_pending_ratio: float = 0.25
    target_pick_ratio: float = 0.20
    import_batch_size: int = 40
    max_compare_images: int = 4
    preview_max_size: int = 1600
    scoring_weights: dict = field(default_factory=lambda: {k: list(v) for k, v in V.PICK_WEIGHTS.items()})

    def __post_init__(self) -> None:
        self.confidence_threshold = min(1.0, max(0.0, float(self.confidence_threshold)))
        self.similarity_hamming_threshold = min(64, max(0, int(self.similarity_hamming_threshold)))
        self.batch_size, self.import_batch_size = max(1, int(self.batch_size)), max(1, int(self.import_batch_size))
        self.max_pending_ratio, self.target_pick_ratio = min(1.0, max(0.0, float(self.max_pending_ratio))), min(1.0, max(0.01, float(self.target_pick_ratio)))
        self.min_keep_per_group = max(1, int(self.min_keep_per_group))
        self.max_keep_per_group = max(self.min_keep_per_group, int(self.max_keep_per_group))
        self.max_compare_images = max(2, int(self.max_compare_images))
        if self.model_profile not in ("fast", "balanced", "accurate", "ultra"):
            self.model_profile = "balanced"
        if self.similarity_mode not in V.HAMMING_BY_MODE:
            self.similarity_mode = "standard"
        if self.screening_strategy not in V.PICK_WEIGHTS:
            self.screening_strategy = "delivery"
        self.scoring_weights = {k: list(v) for k, v in V.PICK_WEIGHTS.items()} | dict(self.scoring_weights)

    def batch_for_profile(self) -> int:
        return {"fast": max(self.batch_size, 32), "accurate": min(self.batch_size, 12), "ultra": min(self.batch_size, 8)}.get(self.model_profile, self.batch_size)

    def merged_with(self, **changes: object) -> Settings:
        known = {f.name for f in fields(self)}
        return Settings(**(asdict(self) | {k: v for k, v in changes.items() if k in known}))


def read_settings(path: str) -> Settings:
    """Settings of a JSON file; unknown keys are ignored, and without a file they are the defaults."""
    if not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        return Settings().merged_with(**json.load(f))


def write_settings(settings: Settings, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, ensure_ascii=False, indent=2)


def presets(spark: SparkSession, folder: str) -> DataFrame:
    """preset, name and weight of the preset files of a folder or path."""
    from . import session

    found = spark.read.text(folder, wholetext=True).select(F.explode(session.plain_presets(F.col("value"))).alias("preset", "own"))
    return found.select("preset", F.explode("own").alias("name", "weight"))
