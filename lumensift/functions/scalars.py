"""Scalar, array and JSON functions over columns; all stay in the JVM.

Blank text, not NULL, means missing in the catalog, so most functions treat NULL
and blank alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab as V


# -- text


def filled(c: Column, *others: Column | str) -> Column:
    """The first that is neither NULL nor blank text; the last as it is."""
    values = [x if isinstance(x, Column) else F.lit(x) for x in (c, *others)]
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in values[:-1]), values[-1])


def blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def safe_name(value: Column, default: str) -> Column:
    """A folder or file name: nine characters that file systems forbid become ``_``; blanks and final dots go."""
    plain = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r'[<>:"/\\|?*]', "_")
    return F.coalesce(F.nullif(F.rtrim(plain, F.lit(" .")), F.lit("")), F.lit(default))


def suffix(name: Column) -> Column:
    """The last extension in lower case, without dot; blank if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*\.([^./]+)$", 1))


def stem(name: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^./]*$", "")


def safe_file_name(name: Column) -> Column:
    """A safe stem with its extension, ``.jpg`` where there is none."""
    extension = F.regexp_extract(name, r"[^/.][^/]*(\.[^./]+)$", 1)
    return F.concat(safe_name(stem(name), "未命名"), F.when(extension == "", F.lit(".jpg")).otherwise(extension))


def joined(values: Column, separator: str = "、") -> Column:
    """Non-blank members of an array joined for reading."""
    return F.array_join(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x != ""), separator)


def has_keyword(text: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(text, F.lit(k))
    return out


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed number of digits; halves of its binary value go to the even digit."""
    return F.regexp_replace(F.format_number(x, digits), ",", "")


def rounded(x: Column, digits: int) -> Column:
    """A number rounded by its binary value, halves to the even digit."""
    return fixed(x, digits).cast("double")


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


# -- numbers


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def safe_score(text: Column) -> Column:
    """An integer from 0 to 100; what is no number is 0."""
    return clamp(F.coalesce(F.floor(text.try_cast("double")).cast("double"), F.lit(0.0))).cast("int")


def half_even(x: Column, digits: int) -> Column:
    """Rounding with ties to the even digit."""
    return F.bround(x, digits)


def megapixels(width: Column, height: Column) -> Column:
    return width * height / 1_000_000


def orientation(width: Column, height: Column) -> Column:
    return F.when(height >= width, "竖图").otherwise("横图")


def orientation3(width: Column, height: Column) -> Column:
    """Landscape, portrait or square."""
    return F.when(width > height, "横幅").when(height > width, "竖幅").otherwise("方图")


def fit_size(width: Column, height: Column, edge: int) -> Column:
    """Width and height scaled down to a longest edge, never up."""
    longest = F.greatest(width, height)
    ratio = F.when(longest > edge, edge / longest).otherwise(F.lit(1.0))
    return F.struct(F.greatest(F.lit(1), F.floor(width * ratio)).cast("int").alias("width"), F.greatest(F.lit(1), F.floor(height * ratio)).cast("int").alias("height"))


def thumbnail_tier(size: Column) -> Column:
    """Width and height of the thumbnails that a list of a size shows."""
    tier = lambda w, h: F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))
    return F.when(size <= 130, tier(240, 180)).when(size <= 180, tier(320, 240)).otherwise(tier(440, 330))


def people_label(count: Column) -> Column:
    return F.when(count <= 0, "none").when(count == 1, "single_person").when(count == 2, "two_people").when(count == 3, "three_people").otherwise("group_people")


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of boxes (x, y, w, h)."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union == 0, F.lit(0.0)).otherwise(w * h / union)


def euclidean(a: Column, b: Column) -> Column:
    """Distance over the shorter vector's length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))


# -- hashes


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_to_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def hash_from_hex(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def hamming_hex(a: Column, b: Column) -> Column:
    return F.when(blank(a) | blank(b), 64).otherwise(hamming(hash_from_hex(a), hash_from_hex(b)))


def cache_key(*parts: Column) -> Column:
    """A digest of parts joined by colons."""
    return F.sha1(F.concat_ws(":", *(p.cast("string") for p in parts)))


def thumbnail_name(path: Column, mtime: Column, size: Column, edge: int, mode: str) -> Column:
    return F.concat(stem(path), F.lit("_"), F.substring(cache_key(path, mtime, size, F.lit(edge), F.lit(mode)), 1, 16), F.lit(".jpg"))


# -- time


def exif_time(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of the two EXIF forms; any other text as it is, trimmed."""
    shown = [F.date_format(F.try_to_timestamp(F.trim(text), F.lit(f)), "yyyy-MM-dd HH:mm:ss") for f in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss")]
    return F.coalesce(*shown, F.trim(text), F.lit(""))


def minutes_seconds(seconds: Column) -> Column:
    whole = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def elapsed(started: Column, ended: Column) -> Column:
    return minutes_seconds(F.unix_timestamp(ended) - F.unix_timestamp(started))


# -- lists and JSON


def encode_tags(values: Column) -> Column:
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def decode_tags(text: Column) -> Column:
    """A JSON list as strings; anything else is empty."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def encode_choices(values: Column) -> Column:
    return F.to_json(F.filter(values, lambda x: F.trim(x) != ""))


def decode_choices(text: Column) -> Column:
    return F.filter(decode_tags(text), lambda x: F.trim(x) != "")


def append_once(values: Column, value: Column | str) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.array_contains(values, v), values).otherwise(F.array_append(values, v))


def toggled(values: Column, value: Column | str) -> Column:
    v = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.array_contains(values, v), F.array_remove(values, v)).otherwise(F.array_append(values, v))


def keep_if(*pairs: tuple[Column, str]) -> Column:
    """The texts whose conditions hold, in order, once each."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in pairs))))


def rating_label(code: Column) -> Column:
    return F.coalesce(V.lookup({k: f"{k}：{v}" for k, v in V.RATINGS.items()}, code), code)


def normal_type(value: Column) -> Column:
    return F.when(value.isin(V.PHOTO_TYPES), value).otherwise(V.UNKNOWN_TYPE)
