"""Pixel features: one image in, one typed struct out, in Arrow batches; never a row a pixel.

Images come from Spark's ``image`` source (BGR rows). Face and person detectors are
plug-ins: their boxes arrive as columns. Grey is 0.299 R + 0.587 G + 0.114 B in
integers. Hashes, colours and noise come from small pictures with the kernels and rounding of
``functions.resample``; the scaled mean and deviation, and ``hash_area``, average areas.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.resample import gaussian_blur, halved, resized

FEATURES = (
    "width int, height int, sharpness double, sharpness_gradient double, brightness double, contrast double, noise double, bright_clip double, dark_clip double, edge_density double, "
    "dominant_r int, dominant_g int, dominant_b int, color_std double, white_ratio double, lower_white_ratio double, center_white_ratio double, green_ratio double, blue_ratio double, "
    "hash long, hash_above long, hash_area long, rgb_mean array<double>, rgb_std array<double>, error string"
)

#: Pixels of pictures of one size that are worked on at once (a larger picture alone).
PIXELS = 1 << 18


def to_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB rows from an image struct; alpha is laid on white."""
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    rgb = raw[:, :, 2::-1]
    if channels == 4:
        alpha = raw[:, :, 3:].astype(np.float32) / 255
        rgb = np.round(rgb * alpha + 255 * (1 - alpha)).astype(np.uint8)
    return rgb


def grey(rgb: np.ndarray) -> np.ndarray:
    r, g, b = (rgb[:, :, i].astype(np.uint32) for i in range(3))
    return ((r * 19595 + g * 38470 + b * 7471 + 0x8000) >> 16).astype(np.uint8)


def laplacian_variance(g: np.ndarray) -> float:
    """Population variance of the 4-neighbour Laplacian, borders reflected without the edge."""
    return float(_laplacian_variances(g[:, :, None])[0])


def _by_picture(a: np.ndarray) -> np.ndarray:
    """Rows, columns and pictures as one row of values a picture."""
    return np.ascontiguousarray(np.moveaxis(a, -1, 0)).reshape(a.shape[-1], -1)


def _laplacian_variances(g: np.ndarray) -> np.ndarray:
    x = np.pad(g.astype(np.float64), [(1, 1), (1, 1), (0, 0)], mode="reflect" if min(g.shape[:2]) > 1 else "edge")
    return _by_picture(x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]).var(axis=1)


def gradient(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if min(g.shape[:2]) < 2:
        z = np.zeros(g.shape)
        return z, z
    gy, gx = np.gradient(g.astype(np.float64), axis=(0, 1))
    return gx, gy


def _area_along(x: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
    at = np.linspace(0, len(x), n + 1)
    low = np.minimum(np.floor(at).astype(int), len(x))
    high = np.minimum(low + 1, len(x))
    part = (at - low).reshape(-1, *([1] * (x.ndim - 1)))
    edges = total[low] * (1 - part) + total[high] * part
    return np.diff(edges, axis=0) / (len(x) / n)


def area_resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over equal areas, by cumulative sums with fractional borders."""
    return np.swapaxes(_area_along(np.swapaxes(_area_along(a.astype(np.float64), height), 0, 1), width), 0, 1)


@lru_cache(256)
def _area_band(source: int, target: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean weights of the input pixels, and the product of the weights' matrix with itself: its diagonal and the one beside it. No output pixel of a picture that grows touches more than two input pixels, so there are no others."""
    a = _area_along(np.eye(source), target)
    square = a.T @ a / target
    return a.mean(axis=0), np.diag(square).copy(), np.diag(square, 1).copy()


def area_moments(a: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation over edge x edge pixels of pictures scaled by ``area_resize`` (rows and columns first). Pictures that grow aren't scaled for it: both follow from the input pixels."""
    height, width = a.shape[:2]
    if max(height, width) > edge:
        net = area_resize(a, edge, edge)
        return net.mean(axis=(0, 1)), net.std(axis=(0, 1))

    def banded(x: np.ndarray, band: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        own, beside = (w.reshape(-1, *([1] * (x.ndim - 1))) for w in band[1:])
        out = x * own
        out[1:] += x[:-1] * beside
        out[:-1] += x[1:] * beside
        return out

    down, across = _area_band(height, edge), _area_band(width, edge)
    x = a.astype(np.float64)
    mean = np.tensordot(across[0], np.tensordot(down[0], x, axes=(0, 0)), axes=(0, 0))
    x -= mean
    square = banded(x, down) * np.swapaxes(banded(np.swapaxes(x, 0, 1), across), 0, 1)
    return mean, np.sqrt(np.maximum(0.0, square.sum(axis=(0, 1))))


def resize_to_edge(rgb: np.ndarray, edge: int) -> np.ndarray:
    h, w = rgb.shape[:2]
    if max(h, w) <= edge:
        return rgb
    ratio = edge / max(h, w)
    return np.round(area_resize(rgb, max(1, int(h * ratio)), max(1, int(w * ratio)))).astype(np.uint8)


def noise(g: np.ndarray) -> float:
    """Deviation of what a blur takes from the picture in half its size."""
    return float(_noises(g[:, :, None])[0])


def _noises(g: np.ndarray) -> np.ndarray:
    small = halved(g)
    return _by_picture(small.astype(np.float32) - gaussian_blur(small, 1.2).astype(np.float32)).std(axis=1)


def hash_bits(cells: np.ndarray, inclusive: bool) -> int:
    """Average hash of a small grey picture as a signed number, first cell highest: which cells are above (or at) the mean."""
    flat = cells.ravel().astype(np.float64)
    on = flat >= flat.mean() if inclusive else flat > flat.mean()
    value = int("".join("1" if x else "0" for x in on), 2)
    return value - (1 << flat.size) if value >> (flat.size - 1) else value


def image_features(data: bytes, height: int, width: int, channels: int) -> dict:
    return _features_of([_planes(data, height, width, channels)])[0]


def _planes(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB rows, or one plane that stands for all three."""
    return to_rgb(data, height, width, channels)[:, :, : 1 if channels == 1 else 3]


def _features_of(pictures: list[np.ndarray]) -> list[dict]:
    """Features of pictures of one size and number of planes (``_planes``). Their axis is the last one, so every kernel passes once over all of them."""
    rgb = np.stack(pictures, axis=-1)
    height, width, planes = rgb.shape[:3]
    three = [i % planes for i in range(3)]
    g = grey(rgb) if planes == 3 else rgb[:, :, 0]
    gx, gy = gradient(g)
    small = resized(rgb, 96, 96, "bicubic").astype(np.float32)
    lanczos, area = resized(g, 8, 8, "lanczos"), np.rint(area_resize(g, 8, 8))
    white = (small > 185).all(axis=2)
    r, gr, b = (small[:, :, i] for i in three)
    dominant = resized(rgb, 1, 1, "bicubic")[0, 0, three]
    mean, deviation = (x[three] / 255 for x in area_moments(rgb, 224))
    own = _by_picture(g)
    values = {
        "sharpness": _laplacian_variances(g), "sharpness_gradient": (_by_picture(gx).var(axis=1) + _by_picture(gy).var(axis=1)) * 4, "brightness": own.mean(axis=1), "contrast": own.std(axis=1), "noise": _noises(g),
        "bright_clip": (own >= 250).mean(axis=1), "dark_clip": (own <= 5).mean(axis=1), "edge_density": _by_picture(np.hypot(gx, gy)).mean(axis=1),
        "dominant_r": dominant[0], "dominant_g": dominant[1], "dominant_b": dominant[2], "color_std": _by_picture(small).std(axis=1, dtype=np.float64), "white_ratio": white.mean(axis=(0, 1)), "lower_white_ratio": white[48:].mean(axis=(0, 1)),
        "center_white_ratio": white[24:88, 24:72].mean(axis=(0, 1)), "green_ratio": ((gr > r + 18) & (gr > b + 12)).mean(axis=(0, 1)), "blue_ratio": ((b > r + 18) & (b > gr + 8)).mean(axis=(0, 1)),
    }
    listed = {c: x.tolist() for c, x in values.items()} | {"rgb_mean": mean.T.tolist(), "rgb_std": deviation.T.tolist()}
    return [
        {"width": width, "height": height} | {c: x[i] for c, x in listed.items()}
        | {"hash": hash_bits(lanczos[..., i], True), "hash_above": hash_bits(lanczos[..., i], False), "hash_area": hash_bits(area[..., i], False), "error": None}
        for i in range(len(pictures))
    ]


def _all_features(rows: Iterable[tuple[bytes, int, int, int]]) -> list[dict]:
    """Features of image rows in their order, those of one size together, PIXELS at once; one bad image is a row with an error, not a failed job."""
    names = [c.split()[0] for c in FEATURES.split(", ")]
    out: list[dict] = []
    waiting: dict[tuple[int, ...], list[tuple[int, np.ndarray]]] = {}

    def lacking(e: Exception) -> dict:
        return dict.fromkeys(names) | {"error": f"{type(e).__name__}: {e}"}

    def done(some: list[tuple[int, np.ndarray]]) -> None:
        try:
            for (at, _), found in zip(some, _features_of([x for _, x in some])):
                out[at] = found
        except Exception as e:
            if len(some) == 1:
                out[some[0][0]] = lacking(e)
            else:
                for one in some:
                    done([one])

    for at, row in enumerate(rows):
        out.append({})
        try:
            x = _planes(*row)
        except Exception as e:
            out[at] = lacking(e)
            continue
        some = waiting.setdefault(x.shape, [])
        some.append((at, x))
        if len(some) * max(x.shape[0] * x.shape[1], 96 * 96) >= PIXELS:
            done(waiting.pop(x.shape))
    for some in waiting.values():
        done(some)
    return out


def features(images: DataFrame, key: str = "path") -> DataFrame:
    """key and FEATURES of each row with an ``image`` struct; an image that fails has an error and no features."""
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = pd.DataFrame(_all_features(zip(frame["data"], frame["height"], frame["width"], frame["channels"])), columns=names)
            out.insert(0, "key", frame["key"].to_numpy())
            for c in ("width", "height", "dominant_r", "dominant_g", "dominant_b", "hash", "hash_above", "hash_area"):
                out[c] = out[c].astype("Int64")
            yield out

    flat = images.select(F.col(key).alias("key"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, f"key string, {FEATURES}").withColumnRenamed("key", key)


# -- scores from features, as columns


def basic_quality() -> dict[str, Column]:
    """basic_score, basic_confidence, basic_tags, basic_problems and basic_reason."""
    s, e, c, n = (F.col(x) for x in ("sharpness", "brightness", "contrast", "noise"))
    mp = S.megapixels(F.col("width"), F.col("height"))
    parts = [
        (F.least(F.lit(100.0), s / 2), 0.34), (F.greatest(F.lit(0.0), 100 - F.abs(e - 128) * 100 / 128), 0.24), (F.least(F.lit(100.0), c * 2.2), 0.18), (F.least(F.lit(100.0), mp / 12 * 100), 0.14), (F.greatest(F.lit(0.0), 100 - n * 1.5), 0.10),
    ]
    score = parts[0][0] * parts[0][1]
    for x, w in parts[1:]:
        score = score + x * w
    exposed = (e < 95) | (e > 190)
    problems = S.keep_if((s < 55, "虚焦"), (s.between(55, 110) & (s < 110), "技术可修"), (exposed, "曝光问题"), ((e.between(72, 95) & (e < 95)) | ((e > 190) & (e <= 220)) | (n > 28), "技术可修"), (c < 24, "色彩问题"))
    tags = S.keep_if(
        (s < 55, "清晰度风险"), ((s >= 55) & (s < 110), "轻微模糊"), (s >= 110, "清晰度正常"), (e < 72, "严重欠曝"), ((e >= 72) & (e < 95), "轻微欠曝"), (e > 220, "严重过曝"), ((e > 190) & (e <= 220), "轻微过曝"), (~exposed, "曝光基本正常"),
        (c < 24, "对比度偏低"), (c >= 24, "对比度可用"), (n > 28, "噪点偏高"),
    )
    text = F.concat(F.concat_ws("，", F.when(s < 55, "清晰度不足").otherwise("主体清晰度基本可用"), F.when(exposed, "曝光存在可复核问题").otherwise("曝光较稳定"), F.when(c < 24, "画面对比度偏弱")), F.lit("。"))
    # the order of problems is that of the rules: an exposure problem before a colour problem
    return _module("basic", score, F.lit(0.92), tags, problems, text)


def face_quality() -> dict[str, Column]:
    """From the plug-in's columns: face_boxes (x, y, w, h; largest first), face_clarity, eye_count (-1: unknown), and detector (NULL: none)."""
    n = F.size(F.coalesce(F.col("face_boxes"), F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")))
    box, w, h = F.get(F.col("face_boxes"), F.lit(0)), F.col("width"), F.col("height")
    cx, cy = (box["x"] + box["w"] / 2) / w, (box["y"] + box["h"] / 2) / h
    centre = F.greatest(F.lit(0.0), 1 - (F.abs(cx - 0.5) + F.abs(cy - 0.45)))
    clarity = F.col("face_clarity")
    edge = (box["x"] < w * 0.04) | (box["y"] < h * 0.04) | (box["x"] + box["w"] > w * 0.96) | (box["y"] + box["h"] > h * 0.96)
    none, missing = n == 0, F.col("detector").isNull()
    score = F.when(missing, 50.0).when(none, 58.0).otherwise(F.least(F.lit(100.0), 55 + F.least(F.lit(30.0), clarity / 7) + centre * 15))
    seen = ~missing & ~none
    problems = S.keep_if((seen & (clarity > 45) & (clarity <= 90), "技术可修"), (seen & (clarity <= 45), "虚焦"), (seen & edge, "裁切风险"), (seen & (F.col("eye_count") == 0), "闭眼"))
    tags = S.keep_if((missing, "人脸模型未接入"), (~missing & none, "未检测到人脸"), (seen & (clarity > 90), "主人脸清晰"), (seen & (clarity > 45) & (clarity <= 90), "主人脸略软"), (seen & (clarity <= 45), "主人脸清晰度风险"), (seen & edge, "人脸靠近边缘"), (seen & (F.col("eye_count") == 0), "可能闭眼或眼部遮挡"))
    return _module("face", score, F.when(missing, 0.1).when(none, 0.35).otherwise(0.72), tags, problems, F.lit(""))


def pose_quality() -> dict[str, Column]:
    cut = F.array_contains(F.col("face_problems"), "裁切风险")
    return _module("pose", F.when(cut, 46.0).otherwise(52.0), F.lit(0.12), S.keep_if((F.lit(True), "姿态模型未接入"), (cut, "可能存在裁切风险")), S.keep_if((cut, "裁切风险")), F.lit(""))


def expression_quality() -> dict[str, Column]:
    none = F.coalesce(F.size("face_boxes"), F.lit(0)) <= 0
    shut = ~none & F.array_contains(F.col("face_problems"), "闭眼")
    return _module("expression", F.when(none, 50.0).when(shut, 42.0).otherwise(62.0), F.when(none, 0.12).otherwise(0.22), S.keep_if((none, "表情模型未接入"), (~none, "表情自然度需人工复核"), (shut, "可能存在闭眼或半闭眼风险")), S.keep_if((shut, "闭眼"), (shut, "客户可能不喜欢")), F.lit(""))


def composition_quality() -> dict[str, Column]:
    w, h = F.col("width"), F.col("height")
    aspect, edge, light = w / F.greatest(F.lit(1), h), F.col("edge_density"), F.col("brightness")
    box = F.get(F.col("face_boxes"), F.lit(0))
    cx, cy = (box["x"] + box["w"] / 2) / w, (box["y"] + box["h"] / 2) / h
    faced = box.isNotNull()
    aside = faced & ((cx < 0.18) | (cx > 0.82) | (cy < 0.12) | (cy > 0.82))
    usual, dim = aspect.between(0.72, 1.55), (light < 80) | (light > 200)
    score = 72 - F.when(usual, 0.0).otherwise(5.0) + F.when(aside, -12.0).when(faced, 8.0).otherwise(0.0) - F.when(edge > 42, 8.0).otherwise(0.0) - F.when(dim, 6.0).otherwise(0.0)
    tags = S.keep_if((usual, "常规画幅"), (~usual, "特殊画幅"), (aside, "主体位置靠边"), (faced & ~aside, "主体位置基本可用"), (~faced, "主体位置需人工确认"), (edge > 42, "背景复杂度偏高"), (edge < 14, "背景较简洁"))
    return _module("composition", S.clamp(score), F.when(faced, 0.62).otherwise(0.46), tags, S.keep_if((aside, "裁切风险"), (edge > 42, "背景杂乱"), (dim, "曝光问题")), F.lit(""))


def _module(name: str, score: Column, confidence: Column, tags: Column, problems: Column, reason: Column) -> dict[str, Column]:
    return {f"{name}_score": score, f"{name}_confidence": confidence, f"{name}_tags": tags, f"{name}_problems": problems, f"{name}_reason": reason}


def person_metrics(boxes: Column, width: Column, height: Column) -> Column:
    """Seven metrics of detector boxes (x1, y1, x2, y2, label, score): persons are label 0 with a score from 0.25."""
    persons = F.filter(boxes, lambda b: (b["label"] == 0) & (b["score"] >= 0.25))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    main = F.array_max(F.transform(persons, lambda b, n: F.struct(area(b).alias("a"), (-n).alias("n"), b.alias("b"))))["b"]
    n = F.coalesce(F.size(persons), F.lit(0))
    cx, cy = (main["x1"] + main["x2"]) / 2 / F.greatest(F.lit(1), width), (main["y1"] + main["y2"]) / 2 / F.greatest(F.lit(1), height)
    centre = F.greatest(F.lit(0.0), 1 - F.sqrt((cx - 0.5) * (cx - 0.5) + (cy - 0.5) * (cy - 0.5)) / 0.707)
    edge = (main["x1"] <= width * 0.025) | (main["y1"] <= height * 0.025) | (main["x2"] >= width * 0.975) | (main["y2"] >= height * 0.975)
    whole = lambda c: c.cast("int").cast("string")
    return F.struct(
        n.alias("detected_person_count"), F.coalesce(F.concat_ws(",", *(whole(main[c]) for c in ("x1", "y1", "x2", "y2"))), F.lit("")).alias("main_subject_bbox"),
        F.coalesce(F.greatest(F.lit(0.0), area(main) / F.greatest(F.lit(1), width * height)), F.lit(0.0)).alias("subject_area_ratio"), F.coalesce(centre, F.lit(0.0)).alias("subject_center_score"),
        F.when(edge, 0.72).otherwise(0.0).alias("edge_cutoff_risk"), F.least(F.lit(1.0), n / 6.0).alias("group_photo_score"), F.coalesce(F.array_max(F.transform(persons, lambda b: b["score"])), F.lit(0.0)).alias("detection_confidence"),
    )


#: Modules by name, in the order in which they need each other's columns.
MODULES: dict[str, Callable[[], dict[str, Column]]] = {"basic": basic_quality, "face": face_quality, "pose": pose_quality, "expression": expression_quality, "composition": composition_quality}


def register(name: str, module: Callable[[], dict[str, Column]]) -> None:
    """Adds a module, or puts another in the place of one: a function that returns the columns name_score, name_confidence, name_tags, name_problems and name_reason."""
    MODULES[name] = module


def analyse(photos: DataFrame, modules: dict[str, Callable[[], dict[str, Column]]] | None = None) -> DataFrame:
    """All modules over features and detector columns. A module that can't be planned has score and confidence 0 and its error as reason, and costs no other."""
    none = F.array().cast("array<string>")
    for name, module in (modules or MODULES).items():
        try:
            done = photos.withColumns(module())
            done.schema  # noqa: B018 (a missing column shows here)
            photos = done
        except Exception as e:
            photos = photos.withColumns(_module(name, F.lit(0.0), F.lit(0.0), none, none, F.lit(f"{type(e).__name__}: {str(e).splitlines()[0]}")))
    return photos
