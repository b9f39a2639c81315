"""Resampling of 8-bit pictures with the kernels and the rounding of the original's imaging library.

A pass along one axis is a sparse matrix: each output pixel has a window of input
pixels around its centre, weighted by a kernel that is stretched when the picture shrinks. Weights
are whole numbers of 22 bits, sums are rounded to 8 bits after each pass, columns
first. Since the weights are whole, sums in double precision are exact, and the
matrices are applied to all rows (or pictures of one size) at once.

A Gaussian blur is three box blurs whose radius has a fraction: the outermost pixels of
a box count in part; weights have 24 bits, each pass is rounded, and edges are continued.
"""

from __future__ import annotations

from functools import lru_cache
from math import floor, sqrt

import numpy as np

#: Half the width of each kernel.
SUPPORT = {"lanczos": 3.0, "bicubic": 2.0}
BITS = 22
BOX_BITS = 24


def kernel(kind: str, x: np.ndarray) -> np.ndarray:
    x = np.abs(x)
    if kind == "lanczos":
        return np.where(x < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    near = (1.5 * x - 2.5) * x * x + 1  # the cubic convolution with a = -1/2
    far = -0.5 * (((x - 5) * x + 8) * x - 4)
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(256)
def windows(source: int, target: int, kind: str) -> tuple[tuple[int, np.ndarray], ...]:
    """First input pixel and whole-number weights of each output pixel."""
    scale = source / target
    stretch = max(scale, 1.0)
    reach = SUPPORT[kind] * stretch
    out = []
    for i in range(target):
        centre = (i + 0.5) * scale
        first, end = max(0, int(centre - reach + 0.5)), min(source, int(centre + reach + 0.5))
        w = kernel(kind, (np.arange(first, end) - centre + 0.5) / stretch)
        w = w / (w.sum() or 1.0) * (1 << BITS)
        out.append((first, np.trunc(w + np.where(w < 0, -0.5, 0.5))))
    return tuple(out)


def _along(a: np.ndarray, target: int, kind: str) -> np.ndarray:
    """Resizes the first axis."""
    flat = a.reshape(len(a), -1).astype(np.float64)
    out = np.empty((target, flat.shape[1]), np.uint8)
    for i, (first, w) in enumerate(windows(len(a), target, kind)):
        total = w @ flat[first : first + len(w)] + (1 << (BITS - 1))
        out[i] = np.clip(np.floor(total / (1 << BITS)), 0, 255)
    return out.reshape(target, *a.shape[1:])


def resized(a: np.ndarray, height: int, width: int, kind: str) -> np.ndarray:
    """An 8-bit picture (rows, columns, perhaps channels) in another size."""
    if width != a.shape[1]:
        a = np.swapaxes(_along(np.swapaxes(a, 0, 1), width, kind), 0, 1)
    if height != a.shape[0]:
        a = _along(a, height, kind)
    return a


def box_radius(radius: float, passes: int = 3) -> float:
    """The radius, with a fraction, of boxes that together have the variance of a Gaussian."""
    variance = radius * radius / passes
    whole = floor((sqrt(12 * variance + 1) - 1) / 2)
    part = (2 * whole + 1) * (whole * (whole + 1) - 3 * variance) / (6 * (variance - (whole + 1) ** 2))
    return whole + part


def _boxed(a: np.ndarray, radius: float) -> np.ndarray:
    """One box along the first axis."""
    whole = int(radius)
    weight = int((1 << BOX_BITS) / (radius * 2 + 1))
    outer = ((1 << BOX_BITS) - (whole * 2 + 1) * weight) // 2
    wide = np.concatenate([np.repeat(a[:1], whole + 1, 0), a, np.repeat(a[-1:], whole + 1, 0)]).astype(np.int64)
    n = len(a)
    inner = sum(wide[1 + j : 1 + j + n] for j in range(2 * whole + 1))
    total = inner * weight + (wide[:n] + wide[2 * whole + 2 : 2 * whole + 2 + n]) * outer
    return ((total + (1 << (BOX_BITS - 1))) >> BOX_BITS).astype(np.uint8)


def gaussian_blur(a: np.ndarray, radius: float, passes: int = 3) -> np.ndarray:
    """An 8-bit picture, blurred along its columns' axis first and then along the other."""
    box = box_radius(radius, passes)
    a = np.swapaxes(a, 0, 1)
    for _ in range(passes):
        a = _boxed(a, box)
    a = np.swapaxes(a, 0, 1)
    for _ in range(passes):
        a = _boxed(a, box)
    return a


def halved(a: np.ndarray) -> np.ndarray:
    return resized(a, max(1, a.shape[0] // 2), max(1, a.shape[1] // 2), "bicubic")
