"""Resampling against plain loops written out for each pixel, and what a table by hand gives."""

import math

import numpy as np
import pytest

from lumensift.functions import resample
from lumensift.operators import pixels


def _lanczos(x):
    if x == 0:
        return 1.0
    return 3 * math.sin(math.pi * x) * math.sin(math.pi * x / 3) / (math.pi * math.pi * x * x) if abs(x) < 3 else 0.0


def _bicubic(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def _line(values, target, f, support):
    scale = len(values) / target
    wide = max(scale, 1.0)
    out = []
    for i in range(target):
        c = (i + 0.5) * scale
        js = range(max(0, int(c - support * wide + 0.5)), min(len(values), int(c + support * wide + 0.5)))
        w = [f((j - c + 0.5) / wide) for j in js]
        whole = [int(x / sum(w) * 2**22 + (0.5 if x / sum(w) >= 0 else -0.5)) for x in w]
        out.append(max(0, min(255, (sum(k * int(values[j]) for k, j in zip(whole, js)) + 2**21) >> 22)))
    return out


def _plain(a, height, width, f, support):
    rows = [_line(r, width, f, support) if width != a.shape[1] else list(r) for r in a.tolist()]
    columns = [_line(c, height, f, support) if height != a.shape[0] else list(c) for c in zip(*rows)]
    return np.array(list(zip(*columns)))


@pytest.mark.parametrize("shape,size", [((13, 9), (8, 8)), ((40, 57), (8, 8)), ((5, 6), (8, 8)), ((31, 20), (15, 10)), ((8, 8), (8, 8)), ((7, 7), (1, 1)), ((1, 1), (8, 8)), ((3, 200), (96, 96))])
@pytest.mark.parametrize("kind", ["lanczos", "bicubic"])
def test_kernels(shape, size, kind):
    f, support = (_lanczos, 3.0) if kind == "lanczos" else (_bicubic, 2.0)
    a = np.random.default_rng(sum(shape)).integers(0, 256, shape, dtype=np.uint8)
    assert (resample.resized(a, *size, kind) == _plain(a, *size, f, support)).all()
    colours = np.stack([a, 255 - a, a // 2], axis=2)
    got = resample.resized(colours, *size, kind)
    assert all((got[:, :, i] == resample.resized(colours[:, :, i], *size, kind)).all() for i in range(3))


def test_weights_by_hand():
    """Halving with the cubic kernel: 8 weights in quarters of a pixel, -0.0107 -0.0410 0.0596 ... of the sum 2."""
    first, w = resample.windows(16, 8, "bicubic")[3]
    x = [abs(j + 0.5 - 4) / 2 for j in range(8)]
    want = [1.5 * t**3 - 2.5 * t**2 + 1 if t < 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 for t in x]
    assert first == 3 and np.abs(w / 2**22 - np.array(want) / sum(want)).max() < 1e-6 and w.sum() in range(2**22 - 4, 2**22 + 5)
    assert (resample.resized(np.full((50, 30), 77, np.uint8), 8, 8, "lanczos") == 77).all()


def _blurred(values, radius):
    whole = int(radius)
    inner = int(2**24 / (radius * 2 + 1))
    outer = (2**24 - (2 * whole + 1) * inner) // 2
    at = lambda i: int(values[max(0, min(len(values) - 1, i))])
    return [(sum(at(i + d) for d in range(-whole, whole + 1)) * inner + (at(i - whole - 1) + at(i + whole + 1)) * outer + 2**23) >> 24 for i in range(len(values))]


@pytest.mark.parametrize("shape", [(9, 14), (2, 3), (1, 1), (30, 4)])
def test_gaussian_blur(shape):
    a = np.random.default_rng(5).integers(0, 256, shape, dtype=np.uint8)
    box = resample.box_radius(1.2)
    rows = a.tolist()
    for _ in range(3):
        rows = [_blurred(r, box) for r in rows]
    columns = [list(c) for c in zip(*rows)]
    for _ in range(3):
        columns = [_blurred(c, box) for c in columns]
    assert (resample.gaussian_blur(a, 1.2) == np.array(columns).T).all()
    # the variances of three boxes, with their fractions, add up to that of the Gaussian
    whole, part = int(box), box - int(box)
    size = 2 * box + 1
    variance = (sum(2 * d * d for d in range(1, whole + 1)) + 2 * part * (whole + 1) ** 2) / size
    assert 3 * variance == pytest.approx(1.44, abs=1e-9)


def test_hashes_and_noise():
    g = np.zeros((64, 64), np.uint8)
    g[:, 32:] = 200
    assert f"{pixels.hash_bits(resample.resized(g, 8, 8, 'lanczos'), True) & (1 << 64) - 1:064b}" == "00001111" * 8
    assert pixels.hash_bits(np.full((8, 8), 9), True) == -1 and pixels.hash_bits(np.full((8, 8), 9), False) == 0
    assert pixels.noise(np.full((20, 20), 9, np.uint8)) == 0 and pixels.noise(np.random.default_rng(1).integers(0, 256, (40, 40), dtype=np.uint8)) > 20


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (1, 9), (96, 30), (224, 224), (225, 10)])
def test_area_moments(shape):
    a = np.random.default_rng(3).integers(0, 256, (*shape, 3, 4), dtype=np.uint8)
    a[..., 3] = 77
    mean, deviation = pixels.area_moments(a, 224)
    net = pixels.area_resize(a, 224, 224)
    assert np.abs(mean - net.mean(axis=(0, 1))).max() < 1e-9 and np.abs(deviation - net.std(axis=(0, 1))).max() < 1e-9


def test_pictures_of_one_size_together(monkeypatch):
    """Kernels pass once over all pictures of a size, bad pictures between them cost none of these, and rows stay in order."""
    random = np.random.default_rng(4)
    sizes = [(8, 8, 1), (5, 7, 3), (5, 7, 4)] * 20
    rows = [(random.integers(0, 256, s, dtype=np.uint8).tobytes(), *s) for s in sizes]
    rows[5:5] = [(b"short", 8, 8, 1), (None, 5, 7, 3), (b"", 0, 8, 1), (b"", 0, 8, 1)]
    calls = []
    monkeypatch.setattr(pixels, "PIXELS", 1 << 20)
    monkeypatch.setattr(pixels, "resized", lambda *a: calls.append(a[0].shape) or resample.resized(*a))
    got = pixels._all_features(rows)
    assert len([c for c in calls if c[0]]) == 2 * 3  # three kernels for each of two sizes, those of 5 x 7 with or without alpha
    monkeypatch.undo()
    assert [x["error"] is None for x in got] == [True] * 5 + [False] * 4 + [True] * 55
    for row, x in zip(rows, got):
        if x["error"] is None:
            alone = pixels.image_features(*row)
            assert all(x[c] == (pytest.approx(alone[c], abs=1e-9) if c.startswith("rgb") else alone[c]) for c in alone)
