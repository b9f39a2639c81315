"""Whole-batch tokenising and hashing with numpy, shared by the Arrow operators.

A batch of texts becomes one byte buffer with a separator byte before, between
and after the texts; words are byte ranges in it. Every routine covers whole
texts. Batches are cut to about ``CHUNK_BYTES`` of text (one text at least), so
memory stays bounded whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK_BYTES = 2 << 20

#: Bytes of one Arrow batch of texts. Spark's own limit is 64 MB, which both sides of a Python worker hold, doubled while it grows.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space: 0x20 and 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: bytes.translate table: A-Z to a-z.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

#: A-Z to a-z, and every ASCII byte that is no letter or digit to a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else (b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32) for b in range(256))

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)

#: Null ids travel as this key, which no table is expected to hold.
NO_ID = (1 << 63) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    data: np.ndarray  # uint8, with separators
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    offsets: np.ndarray  # word range of text i: offsets[i] to offsets[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def words_of(texts: list[bytes], separators: np.ndarray = WHITE) -> Words:
    """The words of each text: longest runs of bytes that are no separators."""
    buf = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(buf, np.uint8)
    inside = ~separators[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + 1, out=at[1:])
    return Words(data, starts, ends, np.searchsorted(starts, at))


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    n = len(w.starts)
    if not n:
        return np.zeros(0, np.uint64)
    lens = w.ends - w.starts
    power = np.empty(int(lens.max()), np.uint64)
    power[0] = 1
    if len(power) > 1:
        power[1:] = _BASE
        np.multiply.accumulate(power, out=power)
    total = int(lens.sum())
    first = np.cumsum(lens) - lens
    within = np.arange(total) - np.repeat(first, lens)
    letters = w.data[np.repeat(w.starts, lens) + within]
    return mix(np.add.reduceat(_BYTE[letters] * power[within], first) + lens.astype(np.uint64))


def gram_hashes(h: np.ndarray, n: int, salt: int = 0x2545F491) -> np.ndarray:
    """A hash of each run of n words, by its first word; runs may cross texts."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = np.uint64((salt * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    m = len(h) - n + 1
    acc = mix(h[:m] ^ np.uint64(salt))
    for j in range(1, n):
        acc = acc * base + mix(h[j : j + m] ^ np.uint64(salt))
    return mix(acc)


def whole_grams(w: Words, n: int) -> np.ndarray:
    """Indices of words that start a run of n words inside one text."""
    if len(w.starts) < n:
        return np.zeros(0, np.int64)
    left = np.repeat(w.offsets[1:], w.counts()) - np.arange(len(w.starts))
    return np.flatnonzero(left >= n)


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are no larger than BATCH_BYTES."""
    now = df.sparkSession.conf.get(BATCH_SETTING)
    if int(now.rstrip("b") if now.rstrip("b").isdigit() else -1) > BATCH_BYTES:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about CHUNK_BYTES of text, and their texts as bytes."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        begin = size = 0
        for i, v in enumerate(values):
            size += len(v or b"")
            if size >= CHUNK_BYTES:
                yield batch.slice(begin, i + 1 - begin), values[begin : i + 1]
                begin, size = i + 1, 0
        if begin < len(values):
            yield batch.slice(begin), values[begin:]


def covered(n: int, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in any range."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + lengths, n), -1)
    return np.cumsum(d[:n]) > 0
